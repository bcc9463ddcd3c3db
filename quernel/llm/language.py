"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (n from 1 to 3, words padded by one space) in order of
frequency. A text's own most frequent n-grams, counted over the whole text, are compared with every profile by the
out-of-place distance: the sum of rank differences, an n-gram that the profile lacks counting PROFILE places.

Profiles are learned from texts with a non-null language outside the held-out fold, from at most
`max_per_language` of them a language (the bounded, documented sample: those whose doc_id hashes smallest).

Defined cases: a null text, or one without letters, is `und` with score 0, as is every text where no profile
could be learned; equal counts rank by n-gram, equal distances go to the language that sorts first; a null doc_id
is not held out and not learned from; repeated rows get the same answer.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

PROFILE = 400
DOCUMENT_GRAMS = 300
MAX_PER_LANGUAGE = 800
HELD_OUT = 2

#: Characters of a text whose n-grams are counted at once.
SLICE = 1 << 20

_SPACE = 32
_BLANK = re.compile(r"\s")


def _letters() -> np.ndarray:
    """For each code point of the basic plane: itself if it is a letter, else a space."""
    return np.array([i if chr(i).isalpha() else _SPACE for i in range(0x10000)], np.int64)


def slices(text: str, most: int) -> Iterator[str]:
    """Parts of a text of about most characters, each cut before white space, where no n-gram has more than its edge."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + most)
        stop = blank.start() if blank else len(text)
        yield text[at:stop]
        at = stop


def grams(text: str, letters: np.ndarray, most: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as packed integers, and their counts; none if it has no letter. A long text is counted
    slice by slice, so that what is held besides it doesn't grow with it."""
    if len(text) <= most:
        return _grams(text, letters)
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in slices(text, most):
        own, n = _grams(part, letters)
        found, place = np.unique(np.concatenate((found, own)), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, np.concatenate((counts, n)))
        counts = total
    return found, counts


def _grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = points >= len(letters)
    base = letters[np.where(wide, 0, points)]
    points = np.where(_alpha(points, wide), points, base) if wide.any() else base
    x = np.concatenate(([_SPACE], points, [_SPACE]))
    blank = x == _SPACE
    x = x[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = x == _SPACE
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    packed = np.concatenate((x[~gap], two, three[~gap[1:-1]]))
    packed.sort()
    at = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    return packed[at], np.diff(np.concatenate((at, [len(packed)])))


def _alpha(points: np.ndarray, wide: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), bool)
    out[wide] = [chr(p).isalpha() for p in points[wide]]
    return out


def top(found: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order of rank; equal counts by n-gram."""
    if len(found) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = counts >= least
        found, counts = found[some], counts[some]
    return found[np.lexsort((found, -counts))][:most]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = _letters()
    total: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            own = total[lang]
            for g, n in zip(*(x.tolist() for x in grams(text, letters)), strict=True):
                own[g] += n
    for lang, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, max_per_language: int = MAX_PER_LANGUAGE) -> dict[str, list[int]]:
    """Profiles of PROFILE n-grams a language; the number of languages bounds what reaches the driver."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return {}
    # an even threshold on a hash leaves about max_per_language rows of each language, without a sort of its rows
    share = F.create_map(*[F.lit(v) for lang, n in totals.items() for v in (lang, min(1.0, max_per_language / n))])
    drawn = F.pmod(F.xxhash64(F.lit("language-sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counted = rows.filter(drawn < share[F.col("lang")]).select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    ranked = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = defaultdict(list)
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles[r["lang"]].append(r["gram"])
    return dict(profiles)


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """lang_pred and score (1 less the distance as a part of the greatest possible) of every whole text."""
    names = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        known = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        places = np.full((len(names), len(known) + 1), -1, np.int64)
        for i, name in enumerate(names):
            places[i, np.searchsorted(known, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))
        for batch in batches:
            said, score = [], []
            for text in batch.column(text_column).to_pylist():
                own = top(*grams(text, letters), DOCUMENT_GRAMS) if text and names else ()
                if not len(own):
                    said.append("und")
                    score.append(0.0)
                    continue
                at = np.searchsorted(known, own)
                at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
                rank = places[:, at]
                away = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(own)))).sum(axis=1)
                best = int(away.argmin())
                said.append(names[best])
                score.append(1 - float(away[best]) / (PROFILE * len(own)))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), batch.column("held_out"), pa.array(said, pa.string()), pa.array(score, pa.float64())], [id_column, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column, held_out(id_column).alias("held_out")).mapInArrow(run, f"{id_column} {kind}, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return predict(docs, learn(docs.select("doc_id", "text", "lang")))
