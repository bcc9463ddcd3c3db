"""Removal of repeated passages by super-k-mer partitioning.

A window is WINDOW consecutive words of a text, its minimiser the least hash of its MINIMISER-word runs. Consecutive
windows with one minimiser form a super-k-mer, which travels as one packed string; equal windows always meet under the
same minimiser.

1. Equal packed strings are pre-aggregated before any of them travels, known by 128 bits of their SHA-256: each keeps
   its least doc_id, and later documents that have it are covered there whole. No shorter hash decides anything: those
   of words only pick minimisers.
2. The distinct strings of a minimiser that has several travel once, from the least document that has each, to the
   minimiser's bucket, where sorting the windows brings equal ones together, compared word by word, and gives each its
   least doc_id.
3. A minimiser of more than CROWD strings would fill one task, so its bucket is split by the windows' own SHA-256: its
   strings are cut into windows where they are, and the windows are counted by digest, map-side first. Both ways give
   the same windows the same least doc_id.

Covered words are kept by row (doc_id and text), so rows of one doc_id with different texts don't mix.

Defined cases: a null text has no words; a null doc_id is neither smaller nor larger than another, so its text stays
whole and removes nothing; windows repeated within one doc_id, in one row or several, stay; an empty table gives none;
doc_id may be of any type that Spark orders as Python does (numbers, strings, dates).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
MINIMISER = 8
CROWD = 512
#: Copies of a string or window, or strings of a minimiser, above which the key is sent to its rows instead of the rows to it.
HOT = 1000
#: Windows of one super-k-mer at most; a longer run of one minimiser (a periodic text) is cut here.
LONGEST = 512


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def super_kmers(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the word hashes of texts: minimiser, text number, first word (within the chunk), number of windows."""
    none = np.zeros(0, np.int64)
    if len(hashes) < WINDOW:
        return none.astype(np.uint64), none, none, none
    least = _sliding_min(C.gram_hashes(hashes, MINIMISER), WINDOW - MINIMISER + 1)
    ok = np.flatnonzero(C.inside(first, WINDOW, len(hashes)))
    if not len(ok):
        return none.astype(np.uint64), none, none, none
    doc = np.searchsorted(first, ok, side="right") - 1
    new = np.ones(len(ok), bool)
    new[1:] = (least[ok[1:]] != least[ok[:-1]]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((starts, [len(ok)])))
    if len(sizes) and sizes.max() > LONGEST:
        cut = np.concatenate([np.arange(s, s + n, LONGEST) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        starts, sizes = cut, np.diff(np.concatenate((cut, [len(ok)])))
    at = ok[starts]
    return least[at], doc[starts], at, sizes


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of the SHA-256 of each stretch of raw, as two longs."""
    sha = hashlib.sha256
    return np.frombuffer(b"".join([sha(raw[a:b]).digest()[:16] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)


class Strings:
    """The super-k-mers of a batch of texts, as stretches of the bytes with single spaces."""

    def __init__(self, batch: pa.RecordBatch, powers: C.Powers) -> None:
        data, offsets = C.utf8(batch.column("text"))
        starts, ends, self.first = C.word_spans(data, offsets)
        self.mini, self.doc, self.at, self.n = super_kmers(C.word_hashes(data, starts, ends, powers), self.first)
        self.raw, place = C.squeezed(data) if len(data) else (b"", np.zeros(1, np.int64))
        self.a, self.b = place[starts[self.at]], place[ends[self.at + self.n + WINDOW - 2]]
        self.digest = digests(self.raw, self.a, self.b)

    def start(self) -> np.ndarray:
        """First words, counted within their texts."""
        return self.at - self.first[self.doc]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = C.Powers()
    for batch in C.chunks(batches):
        s = Strings(batch, powers)
        rows = pa.array(s.doc)
        yield pa.RecordBatch.from_arrays([pa.array(s.mini.view(np.int64)), pa.array(np.ascontiguousarray(s.digest[:, 0])), pa.array(np.ascontiguousarray(s.digest[:, 1])), batch.column("doc").take(rows), batch.column("row").take(rows), pa.array(s.start().astype(np.int32)), pa.array(s.n.astype(np.int32))], ["mini", "d1", "d2", "doc", "row", "start", "n"])


def _packed(batches: Iterator[pa.RecordBatch], doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of texts with the super-k-mers wanted from them: each packed string with its places in the text."""
    powers = C.Powers()
    for batch in C.chunks(batches):
        s = Strings(batch, powers)
        ids, of_row, wanted = (batch.column(c).to_pylist() for c in ("doc", "row", "wanted"))
        bounds = np.searchsorted(s.doc, np.arange(batch.num_rows + 1))
        d1, d2, start = s.digest[:, 0], s.digest[:, 1], s.start()
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for d in range(batch.num_rows):
            places: dict[tuple[int, int], list[int]] = {}
            a, b = bounds[d], bounds[d + 1]
            for key, place in zip(zip(d1[a:b].tolist(), d2[a:b].tolist(), strict=True), range(a, b), strict=True):
                places.setdefault(key, []).append(place)
            for w in wanted[d]:
                found = places.get((w["d1"], w["d2"]))
                if found:
                    k = found[0]
                    for column, value in zip(out, (w["mini"], w["crowd"], ids[d], of_row[d], s.raw[s.a[k] : s.b[k]], [int(start[x]) for x in found], int(s.n[k])), strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.bool_(), doc_type, pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["mini", "crowd", "doc", "row", "packed", "starts", "n"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("mini", "doc", "row", "packed", "starts", "n")), strict=True)


def _ranges(flags: list[bool]) -> Iterator[tuple[int, int]]:
    at = 0
    for flag, run in groupby(flags):
        n = len(list(run))
        if flag:
            yield at, at + n
        at += n


def _span_batch(out: list, doc_type: pa.DataType) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (doc_type, pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "row", "a", "b"])


def _count_buckets(batches: Iterator[pa.RecordBatch], doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimiser: sorts the windows of each and covers those that a smaller doc_id has."""
    out: list = []
    for _, rows in groupby(_rows(batches), key=lambda r: r[0]):
        own = list(rows)
        if len({r[1] for r in own}) > 1:
            windows = []
            for i, (_, doc, _, packed, _, n) in enumerate(own):
                gaps = [-1, *(k for k, c in enumerate(packed) if c == 32), len(packed)]
                windows += [(packed[gaps[k] + 1 : gaps[k + WINDOW]], doc, i, k) for k in range(n)]
            windows.sort()
            covered = [[False] * r[5] for r in own]
            for _, same in groupby(windows, key=lambda w: w[0]):
                least = None
                for _, doc, i, k in same:
                    least = doc if least is None else least
                    covered[i][k] = doc > least
            for (_, doc, row, _, starts, _), flags in zip(own, covered, strict=True):
                out += [(doc, row, s + a, s + b + WINDOW - 1) for a, b in _ranges(flags) for s in starts]
        if len(out) > 50_000:
            yield _span_batch(out, doc_type)
            out = []
    yield _span_batch(out, doc_type)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of packed strings by digest."""
    for batch in C.chunks(batches, "words"):
        data, offsets = C.utf8(batch.column("words"))
        starts, ends, first = C.word_spans(data, offsets)
        n = batch.column("n").to_numpy().astype(np.int64)
        k = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        at = np.repeat(first[:-1], n) + k
        d = digests(data.tobytes(), starts[at], ends[at + WINDOW - 1])
        rows = pa.array(np.repeat(np.arange(batch.num_rows), n))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), *(batch.column(c).take(rows) for c in ("doc", "row", "starts")), pa.array(k.astype(np.int32))], ["w1", "w2", "doc", "row", "starts", "k"])


def covered_spans(docs: DataFrame, id_column: str = "doc_id") -> dict[str, DataFrame]:
    """doc, row, a, b by step: the words from a to b (exclusive) of that row are covered by repeated windows.

    docs has the id, the text and `row`, a long that tells the rows of one id apart.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema[id_column].dataType
    kind, doc_type = field.simpleString(), to_arrow_type(field)
    span = f"doc {kind}, row long, a int, b int"
    named = docs.filter(F.col(f"`{id_column}`").isNotNull() & F.col("text").isNotNull()).select(F.col(f"`{id_column}`").alias("doc"), "row", "text")
    found = C.written(named.mapInArrow(_occurrences, f"mini long, d1 long, d2 long, doc {kind}, row long, start int, n int"))
    kinds = C.written(found.groupBy("mini", "d1", "d2").agg(F.min("doc").alias("least"), F.max("doc").alias("last"), F.count("*").alias("times")))
    # 1: later copies of a string, whole
    shared = kinds.filter("least < last").select(F.col("d1").alias("g1"), F.col("d2").alias("g2"), "least", "times")
    later = C.uneven_join(found, shared, (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2")), F.col("times"), HOT).filter("doc > least")
    whole = later.select("doc", "row", F.col("start").alias("a"), (F.col("start") + F.col("n") + WINDOW - 1).alias("b"))
    # 2: minimisers with several strings in several documents
    several = kinds.groupBy("mini").agg(F.count("*").alias("kinds"), F.min("least").alias("lo"), F.max("last").alias("hi")).filter("kinds > 1 and lo < hi")
    several = C.written(several.select(F.col("mini").alias("m"), (F.col("kinds") > CROWD).alias("crowd"), F.col("kinds").alias("strings")))
    wanted = C.uneven_join(kinds, several, F.col("mini") == F.col("m"), F.col("strings"), HOT).groupBy(F.col("least").alias("id")).agg(F.collect_list(F.struct("mini", "d1", "d2", "crowd")).alias("wanted"))
    strings = C.written(named.join(wanted, F.col("doc") == F.col("id")).select("doc", "row", "text", "wanted").mapInArrow(lambda b: _packed(b, doc_type), f"mini long, crowd boolean, doc {kind}, row long, packed binary, starts array<int>, n int"))
    buckets = strings.filter("not crowd").select("mini", "doc", "row", "packed", "starts", "n").repartition("mini").sortWithinPartitions("mini")
    in_buckets = buckets.mapInArrow(lambda b: _count_buckets(b, doc_type), span)
    # 3: crowded minimisers
    windows = strings.filter("crowd").select("doc", "row", F.col("packed").cast("string").alias("words"), "starts", "n").mapInArrow(_windows, f"w1 long, w2 long, doc {kind}, row long, starts array<int>, k int")
    least = windows.groupBy("w1", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("copies")).filter("lo < hi")
    least = C.written(least.select(F.col("w1").alias("x1"), F.col("w2").alias("x2"), "lo", "copies"))
    repeated = C.uneven_join(windows, least, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2")), F.col("copies"), HOT).filter("doc > lo").select("doc", "row", "k", F.explode("starts").alias("s"))
    in_crowds = repeated.select("doc", "row", (F.col("s") + F.col("k")).alias("a"), (F.col("s") + F.col("k") + WINDOW).alias("b"))
    return {"whole strings": whole, "buckets": in_buckets, "crowds": in_crowds}


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        data, offsets = C.utf8(batch.column("text"))
        starts, ends, first = C.word_spans(data, offsets)
        raw, spans = data.tobytes(), batch.column("spans").to_pylist()
        removed, kept = [], []
        for d in range(batch.num_rows):
            s, e = starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]]
            if spans[d]:
                depth = np.zeros(len(s) + 1, np.int64)
                np.add.at(depth, [x["a"] for x in spans[d]], 1)
                np.add.at(depth, [x["b"] for x in spans[d]], -1)
                stay = np.cumsum(depth)[:-1] == 0
                removed.append(int(len(s) - stay.sum()))
                s, e = s[stay], e[stay]
            else:
                removed.append(0)
            kept.append(b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every document."""
    ids = docs.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("m")).first()
    # rows of one id are told apart by their texts; where no id stands twice, there is nothing to tell apart
    rows = docs.select("doc_id", (F.xxhash64("text") if ids["n"] > ids["m"] else F.lit(0).cast("long")).alias("row"), "text")
    steps = list(covered_spans(rows).values())
    spans = steps[0].union(steps[1]).union(steps[2]).groupBy("doc", F.col("row").alias("r")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    both = rows.join(spans, (F.col("doc_id") == F.col("doc")) & (F.col("row") == F.col("r")), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_strip, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, k, sha256(array_to_string(words[k:k + {WINDOW - 1}], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS k FROM split)),
least AS (SELECT w, min(doc_id) AS lo FROM windows GROUP BY w),
hit AS (SELECT DISTINCT doc_id, unnest(range(k, k + {WINDOW})) AS place FROM windows JOIN least USING (w) WHERE doc_id > lo),
gone AS (SELECT doc_id, list(place) AS places, count(*) AS n FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN n IS NULL THEN array_to_string(words, ' ') ELSE array_to_string([words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(places, i)], ' ') END, '')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id)
"""
