"""Source divergence audit: how far apart the vocabularies of a language's sources are, and by which terms.

Each term that enough documents of its language hold becomes one wide vector over the language's sources, of counts and of
smoothed shares in thousand-millionths. Higher-order functions emit, for each source that has the term, its pairs with the
sources that haven't and with those after it; the two shares give f = floor((p - q)^2 / (p + q)), and partial sums leave
each task, a row a pair. Where neither source has a term, f depends on the pair only and is added once, times the number
of such terms, so the work grows with the sources that terms occur in, not with all pairs of sources for each term.

All arithmetic is in whole numbers, and exact for up to 9 * 10^15 occurrences of terms in a language.

Defined cases: null text, lang and source are empty strings; a group without terms has shares by smoothing alone; a
language that keeps no term has pairs of value 0 and no terms; ties rank by item in byte order; each row is a document,
repeated or not; extra columns are left out; an empty table gives no rows. A text beyond SLICE_BYTES is counted in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: A language keeps the terms of at least so many of its documents.
LEAST_DOCUMENTS = 10
#: Terms that are reported of each source.
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Bytes of text that are counted at once.
SLICE_BYTES = 8 << 20
#: A language's sources travel to its terms by broadcast up to so many sources in all, else in SALTS copies by shuffle.
BROADCAST_SOURCES = 100_000
SALTS = 256

#: Terms consist of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of the texts, and for each text and term of it: the text's number, the term's, the occurrences."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = C.word_spans(data, offsets, _NO_TERM)
    words = C.word_array(data, starts, ends).dictionary_encode()
    width = max(1, len(words.dictionary))
    key = np.repeat(np.arange(len(offsets) - 1), np.diff(first)) * width + words.indices.to_numpy(zero_copy_only=False)
    key, n = np.unique(key, return_counts=True)
    return words.dictionary, key // width, key % width, n


def _long_text(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """What _terms gives, for one text, slice by slice."""
    total = None
    for part in C.slices(data, _NO_TERM, SLICE_BYTES):
        terms, _, code, n = _terms(part, np.array([0, len(part)]))
        own = pa.table({"term": terms.take(pa.array(code)), "n": pa.array(n, pa.int64())})
        total = own if total is None else pa.concat_tables([total, own]).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
    terms = total["term"].combine_chunks()
    return terms, np.zeros(len(terms), np.int64), np.arange(len(terms)), total["n"].to_numpy()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches, most=SLICE_BYTES):
        data, offsets = C.utf8(batch.column("text"))
        terms, doc, code, n = _long_text(data) if len(data) > SLICE_BYTES else _terms(data, offsets)
        if not len(doc):
            continue
        groups: dict[tuple[str, str], int] = {}
        of = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)])
        key, place, docs = np.unique(of[doc] * len(terms) + code, return_inverse=True, return_counts=True)
        names, group = list(groups), pa.array(key // len(terms))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g in names], pa.string()).take(group),
                pa.array([g[1] for g in names], pa.string()).take(group),
                terms.take(pa.array(key % len(terms))).cast(pa.string()),
                pa.array(np.bincount(place, n).astype(np.int64)),
                pa.array(docs.astype(np.int64)),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences n of each term in each lang and source, and the documents docs that hold it."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def wide_vectors(counts: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """A row a kept term of a language: its occurrences in all, and those by source; at most one entry a source."""
    entry = F.struct("source", "n")
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(entry)).alias("counts")).filter(F.col("docs") >= least_documents).drop("docs")


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total) by long division in thousands, so that no step leaves 64 bits."""
    whole, rest = _div(count + 2, total), (count + 2) % total
    for _ in range(3):
        whole, rest = whole * 1000 + _div(rest * 1000, total), rest * 1000 % total
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def sources_of(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row a language: its kept terms v, all their occurrences n_all, and its sources in byte order.

    Each source has its name, the denominator of its shares and the share p0 of a term that it lacks.
    """
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = vectors.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_all"))
    each = found.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("found"))
    of = each.join(kept, "lang", "left").select("lang", "found", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_all", F.lit(0)).alias("n_all"))
    with_total = F.transform("found", lambda g: F.struct(g["source"].alias("source"), F.nullif(g["n"] + 2 * F.col("v"), F.lit(0)).alias("total")))
    with_share = F.transform(with_total, lambda g: F.struct(g["source"].alias("source"), g["total"].alias("total"), share(F.lit(0), g["total"]).alias("p0")))
    return of.select("lang", "v", "n_all", with_share.alias("sources"))


def dense(vectors: DataFrame, languages: DataFrame) -> DataFrame:
    """Each kept term with a vector over its language's sources: count c and share p, and the language's share q."""
    n = languages.agg(F.sum(F.size("sources"))).first()[0] or 0
    if n <= BROADCAST_SOURCES:
        both = vectors.join(F.broadcast(languages), "lang")
    else:
        salted = languages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = vectors.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), ["lang", "salt"]).drop("salt")
    counted = F.transform("sources", lambda g: F.struct(F.coalesce(F.element_at("counts", g["source"]), F.lit(0)).alias("c"), g["total"].alias("total")))
    vector = F.transform(counted, lambda x: F.struct(x["c"].alias("c"), share(x["c"], x["total"]).alias("p")))
    return both.select("lang", "term", "sources", vector.alias("vector"), share(F.col("n"), F.col("n_all") + 2 * F.col("v")).alias("q"))


def pair_sums(terms: DataFrame) -> DataFrame:
    """For places a < b of sources of a language, f summed over the terms that either has, and their number."""
    places = F.sequence(F.lit(0), F.size("vector") - 1)
    of_a = terms.select("lang", "vector", F.posexplode("vector").alias("a", "own")).filter(F.col("own.c") > 0)
    others = F.filter(places, lambda b: (b > F.col("a")) | (F.get("vector", b)["c"] == 0))
    emitted = F.transform(others, lambda b: F.struct(b.alias("b"), F.get("vector", b)["p"].alias("p")))
    pairs = of_a.select("lang", "a", F.col("own.p").alias("p"), F.explode(emitted).alias("other"))
    value = distance(F.col("p"), F.col("other.p"))
    return pairs.groupBy("lang", F.least("a", "other.b").alias("a"), F.greatest("a", "other.b").alias("b")).agg(F.sum(value).alias("f"), F.count("*").alias("terms"))


def pair_divergence(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """Each source of a language with each other: f summed over all kept terms, ranked."""
    numbered = F.transform("sources", lambda g, b: F.struct(b.alias("b"), g["source"].alias("source"), g["p0"].alias("p0")))
    later = F.filter(numbered, lambda x: x["b"] > F.col("a"))
    skeleton = languages.select("lang", "v", "sources", F.posexplode("sources").alias("a", "one")).select("lang", "v", "a", "one", F.explode(later).alias("two"))
    sums = pair_sums(terms).withColumnsRenamed({"a": "at_a", "b": "at_b", "lang": "of"})
    joined = skeleton.join(sums, (F.col("lang") == F.col("of")) & (F.col("a") == F.col("at_a")) & (F.col("two.b") == F.col("at_b")), "left")
    absent = F.col("v") - F.coalesce("terms", F.lit(0))
    value = F.coalesce("f", F.lit(0)) + F.coalesce(absent * distance(F.col("one.p0"), F.col("two.p0")), F.lit(0))
    both = F.array(F.struct(F.col("one.source").alias("source"), F.col("two.source").alias("item")), F.struct(F.col("two.source").alias("source"), F.col("one.source").alias("item")))
    rows = joined.select("lang", value.alias("value"), F.explode(both).alias("pair")).select("lang", "pair.source", F.lit("pair").alias("part"), "pair.item", "value")
    return rows.withColumn("rank", F.row_number().over(_order()))


def term_divergence(terms: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """The terms that each source has more of than its language, by f, the first of them only."""
    zipped = F.arrays_zip(F.col("sources.source").alias("source"), F.col("vector.c").alias("c"), F.col("vector.p").alias("p"))
    over = F.filter(zipped, lambda x: (x["c"] > 0) & (x["p"] > F.col("q")))
    rows = terms.select("lang", "term", "q", F.explode(over).alias("own"))
    rows = rows.select("lang", "own.source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("own.p"), F.col("q")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") <= most)


def _order() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    vectors = C.written(wide_vectors(term_counts(docs), least_documents))
    languages = C.written(sources_of(docs, vectors))
    terms = dense(vectors, languages)
    return pair_divergence(terms, languages).unionByName(term_divergence(terms, top_terms))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), w AS (
  SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item FROM d
), counted AS (
  SELECT lang, source, item, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL
), kept AS (
  SELECT lang, item, sum(n) AS n_lang FROM counted GROUP BY ALL HAVING sum(df) >= 10
), own AS (
  SELECT c.lang, c.source, c.item, c.n FROM counted c JOIN kept k ON c.lang = k.lang AND c.item = k.item
), sizes AS (
  SELECT lang, count(*) AS v, sum(n_lang) AS n_all FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(own.n), 0) AS n_own
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
  GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.item, coalesce(own.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 2)) // (g.n_own + 2 * s.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n_lang + 2)::HUGEINT) // (s.n_all + 2 * s.v)::HUGEINT AS q
  FROM groups g JOIN sizes s ON s.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.item = k.item
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
