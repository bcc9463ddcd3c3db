"""Lexical and dense scoring of passages, and the fusion of their ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ranking import ranked


def _times(low: Column, term: str) -> Column:
    """How often a token stands in a lower-cased text, without a list of its tokens."""
    alone = f"{term}(?![a-z0-9])(?<![a-z0-9]{term})" if re.fullmatch("[a-z0-9]+", term) else re.escape(term)
    return F.regexp_count(low, F.lit(alone))


def bm25(chunks: DataFrame, terms: list[str], group: str, text: str, into: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """chunks with a BM25 score against the terms (repeated terms count again), rounded to 6 digits."""
    return bm25_many(chunks, {into: terms}, group, text, k1, b)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if their few files would keep only some of them busy; a large table is left as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def bm25_many(chunks: DataFrame, queries: dict[str, list[str]], group: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """chunks without their text, with a BM25 score of each query under its name; queries share one count of terms.

    N, document frequencies and the mean length are those of the chunk's group. Frequencies of the few query terms
    are counted within each row, so only a row per group is shuffled. Join groups by size: a row each.
    """
    distinct = sorted({term for terms in queries.values() for term in terms})
    scored = spread(chunks).withColumn("__low", F.lower(F.coalesce(text, F.lit(""))))
    scored = scored.withColumns({"__len": F.regexp_count("__low", F.lit(X.TOKEN))} | {f"__f{k}": _times(F.col("__low"), term) for k, term in enumerate(distinct)}).drop("__low", text)
    # both the statistics and the scores read these counts: kept, so that every text is tokenised once
    scored = scored.persist()
    stats = scored.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *[F.sum((F.col(f"__f{k}") > 0).cast("int")).alias(f"__d{k}") for k in range(len(distinct))])
    both = scored.join(stats, F.col(group).eqNullSafe(F.col("__g")))
    norm = k1 * ((1 - b) + b * F.col("__len") / F.greatest(F.col("__avg"), F.lit(1e-9)))
    scores = {}
    for into, terms in queries.items():
        total = F.lit(0.0)
        for k, term in enumerate(distinct):
            if term in terms:
                idf = F.log((F.col("__n") - F.col(f"__d{k}") + 0.5) / (F.col(f"__d{k}") + 0.5) + 1)
                total = total + terms.count(term) * idf * F.col(f"__f{k}") * (k1 + 1) / (F.col(f"__f{k}") + norm)
        scores[into] = F.round(total, 6)
    return both.withColumns(scores).drop(*[c for c in both.columns if c.startswith("__")])


def blend(scored: DataFrame, group: str, parts: list[tuple[str, float]], into: str) -> DataFrame:
    """Weighted sum of scores, each divided by its greatest in the group; a side whose greatest is 0 counts 0."""
    tops = scored.groupBy(F.col(group).alias("__g")).agg(*[F.max(c).alias(f"__m{k}") for k, (c, _) in enumerate(parts)])
    both = scored.join(tops, F.col(group).eqNullSafe(F.col("__g")))
    total = F.lit(0.0)
    for k, (c, weight) in enumerate(parts):
        total = total + F.when(F.col(f"__m{k}") > 0, weight * F.col(c) / F.col(f"__m{k}")).otherwise(0.0)
    return both.withColumn(into, F.round(total, 6)).drop("__g", *[f"__m{k}" for k in range(len(parts))])


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, into: str = "rank") -> DataFrame:
    """The k first rows of each group, with their places."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(into, F.row_number().over(window)).filter(F.col(into) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, each norm at least 1e-12."""

    def norm(x: Column) -> Column:
        return F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12))

    return dot(a, b) / (norm(a) * norm(b))


def reciprocal_rank_fusion(rows: DataFrame, group: list[str], scores: list[str], ties: list[str], depth: int = 8, most: int = 12, k: int = 60) -> DataFrame:
    """Rows in the first `depth` of any score, by the sum of 1 / (k + rank) over those scores, the `most` best.

    Group and ties name a row. Every score is cut to its first `depth` in each task before rows travel.
    """
    each = rows.withColumn("__x", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(s, F.lit(0.0)).cast("double").alias("s")) for i, s in enumerate(scores)])))
    first = top_per_group(each, [*group, "__x.i"], [F.col("__x.s").desc(), *[F.col(c) for c in ties]], depth, "__r")
    rest = [c for c in rows.columns if c not in (*group, *ties)]
    ranks = [F.min(F.when(F.col("__x.i") == i, F.col("__r"))).alias(f"__r{i}") for i in range(len(scores))]
    met = first.groupBy(*group, *ties).agg(*[F.first(c).alias(c) for c in rest], *ranks)
    total = F.lit(0.0)
    for i in range(len(scores)):
        total = total + F.coalesce(1.0 / (k + F.col(f"__r{i}")), F.lit(0.0))
    fused = met.select(*rows.columns, F.round(total, 6).alias("rrf"))
    return top_per_group(fused, group, [F.col("rrf").desc(), *[F.col(c) for c in ties]], most, "place")


def gated_fusion(rows: DataFrame, group: list[str], orders: list[list[Column]], eligible: Column, score: Column, tie: str, depth: int = 10, most: int = 16, k: int = 60) -> DataFrame:
    """Ranks r0, r1, ... over all rows of a group; of the eligible rows the `depth` first by any of them, the `most` best by
    the sum of 1 / (k + rank), and their `rank` by a last score.

    Ranks come before the gate, so a row's ranks don't depend on which others are eligible.
    """
    placed = rows
    for i, order in enumerate(orders):
        placed = ranked(placed, group, order, f"r{i}")
    names = [f"r{i}" for i in range(len(orders))]
    own = placed.filter(eligible)
    for r in names:
        own = ranked(own, group, [F.col(r)], f"__{r}")
    near = own.filter(F.least(*[F.col(f"__{r}") for r in names]) <= depth).drop(*[f"__{r}" for r in names])
    fused = sum((1.0 / (k + F.col(r)) for r in names), F.lit(0.0))
    cut = near.withColumn("__p", F.row_number().over(Window.partitionBy(*group).orderBy(fused.desc(), tie))).filter(F.col("__p") <= most).drop("__p")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(score.desc(), *names)))
