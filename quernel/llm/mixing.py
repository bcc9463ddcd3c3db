"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every row has a keyed 62-bit key within its source; that is the source's permutation. A source is cut into blocks,
equal ranges of keys, in proportion to its words. A source whose target is e times its words plus a rest gives e whole
passes over its blocks and a last pass that ends within one block; the place is found by descending the key's digits
with one aggregation a level, so no task ever orders a source. A source's descent ends when its own group of keys has at
most GROUP_ROWS rows. Inside this last group, rows are taken in key order where they still fit the rest, which leaves
less than the smallest row of the group that was passed over.

The blocks of all sources (their exact quotas) are split among output shards by a binary tree: at each node the blocks
that go left are a multivariate-hypergeometric draw. A shard then owns a range of positions of each source's
permuted blocks, disjoint from the others', and shuffles locally by a keyed order.

What reaches the driver: a row per source, at most HISTOGRAM counts a level, and the last group of keys of each source
(about GROUP_ROWS rows). All of it is bounded by the number of sources, not by rows.

Defined cases: a null text has size 0 and a null source is a source of its own, sorted last; rows equal in id, source
and text share a key and are drawn together; an empty table gives an empty mix; a source without words is not taken.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KEY_BITS = 62
HISTOGRAM = 1 << 15
GROUP_ROWS = 512
BLOCKS = 1 << 14
MAX_SOURCES = 1 << 15
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
STOP = 2
SEED = 20240607


@dataclass
class Plan:
    """A row per source; taken_below: keys under it are in the last pass; also: further keys that are."""

    sources: list
    sizes: list[int]
    targets: list[Fraction]
    passes: list[int]
    taken_below: list[int]
    also: list[list[int]]
    blocks: list[int]
    shard_ends: list[list[int]]


def targets_of(sources: list, sizes: list[int], weights=WEIGHTS, share: Fraction = SHARE, stop: int = STOP) -> list[Fraction]:
    """Shares of share x all words by weight, each at most stop times its source, the excess dealt again by weight."""
    left = share * sum(sizes)
    out: list[Fraction] = [Fraction(0)] * len(sources)
    open_ = {i: weights[i % len(weights)] for i in range(len(sources))}
    while open_:
        unit = left / sum(open_.values())
        full = [i for i, w in open_.items() if unit * w > stop * sizes[i]]
        if not full:
            for i, w in open_.items():
                out[i] = unit * w
            break
        for i in full:
            out[i] = Fraction(stop * sizes[i])
            left -= out[i]
            del open_[i]
    return out


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """For each source the cumulative block counts of the shards, by draws down a binary tree of shards."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def go(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        total = int(counts.sum())
        take = total * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, take, method="marginals") if total else counts
        go(lo, mid, left)
        go(mid, hi, counts - left)

    go(0, shards, np.array(quotas, np.int64))
    return np.cumsum(out, axis=0).T.tolist()


def row_key(id_column: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("source"), F.col(id_column), F.col("text")), 64 - KEY_BITS)


def sized(docs: DataFrame, id_column: str = "doc_id", seed: int = SEED) -> DataFrame:
    return docs.select(F.col("source").alias("__source"), C.n_words(F.col("text")).alias("__size"), row_key(id_column, seed).alias("__key"))


def plan_mix(rows: DataFrame, shards: int, weights=WEIGHTS, share: Fraction = SHARE, stop: int = STOP, seed: int = SEED) -> Plan:
    """rows: __source, __size, __key of every document."""
    totals = rows.groupBy("__source").agg(F.sum("__size").alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))
    sources, sizes = [r["__source"] for r in totals], [r["words"] for r in totals]
    targets = targets_of(sources, sizes, weights, share, stop)
    passes = [int(t // s) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    rest = [int(t - e * s) for t, e, s in zip(targets, passes, sizes, strict=True)]
    low = [0] * len(sources)
    # descend in each source to a group of keys of at most GROUP_ROWS rows
    level = max(1, int(np.log2(max(2, HISTOGRAM // max(1, len(sources))))))
    depth, within = [0] * len(sources), [r["n"] for r in totals]
    live = [i for i, r in enumerate(rest) if r > 0]
    left = {i: rest[i] for i in live}
    spark = rows.sparkSession
    while deep := [i for i in live if within[i] > GROUP_ROWS and depth[i] + level <= KEY_BITS]:  # all at one depth
        for i in deep:
            depth[i] += level
        width = 1 << (KEY_BITS - depth[deep[0]])
        params = spark.createDataFrame([(sources[i], i, low[i]) for i in deep], "s string, i int, low long")
        near = rows.join(F.broadcast(params), F.col("__source").eqNullSafe(F.col("s")))  # MAX_SOURCES rows at most
        digit = F.floor((F.col("__key") - F.col("low")) / F.lit(width)).cast("long")
        inside = near.filter((F.col("__key") >= F.col("low")) & (F.col("__key") - F.col("low") < F.lit(width << level)))
        counts: dict[int, list] = {i: [] for i in deep}
        for r in inside.groupBy("i", digit.alias("d")).agg(F.sum("__size").alias("words"), F.count("*").alias("n")).collect():
            counts[r["i"]].append((r["d"], r["words"], r["n"]))
        for i in deep:
            for d, words, n in sorted(counts[i]):
                if words > left[i]:
                    low[i] += d * width
                    within[i] = n
                    break
                left[i] -= words
    also: list[list[int]] = [[] for _ in sources]
    if live:
        params = spark.createDataFrame([(sources[i], i, low[i], 1 << (KEY_BITS - depth[i])) for i in live], "s string, i int, low long, width long")
        near = rows.join(F.broadcast(params), F.col("__source").eqNullSafe(F.col("s"))).filter((F.col("__key") >= F.col("low")) & (F.col("__key") - F.col("low") < F.col("width")))
        ends: dict[int, list] = {i: [] for i in live}
        for r in near.groupBy("i", "__key").agg(F.sum("__size").alias("words")).collect():
            ends[r["i"]].append((r["__key"], r["words"]))
        for i in live:
            whole = True
            for key, words in sorted(ends[i]):
                if words > left[i]:
                    whole = False
                elif whole:
                    low[i], left[i] = key + 1, left[i] - words
                elif words:
                    also[i].append(key)
                    left[i] -= words
    every = max(1, sum(sizes))
    blocks = [max(1, -(-BLOCKS * s // every)) for s in sizes]
    # a row taken beyond the last whole key travels with the last block
    quotas = [e * b + (((k - 1) * b >> KEY_BITS) + 1 if k else bool(more)) for e, b, k, more in zip(passes, blocks, low, also, strict=True)]
    return Plan(sources, sizes, targets, passes, low, also, blocks, split_tree(quotas, shards, seed))


def mix(docs: DataFrame, plan: Plan, into: str = "mix", id_column: str = "doc_id", seed: int = SEED) -> DataFrame:
    """docs with a struct `into`: size, source_size, target and copies, a struct (shard, block, place) for each time it is taken."""
    spark = docs.sparkSession
    rows = [(s, i, size, float(t), e, low, also, b, ends) for i, (s, size, t, e, low, also, b, ends) in enumerate(zip(plan.sources, plan.sizes, plan.targets, plan.passes, plan.taken_below, plan.also, plan.blocks, plan.shard_ends, strict=True))]
    params = spark.createDataFrame(rows, "s string, i int, source_size long, target double, e int, low long, also array<long>, b long, ends array<long>")
    name, own = C.free_name("__own", docs), C.free_name("__plan", docs)
    params = params.select(F.struct(*params.columns).alias(own))
    with_key = docs.withColumn(name, F.struct(C.n_words(F.col("text")).alias("size"), row_key(id_column, seed).alias("key")))
    both = with_key.join(F.broadcast(params), F.col("source").eqNullSafe(F.col(f"{own}.s")))  # a row per source
    p, size, key = F.col(own), F.col(f"{name}.size"), F.col(f"{name}.key")
    block = F.floor(key / F.lit(float(1 << KEY_BITS)) * p["b"]).cast("long")
    last = (key < p["low"]) | F.array_contains(p["also"], key)
    n = F.when(size > 0, p["e"] + last.cast("int")).otherwise(0)

    def copy(k: Column) -> Column:
        final = F.greatest(F.floor((p["low"] - 1) / F.lit(float(1 << KEY_BITS)) * p["b"]).cast("long"), F.lit(0))
        at = k * p["b"] + F.when(k == p["e"], F.least(block, final)).otherwise(block)
        shard = F.size(F.filter(p["ends"], lambda end: end <= at))
        return F.struct(F.least(shard, F.size(p["ends"]) - 1).alias("shard"), at.alias("block"), F.xxhash64(F.lit(seed), k, key).alias("place"))

    copies = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), copy)).otherwise(F.array().cast("array<struct<shard:int,block:bigint,place:bigint>>"))
    out = F.struct(size.alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), copies.alias("copies"))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], out.alias(into))


def shards_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of docs, repeated as often as taken, dealt to shards and shuffled within each."""
    shards = shards_of(docs.sparkSession)
    plan = plan_mix(C.cut(sized(docs, id_column, seed)), shards, seed=seed)
    name = C.free_name("__mix", docs)
    taken = mix(docs, plan, name, id_column, seed).withColumn(name, F.explode(f"{name}.copies"))
    return taken.repartitionById(shards, F.col(f"{name}.shard")).sortWithinPartitions(f"{name}.shard", f"{name}.place").drop(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = plan_mix(C.cut(sized(docs)), shards_of(spark))
    return mix(docs, plan).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.size("mix.copies")).alias("taken"), F.transform("mix.copies", lambda c: c["shard"]).alias("shards"))
