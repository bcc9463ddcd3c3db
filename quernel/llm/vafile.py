"""Exact top-k inner products with a vector-approximation file.

Components become integers floor(64 x). Equal vectors are one entry that keeps the k + 1 smallest ids (no query can
need more of them). The file holds for each entry one byte a component: its cell among at most CELLS of that component.
Cell edges are quantiles of a bounded sample (SAMPLE entries, those whose ids hash smallest), the outermost cells end
at the component's least and greatest value of all rows, so a far value widens only a cell of its own kind; every entry
is indexed and every bound holds, whatever the sample.

1. A scan of the file gives each query a lower bound of every inner product; the kth greatest of them, kept per
   partition and merged, is the query's floor.
2. A second scan passes on the entries whose upper bound reaches the floor.
3. Exact vectors are read in falling order of upper bound, a step of them at a time, until the kth exact score is above
   every upper bound that is left; entries below it are never read.

Queries go in waves of WAVE distinct vectors, a bounded broadcast each, against all rows; a wave is one job over all
partitions of the file, which works on BLOCK of its queries at a time.

Defined cases: null vectors and those with a null or non-finite component take no part; a null vec_id takes no part;
shorter vectors count as padded by zeros; repeated ids are rows of their own, of which a query leaves out one; an
empty table gives an empty result; integers beyond 2^62 count as 2^62, scores beyond a long as the longs' ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

K = 20
SCALE = 64
CELLS = 256
SAMPLE = 4096
WAVE = 16384
BLOCK = 512
SCAN_ROWS = 1024
LIMIT = 1 << 62
#: What bounds are widened by, as a part of the greatest sum of products: far more than the rounding of doubles.
ROUNDING = 1e-11


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, v: array<long> of the rows that take part."""
    v = F.col(f"`{vector_column}`")
    fit = v.isNotNull() & F.col(f"`{id_column}`").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long"))
    return rows.filter(F.coalesce(fit, F.lit(False))).select(F.col(f"`{id_column}`").cast("long").alias("id"), whole.alias("v"))


def _packed(v: np.ndarray) -> bytes:
    """A vector's integers as 4 or 8 bytes each, whichever all of them need, trailing zeros left out."""
    some = np.flatnonzero(v)
    v = v[: some[-1] + 1] if len(some) else v[:0]
    small = not len(v) or (v.min() >= -(1 << 31) and v.max() < 1 << 31)
    return b"4" + v.astype(np.int32).tobytes() if small else b"8" + v.astype(np.int64).tobytes()


def _matrix(v: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(v), width), np.int64)
    for i, x in enumerate(v):
        own = np.frombuffer(x, np.int32 if x[:1] == b"4" else np.int64, offset=1)
        out[i, : len(own)] = own
    return out


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        at, flat = np.asarray(v.offsets), np.asarray(v.values)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([_packed(flat[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.binary())], ["id", "v"])


def _least_ids(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Per batch one row for each distinct vector, with its smallest ids."""
    for batch in _with_bytes(batches):
        own: dict[bytes, list[int]] = {}
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            own.setdefault(v, []).append(i)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([sorted(x)[:keep] for x in own.values()], pa.list_(pa.int64()))], ["v", "ids"])


def distinct_vectors(whole: DataFrame, keep: int) -> DataFrame:
    """vid (the least id), v (packed) and ids of each distinct vector; pre-aggregated before the shuffle."""
    first = whole.mapInArrow(lambda b: _least_ids(b, keep), "v binary, ids array<long>")
    pre = first.groupBy("v", F.pmod(F.spark_partition_id(), F.lit(64)).alias("lane")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    merged = pre.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    # a vec_id may stand for several vectors: entries have numbers of their own
    return merged.select(F.xxhash64(F.element_at("ids", 1), "v").alias("vid"), "v", "ids")


class Cells:
    """Edges, and the least and greatest value, of each component's cells."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.width = len(low)
        self.edges, los, his = [], [], []
        for j in range(self.width):
            own = np.sort(sample[:, j]) if len(sample) else np.zeros(0, np.int64)
            # an edge starts a cell; the values below the first edge and those above the sample have one each
            edges = np.unique(own[np.linspace(0, len(own) - 1, CELLS - 2).astype(int)]) if len(own) else own
            if len(edges):
                edges = np.append(edges, own[-1] + 1)
            lo = np.concatenate(([low[j]], edges))
            hi = np.maximum(np.concatenate((edges - 1, [high[j]])), lo)
            self.edges.append(edges)
            los.append(np.pad(lo, (0, CELLS - len(lo))))
            his.append(np.pad(hi, (0, CELLS - len(hi))))
        self.lo = np.array(los, np.float64).reshape(self.width, CELLS)
        self.hi = np.array(his, np.float64).reshape(self.width, CELLS)
        self.size = np.maximum(np.abs(low), np.abs(high)).astype(np.float64)

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if self.width else np.zeros((len(v), 0), np.uint8)

    def values(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = np.arange(self.width)
        return self.lo[j, cells], self.hi[j, cells]

    def bounds(self, values: tuple[np.ndarray, np.ndarray], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = values
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        slack = ROUNDING * (np.abs(q).astype(np.float64) @ self.size)[:, None]
        return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


def _extent(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    low, high = np.zeros((2, width), np.int64)
    for batch in batches:
        if batch.num_rows:
            m = _matrix(batch.column("v").to_pylist(), width)
            low, high = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high)], ["j", "low", "high"])


def cells_of(vectors: DataFrame, width: int) -> Cells:
    """The cells; what reaches the driver is SAMPLE vectors and two numbers a component."""
    ends = vectors.select("v").mapInArrow(lambda b: _extent(b, width), "j int, low long, high long").groupBy("j").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("j").collect()
    sample = vectors.select("v", F.xxhash64(F.lit("cells"), "vid").alias("h")).orderBy("h").limit(SAMPLE).collect()
    return Cells(_matrix([bytes(r["v"]) for r in sample], width), np.array([r["low"] for r in ends], np.int64), np.array([r["high"] for r in ends], np.int64))


def _scores(q: np.ndarray, v: np.ndarray) -> list[int]:
    """Exact inner products row by row, within the range of a long."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**62:
        return np.einsum("ij,ij->i", q, v).tolist()
    return [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y, strict=True)))) for x, y in zip(q.tolist(), v.tolist(), strict=True)]


def search(file: DataFrame, vectors: DataFrame, queries: list, cells: Cells, k: int) -> DataFrame:
    """queries: (vid, v) of one wave. qid, vid, score of the k best entries of each, and of all that tie with the last."""
    spark = file.sparkSession
    sent = spark.sparkContext.broadcast((np.array([x["vid"] for x in queries], np.int64), [bytes(x["v"]) for x in queries], cells))

    def blocks(batch: pa.RecordBatch, q: np.ndarray) -> Iterator[tuple]:
        """Queries from a on, rows of the file, and their bounds."""
        for r in range(0, batch.num_rows, SCAN_ROWS):
            part = batch.slice(r, SCAN_ROWS)
            raw = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(part.num_rows, cells.width)
            values = sent.value[2].values(raw)
            for a in range(0, len(q), BLOCK):
                yield a, part, *sent.value[2].bounds(values, q[a : a + BLOCK])

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value[0], _matrix(sent.value[1], cells.width)
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for a, _, low, _ in blocks(batch, q):
                own = np.concatenate((best[a], low), axis=1) if a in best else low
                best[a] = np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k :] if own.shape[1] > k else own
        for a, own in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(qid[a : a + BLOCK]), pa.array(list(own), pa.list_(pa.float64()))], ["qid", "low"])

    def kth(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("low")), asc=False), 1, k).alias("low"))

    lanes = kth(file.mapInArrow(lower, "qid long, low array<double>").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64))), "qid", "lane")
    floors = {r["qid"]: r["low"][-1] for r in kth(lanes, "qid").collect() if len(r["low"]) == k}  # a number for each query of the wave
    told = spark.sparkContext.broadcast(floors)

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value[0], _matrix(sent.value[1], cells.width)
        floor = np.array([told.value.get(x, -np.inf) for x in qid.tolist()])
        for batch in batches:
            for a, part, _, high in blocks(batch, q):
                x, y = np.nonzero(high >= floor[a : a + BLOCK, None])
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(qid[a + x]), part.column("vid").take(pa.array(y)), pa.array(high[x, y])], ["qid", "vid", "high"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(sent.value[0].tolist())}
        for batch in batches:
            q = _matrix([sent.value[1][place[x]] for x in batch.column("qid").to_pylist()], cells.width)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("vid"), pa.array(_scores(q, _matrix(batch.column("v").to_pylist(), cells.width)), pa.int64())], ["qid", "vid", "score"])

    may = file.mapInArrow(upper, "qid long, vid long, high double")
    left = C.cut(may.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("high").desc(), "vid"))))
    done, step, read = 0, 2 * k, None
    while True:
        now = left.filter((F.col("r") > done) & (F.col("r") <= done + step)).select("qid", "vid")
        got = now.join(vectors.select(F.col("vid").alias("w"), "v"), F.col("vid") == F.col("w")).select("qid", "vid", "v").mapInArrow(exact, "qid long, vid long, score long")
        read = C.cut(got if read is None else read.union(got))
        done, step = done + step, 2 * step
        sure = read.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc()))).filter(F.col("n") == k).select(F.col("qid").alias("q"), F.col("score").cast("double").alias("kth"))
        rest = left.filter(F.col("r") > done).join(sure, F.col("qid") == F.col("q"), "left").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth")))
        left = C.cut(rest.select("qid", "vid", "high", "r"))
        if left.isEmpty():
            break
    return read.withColumn("n", F.rank().over(Window.partitionBy("qid").orderBy(F.col("score").desc()))).filter(F.col("n") <= k).select("qid", "vid", "score")


def top_k(rows: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query row but the row itself."""
    spark = rows.sparkSession
    whole = whole_vectors(rows, id_column, vector_column)
    vectors = C.cut(distinct_vectors(whole, k + 1))
    width = int(whole.agg(F.max(F.size("v"))).first()[0] or 0)
    cells = cells_of(vectors, width)
    sent = spark.sparkContext.broadcast(cells)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = sent.value.of(_matrix(batch.column("v").to_pylist(), width))
            yield pa.RecordBatch.from_arrays([batch.column("vid"), pa.array([c.tobytes() for c in raw], pa.binary())], ["vid", "cells"])

    file = C.cut(vectors.select("vid", "v").mapInArrow(approximate, "vid long, cells binary"))
    asked = whole_vectors(rows.filter(is_query), id_column, vector_column).mapInArrow(_with_bytes, "id long, v binary")
    named = C.cut(asked.join(vectors.select("vid", F.col("v").alias("v2")), F.col("v") == F.col("v2")).select("id", "vid", "v"))
    distinct = C.cut(named.groupBy("vid").agg(F.first("v").alias("v")))
    waves = max(1, -(-distinct.count() // WAVE))
    results = None
    for wave in range(waves):
        mine = distinct.filter(F.pmod(F.xxhash64("vid"), F.lit(waves)) == wave).collect()  # about WAVE vectors
        if mine:
            part = C.cut(search(file, vectors, mine, cells, k + 1))
            results = part if results is None else results.union(part)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # the k + 1 best entries hold the k + 1 best rows, each with its smallest ids; entries of equal score may all matter
    ids = results.join(vectors.select(F.col("vid").alias("w"), "ids"), F.col("vid") == F.col("w")).select("qid", "vid", "score", F.explode("ids").alias("vec"))
    best = ids.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec"))).filter(F.col("r") <= k + 1)
    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "vec", "score", F.col("vid").alias("entry")))).alias("top"))
    full = named.join(lists, F.col("vid") == F.col("qid")).select("id", "vid", "top")
    own = F.array_position(F.transform("top", lambda t: F.struct(t["vec"].alias("vec"), t["entry"].alias("entry"))), F.struct(F.col("id").alias("vec"), F.col("vid").alias("entry")))
    rest = F.when(own > 0, F.concat(F.slice("top", F.lit(1), (own - 1).cast("int")), F.slice("top", (own + 1).cast("int"), F.lit(k + 1)))).otherwise(F.col("top"))
    cut_at_k = full.select("id", F.slice(rest, 1, k).alias("top"))
    return cut_at_k.select(F.col("id").alias("query_id"), F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("t.vec").alias("vec_id"), F.col("t.score").alias("score"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH flat AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM flat q JOIN flat c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
