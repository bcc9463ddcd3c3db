"""Near-duplicate groups by SimHash fingerprints with a pigeonring filter.

A fingerprint is cut into a ring of three segments. If two fingerprints differ in at most DISTANCE = 2 bits, some
segment starts a chain whose every prefix of l segments differs in at most l * 2 / 3 bits: the first segment agrees,
the first two differ in at most one bit, all three in at most two. Candidates share the first segment and one half of
the second (one of two halves must agree if at most one bit differs), so a key has 32 or 33 bits; a candidate that
breaks the chain's budgets is dropped before the full Hamming check.

Equal fingerprints are one node, so copies are never paired. Keys that more than BUCKET fingerprints share aren't
paired either: two fingerprints within two bits have a neighbour at one bit or less in common, so each is linked to
the least fingerprint of each of its 65 neighbours' groups, which gives the same components with edges in proportion.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; a null doc_id never names a
component while another id is there; repeated rows are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
BUCKET = 16
#: First bit and width of each segment of the ring.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprints of texts given as bytes and offsets."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = C.word_spans(data, offsets)
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    raw, place = C.squeezed(data)
    words = np.diff(first)
    take = np.maximum(words - SHINGLE + 1, (words > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(take)))
    lead = np.arange(bounds[-1]) - np.repeat(bounds[:-1], take) + np.repeat(first[:-1], take)
    last = np.minimum(lead + SHINGLE, np.repeat(first[1:], take)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(place[starts[lead]].tolist(), place[ends[last]].tolist(), strict=True)), np.uint64, len(lead))
    full = np.flatnonzero(take)
    step = 1 << 17
    counts = np.zeros((n, 64), np.int64)
    for d0 in range(0, len(full), 4096):
        some = full[d0 : d0 + 4096]
        a, b = bounds[some[0]], bounds[some[-1] + 1]
        for x in range(a, b, step):
            y = min(x + step, b)
            inside = some[(bounds[some] < y) & (bounds[some + 1] > x)]
            bits = np.unpackbits(h[x:y].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[inside] += np.add.reduceat(bits, np.maximum(bounds[inside] - x, 0), axis=0, dtype=np.int64)
    over = (2 * counts > take[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, *carried: str, text_column: str = "text") -> DataFrame:
    """The carried columns and fp (a long with the fingerprint's 64 bits) of every whole text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, text_column):
            fp = fingerprints_of(*C.utf8(batch.column(text_column)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(fp.view(np.int64))], [*carried, "fp"])

    return docs.select(*carried, text_column).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", fp long")


def _bits(x: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1)) if at else x.bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column) -> Column:
    """A struct (key, i) for each start i of a chain and half of the segment that follows it."""
    out = []
    for i, (at, width) in enumerate(SEGMENTS):
        b, w = SEGMENTS[(i + 1) % len(SEGMENTS)]
        for half, (x, y) in enumerate(((b, w // 2), (b + w // 2, w - w // 2))):
            key = F.lit((2 * i + half) << 40).bitwiseOR(F.shiftleft(_bits(fp, at, width), 12)).bitwiseOR(_bits(fp, x, y))
            out.append(F.struct(key.alias("key"), F.lit(i).alias("i")))
    return F.array(*out)


def _chain(i: Column, x: Column) -> Column:
    """Whether differences x keep the proportional budgets on the chain that starts at segment i, then the full check."""
    cases = F.lit(False)
    for k, (at, width) in enumerate(SEGMENTS):
        b, w = SEGMENTS[(k + 1) % len(SEGMENTS)]
        first, second = F.bit_count(_bits(x, at, width)), F.bit_count(_bits(x, b, w))
        cases = F.when(i == k, (3 * first <= DISTANCE) & (3 * (first + second) <= 2 * DISTANCE) & (F.bit_count(x) <= DISTANCE)).otherwise(cases)
    return cases


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp. Edges (a, b) whose components are those of all pairs within DISTANCE bits."""
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.key", "k.i")
    busy = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("key", "busy")
    shared = C.cut(keyed.join(busy, F.col("key") == F.col("busy")).select("key", "i", "fp", "n"))
    few = shared.filter(F.col("n") <= BUCKET)
    left, right = few.select("key", "i", F.col("fp").alias("a")), few.select(F.col("key").alias("key2"), F.col("fp").alias("b"))
    near = left.join(right, (F.col("key") == F.col("key2")) & (F.col("a") > F.col("b")) & _chain(F.col("i"), F.col("a").bitwiseXOR(F.col("b"))))
    crowd = shared.filter(F.col("n") > BUCKET).select("fp").distinct()
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    around = crowd.select("fp", F.explode(ball).alias("point"))
    hub = around.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select(F.col("point").alias("p"), "b")
    met = around.join(hub, F.col("point") == F.col("p")).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.select("a", "b").union(met)


def grouped(marked: DataFrame, least: Column) -> DataFrame:
    """marked: rows with fp. A row (fp, least) per fingerprint: the least value over its whole component."""
    fps = C.cut(marked.groupBy("fp").agg(F.min(least).alias("least")))
    roots = components(links(fps.select("fp")))
    named = C.cut(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    best = named.groupBy("root").agg(F.min("least").alias("best")).withColumnRenamed("root", "r")
    return named.join(best, named["root"] == best["r"]).select("fp", "best")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group: the one of the least doc_id stays."""
    name = C.free_name("__row", docs)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    with_row = docs.select("doc_id", row.alias("__row"), "text")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    marked = C.cut(fingerprints(with_row, "doc_id", "__row"))
    stay = grouped(marked, rank).select(F.col("best.id").alias("id"), F.col("best.row").alias("row")).distinct().alias("stay")
    named = docs.withColumn(name, row).alias("docs")
    kept = named.join(stay, F.col("docs.doc_id").eqNullSafe(F.col("stay.id")) & (F.col(f"docs.{name}") == F.col("stay.row")), "left_semi")
    return kept.dropDuplicates(["doc_id", name]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = C.cut(fingerprints(C.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))
    best = grouped(marked, F.col("doc_id")).withColumnRenamed("fp", "f")
    return marked.join(best, marked["fp"] == best["f"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))
