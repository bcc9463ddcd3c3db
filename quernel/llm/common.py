"""What the corpus operators share: the word pattern, lineage cuts and Arrow text kernels."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a vectorised kernel holds at once, unless one text alone is longer.
CHUNK_BYTES = 2 << 20

_U = np.uint64
_B = _U(0x9E3779B97F4A7C15 | 1)
_B_INV = _U(pow(int(_B), -1, 1 << 64))
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[9, 10, 11, 12, 13, 32]] = True


def n_words(text: Column) -> Column:
    """Words in a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage by a reliable checkpoint in the shared folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.match(r"local($|\[)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="quernel-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts in column take most bytes together, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = utf8(batch.column(column))[1]
        at = 0
        while at < n:
            stop = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
            stop = min(max(stop, at + 1), n)
            yield batch.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows in them; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.string()), False
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_separator: np.ndarray = _IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    sep = is_separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(sep)
    before[0], before[1:] = True, sep[:-1]
    before |= edge[:-1]
    after = np.empty_like(sep)
    after[-1], after[:-1] = True, sep[1:]
    after |= edge[1:]
    starts = np.flatnonzero(~sep & before)
    ends = np.flatnonzero(~sep & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words between starts and ends as one Arrow array, in bytes."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    packed = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])


def slices(data: np.ndarray, is_separator: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """Parts of a text of about most bytes that end before a separator, or where the text does."""
    at = 0
    while at < len(data):
        stop = at + most
        while stop < len(data):
            cuts = np.flatnonzero(is_separator[data[stop : stop + most]])
            if len(cuts):
                stop += int(cuts[0])
                break
            stop += most
        yield data[at : min(stop, len(data))]
        at = stop


def squeezed(data: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes with each stretch of white space as one space, and where each byte of data (and the end) then stands."""
    sep = _IS_SEP[data]
    keep = ~sep
    keep[1:] |= ~sep[:-1]
    place = np.concatenate(([0], np.cumsum(keep)))
    return np.where(sep, np.uint8(32), data)[keep].tobytes(), place


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with underscores in front until no column of the frames is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the public SplitMix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            self.up = np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, _B))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, _B_INV))), dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    powers.grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers.up[: len(data)], dtype=np.uint64, out=total[1:])
    return mix64((total[ends] - total[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values; the last n - 1 positions are left out."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _B + hashes[k : k + m]
    return mix64(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for the positions from which n values stay within one text; first has the n + 1 bounds of the texts."""
    m = max(0, total - n + 1)
    ok = np.ones(m, bool)
    for k in range(1, n):
        cut_at = first[1:-1] - k
        ok[cut_at[(cut_at >= 0) & (cut_at < m)]] = False
    return ok


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds, each in its own order of addition; empty ranges give 0."""
    out = np.zeros(len(bounds) - 1, values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], dtype=out.dtype)
    return out


#: Keys that are joined by broadcast because each has very many rows: at most so many.
HOT_KEYS = 50_000


def uneven_join(left: DataFrame, right: DataFrame, on: Column, partners: Column, least: int) -> DataFrame:
    """left joined with right, one row a key; partners is the number of rows of left that each row of right meets, about.

    Keys of more than least partners are hot: they are sent to the rows of left, which stay where they are; the others are
    shuffled. Where over HOT_KEYS are hot, the limit rises by powers of two until that many remain, so a shuffled key has
    at most about a HOT_KEYS-th of left.
    """
    power = F.floor(F.log2(partners / least))
    counts = {r["power"]: r["count"] for r in right.filter(partners > least).groupBy(power.alias("power")).count().collect()}  # 64 rows at most
    lowest, sent = None, 0
    for p in sorted(counts, reverse=True):
        sent += counts[p]
        if sent > HOT_KEYS:
            break
        lowest = p
    if lowest is None:
        return left.join(right, on)
    hot = (partners > least) & (power >= lowest)
    many = F.broadcast(cut(right.filter(hot)))
    return left.join(many, on).unionByName(left.join(many, on, "left_anti").join(right.filter(~hot), on))


def written_to(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, and the path."""
    import uuid

    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="quernel-written-")
    path = f"{shared.rstrip('/')}/quernel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    return written_to(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that written_to wrote, through the file system that Spark knows it by."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
