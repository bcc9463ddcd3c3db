"""Quality rules: plain text counts, then a calibrated n-gram classifier trained on labelled rows.

Words and characters are hashed as n-grams (word 1- and 2-grams, character 3-grams) into one space of DIM
buckets; a text's feature is the relative frequency of a bucket within its family, drawn towards the mean in short texts. A logistic regression is
trained on at most `max_labelled` labelled rows (the bounded, documented sample: those whose doc_id hashes
smallest), calibrated by Platt's sigmoid on a held-out fifth of each class, and applied to every whole text in Arrow
batches against a fixed threshold.

Defined cases: a null or empty text has no words and fails the base rule; rows labelled null, or twice with
different values, don't train; without labelled rows of both classes every text that passes the base rule is
kept; repeated rows get the same verdict; a null doc_id is passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DIM = 8192
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_AT = 0.2
#: Words at which a text's own frequencies weigh as much as the mean text's: short texts are judged with care.
SHORT = 60
MAX_LABELLED = 3000
#: Bytes of text that are scored at once: the arrays of a chunk take about a hundred times as much.
SCORED_BYTES = 256 << 10

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_FAMILY = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x243F6A8885A308D3], np.uint64)


def _families(data: np.ndarray, offsets: np.ndarray, starts, ends, first, hashes) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram family the buckets of its grams and the bounds of each text's grams."""
    out = []
    two = C.gram_hashes(hashes, 2)
    ok = C.inside(first, 2, len(hashes))
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    three = C.gram_hashes(points, 3)
    fit = C.inside(chars, 3, len(points))
    for seed, grams, mask, bounds in ((0, hashes, None, first), (1, two, ok, first), (2, three, fit, chars)):
        if mask is not None:
            kept = np.concatenate(([0], np.cumsum(mask)))
            bounds = kept[np.minimum(bounds, len(mask))]
            grams = grams[mask]
        buckets = ((grams ^ _FAMILY[seed]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 13)
        out.append((buckets.astype(np.int64), bounds))
    return out


def _in_repeats(data, starts, ends, first, hashes) -> np.ndarray:
    """For each word whether it is in a window of REPEAT_WINDOW words that its text has twice or more.

    Hashes only propose windows; those that agree are compared word by word.
    """
    windows = C.gram_hashes(hashes, REPEAT_WINDOW)
    covered = np.zeros(len(hashes) + 1, np.int64)
    raw = place = None
    for d in np.flatnonzero(np.diff(first) > REPEAT_WINDOW):
        a, b = first[d], first[d + 1] - REPEAT_WINDOW + 1
        order = np.argsort(windows[a:b], kind="stable")
        ranked = windows[a:b][order]
        same = np.zeros(len(ranked), bool)
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        if not same.any():
            continue
        if raw is None:
            raw, place = C.squeezed(data)
        at = order[same] + a
        found: dict[bytes, list[int]] = {}
        for k, x, y in zip(at.tolist(), place[starts[at]].tolist(), place[ends[at + REPEAT_WINDOW - 1]].tolist(), strict=True):
            found.setdefault(raw[x:y], []).append(k)
        at = np.array([k for places in found.values() if len(places) > 1 for k in places], np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + REPEAT_WINDOW, -1)
    return np.cumsum(covered)[:-1] > 0


def _base(texts: list, data, offsets, starts, ends, first, hashes) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbol = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    word_chars = C.sums(lead[ends] - lead[starts], first)
    dup = np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            dup[i] = len(lines) - len(set(lines))
    repeat = C.sums(_in_repeats(data, starts, ends, first, hashes).astype(np.int64), first)
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": word_chars.astype(np.int64),
        "n_symbols": (symbol[offsets[1:]] - symbol[offsets[:-1]]).astype(np.int64),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
    }


def _parts(batch: pa.RecordBatch, column: str, powers: C.Powers):
    data, offsets = C.utf8(batch.column(column))
    starts, ends, first = C.word_spans(data, offsets)
    return data, offsets, starts, ends, first, C.word_hashes(data, starts, ends, powers)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = C.Powers()
    for batch in C.chunks(batches, most=SCORED_BYTES):
        parts = _parts(batch, "text", powers)
        families, size = _families(*parts), np.diff(parts[4]).astype(np.int64)
        at, value = [], []
        for d in range(batch.num_rows):
            x = np.zeros(DIM, np.float64)
            for buckets, bounds in families:
                own = buckets[bounds[d] : bounds[d + 1]]
                if len(own):
                    x += np.bincount(own, minlength=DIM) / len(own)
            some = np.flatnonzero(x)
            at.append(some.astype(np.int32).tobytes())
            value.append(x[some].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("__y").cast(pa.int32()), batch.column("__key").cast(pa.int64()), pa.array(size), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["y", "key", "size", "at", "value"])


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on standardised features, classes weighted alike."""
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = ((p - y) * weight).astype(np.float32)
        g, gb = x.T @ e + l2 * w, float(e.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, k = 1 - 0.9**t, 1 - 0.999**t
        w = w - 0.02 * (m / c) / (np.sqrt(v / k) + 1e-8)
        b -= 0.02 * (mb / c) / (math.sqrt(vb / k) + 1e-8)
    return w, b


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the sigmoid that maps scores to probabilities, by Newton steps with smoothed targets."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        haa, hab, hbb = (h * z * z).sum() + 1e-6, (h * z).sum(), h.sum() + 1e-6
        ga, gb = (d * z).sum(), d.sum()
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[bytes, float, float] | None:
    """Calibrated weights (float64 bytes), intercept and the mean text's score from labelled rows; None if both classes aren't there."""
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    key = F.xxhash64(F.lit("quality-sample"), "doc_id")
    sample = rows.filter("lo = hi").select(F.col("doc_id").alias("__id"), F.col("lo").alias("__y"), key.alias("__key")).orderBy("__key", "__id").limit(max_labelled)
    sample = C.cut(sample)  # max_labelled rows at most, so it may be broadcast
    got = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("text", "__y", "__key")
    found = got.mapInArrow(_featurise, "y int, key long, size long, at binary, value binary").collect()
    found.sort(key=lambda r: (r["key"], bytes(r["at"]), bytes(r["value"])))
    y = np.array([r["y"] for r in found], np.float64)
    if not 0 < y.sum() < len(y):
        return None
    x = np.zeros((len(y), DIM), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
    scale = x.std(axis=0) + np.float32(1e-4)
    mean = x.mean(axis=0)
    size = np.array([r["size"] for r in found], np.float32)
    x = (x - mean) / scale * (size / (size + SHORT))[:, None]
    # every fifth row of each class is held out; a class of one row both trains and calibrates
    held, fits = np.zeros(len(y), bool), np.ones(len(y), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        held[own[::5]] = True
        if len(own) > 1:
            fits[own[::5]] = False
    w, b = _fit(x[fits], y[fits])
    a, c = _platt(x[held] @ w + b, y[held])
    w = (a * w / scale).astype(np.float64)
    return w.tobytes(), a * b + c, float(mean.astype(np.float64) @ w)


def score(docs: DataFrame, model: tuple[bytes, float, float] | None, keep_at: float = KEEP_AT, id_column: str = "doc_id", text_column: str = "text", keep_columns: bool = False) -> DataFrame:
    """The counts, probability and verdict of every whole text; with keep_columns only the kept rows, as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = C.Powers()
        w = np.frombuffer(model[0], np.float64) if model else None
        for batch in C.chunks(batches, text_column, SCORED_BYTES):
            parts = _parts(batch, text_column, powers)
            base = _base(batch.column(text_column).to_pylist(), *parts)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
            p = np.ones(batch.num_rows)
            if w is not None:
                z = np.full(batch.num_rows, -model[2])
                for buckets, bounds in _families(*parts):
                    z += C.sums(w[buckets], bounds) / np.maximum(np.diff(bounds), 1)
                p = 1 / (1 + np.exp(-np.clip(model[1] + z * base["n_words"] / (base["n_words"] + SHORT), -40, 40)))
            kept = ~failed & (p >= keep_at)
            if keep_columns:
                yield batch.filter(pa.array(kept))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(id_column), *(pa.array(v) for v in base.values()), pa.array(failed), pa.array(kept), pa.array(p)], [id_column, *base, "base_failed", "kept", "probability"])

    if keep_columns:
        return docs.mapInArrow(run, docs.schema)
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return score(docs, train(docs, labels), keep_columns=True)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score(docs, train(docs, C.table(spark, sf_dir, "labels")))
