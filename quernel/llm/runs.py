"""Periodic runs of words, by Lyndon arrays on ordered alphabets (the linear-time method of Ellert and Fischer).

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping period q. Each
run holds a Lyndon word of length q, under one of the two orders of the alphabet, that is the longest Lyndon word at its
place; so the edges from each place to its next smaller suffix, under both orders, give all runs. `lyndon_edges` finds
them with a stack from left to right, and with each edge how far the two suffixes agree. No match is made twice: inside
the part that an earlier match covers, the answer is that of the pair one period before, and beyond its end the comparison
goes on where it stopped. All comparisons together therefore take linear time, on any alphabet with an order; there are no
suffix structures and no hashes of stretches. To the left, a run is extended once, by less than one period.

Before that, `narrowed` leaves out words that are too rare between two left-out words to be in a run of the wanted
exponent. That changes no run, and leaves little of most texts.

Defined cases: a null or empty text has no words and no runs, and its collapsed text is empty; a null id is kept; repeated
rows get the same answer; extra columns are left out but for the id. One task holds a text whole, with a few integers a
word, and five more for each word that `narrowed` leaves.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The runs that are looked for have at least so many words, and so many periods.
LEAST_LENGTH = 6
LEAST_EXPONENT = 4


def lyndon_edges(x: Sequence[int]) -> tuple[array, array]:
    """For each place the start of the next smaller suffix (len(x) if there is none), and how far the two suffixes agree.

    The window is the match that reaches furthest: what stands from `b` to `reach` also stands `d` places before. For a pair
    (l, r) with b <= l < r < reach, the pair (l - d, r - d) has been compared, as the same suffixes were on the stack then;
    unless its match goes to the window's end, (l, r) agrees just as far. A pair below one whose left suffix was greater
    follows from that pair and from the match between the two left suffixes, or agrees at least as far as they do.
    """
    n = len(x)
    down, match = array("q", [n]) * n, array("q", [0]) * n
    up, up_match = array("q", [-1]) * n, array("q", [0]) * n
    b = d = reach = 0
    for r in range(1, n):
        left, m, popped = r - 1, 0, -1
        covered = reach - r
        stop = False
        while covered > 0 and left >= b:
            a, c = left - d, r - d
            m = match[a] if down[a] == c else up_match[c]
            if m >= covered:
                m, popped = covered, -1
                break
            if x[left + m] < x[r + m]:
                stop = True
                break
            down[left], match[left] = r, m
            popped, left = left, up[left]
        while left >= 0 and not stop:
            between = up_match[popped] if popped >= 0 else m
            if between < m:
                m = between
                break
            if between == m:
                while r + m < n and x[left + m] == x[r + m]:
                    m += 1
                if r + m > reach:
                    b, d, reach = r, r - left, r + m
            if r + m < n and x[left + m] < x[r + m]:
                break
            down[left], match[left] = r, m
            popped, left = left, up[left]
        up[r], up_match[r] = left, m if left >= 0 else 0
    return down, match


def runs_of(x: Sequence[int], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a sequence of numbers, by start, then period; least_exponent is 2 or more."""
    found = set()
    n = len(x)
    for order in (x, [-v for v in x]):
        down, match = lyndon_edges(order)
        for i in range(n):
            j = down[i]
            p, m = j - i, match[i]
            if m <= (least_exponent - 2) * p or j == n:
                continue  # with less than one more period to the left it stays too short
            if i >= p and down[i - p] == i and match[i - p] >= p:
                continue  # the same Lyndon word stands one period before
            k = 0
            while k < p and k < i and x[i - k - 1] == x[j - k - 1]:
                k += 1
            length = k + p + m
            if k < p and length >= least_length and length >= least_exponent * p:
                found.add((i - k, length, p))
    return sorted(found, key=lambda t: (t[0], t[2]))


def narrowed(codes: np.ndarray, first: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int]]:
    """Stretches (start, end) that hold all runs of the texts whose words start at first (n + 1 bounds).

    Each word of such a run stands in it least_exponent times. So a word that a stretch holds less often is in none of its
    runs and ends the stretch; what remains is judged again, for as long as a quarter goes.
    """
    at = np.arange(len(codes))
    stretch = np.repeat(np.arange(len(first) - 1), np.diff(first))
    width = int(codes.max()) + 1 if len(codes) else 1
    while len(at):
        _, place, count = np.unique(stretch * width + codes[at], return_inverse=True, return_counts=True)
        keep = count[place] >= least_exponent
        kept, own = at[keep], stretch[keep]
        edge = np.ones(len(kept), bool)
        edge[1:] = (kept[1:] != kept[:-1] + 1) | (own[1:] != own[:-1])
        lengths = np.diff(np.append(np.flatnonzero(edge), len(kept)))
        long = lengths >= least_length
        inside = np.repeat(long, lengths)
        before = len(at)
        at, stretch = kept[inside], np.repeat(np.arange(int(long.sum())), lengths[long])
        if 4 * (before - len(at)) < before:
            break
    edges = np.flatnonzero(np.diff(stretch, prepend=-1))
    ends = np.append(edges[1:], len(at))[: len(edges)]
    return [(int(at[i]), int(at[j - 1]) + 1) for i, j in zip(edges, ends, strict=True)]


#: Given an id and a number of words: which word of the text stands at each place, or None for the text as it is.
Rearrange = Callable[[object, int], "np.ndarray | None"]


def collapsed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, rearrange: Rearrange | None = None
) -> DataFrame:
    """Per row its id, n_words, its runs by start, then period, and its text without the words after any run's first period.

    The collapsed text joins the words that are left by one space. rearrange may put other words of the text in its places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, text_column):
            data, offsets = C.utf8(batch.column(text_column))
            starts, ends, first = C.word_spans(data, offsets)
            words = C.word_array(data, starts, ends)
            place = np.arange(len(words))
            for k, key in enumerate(batch.column(id_column).to_pylist() if rearrange else ()):
                moved = rearrange(key, int(first[k + 1] - first[k]))
                if moved is not None:
                    place[first[k] : first[k + 1]] = first[k] + moved
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[place]
            n_runs = np.zeros(batch.num_rows, np.int64)
            dropped = np.zeros(len(words) + 1, np.int64)
            found: list[tuple[int, int, int]] = []
            for start, end in narrowed(codes, first, least_length, least_exponent):
                doc = int(np.searchsorted(first, start, side="right")) - 1
                own = runs_of(codes[start:end].tolist(), least_length, least_exponent)
                n_runs[doc] += len(own)
                for at, length, period in own:
                    found.append((start + at - int(first[doc]), length, period))
                    dropped[start + at + period] += 1
                    dropped[start + at + length] -= 1
            keep = np.cumsum(dropped[:-1]) == 0
            bounds = np.concatenate(([0], np.cumsum(keep)))[first]
            texts = pc.binary_join(pa.LargeListArray.from_arrays(bounds, words.take(pa.array(place[keep]))), pa.scalar(b" ", pa.large_binary())).cast(pa.string())
            spans = pa.StructArray.from_arrays([pa.array([t[k] for t in found], pa.int64()) for k in range(3)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_runs))), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(np.diff(first)), runs, texts], [id_column, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands where in the texts of the query: in a tenth of them the last part repeats its first words."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def op11_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapsed(C.table(spark, sf_dir, "documents"), rearrange=repeated_tail)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.shorter div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
