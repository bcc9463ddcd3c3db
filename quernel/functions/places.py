r"""Places in texts as columns: running sums and maxima of arrays, matches of a pattern, sentence ends.

Spark's pattern functions give texts, not places. Here the pattern is matched on the JVM, and the lengths of what lies
between matches and of the matches themselves are summed up; the sums are vectorised over a batch, so that an array of any
length costs time in proportion. Each match must begin where the last one ended (\G), or else the text after the last match
would be searched again from each of its places. All places count code points from 0, ends exclusive, and slice back to the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may stand between a sentence's terminal and its end, and abbreviations whose point ends none.
CLOSERS = "\"”’」』】〉》）)\\]}"
_CLOSERS = CLOSERS.replace("\\", "")
ABBREVIATIONS = r"e\.g|i\.e|Dr|Mr|Ms|Prof|vs|et al"
#: At most so many characters before a sentence's closers decide on its end: a terminal, an abbreviation, and what is before it.
REACH = 8

#: A sentence's end: the last of a row of ellipses; a terminal; a wide or small point that isn't between digits; or a point
#: before white space, a closer or the text's end, but after no abbreviation. Closers follow, but not after ellipses.
#: It begins with a point, a mark or no ASCII at all, so that other characters cost one look.
SENTENCE_END = (
    r"(?=[.!?\x{80}-\x{10FFFF}])(?:…(?!…)|(?:[!?。！？｡﹗﹖]|[．﹒](?:(?<!\p{Nd}[．﹒])|(?!\p{Nd}))"
    rf"|\.(?=[\s{CLOSERS}]|\z)(?<!\b(?i:{ABBREVIATIONS})\.))[{CLOSERS}]*)"
)

_INTS = T.ArrayType(T.IntegerType())
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _running(lists: pa.Array, step) -> pa.Array:
    """Lists of the same lengths, their values given by step(values, first place of each row, lengths); a null value is 0."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    out = step(values, starts[:-1], lengths) if len(values) else values
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out, pa.int32()), mask=lists.is_null() if lists.null_count else None)


def _sums(lists: pa.Array) -> pa.Array:
    def step(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return total[1:] - np.repeat(total[starts], lengths)

    return _running(lists, step)


def _maxima(lists: pa.Array) -> pa.Array:
    def step(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(lengths)) << 32, lengths)
        return np.maximum.accumulate(values + row) - row

    return _running(lists, step)


def _stretches(until: pa.Array, hit: pa.Array) -> pa.Array:
    """Where stretches of the lengths `hit` (those of length 0 left out) end, if each part up to one's end has length `until`."""
    ends, n = _sums(until), hit.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(until)), until.value_lengths().to_numpy(zero_copy_only=False))
    to, real = ends.flatten().to_numpy(zero_copy_only=False), n > 0
    spans = pa.StructArray.from_arrays([pa.array((to - n)[real], pa.int32()), pa.array(to[real], pa.int32())], ["start", "end"])
    counts = np.bincount(rows[real], minlength=len(until))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), spans)


def running_sum(values: Column) -> Column:
    """The sums of an int array up to each of its places; null stays null."""
    return F.arrow_udf(_sums, _INTS)(values)


def running_max(values: Column) -> Column:
    """The maxima of an int array, of values from 0, up to each of its places; null stays null."""
    return F.arrow_udf(_maxima, _INTS)(values)


def matches(text: Column, pattern: str, but_in: str | None = None) -> Column:
    """array<struct<start, end>> of a pattern's matches, in order; those that begin inside a match of but_in don't count.

    The pattern has no groups of its own but (?:...), and matches no empty text.
    """
    whole = F.lit(rf"(?sU)\G.*?(?:(?:{but_in})|({pattern}))" if but_in else rf"(?sU)\G.*?({pattern})")
    until, hit = (F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), whole, F.lit(k)), lambda s: F.length(s)) for k in (0, 1))
    return F.arrow_udf(_stretches, _SPANS)(until, hit)


def sentence_ends(text: Column) -> Column:
    """array<int> of the places where sentences end; a rest without a terminal ends none."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?sU)\G.*?(?:{SENTENCE_END})"), F.lit(0))
    return running_sum(F.transform(pieces, lambda s: F.length(s)))


def search_from(text: Column, start: Column) -> Column:
    """From where on a text is to be searched to find all of its sentence ends from start on: before closers that reach up
    to start, before their terminal and an abbreviation. What sentence_ends gives before start may be wrong then."""
    head = F.substr(text, F.lit(1), start)
    bare = F.when(F.substr(text, start, F.lit(1)).rlike(f"[{CLOSERS}]"), F.length(F.rtrim(head, F.lit(_CLOSERS)))).otherwise(start)
    return F.greatest(bare - REACH, F.lit(0))


def sentence_spans(text: Column) -> Column:
    """array<struct<start, end, text>> of the sentences, and of a rest without a terminal."""
    return spans_by(text, SENTENCE_END)


def spans_by(text: Column, end: str) -> Column:
    """array<struct<start, end, text>> of the parts of a text that end with a match of `end`, and of a rest without one, all
    without white space around; empty parts are left out. Joined with what lies between them they are the text."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?sU)\G(?:.*?(?:{end})|.+)"), F.lit(0))
    bare = lambda s: F.regexp_replace(s, r"(?U)^\s+", "")
    sized = F.transform(parts, lambda s: F.struct(F.length(s).alias("n"), (F.length(s) - F.length(bare(s))).alias("before"), F.regexp_replace(bare(s), r"(?U)\s+$", "").alias("text")))

    def span(e: Column, m: Column) -> Column:
        start = e - m["n"] + m["before"]
        return F.struct(start.alias("start"), (start + F.length(m["text"])).alias("end"), m["text"].alias("text"))

    spans = F.zip_with(running_sum(F.transform(sized, lambda m: m["n"])), sized, span)
    return F.filter(spans, lambda s: s["text"] != "")
