"""What a reader is shown: chunks packed under token and character budgets, and previews that begin with the best sentence.

Everything shown is a stretch of its source, found by its offsets; nothing is reworded. Tokens are counted by the
tokenizer that `by` names (see functions.counting).
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counting
from ..functions import places as P

#: How far a window may grow to a sentence's end, and the marks at which a text is cut if no sentence fits.
GROWTH = 600
CLAUSE = re.compile(r"[,，、;；:：]")

Counter = Callable[[str], int]

# --- packing


def longest_fit(n: int, fits: Callable[[int], bool]) -> int:
    """The greatest length up to n that fits, found by bisection; a length that bisection misjudged is shortened until it fits."""
    found = bisect.bisect_left(range(1, n + 1), True, key=lambda k: not fits(k))
    while found and not fits(found):
        found -= 1
    return found


def fitted(text: str, ends: Sequence[int], tokens: int, chars: int, count: Counter) -> str:
    """The text, or as much of it as fits: up to a sentence's end, else to a clause's, else to any character."""

    def fits(n: int) -> bool:
        return n <= chars and count(text[:n]) <= tokens

    if fits(len(text)):
        return text
    for stops in (ends, [m.end() for m in CLAUSE.finditer(text)]):
        n = next((n for n in reversed(stops) if fits(n)), 0)
        if n:
            return text[:n]
    return text[: longest_fit(min(len(text), chars), fits)]


def packed(parts: Sequence[Any], tokens: int, chars: int, count: Counter) -> list[dict]:
    """Each part's text cut to its fair share of what is left of the budgets: an even part of it for every part to come."""
    out = []
    for k, part in enumerate(parts):
        left = len(parts) - k
        token_cap, char_cap = (max(1, x // left) if x else 0 for x in (tokens, chars))
        text = fitted(part["window"], part["window_ends"], token_cap, char_cap, count) if token_cap and char_cap else ""
        reason = "kept" if text else "invalid_boundary_window" if tokens and chars else "budget_exhausted"
        out.append({"place": part["place"], "text": text, "reason": reason, "token_cap": token_cap, "character_cap": char_cap})
        tokens, chars = tokens - count(text), chars - len(text)
    return out


def aligned(chunks: DataFrame, section_text: str) -> DataFrame:
    """chunks with `window`, their text from start_char to a sentence's end in their span, its `window_end`, and whether it
    is `open`: does not begin or end at a sentence's end. A window grows by GROWTH characters at most, else it shrinks."""
    start, end, size, skipped = F.col("start_char"), F.col("end_char"), F.col("__length"), F.col("__skipped")
    found = chunks.withColumns({"__length": F.length(section_text), "__skipped": P.search_from(F.col(section_text), start)})
    # the character after the last end of interest decides on it
    found = found.withColumn("__near", F.substr(F.col(section_text), skipped + 1, end + GROWTH + 1 - skipped))
    found = found.withColumn("__ends", F.transform(P.sentence_ends(F.col("__near")), lambda p: p + skipped))
    inside = F.filter("__ends", lambda p: (p >= start) & p.between(F.col("span_start"), F.col("span_end")))
    found = found.withColumn("__ends", inside)
    stops = (end >= size) | F.array_contains("__ends", end)
    later = F.array_min(F.filter("__ends", lambda p: (p > end) & (p <= end + GROWTH)))
    earlier = F.array_max(F.filter("__ends", lambda p: (p > start) & (p <= end)))
    to = F.when(stops, end).otherwise(F.coalesce(later, earlier, end))
    begins = (start == 0) | F.array_contains("__ends", start)
    opened = ~begins | (~stops & later.isNull() & earlier.isNull())
    return found.select(*chunks.columns, to.alias("window_end"), opened.alias("open"), F.trim(F.substr("__near", start + 1 - skipped, to - start)).alias("window"))


def first_of_sections(ranked: DataFrame, key: list[str], top_k: int, section: str = "section_index", rank: str = "rank") -> DataFrame:
    """The top_k of each key, in `place` from 0: the best of each section by rank, then the others by rank."""
    nth = F.row_number().over(Window.partitionBy(*key, section).orderBy(rank))
    own = ranked.withColumn("__nth", nth).filter(F.col("__nth") <= top_k)  # a section's others come after top_k of its own
    order = Window.partitionBy(*key).orderBy((F.col("__nth") == 1).desc(), rank)
    best = own.withColumn("__row", F.row_number().over(order)).filter(F.col("__row") <= top_k)
    return best.withColumn("place", F.col("__row") - 1).drop("__nth", "__row")


_PACKED = "array<struct<place:int,text:string,reason:string,token_cap:int,character_cap:int>>"


def pack(ranked: DataFrame, sections: DataFrame, key: list[str], section_key: list[str], max_tokens: int = 700, max_chars: int = 4200, top_k: int = 3, by: str = counting.CHARACTERS) -> DataFrame:
    """What a reader is shown of ranked chunks, a row a chosen chunk, in `place`; a chunk that shows nothing keeps its row.

    ranked: key, section_key (ending in section_index), chunk_index, start_char, end_char, span_start, span_end, rank, a
    chunk once a key; other columns, such as its text, are carried along. sections: section_key, text. Only chosen chunks
    meet their section's text, and only what is near them is searched for sentence ends. Both budgets hold for
    each key's texts together. Columns: those of ranked, place, text, from start_char to text_end, reason (kept,
    budget_exhausted or invalid_boundary_window), token_cap, character_cap, and open: not whole sentences.
    """
    if min(max_tokens, max_chars, top_k) < 1:
        raise ValueError("budgets and top_k are 1 at least")
    chosen = first_of_sections(ranked, key, top_k).join(sections.select(*section_key, F.col("text").alias("__section")), section_key)
    windows = aligned(chosen.withColumn("__size", F.length("__section")), "__section").drop("__section")
    windows = windows.withColumn("window_ends", P.sentence_ends(F.col("window")))

    @F.pandas_udf(_PACKED)
    def cut(parts: pd.Series) -> pd.Series:
        count = counting.counter(by)
        return pd.Series([packed(sorted(p, key=lambda x: x["place"]), max_tokens, max_chars, count) for p in parts], dtype=object)

    own = F.struct("place", *[c for c in windows.columns if c not in {*key, "place"}])
    groups = windows.groupBy(*key).agg(F.collect_list(own).alias("__parts"))  # top_k parts at most
    done = groups.withColumn("__done", cut("__parts"))
    each = done.select(*key, F.explode(F.arrays_zip(F.array_sort("__parts").alias("p"), F.col("__done").alias("d"))).alias("__x"))
    rows = each.select(*key, *[F.col(f"__x.p.{c}").alias(c) for c in windows.columns if c not in key], F.col("__x.d.text").alias("text"), *[F.col(f"__x.d.{c}").alias(c) for c in ("reason", "token_cap", "character_cap")])
    whole = F.array_contains(P.sentence_ends(F.col("text")), F.length("text"))
    shortened = (F.length("text") < F.col("end_char") - F.col("start_char")) | (F.col("end_char") < F.col("__size"))
    opened = (F.col("open") & (F.col("window") != "")) | ((F.col("text") != "") & ~whole & shortened)
    return rows.withColumns({"open": opened, "text_end": F.col("start_char") + F.length("text")}).drop("window", "window_ends", "window_end", "__size")


# --- a reader's choice


def choice(reply: Column, count: Column, top_k: int) -> Column:
    """struct<indices, fault>: the places that a reader's reply chooses among `count` chunks, at most top_k, each once.

    The reply holds one object with selected_indices, whatever stands around it. Numbers are cut to whole ones, texts count
    if they are whole numbers, anything else and places out of range are passed over. A null reply is a reader that is off:
    the first top_k stand. Faults: no_selection without such a list, no_valid_index if nothing of it is left.
    """
    listed = F.try_variant_get(F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0)), "$.selected_indices", "array<variant>")

    def whole(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        said = F.try_variant_get(x, "$", "string")
        return F.when(kind == "STRING", F.when(said.rlike(r"\A\s*[+-]?\d{1,9}\s*\z"), F.trim(said).cast("int"))).when(kind != "BOOLEAN", F.try_variant_get(x, "$", "double").cast("int"))

    kept = F.filter(F.array_distinct(F.transform(listed, whole)), lambda i: (i >= 0) & (i < count))
    first = F.filter(F.transform(F.array(*[F.lit(k) for k in range(top_k)]), lambda k: F.when(k < count, k)), lambda k: k.isNotNull())
    indices = F.when(reply.isNull(), first).otherwise(F.slice(F.coalesce(kept, F.array().cast("array<int>")), 1, top_k))
    fault = F.when(reply.isNull(), F.lit(None).cast("string")).when(listed.isNull(), "no_selection").when(F.size(indices) == 0, "no_valid_index")
    return F.struct(indices.alias("indices"), fault.alias("fault"))


def chosen(ranked: DataFrame, replies: DataFrame, key: list[str], rank: str = "rank", reply: str = "reply", top_k: int = 3) -> DataFrame:
    """The rows of ranked that their key's reply chooses, in `place` from 0, in the reply's order; `fault` on a key's only
    row, without a place, where the reply chooses nothing. Places count from 0 in order of rank, which is distinct in a key.
    A key without a reply has a reader that is off."""
    counts = ranked.groupBy(*key).agg(F.count("*").alias("__n"))
    told = counts.join(replies.select(*key, F.col(reply).alias("__reply")), key, "left").select(*key, choice(F.col("__reply"), F.col("__n"), top_k).alias("__c"))
    own = ranked.withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(rank)) - 1).join(told, key)
    at = F.array_position("__c.indices", F.col("__i")).cast("int") - 1
    return own.withColumns({"place": F.when(at >= 0, at), "fault": F.col("__c.fault")}).filter("place is not null or (fault is not null and __i = 0)").drop("__i", "__c")


# --- previews

#: Where a preview's sentences end, the abbreviations that end none, and the weights of question and focus.
PREVIEW_END = r"(?<!\b(?i:e\.g|i\.e|vs|al|Dr|Fig))\.(?=\s|\z)|[!?。！？](?=\s|\z)"
QUESTION_WEIGHT, FOCUS_WEIGHT = 0.7, 0.3


def _clipped(text: str, start: int, end: int, ceiling: int, count: Counter) -> int:
    """Where to end a stretch that is too long: before a word that doesn't fit, and not inside brackets if some were closed."""
    to = start + longest_fit(end - start, lambda n: count(text[start : start + n]) <= ceiling)
    space = text.rfind(" ", start, to)
    to = space if space > start else to
    part = text[start:to]
    closed = part.rfind(")")
    return start + closed + 1 if part.count("(") > part.count(")") and closed > 0 else to


def previewed(text: str, spans: Sequence[Any], target: int, ceiling: int, count: Counter) -> dict:
    """The spans (start, end, score) shown of a text: the best, then the next best while under the target, each if it fits
    the ceiling with the others; in the text's order. `cut` says that the best one was too long and is clipped."""
    if not text or ceiling <= 0:
        return {"spans": [], "shown": "", "cut": bool(text)}
    if count(text) <= ceiling:
        return {"spans": [{"start": 0, "end": len(text)}], "shown": text, "cut": False}
    shown = lambda some: " ".join(text[a:b] for a, b in sorted(some))
    ranked = [(s["start"], s["end"]) for s in sorted(spans, key=lambda s: (-s["score"], s["start"]))]
    best, chosen, cut = ranked[0], ranked[:1], False
    if count(text[slice(*best)]) > ceiling:
        chosen, cut = [(best[0], _clipped(text, *best, ceiling, count))], True
    else:
        for span in ranked[1:]:
            if count(shown(chosen)) >= target:
                break
            if count(shown([*chosen, span])) <= ceiling:
                chosen.append(span)
    return {"spans": [{"start": a, "end": b} for a, b in sorted(chosen)], "shown": shown(chosen), "cut": cut}


_PREVIEW = "struct<spans:array<struct<start:int,end:int>>,shown:string,cut:boolean>"


def preview(rows: DataFrame, text: str, score: Callable[[Column], Column], target: int = 96, ceiling: int = 128, by: str = counting.CHARACTERS, end: str = PREVIEW_END) -> DataFrame:
    """rows with `preview`, struct<spans, shown, cut>: the sentences of the text (white space compacted) that score gives most,
    within `ceiling` tokens; a sentence ends with a match of `end`. Never empty for a text with anything in it, if the ceiling lets one token through."""
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "))
    parts = rows.withColumn("__flat", flat).withColumn("__spans", P.spans_by(F.col("__flat"), end))
    scored = F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), score(s["text"]).cast("double").alias("score")))

    @F.pandas_udf(_PREVIEW)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        count = counting.counter(by)
        for texts, lists in batches:
            yield pd.DataFrame([previewed(t, s, target, ceiling, count) for t, s in zip(texts, lists, strict=True)], columns=["spans", "shown", "cut"])

    return parts.select(*rows.columns, run("__flat", scored).alias("preview"))


def weighted(question: Column, focus: Column, terms: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A score of sentences: the shares of the question's and of the focus' terms that they have, weighted; without a
    question the number of the focus' terms."""
    asked, wanted = terms(question), terms(focus)

    def score(sentence: Column) -> Column:
        own = terms(sentence)
        share = lambda x: F.size(F.array_intersect(own, x)) / F.greatest(F.size(x), F.lit(1))
        both = QUESTION_WEIGHT * share(asked) + FOCUS_WEIGHT * share(wanted)
        return F.when(F.size(asked) > 0, both).otherwise(F.size(F.array_intersect(own, wanted)).cast("double"))

    return score
