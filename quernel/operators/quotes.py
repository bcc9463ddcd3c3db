"""Quotes and their sources: the exact stretch of a source that a quote stands for, and answers checked against both."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that are written in several ways.
SINGLE_QUOTES, DOUBLE_QUOTES, DASHES = "‘’", "“”", "‐‑‒–—―"
_ALIKE = str.maketrans(dict.fromkeys(SINGLE_QUOTES, "'") | dict.fromkeys(DOUBLE_QUOTES, '"') | dict.fromkeys(DASHES, "-"))


@lru_cache(maxsize=1 << 16)
def _forms(c: str) -> str:
    return unicodedata.normalize("NFKC", c).translate(_ALIKE)


def folded(text: str) -> tuple[str, list[int]]:
    """A text in compatibility form, with plain quotes and dashes and single spaces, none around; and for each of its
    characters the place in the text of the one that it comes from."""
    out, at = [], []
    for k, c in enumerate(text):
        for x in _forms(c):
            if not x.isspace():
                out.append(x)
                at.append(k)
            elif out and out[-1] != " ":
                out.append(" ")
                at.append(k)
    if out and out[-1] == " ":
        del out[-1], at[-1]
    return "".join(out), at


def _slice(source: str | None, quote: str | None) -> str | None:
    if not source or not quote:
        return None
    (whole, at), (part, _) = folded(source), folded(quote)
    k = whole.find(part) if part else -1
    return None if k < 0 else source[at[k] : at[k + len(part) - 1] + 1]


def exact_slice(source: Column, quote: Column) -> Column:
    """The stretch of source that quote stands for, the first if there are several: the same text, or the same but for
    compatibility forms, quotes, dashes and white space; null if there is none, or quote is blank.

    Quotes that the source holds as they are never leave the JVM.
    """
    same = F.coalesce((quote != "") & F.contains(source, quote), F.lit(False))

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, quotes in parts:
            yield pd.Series([_slice(s, q) for s, q in zip(sources, quotes, strict=True)], dtype=object)

    return F.when(same, quote).otherwise(run(F.when(~same, source), F.when(~same, quote)))


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def verification_faults(answers: DataFrame, slots: DataFrame, sources: DataFrame, key: list[str], slot: str = "slot_id", quote: str = "quote", text: str = "text") -> DataFrame:
    """key and fault of the answers that can't be taken: duplicate_slots, slots_incomplete or quote_absent, the first that holds.

    answers: key, slot, quote, a row a slot answered; slots: key, slot, what was asked; sources: key, text, one row a key.
    Each slot is answered once, nothing else is, and a quote that isn't blank stands in the key's source but for white
    space. A key with slots and no answers is incomplete; an answer to no slot at all too. A quote without a source is absent.
    """
    asked = slots.select(*key, slot).distinct().withColumn("__asked", F.lit(1))
    given = answers.groupBy(*key, slot).agg(F.count("*").alias("__given"))
    by_slot = asked.join(given, [*key, slot], "full").groupBy(*key)
    counted = by_slot.agg(F.coalesce(F.max("__given"), F.lit(0)).alias("__most"), F.bool_or(F.col("__asked").isNull() | F.col("__given").isNull()).alias("__open"))
    said = answers.select(*key, spaced(F.col(quote)).alias("__quote")).filter("__quote <> ''")
    held = said.join(sources.select(*key, spaced(F.col(text)).alias("__text")), key, "left")
    absent = held.filter(~F.coalesce(F.contains("__text", "__quote"), F.lit(False))).select(*key).distinct().withColumn("__absent", F.lit(True))
    fault = F.when(F.col("__most") > 1, "duplicate_slots").when(F.col("__open"), "slots_incomplete").when(F.col("__absent"), "quote_absent")
    return counted.join(absent, key, "left").select(*key, fault.alias("fault")).filter("fault is not null")
