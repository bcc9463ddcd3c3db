"""Scores of judged stages, gates and gains; a value that needs an unknown one is null."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def stage_scalar(parts: list[tuple[Column, float, Column]], auxiliary: Column, core_error: Column, step: float = 0.025) -> tuple[Column, Column]:
    """Score and status of a stage.

    parts: value, weight and whether it applies; the weights are shared anew over those that apply. The sign of the
    auxiliary score moves the mean by `step`, upwards only without a core error.
    """
    weight = sum((F.when(on, F.lit(w)).otherwise(0.0) for _, w, on in parts), F.lit(0.0))
    total = sum((F.when(on, v * w).otherwise(0.0) for v, w, on in parts), F.lit(0.0))
    core = F.round(total / F.nullif(weight, F.lit(0.0)), 6)
    move = F.when((auxiliary > 0) & core_error, 0.0).otherwise(F.signum(F.coalesce(auxiliary, F.lit(0.0))) * step)
    return F.round(clamp(core + move), 6), F.when(core.isNull(), "pending_core").otherwise("observed")


def grounded(wrong: Column, unknown: Column, citation: Column) -> Column:
    """0 for a wrong status, 1 for a rightly unknown one, else the citation's value."""
    return F.when(wrong, 0.0).when(unknown, 1.0).otherwise(citation)


def min_then_mean(rows: DataFrame, group: list[str], unit: Column, value: Column, into: str) -> DataFrame:
    """Mean over units of the least value of a unit; null if any value is."""
    least = rows.groupBy(*group, unit.alias("__u")).agg(F.when(F.count("*") == F.count(value), F.min(value)).alias("__v"))
    return least.groupBy(*group).agg(F.when(F.count("*") == F.count("__v"), F.round(F.avg("__v"), 6)).alias(into))


def conflicts(truth: Column, cited: Column, citation: Column) -> Column:
    """Whether all evidence of the truth is cited while the citation is judged below 1."""
    return (F.size(F.array_except(truth, cited)) == 0) & (citation < 1)


def weighted_slots(direct: Column, limited: Column) -> Column:
    """An aggregate: direct slots count 1, limited ones .5, as a part of all."""
    return F.round(F.sum(F.when(direct, 1.0).when(limited, 0.5).otherwise(0.0)) / F.count("*"), 6)


def trajectory_reward(coverage: Column, complete: Column, calls: Column, limit: int, penalty: float = 0.25) -> Column:
    """Coverage less a penalty where the call limit was reached in vain."""
    return F.round(coverage - F.when((calls >= limit) & ~complete, penalty).otherwise(0.0), 6)


def coverage_gain(before: DataFrame, after: DataFrame, key: list[str], item: str, value: str, weight: str) -> DataFrame:
    """Weighted sum of the positive changes of each key's items, and its status.

    An item that one side lacks or doesn't know makes the gain unobservable; a fall asks for a review.
    """
    b = before.select(*key, item, F.col(value).alias("__b"))
    both = after.select(*key, item, weight, F.col(value).alias("__a")).join(b, [*key, item], "full")
    d = F.col("__a") - F.col("__b")
    one = both.groupBy(*key).agg(F.sum(F.when(d > 0, d * F.col(weight)).otherwise(0.0)).alias("__g"), F.bool_or(d.isNull()).alias("__n"), F.bool_or(F.coalesce(d < 0, F.lit(False))).alias("__f"))
    status = F.when(F.col("__n"), "unobservable").when(F.col("__f"), "needs_review").when(F.col("__g") > 0, "observed_positive").otherwise("observed_zero")
    return one.select(*key, F.when(~F.col("__n"), F.round("__g", 6)).alias("gain"), status.alias("status"))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order, each once."""
    return F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in rules]), lambda x: x.isNotNull()))


def atomic_support(any_option: Column, outcome: Column, population: Column, complete: Column) -> Column:
    """Status of four answers: all null unknown, complete direct, some support partial, else none; some null, or complete without the others, is an error."""
    every = [any_option, outcome, population, complete]
    nulls = sum((c.isNull().cast("int") for c in every), F.lit(0))
    bad = nulls.between(1, 3) | (complete & ~(any_option & outcome & population))
    return F.when(nulls == 4, "unknown").when(bad, F.raise_error(F.lit("invalid combination of answers")).cast("string")).when(complete, "direct").when(outcome & (any_option | population), "partial").otherwise("none")


def graded(verdict: Column, values: dict[str, float | None]) -> Column:
    """A verdict's value; an unknown verdict is an error, a value of None null."""
    out = F.when(verdict.isNull(), F.lit(None).cast("double"))
    for name, value in values.items():
        out = out.when(verdict == name, F.lit(value).cast("double"))
    return out.otherwise(F.raise_error(F.concat(F.lit("verdict "), verdict)).cast("double"))


def stage_scores(rows: DataFrame, key: list[str], value: str, weight: str, listed: Column) -> DataFrame:
    """Per key the weighted mean (null if a value is), `complete`: whether all rows are listed, `material`: a value of 0."""
    w = F.col(weight)
    mean = F.when(F.count(value) == F.count("*"), F.sum(F.col(value) * w) / F.sum(w))
    return rows.groupBy(*key).agg(mean.alias("score"), F.bool_and(listed).alias("complete"), F.bool_or(F.coalesce(F.col(value) == 0, F.lit(False))).alias("material"))


def case_folded(text: Column) -> Column:
    """A text in compatibility form (NFKC) without case; texts of ASCII letters alone stay on the JVM."""
    plain = text.rlike(r"\A[\x00-\x7F]*\z")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in batch], dtype=object)

    return F.when(plain, F.lower(text)).otherwise(run(F.when(~plain, text)))


def dimension_scores(rows: DataFrame, key: str, text: str, verdict: str, values: dict[str, float], exempt: str) -> DataFrame:
    """Per key the mean over distinct texts of their least values; null if one isn't known. Texts are the same if they are in
    compatibility form, case and white space aside."""
    same = F.trim(F.regexp_replace(case_folded(F.col(text)), r"(?U)\s+", " "))
    value = F.coalesce(*[F.when(F.col(verdict) == name, F.lit(v)) for name, v in values.items()])
    own = rows.filter(F.col(verdict) != exempt).groupBy(key, same.alias("__t")).agg(F.when(F.count(value) == F.count("*"), F.min(value)).alias("__v"))
    return own.groupBy(key).agg(F.when(F.count("__v") == F.count("*"), F.avg("__v")).alias("score"))


def known_mean(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of those parts that aren't null; null without any."""
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)
