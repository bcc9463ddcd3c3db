"""Null-aware means, returns, advantages, credit and policy loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column | float = 1.0) -> Column:
    """An aggregate: sum(w v) / sum(w); null if any value is, or none is there, or the weights sum to 0."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.when((F.count(F.lit(1)) == F.count(value)) & (F.count(F.lit(1)) > 0), F.sum(w * value) / F.nullif(F.sum(w), F.lit(0.0)))


def return_to_go(rows: DataFrame, key: list[str], order: list[str], value: str, skipped: Column, into: str = "return_to_go") -> DataFrame:
    """Sum of a row's and all later values; an unknown value makes it and every earlier row null, a skipped row counts 0."""
    after = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    unknown = F.max((F.col(value).isNull() & ~skipped).cast("int")).over(after)
    return rows.withColumn(into, F.when(unknown == 0, F.round(F.sum(F.when(skipped, 0.0).otherwise(F.col(value))).over(after), 6)))


def running_count(rows: DataFrame, key: list[str], order: list[str], flag: Column, into: str) -> DataFrame:
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(into, F.sum(flag.cast("long")).over(before))


def leave_one_out(rows: DataFrame, group: list[str], member: str, value: str) -> DataFrame:
    """Own mean less the mean of the other members' means; null without others. Two aggregations, one row a member."""
    own = rows.groupBy(*group, member).agg(F.avg(value).alias("own_mean"))
    of = Window.partitionBy(*group)
    n, total = F.count("own_mean").over(of), F.sum("own_mean").over(of)
    return own.withColumn("advantage", F.when(n > 1, F.round(F.col("own_mean") - (total - F.col("own_mean")) / (n - 1), 6)))


def discounted_return(rows: DataFrame, key: list[str], order: list[str], value: str, gamma: float = 0.9, clip: float = 1.0, into: str = "discounted") -> DataFrame:
    """Per key the discounted return of its first row, clipped: a fold over the key's values in order."""
    folded = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))).alias("__all"))
    total = F.aggregate(F.reverse("__all"), F.lit(0.0), lambda s, x: F.coalesce(x["__v"], F.lit(0.0)) + gamma * s)
    return folded.select(*key, F.round(F.greatest(F.lit(-clip), F.least(F.lit(clip), total)), 6).alias(into))


def group_gate(rows: DataFrame, group: list[str], member: str, needed: int, value: str) -> DataFrame:
    """Groups with exactly `needed` members, all values known."""
    counted = rows.groupBy(*group).agg(F.count_distinct(member).alias("members"), F.bool_and(F.col(value).isNotNull()).alias("whole"))
    return counted.withColumn("admitted", (F.col("members") == needed) & F.col("whole"))


def split_credit(links: DataFrame, item: str, origin: str, weight: str) -> DataFrame:
    """Each item's weight split evenly over its distinct origins, summed by origin."""
    pairs = links.groupBy(item, origin).agg(F.max(weight).alias("__w"))
    share = pairs.groupBy(F.col(item).alias("__i")).agg(F.count("*").alias("__n"))
    both = pairs.join(share, F.col(item) == F.col("__i"))
    return both.groupBy(origin).agg(F.round(F.sum(F.col("__w") / F.col("__n")), 6).alias("credit"))


def first_cover(rows: DataFrame, slot: list[str], decision: str, passes: Column) -> DataFrame:
    """The first decision that covers each slot."""
    return rows.filter(passes).groupBy(*slot).agg(F.min(decision).alias("covered_by"))


def clipped_loss(rows: DataFrame, key: list[str], current: str, old: str, advantage: str, epsilon: float = 0.2) -> DataFrame:
    """Clipped policy loss, k3 divergence and the part of clipped tokens; a log-ratio beyond 20 is an error."""
    delta = F.col(current) - F.col(old)
    safe = F.when(F.abs(delta) > 20, F.raise_error(F.lit("log-ratio out of range")).cast("double")).otherwise(delta)
    ratio = F.exp(safe)
    a = F.col(advantage)
    bounded = F.least(F.greatest(ratio, F.lit(1 - epsilon)), F.lit(1 + epsilon))
    return rows.groupBy(*key).agg(
        F.round(-F.avg(F.least(ratio * a, bounded * a)), 6).alias("loss"),
        F.round(F.avg(ratio - 1 - safe), 6).alias("kl"),
        F.round(F.avg((ratio != bounded).cast("double")), 6).alias("clip_fraction"),
    )
