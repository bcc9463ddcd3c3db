"""Keyed state over logs: entries that expire, registries of the last record, digests and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def with_expiry(rows: DataFrame, key: str, time: str, order: str, ttl: int) -> DataFrame:
    """rows (key, time, order) with `hit`: whether an entry younger than ttl was stored; a miss stores a new one. Requests of
    the same time follow each other by `order`, of any type that can be sorted.

    Requests of a key that are more than ttl after the one before always miss, so a key's log is cut there first: the
    fold runs over each such session by itself, however long the key's whole log is.
    """
    w = Window.partitionBy(key).orderBy(time, order)
    fresh = F.coalesce(F.col(time) - F.lag(time).over(w) >= ttl, F.lit(True))
    cut = rows.select(key, time, order).withColumn("__n", F.sum(fresh.cast("int")).over(w))
    packed = cut.groupBy(key, "__n").agg(F.array_sort(F.collect_list(F.struct(time, order))).alias("__all"))
    kind = f"struct<stored:bigint,out:array<struct<{order}:{rows.schema[order].dataType.simpleString()},hit:boolean>>>"

    def step(state: Column, x: Column) -> Column:
        hit = F.coalesce(x[time] - state["stored"] < ttl, F.lit(False))
        return F.struct(F.when(hit, state["stored"]).otherwise(x[time]).alias("stored"), F.concat(state["out"], F.array(F.struct(x[order].alias(order), hit.alias("hit")))).alias("out")).cast(kind)

    start = F.struct(F.lit(None).cast("long").alias("stored"), F.array().alias("out")).cast(kind)
    return packed.select(key, F.explode(F.aggregate("__all", start, step)["out"]).alias("x")).select(key, f"x.{order}", "x.hit")


def upserted(rows: DataFrame, key: list[str], order: str, value: str, fixed: str) -> DataFrame:
    """The last value of each key, its place, and `mixed`: whether its versions disagree on `fixed`."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order), (F.min(fixed) != F.max(fixed)).alias("mixed"))


def packed_digest(order: str, part: Column) -> Column:
    """An aggregate: MD5 of a group's order:part pairs, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return F.md5(F.array_join(F.transform(pairs, lambda x: F.concat(x["o"].cast("string"), F.lit(":"), x["p"].cast("string"))), ";"))


def receipts(rows: DataFrame, key: str, order: str, kind: str, delivered: str, after: list[str]) -> DataFrame:
    """Deliveries whose preceding event of the key has one of the kinds `after`, each with a receipt."""
    before = F.lag(kind).over(Window.partitionBy(key).orderBy(order))
    seen = rows.withColumn("__before", before).filter((F.col(kind) == delivered) & F.col("__before").isin(after))
    return seen.withColumn("receipt", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col(order).cast("string")))).drop("__before")


def factored(rows: DataFrame, column: str, into: str) -> tuple[DataFrame, DataFrame]:
    """rows with a number in place of a repeated value, and the dictionary (number, value) that gives it back."""
    names = ranked(rows.select(column).distinct(), [], [F.col(column).asc()], into)
    return rows.join(names, column).drop(column), names.select(into, column)


def call_key(function: str, arguments: dict[str, Column], unused: tuple[str, ...] = ("timeout",)) -> Column:
    """MD5 of a function's name and its arguments in order of their names, those that don't change the result left out."""
    return F.md5(F.concat_ws("|", F.lit(function), *[arguments[k].cast("string") for k in sorted(arguments) if k not in unused]))


def unexpired(requests: DataFrame, stored: DataFrame, key: str, time: str, at: str, ttl: int) -> DataFrame:
    """requests with `hit`: whether an entry of the key was stored by then and less than ttl ago."""
    hit = (F.col(time) >= F.col(at)) & (F.col(time) - F.col(at) < ttl)
    return requests.join(stored.select(key, at), key, "left").withColumn("hit", F.coalesce(hit, F.lit(False)))


def attempts(rows: DataFrame, key: str, order: str, done: Column, most: int) -> DataFrame:
    """Per key how many of at most `most` attempts it took, and whether one was done."""
    first = rows.withColumns({"__n": F.row_number().over(Window.partitionBy(key).orderBy(order)), "__d": done}).filter(F.col("__n") <= most)
    ok = F.min(F.when(F.col("__d"), F.col("__n")))
    return first.groupBy(key).agg(F.coalesce(ok, F.lit(most)).cast("int").alias("attempts"), ok.isNotNull().alias("refreshed"))
