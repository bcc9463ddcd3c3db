"""Selection under budgets of characters, items and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ONE_TASK, running


def prefix_budget(rows: DataFrame, key: list[str], order: list[str], size: str, total: int, each: int | None = None, into: str = "granted", one_task: int = ONE_TASK) -> DataFrame:
    """What each row gets, in order, of a total per key and at most `each` per row: a running sum, no fold."""
    capped = F.least(F.col(size), F.lit(each)) if each else F.col(size)
    upto = running(rows, key, order, {"__upto": F.coalesce(capped, F.lit(0))}, one_task=one_task)
    before = F.col("__upto") - F.coalesce(capped, F.lit(0))
    return upto.withColumn(into, F.least(capped, F.greatest(F.lit(0), F.lit(total) - before)).cast("long")).drop("__upto")


def fair_share(rows: DataFrame, key: list[str], order: str, size: str, total: int) -> DataFrame:
    """Grants in order, each at most max(1, what is left // rows left) and its size: a fold over a bounded group.

    Each step depends on what earlier rows left unused, so there is no closed form; the fold runs inside one array
    expression per group.
    """
    packed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(size).alias("s")))).alias("__all"))
    kind = f"struct<left:bigint,n:bigint,out:array<struct<{order}:bigint,granted:bigint>>>"
    start = F.struct(F.lit(total).cast("long").alias("left"), F.size("__all").cast("long").alias("n"), F.array().alias("out")).cast(kind)

    def step(state, x):
        cap = F.greatest(F.lit(1), F.floor(state["left"] / state["n"]))
        own = F.least(F.least(cap, x["s"]), state["left"]).cast("long")
        return F.struct((state["left"] - own).alias("left"), (state["n"] - 1).alias("n"), F.concat(state["out"], F.array(F.struct(x[order].cast("long").alias(order), own.alias("granted")))).alias("out")).cast(kind)

    return packed.select(*key, F.explode(F.aggregate("__all", start, step)["out"]).alias("__x")).select(*key, f"__x.{order}", "__x.granted")


def whole_chunks(rows: DataFrame, key: list[str], document: str, order: str, text: str, documents: int = 6, chunks: int = 3, total: int = 2400) -> DataFrame:
    """Whole chunks of the first documents of a key: the first chunks of each that fit what is left of `total`.

    Chunks of a document that are equal but for white space count once. At most `chunks` sizes of a document are
    folded, so the fold is bounded however many rows a key has. Blank texts take no part.
    """
    flat = F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))
    given = rows.filter(flat != "").select(*key, document, order, F.length(text).cast("long").alias("__s"), F.md5(flat).alias("__k"))
    once = given.groupBy(*key, document, "__k").agg(F.min_by(F.struct(order, "__s"), order).alias("__x")).select(*key, document, F.col(f"__x.{order}"), F.col("__x.__s"))
    own = once.withColumn("__n", F.row_number().over(Window.partitionBy(*key, document).orderBy(order))).filter(F.col("__n") <= chunks)
    packed = own.groupBy(*key, document).agg(F.array_sort(F.collect_list(F.struct(order, F.col("__s").alias("s")))).alias("__all"))
    packed = packed.withColumn("__p", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("__all")[0][order], document))).filter(F.col("__p") <= documents)
    kind = f"struct<left:bigint,out:array<{once.schema[order].dataType.simpleString()}>>"

    def step(state, x):
        fits = x["s"] <= state["left"]
        return F.struct(F.when(fits, state["left"] - x["s"]).otherwise(state["left"]).alias("left"), F.when(fits, F.concat(state["out"], F.array(x[order]))).otherwise(state["out"]).alias("out"))

    folded = F.aggregate("__all", F.struct(F.lit(total).cast("long").alias("left"), F.array().alias("out")).cast(kind), step)
    return packed.select(*key, document, F.explode(folded["out"]).alias(order))
