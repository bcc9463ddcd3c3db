"""Sentences, greedy choices under a budget, and caps over groups of previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Caps of a preview that are tried in turn.
CAPS = [96, 80, 64, 48, 32, 16, 0]


def sentences(text: Column) -> Column:
    """Sentences of a text with white space compacted: cut after . ! ? before a space."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+", " "))
    return F.filter(F.split(F.regexp_replace(flat, "([.!?]) ", "$1\n"), "\n"), lambda s: s != "")


def words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def greedy(items: Column, budget: Column, until: Column | None = None, extra: int = 0) -> Column:
    """Places (in the text's order) of the items that fit.

    items: array<struct<sort..., place int, cost int>> in order of preference. An item is taken if its cost (and `extra`)
    still fits the budget; once the cost taken reaches `until`, nothing more is. One bounded array a row, folded on the JVM.
    """
    start = F.struct(F.lit(0).cast("int").alias("used"), F.array().cast("array<int>").alias("taken"))

    def take(state: Column, x: Column) -> Column:
        cost = state["used"] + x["cost"] + extra
        fits = cost <= budget if until is None else (cost <= budget) & (state["used"] < until)
        return F.struct(F.when(fits, cost).otherwise(state["used"]).cast("int").alias("used"), F.when(fits, F.concat(state["taken"], F.array(x["place"]))).otherwise(state["taken"]).alias("taken"))

    return F.array_sort(F.aggregate(items, start, take)["taken"])


def preferred(parts: Column, score, first_kept: bool = False) -> Column:
    """The items of greedy() for sentences: by falling score, then by place; first_kept: the first sentence leads."""
    scored = F.transform(parts, lambda s, i: F.struct((F.when(i == 0, -1e9).otherwise(-score(s)) if first_kept else -score(s)).alias("s"), i.alias("place"), words(s).cast("int").alias("cost")))
    return F.array_sort(scored)


def joined(parts: Column, places: Column, between: str = " ") -> Column:
    return F.array_join(F.transform(places, lambda i: F.get(parts, i)), between)


def first_cap(rows: DataFrame, key: str, cost: str, most: int, total: int, per_group: int) -> DataFrame:
    """rows with `cap`: the group's first of CAPS under which its costs sum to at most `total`; costs have at most
    min(most, per_group // rows of the group) to begin with."""
    n = rows.groupBy(key).agg(F.count("*").alias("__n"))
    share = F.least(F.lit(most), F.floor(F.lit(per_group) / F.col("__n"))).cast("int")
    given = rows.join(n, key).withColumn("ceiling", F.least(F.col(cost), share))
    tried = [F.sum(F.least("ceiling", F.lit(c))).alias(f"__{c}") for c in [most, *CAPS]]
    sums = given.groupBy(key).agg(*tried)
    cap = F.coalesce(*[F.when(F.col(f"__{c}") <= total, F.lit(c)) for c in [most, *CAPS]])
    return given.join(sums.select(key, cap.alias("cap")), key).drop("__n")


def shrunk(costs: Column, limit: int, step: int = 16, rounds: int = 128) -> Column:
    """Costs with the greatest (the first of equals) reduced by `step` until their sum is at most limit; null if never."""

    def once(c: Column, _: Column) -> Column:
        at = F.array_position(c, F.array_max(c)).cast("int") - 1
        less = F.transform(c, lambda x, i: F.when(i == at, F.greatest(x - step, F.lit(0))).otherwise(x))
        return F.when(total(c) <= limit, c).otherwise(less)

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0), lambda a, x: a + x)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), costs, once)
    return F.when(total(out) <= limit, out)


def compacted(rows: DataFrame, key: str, order: str, kind: str, size: str, soft: int, snippet: int, older: int) -> DataFrame:
    """rows with `kept`: sizes cut in stages, each only while the key's total is over `soft`.

    First search rows to `snippet`, then browse rows but the last to `older`, then thoughts but the last to nothing.
    """
    last = F.row_number().over(Window.partitionBy(key, kind).orderBy(F.col(order).desc())) == 1
    marked = rows.withColumn("__last", last)
    one = F.when(F.col(kind) == "search", F.least(F.col(size), F.lit(snippet))).otherwise(F.col(size))
    two = F.when((F.col(kind) == "browse") & ~F.col("__last"), F.least(one, F.lit(older))).otherwise(one)
    three = F.when((F.col(kind) == "thought") & ~F.col("__last"), F.lit(0)).otherwise(two)
    marked = marked.withColumns({"__0": F.col(size), "__1": one, "__2": two, "__3": three})
    totals = marked.groupBy(key).agg(*[F.sum(f"__{k}").alias(f"__t{k}") for k in range(3)])
    stage = F.when(F.col("__t0") <= soft, 0).when(F.col("__t1") <= soft, 1).when(F.col("__t2") <= soft, 2).otherwise(3)
    both = marked.join(totals, key).withColumn("stage", stage)
    kept = F.element_at(F.array("__0", "__1", "__2", "__3"), F.col("stage") + 1)
    return both.withColumn("kept", kept).drop("__last", *[f"__{k}" for k in range(4)], *[f"__t{k}" for k in range(3)])


def line_sentences(text: Column) -> Column:
    """Sentences of a text in which a line end also ends one."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?]) ", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")
