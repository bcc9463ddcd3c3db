"""Ordered checks and edits of logs: continuity, terminal order, histories, gaps between spans, best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def broken_chain(rows: DataFrame, key: list[str], order: list[str], before: str, after: str) -> DataFrame:
    """Rows whose `before` isn't the previous row's `after`; a key's first row is whole."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumns({"expected": F.lag(after).over(w), "__n": F.row_number().over(w)})
    return marked.filter((F.col("__n") > 1) & ~F.col(before).eqNullSafe(F.col("expected"))).drop("__n")


def terminal_order(rows: DataFrame, key: list[str], order: str, final: Column, stop: Column) -> DataFrame:
    """Rows after a final one, and rows after a stop that aren't final."""
    earlier = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.coalesce(F.max(c.cast("int")).over(earlier), F.lit(0)) for c in (final, stop)]
    marked = rows.withColumns({"__f": seen[0], "__s": seen[1], "__is": final})
    why = F.when(F.col("__f") == 1, "after_final").when((F.col("__s") == 1) & ~F.col("__is"), "after_stop")
    return marked.withColumn("violation", why).drop("__f", "__s", "__is").filter("violation is not null")


def first_seen(rows: DataFrame, key: list[str], order: str, content: Column, into: str = "is_new") -> DataFrame:
    """Whether no earlier row of the key has the same content; `order` is never null and names a row of the key.

    Firsts are pre-aggregated in every task, so a content of very many rows is ordered nowhere.
    """
    first = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], content.alias("__c")).agg(F.min(order).alias("__first"))
    met = F.col("__own").eqNullSafe(F.col("__c"))
    for i, k in enumerate(key):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.withColumn("__own", content).join(first, met).select(*rows.columns, (F.col(order) == F.col("__first")).alias(into))


def merged_history(rows: DataFrame, key: list[str], order: str, fields: list[str], listed: str) -> DataFrame:
    """Per key the last known value of each field, and the distinct values of `listed` in order of appearance."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    firsts = rows.groupBy(*key, listed).agg(F.min(order).alias("__o"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("__o", F.col(listed).alias("v")))), lambda x: x["v"])
    return rows.groupBy(*key).agg(*last).join(firsts.filter(F.col(listed).isNotNull()).groupBy(*key).agg(names.alias(listed)), key, "left")


def gaps(spans: DataFrame, key: list[str], start: str, end: str, low: int, high: int) -> DataFrame:
    """The maximal gaps that a key's spans leave in [low, high): one window over the spans in order."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.greatest(F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(low)), F.lit(low))
    seen = spans.select(*key, start, end, reach.alias("__r"), F.lead(start).over(w).isNull().alias("__last"))
    tail = F.when(F.col("__last"), F.struct(F.greatest("__r", end).alias("a"), F.lit(high).alias("b")))
    parts = F.filter(F.array(F.struct(F.col("__r").alias("a"), F.least(F.col(start), F.lit(high)).alias("b")), tail), lambda x: x.isNotNull() & (x["a"] < x["b"]))
    return seen.select(*key, F.explode(parts).alias("x")).select(*key, F.col("x.a").alias("gap_start"), F.col("x.b").alias("gap_end"))


def best_match(claims: DataFrame, candidates: DataFrame, key: list[str], claim: str, candidate: str, words: str) -> DataFrame:
    """Each claim's candidate of the same key that shares the most words; null where several do, or none shares any.

    A candidate must have every number of the claim. Rows meet on shared words only, never as all pairs of a key.
    """
    number = "^[0-9]+$"
    left = claims.select(*key, claim, F.size(F.filter(words, lambda x: x.rlike(number))).alias("__need"), F.explode(words).alias("__t"))
    right = candidates.select(*key, candidate, F.explode(words).alias("__t"))
    met = left.join(right, [*key, "__t"]).groupBy(*key, claim, candidate).agg(F.count("*").alias("__n"), F.sum(F.col("__t").rlike(number).cast("int")).alias("__has"), F.first("__need").alias("__need"))
    level = met.filter("__has = __need").groupBy(*key, claim, "__n").agg(F.count("*").alias("__ties"), F.min(candidate).alias(candidate))
    best = level.groupBy(*key, claim).agg(F.max_by(F.struct("__ties", candidate), "__n").alias("__x"))
    found = best.select(*key, claim, F.when(F.col("__x.__ties") == 1, F.col(f"__x.{candidate}")).alias(candidate))
    return claims.select(*key, claim).join(found, [*key, claim], "left")


def with_rationales(log: DataFrame, key: list[str], order: str, is_call: Column, is_message: Column) -> DataFrame:
    """A row before each call that no message precedes; `place` orders the result, `inserted` marks the new rows."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = log.withColumn("__need", is_call & ~F.coalesce(F.lag(is_message).over(w), F.lit(False)))
    places = F.when(F.col("__need"), F.array(F.struct((2 * F.col(order) - 1).alias("p"), F.lit(True).alias("i")), F.struct((2 * F.col(order)).alias("p"), F.lit(False).alias("i")))).otherwise(F.array(F.struct((2 * F.col(order)).alias("p"), F.lit(False).alias("i"))))
    return marked.withColumn("__x", F.explode(places)).withColumns({"place": F.col("__x.p"), "inserted": F.col("__x.i")}).drop("__x", "__need")


def fused_head(rows: DataFrame, within: list[str], model: list[Column], value: list[Column], head: int = 10) -> DataFrame:
    """The first `head` rows by model in order of 1 / (20 + model rank) + 1.1 / (20 + value rank), the rest unchanged."""
    both = ranked(ranked(rows, within, model, "__m"), within, value, "__v")
    score = F.when(F.col("__m") <= head, F.round(1.0 / (20 + F.col("__m")) + 1.1 / (20 + F.col("__v")), 6))
    scored = both.withColumn("fused", score)
    first = scored.filter(F.col("__m") <= head).withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(F.col("fused").desc(), "__m")))
    return first.union(scored.filter(F.col("__m") > head).withColumn("place", F.col("__m"))).drop("__m", "__v")


def coverage_chain(rows: DataFrame, key: list[str], order: str, level: str) -> DataFrame:
    """The level that each row finds and leaves: a status never falls, null leaves it as it was."""
    w = Window.partitionBy(*key).orderBy(order)
    upto = F.max(level).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.max(level).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"level_before": F.coalesce(before, F.lit(0)), "level_after": F.coalesce(upto, F.lit(0))})


def tool_credit(rows: DataFrame, key: list[str], order: str, covered: Column, repeated: Column, failed: Column) -> DataFrame:
    """-.5 for a repeated action, -.25 for a failed one or one after full coverage, else 0."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(covered.cast("int")).over(before), F.lit(0)) == 1
    return rows.withColumn("credit", F.when(repeated, -0.5).when(failed | done, -0.25).otherwise(0.0))


def masked_labels(ids: Column, boundary: Column) -> Column:
    """Ids as labels, -100 before the boundary."""
    return F.transform(ids, lambda x, i: F.when(i < boundary, F.lit(-100)).otherwise(x))
