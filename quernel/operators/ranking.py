"""Diversity, interleaving and ordered duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that Catalyst expects to be smaller than this fit one task, whatever their groups.
ONE_TASK = 64 << 20


def running(rows: DataFrame, key: list[str], order: list[Column], sums: dict[str, Column], totals: str | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """rows with sums over the rows of their key up to and with their own; `totals`: a name for the key's number of rows.

    No task orders a whole key: rows are dealt to ranges of key and order, each range adds up its own, and the sums of
    the ranges before (a row per key and range) are added. The ranges are kept, so both steps see the same ones. A
    table that one task can hold takes a plain window, as Catalyst takes a broadcast for a small side.
    """
    upto = Window.unboundedPreceding, Window.currentRow
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < one_task:
        w = Window.partitionBy(*key)
        out = rows.withColumns({name: F.sum(c).over(w.orderBy(*order).rowsBetween(*upto)) for name, c in sums.items()})
        return out.withColumn(totals, F.count(F.lit(1)).over(w)) if totals else out
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *key, *order).withColumn("__p", F.spark_partition_id()).persist()
    parts = dealt.groupBy(*key, "__p").agg(F.count(F.lit(1)).alias("__c"), *[F.sum(c).alias(f"__s{i}") for i, c in enumerate(sums.values())])
    w = Window.partitionBy(*key)
    earlier = w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__p").alias("__q"), F.sum("__c").over(w).alias("__all"), *[F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    own = Window.partitionBy(*key, "__p").orderBy(*order).rowsBetween(*upto)
    met = F.col("__p") == F.col("__q")
    for i, k in enumerate(key):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    local = dealt.withColumns({f"__l{i}": F.sum(c).over(own) for i, c in enumerate(sums.values())})
    both = local.join(before, met).withColumns({name: F.col(f"__b{i}") + F.coalesce(f"__l{i}", F.lit(0)) for i, name in enumerate(sums)})
    return both.select(*rows.columns, *sums, *([F.col("__all").alias(totals)] if totals else []))


def ranked(rows: DataFrame, key: list[str], order: list[Column], into: str, one_task: int = ONE_TASK) -> DataFrame:
    """rows with their places in their key."""
    return running(rows, key, order, {into: F.lit(1)}, one_task=one_task).withColumn(into, F.col(into).cast("int"))


def diverse(rows: DataFrame, within: list[str], domain: str, score: str, ties: list[Column], penalty: float = 30.0, into: str = "place", one_task: int = ONE_TASK) -> DataFrame:
    """Greedy order in which each pick costs later rows of its domain `penalty`.

    For a penalty of at least 0 the greedy order has a closed form: the row that is the nth best of its domain
    competes with score - penalty * (n - 1).
    """
    own = ranked(rows, [*within, domain], [F.col(score).desc(), *ties], "__n", one_task)
    paid = own.withColumn("adjusted", F.round(F.col(score) - penalty * (F.col("__n") - 1), 6)).drop("__n")
    return ranked(paid, within, [F.col("adjusted").desc(), *ties], into, one_task)


def section_first(rows: DataFrame, within: list[str], section: str, order: list[Column], k: int) -> DataFrame:
    """First rows of every section in rank order, then the rest in rank order; k rows of each group. The order is total.

    Only heads are ordered across tasks: the first row of each section, k of them a group, and the k first rows of a group,
    among which lie all the others that can count, as each place before one of them is a place of the result too. Each task
    keeps no more than these of its rows before it hands them on.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    leaders = rows.withColumn("__s", place(*within, section)).filter("__s = 1")
    leaders = leaders.withColumn("__r", place(*within)).filter(F.col("__r") <= k)
    head = rows.withColumn("__r", place(*within)).filter(F.col("__r") <= k)
    others = head.withColumn("__s", place(*within, section)).filter("__s > 1")
    final = Window.partitionBy(*within).orderBy(F.col("__s") > 1, "__r")
    return leaders.unionByName(others).withColumn("place", F.row_number().over(final)).filter(F.col("place") <= k).drop("__r", "__s")


def round_robin(rows: DataFrame, within: list[str], item: str, position: str, lists: str, k: int) -> DataFrame:
    """Interleaves lists by position, the first place of each item kept; k items of each group."""
    rest = [c for c in rows.columns if c not in (*within, item)]
    first = rows.groupBy(*within, item).agg(F.min_by(F.struct(*rest), F.struct(position, lists)).alias("__x")).select(*within, item, *[F.col(f"__x.{c}").alias(c) for c in rest])
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(position, lists))).filter(F.col("place") <= k)


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last in order, without a sort: the greatest by order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*key, *[F.col(f"__x.{c}").alias(c) for c in rest])


def shards(rows: DataFrame, within: list[str], order: list[Column], n: int, into: str = "shard", one_task: int = ONE_TASK) -> DataFrame:
    """Even consecutive shards, the longer ones first."""
    placed = running(rows, within, order, {"__n": F.lit(1)}, "__all", one_task)
    short, longer = F.floor(F.col("__all") / n), F.col("__all") % n  # `longer` shards have a row more
    at = F.col("__n") - 1
    split = longer * (short + 1)
    shard = F.when(at < split, F.floor(at / (short + 1))).otherwise(longer + F.floor((at - split) / F.greatest(short, F.lit(1))))
    return placed.withColumn(into, (shard + 1).cast("int")).drop("__n", "__all")


def three_slots(rows: DataFrame, within: list[str], order: list[Column], reader: str, section: str, evidence: Column, pool: int = 6, third: int = 3) -> DataFrame:
    """The best row; the reader's choice among the next `pool`; of the next `third` left, evidence in an unused section first."""
    w = Window.partitionBy(*within)
    ranked = rows.withColumns({"__r": F.row_number().over(w.orderBy(*order)), "__e": F.coalesce(evidence, F.lit(False))})
    near = F.col("__r").between(2, pool + 1)
    chosen = ranked.withColumn("__c", near & (F.row_number().over(w.orderBy(near.desc(), F.col(reader).desc_nulls_last(), "__r")) == 1))
    used = [F.max(F.when(c, F.col(section))).over(w) for c in (F.col("__r") == 1, F.col("__c"))]
    rest = (F.col("__r") > 1) & ~F.col("__c")
    known = chosen.withColumns({"__q": F.sum(rest.cast("int")).over(w.orderBy("__r")), "__u": F.coalesce((F.col(section) == used[0]) | (F.col(section) == used[1]), F.lit(False)), "__rest": rest})
    open_to = F.col("__rest") & (F.col("__q") <= third)
    last = open_to & (F.row_number().over(w.orderBy(open_to.desc(), F.col("__e").desc(), "__u", "__r")) == 1)
    slot = F.when(F.col("__r") == 1, 1).when(F.col("__c"), 2).when(F.col("__t"), 3)
    return known.withColumn("__t", last).withColumn("slot", slot).filter("slot is not null").drop("__r", "__e", "__c", "__q", "__u", "__rest", "__t")


def limited(rows: DataFrame, order: list[Column], k: int, into: str = "rank") -> DataFrame:
    """The k first rows of all with their places: a top-k in every partition, then one of k rows each."""
    head = rows.orderBy(*order).limit(k)
    return head.withColumn(into, F.row_number().over(Window.orderBy(*order)))  # k rows
