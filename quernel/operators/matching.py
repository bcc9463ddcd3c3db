"""Joins over ordered logs, intervals, ledgers and repeated actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_calls(log: DataFrame, key: list[str], order: str, is_call: Column, is_output: Column) -> DataFrame:
    """Each call with the place of the first output before the next call; null if there is none."""
    after = Window.partitionBy(*key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    found = log.withColumns({"__out": F.min(F.when(is_output, F.col(order))).over(after), "__call": F.min(F.when(is_call, F.col(order))).over(after)})
    return found.filter(is_call).withColumn("output_at", F.when(F.col("__call").isNull() | (F.col("__out") < F.col("__call")), F.col("__out"))).drop("__out", "__call")


def overlapping(tokens: DataFrame, spans: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Pairs of a token and a span of the same record that overlap: a range join on buckets of `width` places.

    tokens: key, t_start, t_end; spans: key, s_start, s_end. Both sides meet only in shared buckets, and a pair that
    shares several is kept in the first.
    """

    def dealt(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
        return rows.filter(F.col(a) < F.col(b)).withColumn(name, F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))))

    left, right = dealt(tokens, "t_start", "t_end", "__b"), dealt(spans, "s_start", "s_end", "__c").withColumnRenamed(key, "__k")
    met = left.join(right, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__c")) & (F.col("t_start") < F.col("s_end")) & (F.col("t_end") > F.col("s_start")))
    return met.filter(F.col("__b") == F.floor(F.greatest("t_start", "s_start") / width)).drop("__b", "__c", "__k")


def missing(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of left whose key right lacks."""
    return left.join(right.select(*key), key, "left_anti")


def ledger_violations(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Keys of an append-only ledger that the new snapshot dropped or changed."""
    joined = old.select(key, F.col(content).alias("__o")).join(new.select(key, F.col(content).alias("__n"), F.lit(True).alias("__in")), key, "left")
    why = F.when(F.col("__in").isNull(), "dropped").when(~F.col("__o").eqNullSafe(F.col("__n")), "changed")
    return joined.select(key, why.alias("violation")).filter("violation is not null")


def near_actions(log: DataFrame, key: list[str], order: str, words: Column, at_least: float = 0.85) -> DataFrame:
    """Rows whose token set is near that of an earlier row of the same key; a count of such rows.

    Two sets this near share a token among the first n - ceil(at_least * n) + 1 of each in any common order. Long
    tokens come first, as they are rare: rows are joined on these few only, then whole sets are compared. Rows without
    tokens match each other. Key and order name a row.
    """
    named = log.select(*key, order, words.alias("__w")).persist()  # read four times: tokenised once
    by_length = F.sort_array(F.transform("__w", lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    n = F.size("__w")
    lead = F.slice(by_length, F.lit(1), (n - F.ceil(at_least * n - 1e-9) + 1).cast("int"))
    each = named.select(*key, order, n.alias("__n"), F.explode(F.when(n > 0, F.transform(lead, lambda x: x["w"])).otherwise(F.array(F.lit("")))).alias("__t"))
    other = each.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(order).alias("__o"), F.col("__n").alias("__m"), F.col("__t").alias("__u"))
    met = (F.col("__t") == F.col("__u")) & (F.col("__o") < F.col(order)) & (F.least("__n", "__m") >= at_least * F.greatest("__n", "__m"))
    for k in key:
        met = met & (F.col(k) == F.col(f"__{k}"))
    pairs = each.join(other, met).select(*key, order, "__o").distinct()
    earlier = named.select(*key, F.col(order).alias("__o"), F.col("__w").alias("__v"))
    sets = pairs.join(named, [*key, order]).join(earlier, [*key, "__o"])
    shared = F.size(F.array_intersect("__w", "__v"))
    near = sets.filter(shared >= at_least * (F.size("__w") + F.size("__v") - shared))
    return near.groupBy(*key, order).agg(F.count("*").alias("near_before"))


#: Longs of parities that a set's words are hashed to.
_PARITIES = 4


def set_id(words: Column) -> Column:
    """The name of a set of words, whatever their order: a digest."""
    return F.sha2(F.to_json(F.sort_array(words)), 256)


def _by_rarity(sets: DataFrame, seen: DataFrame) -> DataFrame:
    """__set, __n (all of a set's words), __w: those of them that are in seen, rare ones first, and their parities by hash."""
    place = F.pmod(F.xxhash64("__t"), F.lit(64 * _PARITIES))
    each = sets.select("__set", F.size("__words").alias("__n"), F.explode("__words").alias("__t")).join(seen, "__t").withColumn("__h", place)
    parities = [F.bit_xor(F.expr(f"if(__h div 64 = {k}, shiftleft(1L, cast(__h % 64 AS int)), 0L)")).alias(f"__b{k}") for k in range(_PARITIES)]
    return each.groupBy("__set", "__n").agg(F.array_sort(F.collect_list(F.struct("__f", "__t"))).alias("__w"), *parities)


def like_sets(asked: DataFrame, given: DataFrame, least: float) -> DataFrame:
    """__set, __other: pairs of a set in asked and one in given that are alike to `least` (Jaccard), equal ones included.

    Both frames have __set and __words; each set stands once, so that copies form no pairs. Sets this near share one of their
    n - ceil(least * n) + 1 rarest words, and after the first one they share both have enough words left. Each word that
    only one of two sets has turns one parity: where more of them differ than words may, the sets aren't compared. Whole
    sets are compared in the end.
    """
    seen = given.select(F.explode("__words").alias("__t")).groupBy("__t").agg(F.count("*").alias("__f"))
    right = _by_rarity(given, seen).persist()  # read twice, as is the left: sorted once
    left = right if asked is given else _by_rarity(asked, seen).persist()
    size = F.size("__w")
    lead = F.slice("__w", F.lit(1), F.greatest(size - F.ceil(least * F.col("__n") - 1e-9) + 1, F.lit(0)).cast("int"))
    bits = [f"__b{k}" for k in range(_PARITIES)]

    def leads(sets: DataFrame, tag: str) -> DataFrame:
        each = sets.select("__set", "__n", size.alias("__m"), *bits, F.posexplode(lead).alias("__p", "__x"))
        return each.select(F.col("__x.__t").alias(f"{tag}t"), (F.col("__m") - F.col("__p")).alias(f"{tag}left"), *[F.col(c).alias(f"{tag}{c}") for c in ("__set", "__n", *bits)])

    n, m = F.col("a__n"), F.col("b__n")
    shared = F.ceil(least / (1 + least) * (n + m) - 1e-9)
    turned = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in bits), F.lit(0))
    met = (F.col("at") == F.col("bt")) & (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (F.least("aleft", "bleft") >= shared) & (turned <= n + m - 2 * shared)
    pairs = leads(left, "a").join(leads(right, "b"), met).select(F.col("a__set").alias("__set"), F.col("b__set").alias("__other")).distinct()
    both = pairs.join(left.select("__set", F.col("__n").alias("__i"), F.col("__w").alias("__x")), "__set").join(right.select(F.col("__set").alias("__other"), F.col("__n").alias("__j"), F.col("__w").alias("__y")), "__other")
    words = lambda c: F.transform(c, lambda x: x["__t"])
    common = F.size(F.array_intersect(words("__x"), words("__y")))
    return both.filter(common >= least * (F.col("__i") + F.col("__j") - common)).select("__set", "__other")


def recent_count(log: DataFrame, key: list[str], seconds: Column, flag: Column, ttl: int = 900, into: str = "recent") -> DataFrame:
    """Flagged rows of the key within the last ttl seconds, the row itself included."""
    frame = Window.partitionBy(*key).orderBy(seconds).rangeBetween(-ttl, 0)
    return log.withColumn(into, F.coalesce(F.sum(flag.cast("long")).over(frame), F.lit(0)))


def last_outcome(log: DataFrame, key: list[str], order: list[str], outcome: Column) -> DataFrame:
    """The last known outcome of each key; null outcomes don't clear an earlier one."""
    return log.filter(outcome.isNotNull()).groupBy(*key).agg(F.max_by(outcome, F.struct(*order)).alias("last_outcome"))
