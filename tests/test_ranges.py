"""Running sums over ranges give what a plain window gives; near actions match all pairs."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.operators import budget, matching, ranking, scoring, trajectory


def rows_of(spark, n=400):
    draw = random.Random(3)
    # one key holds most rows, one key is null, scores repeat
    data = [(draw.choice(["hot"] * 6 + ["cold", None]), draw.choice("abc"), i, draw.randrange(20), None if i % 37 == 0 else draw.randrange(50)) for i in range(n)]
    return spark.createDataFrame(data, "k string, d string, i long, s int, size int")


def both(make):
    return [sorted(map(str, make(limit).collect())) for limit in (0, 1 << 40)]


def test_ranges_give_the_rows_of_a_window(spark):
    rows = rows_of(spark)
    split, plain = both(lambda limit: ranking.ranked(rows, ["k"], [F.col("s").desc(), F.col("i")], "n", limit))
    assert split == plain and len(split) == 400
    split, plain = both(lambda limit: ranking.ranked(rows, [], [F.col("i")], "n", limit))
    assert split == plain
    split, plain = both(lambda limit: ranking.diverse(rows, ["k"], "d", "s", [F.col("i")], 3.0, "place", limit))
    assert split == plain
    split, plain = both(lambda limit: budget.prefix_budget(rows, ["k"], ["i"], "size", 900, 40, "granted", limit))
    assert split == plain


def test_ranges_of_an_empty_table(spark):
    assert both(lambda limit: ranking.ranked(rows_of(spark).filter("i < 0"), ["k"], [F.col("i")], "n", limit)) == [[], []]


def test_shards_are_ntiles(spark):
    rows = rows_of(spark)
    for n in (1, 7, 300):
        want = sorted((r["i"], r["t"]) for r in rows.selectExpr("i", f"ntile({n}) over (partition by k order by s, i) as t").collect())
        for limit in (0, 1 << 40):
            got = ranking.shards(rows, ["k"], [F.col("s"), F.col("i")], n, "t", limit)
            assert sorted((r["i"], r["t"]) for r in got.collect()) == want


def test_fusion_cuts_each_score_before_rows_travel(spark):
    rows = spark.createDataFrame([("g", i, float(i % 13), float(-i)) for i in range(60)], "g string, i long, a double, b double")
    got = {r["i"]: r["rrf"] for r in scoring.reciprocal_rank_fusion(rows, ["g"], ["a", "b"], ["i"], depth=5, most=8).collect()}
    first = [sorted(range(60), key=lambda i: (-(i % 13), i))[:5], sorted(range(60))[:5]]
    want = {i: round(sum(1 / (61 + f.index(i)) for f in first if i in f), 6) for f in first for i in f}
    assert got == dict(sorted(want.items(), key=lambda x: (-x[1], x[0]))[:8])


def test_near_actions_match_all_pairs(spark):
    draw = random.Random(5)
    base = [f"w{i}" * (1 + i % 3) for i in range(30)]
    log = []
    for i in range(60):
        words = set(base[: draw.choice([0, 1, 7, 20, 30])])
        if words and draw.random() < 0.5:
            words.symmetric_difference_update(draw.sample(base, 2))
        log.append((draw.choice(["k", "l"]), i, sorted(words)))
    got = {(r["k"], r["i"]): r["near_before"] for r in matching.near_actions(spark.createDataFrame(log, "k string, i long, w array<string>"), ["k"], "i", F.col("w")).collect()}
    want = {}
    for k, i, w in log:
        n = sum(1 for l, j, v in log if l == k and j < i and len(set(w) & set(v)) >= 0.85 * len(set(w) | set(v)))
        if n:
            want[k, i] = n
    assert got == want and want


def test_first_seen_by_content(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x"), (None, 4, None), (None, 5, None)], "k string, i long, c string")
    got = {r["i"]: r["is_new"] for r in trajectory.first_seen(rows, ["k"], "i", F.col("c")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_heads_of_sections_are_those_of_whole_windows(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice("abcdef"[: g + 1]), rng.random(), i) for g in range(6) for i in range(rng.choice([1, 3, 40]))]
    frame = spark.createDataFrame(rows, "g int, s string, x double, i int")
    order = [F.col("x").desc(), F.col("i")]
    for k in (1, 3, 7, 60):
        marked = frame.withColumns({"first": F.row_number().over(Window.partitionBy("g", "s").orderBy(*order)) == 1, "r": F.row_number().over(Window.partitionBy("g").orderBy(*order))})
        want = marked.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(~F.col("first"), "r"))).filter(F.col("place") <= k).select("g", "s", "x", "i", "place")
        assert sorted(map(tuple, ranking.section_first(frame, ["g"], "s", order, k).collect())) == sorted(map(tuple, want.collect()))
