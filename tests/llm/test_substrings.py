import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quernel.llm import common as C
from quernel.llm import substrings as S

WINDOW = S.WINDOW



def brute_force(rows: list[tuple]) -> dict:
    """n_words, n_removed and the kept words' SHA-256 by doc_id, for rows (doc_id, text) without repeated ids."""
    words = {d: re.findall(C.WORD, t or "") for d, t in rows}
    least: dict[tuple, int] = {}
    for d in sorted(words):
        for k in range(len(words[d]) - WINDOW + 1):
            least.setdefault(tuple(words[d][k : k + WINDOW]), d)
    out = {}
    for d, w in words.items():
        stay = [True] * len(w)
        for k in range(len(w) - WINDOW + 1):
            if least[tuple(w[k : k + WINDOW])] < d:
                stay[k : k + WINDOW] = [False] * WINDOW
        kept = [x for x, ok in zip(w, stay, strict=True) if ok]
        out[d] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def fixture():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    base, passage = text(400), text(80)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, "\n".join(base[:200] + text(3) + base[203:])), (4, None), (5, ""), (6, " ".join(passage[:49]))]
    rows += [(10 + i, " ".join(text(r.randint(0, 60)) + passage + text(r.randint(0, 60)))) for i in range(40)]
    rows += [(60, "x " * 2000), (61, "x " * 30 + "y " + "x " * 900), (62, " ".join(text(70) * 3)), (0, "\t".join(passage) + " end")]
    return rows


@pytest.mark.parametrize("crowd, hot, keys", [(512, 1000, 50_000), (2, 1000, 50_000), (2, 3, 50_000), (2, 3, 4), (512, 3, 0)])
def test_equals_brute_force(spark, monkeypatch, crowd, hot, keys):
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(C, "HOT_KEYS", keys)
    rows = fixture()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in S.remove_repeats(docs).collect()}
    assert got == brute_force(rows)


@pytest.mark.parametrize("keys", [0, 3, 100])
def test_uneven_join_loses_no_row(spark, monkeypatch, keys):
    monkeypatch.setattr(C, "HOT_KEYS", keys)
    left = spark.range(1000).select(F.floor(F.log2(F.col("id") + 1)).alias("k"), "id")
    right = left.groupBy(F.col("k").alias("r")).agg(F.count("*").alias("times"))
    got = C.uneven_join(left, right, F.col("k") == F.col("r"), F.col("times"), 2)
    assert sorted(r["id"] for r in got.collect()) == list(range(1000))


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(docs).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, long), (7, long), (7, long)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in S.remove_repeats(rows).collect()} == {(None, 0), (7, 0)}


def removed(spark, rows, schema="doc_id long, text string"):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in S.remove_repeats(spark.createDataFrame(rows, schema)).collect())


def test_words_decide_not_hashes(spark):
    a, b = "a", "b"  # the Thue-Morse word and its complement: equal under any polynomial hash modulo 2^64
    for _ in range(11):
        a, b = a + b, b + a
    body = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*body[:30], a, *body[30:]])), (2, " ".join([*body[:30], b, *body[30:]]))]
    assert removed(spark, rows) == [(1, 61, 0), (2, 61, 0)]


def test_rows_of_one_id_are_kept_apart(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    assert removed(spark, [(1, x), (2, x), (2, y)]) == [(1, 60, 0), (2, 60, 0), (2, 60, 60)]


def test_string_ids(spark):
    x = " ".join(f"x{i}" for i in range(60))
    assert removed(spark, [("b", x), ("a", x + " end"), ("c", x)], "doc_id string, text string") == [("a", 61, 0), ("b", 60, 60), ("c", 60, 60)]


def test_every_step_takes_part(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 8)
    docs = spark.createDataFrame(fixture(), "doc_id long, text string").withColumn("row", F.lit(0).cast("long"))
    assert all(step.count() for step in S.covered_spans(docs).values())
