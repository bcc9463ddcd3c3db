"""Runs against a search of all periods, and the query against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import common as C
from quernel.llm import runs


def plain_runs(x, least_length=6, least_exponent=4):
    out = set()
    for p in range(1, len(x) // least_exponent + 1):
        i = 0
        while i < len(x) - p:
            s = i
            while i < len(x) - p and x[i] == x[i + p]:
                i += 1
            n = i - s + p
            w = x[s : s + n]
            if n >= max(least_length, least_exponent * p) and not any(w[q:] == w[: n - q] for q in range(1, p)):
                out.add((s, n, p))
            i += i == s
    return sorted(out, key=lambda t: (t[0], t[2]))


def sequences(n):
    rng = random.Random(11)
    for _ in range(n):
        x = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 45))]
        if x and rng.random() < 0.6:
            a, p = rng.randrange(len(x)), rng.randint(1, max(1, len(x) // 3))
            x[a:] = [x[a + (i - a) % p] for i in range(a, len(x))]
            x[rng.randrange(len(x))] = rng.randrange(3)
        yield x


def test_edges_are_next_smaller_suffixes():
    for x in sequences(1500):
        down, match = runs.lyndon_edges(x)
        for i in range(len(x)):
            j = next(j for j in range(i + 1, len(x) + 1) if x[j:] < x[i:])
            m = 0
            while j + m < len(x) and x[i + m] == x[j + m]:
                m += 1
            assert (down[i], match[i]) == (j, m)


@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (2, 2), (1, 3)])
def test_runs_are_all_runs(length, exponent):
    for x in sequences(3000):
        assert runs.runs_of(x, length, exponent) == plain_runs(x, length, exponent)


def test_comparisons_stay_linear():
    class Counted(list):
        read = 0

        def __getitem__(self, i):
            Counted.read += 1
            return list.__getitem__(self, i)

    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    rng = random.Random(5)
    hard = [b, [bin(i).count("1") & 1 for i in range(30_000)], [1] * 30_000, [0, 1] * 15_000, list(range(30_000)), [rng.randrange(2) for _ in range(30_000)], [int(int(i**0.5) ** 2 == i) for i in range(30_000)]]
    for x in hard:
        for order in (x, [-v for v in x]):
            Counted.read = 0
            runs.lyndon_edges(Counted(order))
            assert Counted.read < 12 * len(x)


def test_narrowed_keeps_every_run():
    for x in sequences(3000):
        found = [(s + a, n, p) for s, e in runs.narrowed(np.array(x, np.int64), np.array([0, len(x)])) for a, n, p in runs.runs_of(x[s:e])]
        assert found == plain_runs(x)
    assert runs.narrowed(np.zeros(0, np.int64), np.array([0, 0, 0])) == []
    assert runs.narrowed(np.array([5] * 12), np.array([0, 6, 12])) == [(0, 6), (6, 12)]


def expected(doc_id, text):
    w = re.findall(C.WORD, text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda t: (-t[1], t[0], t[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab cd e f g ä 日本".split()) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    texts += [None, "", " \t\n", "x " * 700, "no\x0bno\x0cno\rno\nno\tno", "a b " * 9, "one two " * 3 + "one", "tie tie tie tie tie tie low low low low low low"]
    rows = [(i * 7 - 30, t, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "z " * 9, 1, 2, 3), (5, texts[1], 1, 2, 3), (5, texts[1], 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed int, n_words int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op11_run_detection(spark, str(tmp_path))
    want = sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert runs.op11_run_detection(spark, str(tmp_path)).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_collapsed_keeps_first_periods_and_any_id(spark):
    docs = spark.createDataFrame([("k", "so  we go so we go so we go so we go on"), (None, None)], "key string, body string")
    got = {r["key"]: r for r in runs.collapsed(docs, "key", "body").collect()}
    assert got["k"]["collapsed"] == "so we go on" and got["k"]["n_words"] == 13 and [tuple(r) for r in got["k"]["runs"]] == [(0, 12, 3)]
    assert got[None]["collapsed"] == "" and got[None]["runs"] == []
    assert runs.collapsed(docs.filter(F.lit(False)), "key", "body").count() == 0


def test_one_very_long_text(spark):
    n = 1_500_000
    docs = spark.createDataFrame([(1, n)], "doc_id long, n int").select("doc_id", F.concat(F.repeat(F.lit("la di "), n // 2), F.lit("da")).alias("text"))
    r = runs.collapsed(docs).collect()[0]
    assert r["collapsed"] == "la di da" and [tuple(x) for x in r["runs"]] == [(0, n, 2)]
