"""The source audit against plain counting in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quernel.llm import divergence as D

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n int, p int, term string"


def expected(rows, least=10, top=10):
    n, df, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        own = Counter(re.findall(D.TERM, (text or "").translate(LOWER)))
        for t, k in own.items():
            n[lang, source, t] += k
            df[lang, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (of, t), k in df.items() if of == lang and k >= least]
        v = len(kept)
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        share = lambda count, size: 1 + 10**9 * (count + 2) // (size + 2 * v)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {(s, t): share(n[lang, s, t], total[s]) for s in sources for t in kept}
        q = {t: share(sum(n[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(f(p[s, t], p[o, t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s, t], q[t]), t) for t in kept if n[lang, s, t] and p[s, t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def rows():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("A", "b", "ä", "Ä", "日本", "zz", "é") for b in ("", "x", "Q", "ß")]
    out = []
    for i in range(260):
        of = vocabulary[: rng.choice([4, 12, 28])]
        text = rng.choice([" ", "-", "_", "1", "\n", "\x00", "'"]).join(rng.choice(of) for _ in range(rng.randint(0, 60)))
        out.append((text, rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "S3", "", None, "ü"])))
    out += [(None, "en", "empty"), ("", "en", "empty"), ("123 _ 456", "xx", "only"), ("rare words", "yy", "a"), (None, None, None), out[0], out[0]]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, *r, 1, 2, "clash") for i, r in enumerate(data)], SCHEMA)


def test_audit_equals_plain_counts(spark):
    data = rows()
    got = D.audit(frame(spark, data).repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected(data)


@pytest.mark.parametrize("salted", [False, True])
def test_slices_and_salts_change_nothing(spark, monkeypatch, salted):
    data = rows()
    monkeypatch.setattr(D, "SLICE_BYTES", 40)
    monkeypatch.setattr(D, "BROADCAST_SOURCES", 0 if salted else 100)
    monkeypatch.setattr(D, "SALTS", 3)
    counts = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in D.term_counts(frame(spark, data)).collect()}
    want, docs = Counter(), Counter()
    for text, lang, source in data:
        own = Counter(re.findall(D.TERM, (text or "").translate(LOWER)))
        for t, k in own.items():
            want[lang or "", source or "", t] += k
            docs[lang or "", source or "", t] += 1
    assert counts == {k: (n, docs[k]) for k, n in want.items()}
    assert sorted(map(tuple, D.audit(frame(spark, data)).collect())) == expected(data)


def test_other_bounds_and_nothing(spark):
    data = rows()
    assert sorted(map(tuple, D.audit(frame(spark, data), 1, 2).collect())) == expected(data, 1, 2)
    assert sorted(map(tuple, D.audit(frame(spark, data), 10_000).collect())) == expected(data, 10_000)
    assert D.audit(frame(spark, data).filter(F.lit(False))).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(1)
    pairs = [(c := rng.randrange(10**k), c + rng.randrange(1, 10**k)) for k in range(1, 15) for _ in range(20)]
    got = spark.createDataFrame(pairs, "c long, total long").select("c", "total", D.share(F.col("c"), F.col("total") + 2).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 2) // (r["total"] + 2) for r in got)


def test_one_text_longer_than_a_slice(spark):
    docs = spark.createDataFrame([("x", "a"), ("y", "b")], "lang string, source string").withColumn("text", F.repeat(F.lit("Und so weiter, "), 900_000))
    got = {(r["lang"], r["term"]): (r["n"], r["docs"]) for r in D.term_counts(docs).collect()}
    assert got == {(k, t): (900_000, 1) for k in "xy" for t in ("und", "so", "weiter")}
