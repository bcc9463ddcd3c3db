"""Small fixtures with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from datetime import date, timedelta
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from quernel.llm import common as C
from quernel.llm import html, language, mixing, pieces, pii, quality, simhash, vafile, warc
from quernel.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, ids string"
R = random.Random(3)


def words(n, letters="abcdefgh"):
    return " ".join("".join(R.choice(letters) for _ in range(R.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, words(R.randint(1, 120)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \t\n", "de", None), (103, "x " * 20000, "en", "s1"), (104, rows[0][1], "en", "s2"), (104, rows[0][1], "en", "s2"), (None, words(9), "fr", "s3"), (105, "ÄÖ ß 日本 🎉", "de", "s1")]
    return spark.createDataFrame([(*r, 1, 2, "clash", "clash") for r in rows], DOCS)


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- mixing


def test_mix_meets_its_targets(spark, docs):
    plan = mixing.plan_mix(mixing.sized(docs), 4)
    shown = lambda p: mixing.mix(docs, p).select("doc_id", "source", "mix.size", "mix.source_size", "mix.target", F.size("mix.copies").alias("n")).collect()
    rows = shown(plan)
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(re.findall(C.WORD, r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets_of(order, [size[s] for s in order]), strict=True))
    taken = Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]])) and r["n"] <= 2
        taken[r["source"]] += r["n"] * r["size"]
    for s in size:
        assert taken[s] <= want[s] and want[s] - taken[s] <= max([r["size"] for r in rows if r["source"] == s], default=0)
    assert sorted(map(repr, rows)) == sorted(map(repr, shown(mixing.plan_mix(mixing.sized(docs), 4))))


def test_targets_stop_at_twice_the_source():
    assert mixing.targets_of(["a", "b", "c"], [10, 100, 100]) == [20, Fraction(295, 3), Fraction(590, 3)]
    assert mixing.targets_of([], []) == [] and mixing.targets_of([None], [0]) == [0]


def test_split_tree_deals_every_block():
    ends = mixing.split_tree([7, 0, 100], 8)
    assert [e[-1] for e in ends] == [7, 0, 100] and ends == mixing.split_tree([7, 0, 100], 8)
    sizes = [sum(b - a for a, b in zip([0, *e], e, strict=False)) for e in ends]
    assert sum(sizes) == 107


def test_shards_own_disjoint_blocks_and_all_of_them(spark, docs):
    plan = mixing.plan_mix(mixing.sized(docs), 4)
    copies = mixing.mix(docs, plan).select("source", F.explode("mix.copies").alias("c")).collect()
    for source, ends in zip(plan.sources, plan.shard_ends, strict=True):
        own = [r["c"] for r in copies if r["source"] == source]
        assert all(c["shard"] == min(sum(end <= c["block"] for end in ends), 3) for c in own)
    assert {r["c"]["shard"] for r in copies} == {0, 1, 2, 3}


def test_mix_and_dedup_keep_clashing_columns(spark):
    rows = [(i, f"one two three {i} {i}", "s", 7, 8, 9, 10) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, __key int, __row int, __mix int")
    for out in (mixing.mixed_documents(docs), simhash.near_dedup(docs)):
        assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {(7, 8, 9, 10)}


def test_mix_of_nothing(spark, docs):
    assert mixing.mixed_documents(docs.limit(0)).columns == docs.columns
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mix_descends_keys(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 2)
    test_mix_meets_its_targets(spark, docs)


def test_a_hot_source_leaves_small_sources_whole(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 128)
    rows = [(i, "w " * (200 if i % 100 == 0 else R.randint(2, 6)), f"s{i // 100}") for i in range(800)] + [(1000 + i, "w " * 3 + str(i), "hot") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(C.cut(mixing.sized(docs)), 4, stop=1000)
    got = mixing.mix(docs, plan).select("source", "mix.size", F.size("mix.copies").alias("n")).collect()
    for source, target, passes in zip(plan.sources, plan.targets, plan.passes, strict=True):
        if source != "hot":
            own = [r for r in got if r["source"] == source]
            passed_over = [r["size"] for r in own if r["n"] == passes]
            assert 0 <= target - sum(r["n"] * r["size"] for r in own) < min(passed_over) + 1


# --- WARC


PAGES = "page_id long, url string, html string, archive string"


def located(spark, rows, others, schema=PAGES):
    first, second = (warc.leaves(spark.createDataFrame(x, schema)) for x in (rows, others))
    roots, found = warc.audit(first, second)
    return {r["archive"] for r in roots.collect() if r["root"] != r["replica_root"]}, found.collect()


def test_audit_locates_damage(spark):
    rows = [(i, f"http://h/{i}", words(20), "x") for i in range(700)] + [(700, None, None, "x"), (None, "u", "lost", "x"), (5, "http://h/5", "again", "x")]
    change = {3: "!", 299: "much longer than before " * 9, 650: ""}
    bad = [(i, u, change.get(i, h), a) for i, u, h, a in rows if i != 400] + [(701, "new", "page", "x"), (5, "http://h/5", "again", "x")]
    differ, found = located(spark, rows, bad)
    assert differ == {0, 1, 2}
    assert {r["archive"] * warc.RECORDS + r["slot"] for r in found} == {3, 299, 400, 650, 701, 5}
    assert all((r["at"] is None) != (r["replica_at"] is None) for r in found if r["slot"] != 5)
    at, laid = {}, 0  # the offsets of the first replica's archive 1
    for i, u, h, _ in rows[256:512]:
        at[i] = laid
        laid += len(spark.range(1).select(warc.record(F.lit(i), F.lit(u), F.lit(h)).alias("r")).first()["r"].encode()) if i < 300 else 0
    assert [r["at"] for r in found if r["archive"] == 1 and r["slot"] == 43 and r["at"] is not None] == [at[299]]
    same = warc.leaves(spark.createDataFrame(rows, PAGES))
    assert warc.audit(same, same)[1].count() == 0
    empty = warc.leaves(spark.createDataFrame([], PAGES))
    assert warc.audit(empty, empty)[0].count() == 0
    assert warc.audit(same, empty)[1].count() == len(rows)


def test_audit_of_an_overfull_slot(spark, monkeypatch):
    monkeypatch.setattr(warc, "FULL", 4)
    rows = [(7, "u", f"text {i}", "x") for i in range(300)] + [(8, "u", "t", "x")]
    differ, found = located(spark, rows, rows[:100] + rows[101:])
    assert differ == {0} and len(found) == 1 and found[0]["slot"] == 7 and found[0]["replica_at"] is None


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "a\r\n\r\nWARC/1.0\r\n" + words(3) + "é", "x") for i in range(20)] + [(21, None, None, "x")]
    warc.write_warc(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r["url"], r["html"]) for r in got) == sorted((u or "", h or "") for _, u, h, _ in rows)


# --- HTML


def test_main_text(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class='cookie-notice'>Cookies</div><article class='post'><header><h1>A &amp; B</h1></header><p>One\n two<br>three &eacute; <b>bold<p>Next&nbsp;<script>x('</p>')</script>end</p><aside>side</aside><form>f</form><section id='comments'><article>rant</article></section><ul><li>x<li>y</ul></article><footer>F</footer></body></html>"
    cut_off = "<body><article><p>Kept <b>text</b></p><p cla"
    loose = lambda i: f"<body><div>Shared words on every page here</div><div>Only page {i} says {words(6)}</div></body>"
    rows = [(1, "http://a/1", page), (2, None, None), (3, "http://a/3", ""), (4, "http://a/4", cut_off), (1, "http://a/1", page)] + [(10 + i, f"http://b/{i}", loose(i)) for i in range(6)]
    got = [(r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, text string, host string")).collect()]
    texts = dict(got)
    assert texts[1] == "A & B\nOne two three é bold\nNext end\nx\ny" and len(got) == len(rows)
    assert texts[2] == texts[3] == "" and texts[4] == "Kept text"
    assert all("Shared" not in texts[10 + i] and texts[10 + i].startswith(f"Only page {i} says") or texts[10 + i].startswith(f"{i} says") for i in range(6))
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_covered_equals_brute_force():
    streams = [[R.choice("abc") for _ in range(R.randint(0, 30))] for _ in range(12)]
    got = html.covered(streams, 4)
    for i, s in enumerate(streams):
        want = np.zeros(len(s), bool)
        for k in range(len(s) - 3):
            if any(s[k : k + 4] == o[m : m + 4] for j, o in enumerate(streams) if j != i for m in range(len(o) - 3)):
                want[k : k + 4] = True
        assert (got[i] == want).all()


# --- SimHash


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, docs):
    got = simhash.fingerprints(docs, "doc_id").collect()
    want = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("bucket", [16, 2])
def test_links_keep_every_component(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(7)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.add(x)
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_one_document_of_each_group_stays(spark, docs):
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    fp = {r["doc_id"]: fingerprint(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    assert 104 not in ids and 0 in ids and 100 in ids and 101 not in ids and 102 not in ids
    assert len({fp[i] for i in ids if i is not None}) == len([i for i in ids if i is not None])
    assert simhash.near_dedup(docs.limit(0)).count() == 0


# --- top-k


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)]
    rows += [(400 + i, rows[40][1]) for i in range(60)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, rows[1][1]), (20, rows[2][1])]
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<double>, rank int")
    got = Counter(map(tuple, vafile.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()))
    want = Counter()
    for at, (q, v) in enumerate(whole):
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for k, (i, w) in enumerate(whole) if k != at)[:5]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert got == want
    assert vafile.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_takes_any_finite_component(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(200)] + [(300, [1e9] + [0.0] * 7), (301, [1e200, -1.0] + [0.0] * 6), (302, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(max(-vafile.LIMIT, min(vafile.LIMIT, np.floor(x * 64)))) for x in v] + [0] * (8 - len(v))) for i, v in rows]
    top, low = (1 << 63) - 1, -(1 << 63)
    want = set()
    for q, v in whole:
        best = sorted((-max(low, min(top, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in whole if i != q)[:3]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert set(map(tuple, vafile.top_k(df, F.col("vec_id") >= 0, 3).collect())) == want


def test_waves_and_coarse_cells_agree(spark, monkeypatch):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=12)]) for i in range(400)], "vec_id long, embedding array<double>")
    one = plain(vafile.top_k(df, F.col("vec_id") % 5 == 0, 4))
    monkeypatch.setattr(vafile, "WAVE", 16)
    monkeypatch.setattr(vafile, "CELLS", 5)
    monkeypatch.setattr(vafile, "SAMPLE", 50)
    assert plain(vafile.top_k(df, F.col("vec_id") % 5 == 0, 4)) == one


def host_pages(spark, host, texts):
    """Pages of a host as (page_id, url, html)."""
    return spark.createDataFrame([(i, f"http://{host}/{i}", f"<body>{x}</body>") for i, x in enumerate(texts)], "page_id long, url string, html string")


def test_unmarked_notices_leave_articles(spark):
    notice, share = words(30), "Share this text"
    prose = [words(40) for _ in range(10)]
    got = {r["page_id"]: r["text"] for r in html.extract(host_pages(spark, "n", [f"<article><p>{p}</p><p>{notice} {i}</p><p>{share}</p></article>" for i, p in enumerate(prose)])).collect()}
    assert got == {i: f"{p}\n{i}" for i, p in enumerate(prose)}


def test_prose_outside_articles_stays(spark):
    quoted, prose = words(12), [words(40) for _ in range(10)]
    texts = [f"<div>{p[:90]} {quoted if i in (2, 5, 7) else ''} {p[90:]}</div>" for i, p in enumerate(prose)]
    texts += [texts[0]] * 4  # copies of a page
    sidebar = f"<aside><p>{words(25)}</p></aside>"
    got = {r["page_id"]: r["text"] for r in html.extract(host_pages(spark, "p", [x + sidebar for x in texts])).collect()}
    assert got == {i: " ".join(x[5:-6].split()) for i, x in enumerate(texts)}


def main_texts(rows):
    """A plain version of the rule over (page_id, url, html) rows: every run and block of every host counted by itself."""
    kept = [(i, u, u.split("/")[2], [t for kind, t in html.blocks(h) if kind != "d"]) for i, u, h in rows]
    hosts = {}
    for _, _, host, lines in kept:
        if lines:
            hosts.setdefault(host, set()).add("\n".join(lines))
    runs = lambda tokens: [tuple(tokens[k : k + html.RUN]) for k in range(len(tokens) - html.RUN + 1)]
    bad = {}
    for host, texts in hosts.items():
        seen = Counter(x for t in texts for x in {*runs(t.split()), *(b for b in t.split("\n") if len(b.split()) < html.RUN)})
        bad[host] = {x for x, n in seen.items() if n >= html.LEAST and n * html.SHARE >= len(texts)}
    out = []
    for i, u, host, lines in kept:
        tokens, gone = " ".join(lines).split(), set()
        for k, run in enumerate(runs(tokens)):
            if run in bad.get(host, ()):
                gone |= set(range(k, k + html.RUN))
        at, left = 0, []
        for line in lines:
            own = line.split()
            if len(own) >= html.RUN or line not in bad[host]:
                left.append(" ".join(t for k, t in enumerate(own, at) if k not in gone))
            at += len(own)
        out.append((i, u, "\n".join(x for x in left if x)))
    return sorted(out)


@pytest.mark.parametrize("pages_of_host", [15, 150, 600])
def test_extract_equals_brute_force(spark, monkeypatch, pages_of_host):
    monkeypatch.setattr(html, "EVEN_CHARS", 1 << 14)  # 600 pages are several shards
    often, seldom, line = words(24), words(33), "Read more here"
    rows = [(i, f"http://s/{i}", f"<body><nav>{line}</nav><p>{words(30)}</p>" + (f"<p>{words(3)} {often} {words(3)}</p>" if i % 4 == 0 else "") + (f"<p>{seldom}</p>" if i % 6 == 0 else "") + (f"<article>{line}</article>" if i % 5 else f"<aside>{line}</aside>")) for i in range(pages_of_host)]
    rows += [(9000 + i, "http://copies/1", rows[0][2]) for i in range(9)] + [(9100 + i, f"http://few/{i}", f"<p>{line}</p>") for i in range(2)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shards int")
    got = plain(html.extract(pages))
    want = main_texts(rows)
    assert sorted(got) == want and sum(often in r[2] for r in want) == 9  # copies are no boilerplate
    assert (sum(seldom in r[2] for r in want) > 9) == (pages_of_host > 15)  # 3 of 15 pages are one in five, 25 of 150 are not
    monkeypatch.setattr(html, "SENT_CHARS", 0)
    monkeypatch.setattr(html, "SENT_HOSTS", 0)
    assert sorted(plain(html.extract(pages))) == want


# --- pseudonyms


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_formats(spark):
    text = "card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; ip 10.1.2.3, not 999.1.2.3; born 1984-02-29, 31.12.1999, not 2023-02-30; call +1 (017) 555-7713; a.b@c.de token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" v2.0 1234"
    rows = [(1, text), (2, None), (3, ""), (4, "no data here"), (5, "x " * 30000 + "4111111111111111"), (1, text)]
    got = [(r["doc_id"], r["text"]) for r in pii.pseudonymise(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, __x string"), "k").collect()]
    out = dict(got)
    assert out[2] is None and out[3] == "" and out[4] == "no data here" and got.count((1, out[1])) == 2
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), not 4111111111111112;", out[1])
    assert card[1].replace(" ", "") == card[2] != "4111111111111111" and luhn(card[2]) and out[5].endswith(" " + card[2])
    assert re.search(r"not 999\.1\.2\.3;", out[1]) and "10.1.2.3" not in out[1] and "not 2023-02-30" in out[1]
    assert re.search(r"born \d{4}-\d\d-\d\d, \d\d\.\d\d\.\d{4},", out[1]) and "1984-02-29" not in out[1]
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4};", out[1]) and "555-7713" not in out[1]
    assert "a.b@c.de" not in out[1] and "04dbebab" not in out[1] and out[1].endswith(" v2.0 1234")
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def network(left, right, a, b, kind, key):
    """The Feistel network in plain Python."""
    for k in range(pii.ROUNDS):
        half = right if k % 2 == 0 else left
        f = int(hashlib.sha256(f"{key}|{kind}|{a}|{b}|{k}|{half}".encode()).hexdigest()[:15], 16)
        left, right = ((left + f % a) % a, right) if k % 2 == 0 else (left, (right + f % b) % b)
    return left, right


def moved_digits(d, kind, key):
    h = len(d) // 2
    x, y = network(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), kind, key)
    return f"{x:0{h}d}{y:0{len(d) - h}d}"


def moved_date(d, key):
    days = (d - date(1600, 1, 1)).days
    x, y = network(days % 146097 // 773, days % 773 if days < 146097 else days % 146097 % 773, 189, 773, "date", key)
    return date(1600, 1, 1) + timedelta(days // 146097 * 146097 + x * 773 + y)


def test_pseudonyms_equal_a_plain_network(spark):
    def one(text):
        return pii.pseudonymise(spark.createDataFrame([(text,)], "text string"), "k").first()[0]

    body = moved_digits("411111111111111", "card", "k")
    check = next(str(c) for c in range(10) if luhn(body + str(c)))
    assert one("4111-1111-1111-1111") == "-".join((body + check)[i : i + 4] for i in (0, 4, 8, 12))
    x, y = network(10 * 256 + 1, 2 * 256 + 3, 65536, 65536, "address", "k")
    assert one("10.1.2.3") == f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    new = moved_date(date(1984, 2, 29), "k")
    assert one("1984-02-29T10:00:00 29.02.1984 29/02/1984 02/29/1984 2/29/1984 1984/02/29") == f"{new}T10:00:00 {new:%d.%m.%Y} {new:%d/%m/%Y} {new:%m/%d/%Y} {new.month}/{new.day}/{new.year} {new:%Y/%m/%d}"
    n = moved_digits("2079460958", "phone", "k")
    assert one("+44 20 7946 0958, (+442079460958)") == f"+44 {n[:2]} {n[2:6]} {n[6:]}, (+44{n})"
    assert one("(555) 123-4567; 555.123.4567") == "({0}) {1}-{2}; {0}.{1}.{2}".format(*(lambda d: (d[:3], d[3:6], d[6:]))(moved_digits("5551234567", "phone", "k")))
    iban = one("IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00")
    plain_iban = iban[5:32].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain_iban[4:] + plain_iban[:4])) % 97 == 1 and plain_iban[4:] == moved_digits("370400440532013000", "iban", "k") and iban.endswith("not DE88 3704 0044 0532 0130 00")
    x, y = network(219 - 1, 8 * 9999 + 9998, 898, 99 * 9999, "social", "k")
    assert one("219-09-9999 000-12-3456") == f"{x + 1 + (x >= 665):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d} 000-12-3456"
    assert re.fullmatch(r"([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}", one("2001:db8:0:0:0:ff00:42:8329")) and one("12:30:45") == "12:30:45"
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([("x",)], "text string"))


def test_feistel_is_a_bijection(spark):
    n = spark.range(189 * 7).select(pii.feistel(F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(189).cast("long"), F.lit(7).cast("long"), "t", "k").alias("o"))
    assert n.distinct().count() == 189 * 7
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")).select(pii.permute_digits(F.col("d"), "t", "k").alias("o"))
    assert d.distinct().count() == 1000 and d.filter("length(o) <> 3").count() == 0


# --- language and quality


def test_language_profiles(spark, docs):
    en, de = "the quick brown fox jumps over the lazy dog and then ", "der schnelle braune fuchs springt über den faulen hund und "
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in range(60)] + [(100, None, "en"), (101, "12 34", "en"), (None, en, "en"), (102, de, None), (103, "", "de")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, score string")
    got = language.predict(df, language.learn(df)).collect()
    said = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(said[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert said[100]["lang_pred"] == said[101]["lang_pred"] == said[103]["lang_pred"] == "und" and said[102]["lang_pred"] == "de" and not said[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language.predict(df, {}).collect()} == {"und"} and language.learn(df.limit(0)) == {}


def test_out_of_place_distance(spark):
    """Profiles and predictions against a plain version."""
    def ranked(texts, most):
        seen = Counter()
        for t in texts:
            t = " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
            if t:
                t = f" {t} "
                seen.update(x for n in (1, 2, 3) for x in (t[i : i + n] for i in range(len(t) - n + 1)) if x != " " and not (n == 3 and x[1] == " "))
        packed = lambda x: sum(ord(c) << 21 * (len(x) - 1 - i) for i, c in enumerate(x))
        return [x for x, _ in sorted(((packed(x), n) for x, n in seen.items()), key=lambda y: (-y[1], y[0]))][:most]

    rows = [(i, words(R.randint(1, 60), "aeinrst" if i % 3 else "öäüßkpz"), f"l{i % 3}") for i in range(90)] + [(900, "日本 語", None), (901, "!!", "l0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.learn(df)
    fold = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    want = {lang: ranked([t for i, t, own in rows if own == lang and not fold[i]], language.PROFILE) for lang in ("l0", "l1", "l2")}
    assert learned == want
    got = {r["doc_id"]: r for r in language.predict(df, learned).collect()}
    for i, t, _ in rows:
        own = ranked([t], language.DOCUMENT_GRAMS)
        away = {lang: sum(abs(p.index(g) - k) if g in p else language.PROFILE for k, g in enumerate(own)) for lang, p in want.items()}
        best = min(away, key=lambda x: (away[x], x)) if own else "und"
        assert got[i]["lang_pred"] == best and got[i]["held_out"] == fold[i]
        assert got[i]["score"] == pytest.approx(1 - away[best] / (language.PROFILE * len(own)) if own else 0)


def base(text):
    w = re.findall(C.WORD, text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(C.WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdicts(spark, docs):
    good = [(i, words(60, "aeiost"), 1) for i in range(200, 260)]
    junk = [(i, " ".join(w + "%%%" for w in words(60, "aeiost").split()), 0) for i in range(300, 360)]
    extra = [(400, "a b\na b\n\n \na b\nx " + "p q r s t u v w x " * 5, None), (401, "é" * 5 + " z |", None)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(a, b) for a, b, _ in good + junk + extra]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, kept string, __y string")
    labels = spark.createDataFrame([(a, c, 0) for a, _, c in good + junk] + [(None, 1, 0), (200, None, 0), (401, 1, 0), (401, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    got = quality.score(df, model).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((i, *base(t)) for i, t in rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["kept"] for i, _, _ in good) and not any(by[i]["kept"] for i, _, _ in junk)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    kept = quality.quality_filter(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.train(df, labels.limit(0)) is None and quality.score(df.limit(0), None).count() == 0


def test_repeated_windows_are_compared_by_words():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    texts = [" ".join([*"cdefghi", a, *"cdefghi", b]), " \t".join([*"cdefghi", a, *"cdefghi", a])]
    import pyarrow as pa

    parts = quality._parts(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text", C.Powers())
    assert quality._base(texts, *parts)["n_repeat_words"].tolist() == [base(t)[4] for t in texts] == [0, 16]


def test_verdicts_equal_a_plain_score(spark, docs):
    good, junk = [(i, words(60, "aeiost"), 1) for i in range(200, 230)], [(i, words(60, "bcdfgh"), 0) for i in range(300, 303)]
    df = spark.createDataFrame([(a, b) for a, b, _ in good + junk], "doc_id long, text string")
    model = quality.train(df, spark.createDataFrame([(a, c) for a, _, c in good + junk], "doc_id long, quality int"))
    assert model is not None  # few rows of a class still train
    w, powers = np.frombuffer(model[0]), C.Powers()
    for r in quality.score(df, model).collect():
        import pyarrow as pa

        text = next(b for a, b, _ in good + junk if a == r["doc_id"])
        x = np.zeros(quality.DIM)
        for buckets, _ in quality._families(*quality._parts(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), "text", powers)):
            for k in buckets.tolist():
                x[k] += 1 / len(buckets)
        p = 1 / (1 + np.exp(-(model[1] + (x @ w - model[2]) * r["n_words"] / (r["n_words"] + quality.SHORT))))
        assert r["probability"] == pytest.approx(p) and r["kept"] == (not r["base_failed"] and p >= quality.KEEP_AT)


# --- pieces


def test_pieces_equal_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    own = pieces.Pieces(open(pieces.MODEL, "rb").read())
    r = random.Random(2)
    texts = ["", " ", "   a  b", "    " * 9, "aaaa" * 300, "日本語 🎉🎉 x", "x=1;\n\n\t foo(bar) ;"] + ["".join(r.choice("aabeth  \n▁é日") for _ in range(r.randint(0, 90))) for _ in range(300)]
    for text, got in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(got, np.int32).tolist() == sp.encode(text)
        stream, fed, ids = pieces.Stream(own), own.prefix + text.replace(" ", "▁") if text else "", []
        for k in range(0, len(fed), 61):
            ids += stream.feed(fed[k : k + 61])
        assert ids + stream.finish() == sp.encode(text)
    out = pieces.encoded_and_checked(docs.drop("ids")).collect()
    assert len(out) == docs.count() and all(x["round_trip"] for x in out)
    assert all(x["ids"] == sp.encode(x["text"] or "") for x in out)
    assert pieces.encoded_and_checked(docs.drop("ids").limit(0)).count() == 0


def test_long_runs_side_by_side(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(4)
    texts = ["".join(r.choice(x) for _ in range(r.randint(1, 400))) for x in ["thaneringed"] * 150 + ["ab"] * 90 + ["日本aé x"] * 60] + ["a" * 900] * 3
    texts += [" ".join("".join(r.choice("thaneri") for _ in range(r.randint(30, 90))) for _ in range(40))]
    for cache in (96 << 20, 1):
        monkeypatch.setattr(pieces, "CACHE_BYTES", cache)
        own = pieces.Pieces(open(pieces.MODEL, "rb").read())
        for _ in range(2):
            assert [np.frombuffer(x, np.int32).tolist() for x in own.encode_all(texts)] == [sp.encode(t) for t in texts]


def test_lanes_forget_what_is_committed():
    own = pieces.Pieces(open(pieces.MODEL, "rb").read())
    lanes = pieces.Lanes(own, ["▁" + "thehand" * 300 + str(i) for i in range(pieces.LANES)])
    widest = []
    widen = lanes._widen
    lanes._widen = lambda *a: (widen(*a), widest.append(lanes.ends.shape[1]))
    assert lanes.ids() and max(widest) < 8 * own.longest


def test_stream_commits_early():
    stream = pieces.Stream(pieces.Pieces(open(pieces.MODEL, "rb").read()))
    early = stream.feed("thehand" * 400)
    assert early and len(stream.text) < 600


# --- pipeline


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    """Each stage against a plain version, on nulls, empty and long texts, ties, repeats and clashing columns."""
    import corpus_pipeline

    good, junk = [(i, words(60, "aeiost"), 1) for i in range(200, 260)], [(i, words(60, "aeiost").replace(" ", "%%% "), 0) for i in range(300, 340)]
    private = [(400, words(40, "aeiost") + " a.b@c.de 4111111111111111"), (401, good[0][1]), (401, good[0][1]), (None, words(40, "aeiost"))]
    rows = docs.union(spark.createDataFrame([(a, b, "en", f"s{k % 3}", 1, 2, "clash", "clash") for k, (a, b, *_) in enumerate(good + junk + private)], DOCS))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(a, c, 0) for a, _, c in good + junk], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = rows, []
    for _, stage in corpus_pipeline.STAGES:
        now = C.cut(stage(spark, now, str(tmp_path)))
        seen.append(now)
    ruled, single, masked, mixed, encoded = seen
    assert all(x.columns == rows.columns for x in seen[:4])
    verdict = {(r["doc_id"], r["n_words"]) for r in quality.score(rows, quality.train(rows, labels)).collect() if r["kept"]}
    assert Counter(map(tuple, ruled.collect())) == Counter(tuple(r) for r in rows.collect() if (r["doc_id"], base(r["text"])[0]) in verdict)
    prints = Counter(fingerprint(r["text"]) for r in single.collect())
    assert set(prints) == {fingerprint(r["text"]) for r in ruled.collect()} or len(prints) < len({fingerprint(r["text"]) for r in ruled.collect()})
    assert max(prints.values()) == 1 and not any("a.b@c.de" in r["text"] or "4111111111111111" in r["text"] for r in masked.collect())
    size = Counter()
    for r in masked.collect():
        size[r["source"]] += base(r["text"])[0]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets_of(order, [size[s] for s in order]), strict=True))
    taken, times = Counter(), Counter(tuple(r) for r in mixed.collect())
    for r in mixed.collect():
        taken[r["source"]] += base(r["text"])[0]
    assert max(times.values()) <= 2 and all(want[s] - 100 < taken[s] <= want[s] for s in order)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert encoded.columns[: len(rows.columns)] == rows.columns and encoded.columns[-2:] == ["_ids", "round_trip"]
    assert encoded.count() == mixed.count() and all(r["round_trip"] and r["_ids"] == sp.encode(r["text"]) for r in encoded.collect())


def test_pipeline_small(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "ids", "round_trip"} <= set(out.columns)
    assert out.filter("not round_trip").count() == 0 and out.count() > 0


# --- what a page's marks say


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ('<article><section id="related-work"><p>A</p></section><div class="social-sciences"><p>B</p></div></article>', ["A", "B"]),
        ("<div id=search-algorithms>A</div><p class='copyright-law'>B</p>", ["A", "B"]),
        ('<div data-tip="see class=ad here"><p>A</p></div><div title=\'id="nav"\'>B</div>', ["A", "B"]),
        ('<div class="content-sidebar">x</div><div class="cookie-banner">x</div><div class="post-share-buttons">x</div><div class="ad-slot-300x250">x</div><div class=ad>x</div>', []),
        ('<div class="content-with-sidebar">A</div><div id="main-content">B</div>', ["A", "B"]),
        ("<p>Let <math>x=2</math> hold.</p>", ["Let x=2 hold."]),
        ('<article class="comment reply">x</article><article class="commentary">A</article><article data-x="comment">B</article>', ["A", "B"]),
        ("<article><li>A</article><p class=ad>x</p></p>B", ["A", "B"]),
        ("<nav><div>x</nav>A</div><footer><section>x</footer></section>B", ["A", "B"]),
    ],
)
def test_marks_of_a_page(page, kept):
    assert [t for kind, t in html.blocks(page) if kind != "d"] == kept


@pytest.mark.parametrize("page", ["<div>" * 200_000, "<p class=ad><article>" + "<div>" * 50_000 + "</p></span>" * 50_000, "<div " + 'class="a" ' * 100_000 + ">", '<div "' * 20_000, "<section>" + "</div>" * 200_000, "<nav>" * 100_000 + "</nav>" * 100_000])
def test_deep_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html.blocks(page + "end")
    assert time.process_time() - began < 20
