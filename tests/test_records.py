"""Resolution, shredding, sinks and rebuilt data sets, with faults put in by hand."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quernel.operators import alignment, resolving
from quernel.sources import records, sinks


def test_resolution_by_identifier_then_title(spark):
    index = [(1, " 10.1000/ABC ", "One two three four five"), (2, "10.1000/abc", "x"), (3, None, "Alpha beta gamma delta epsilon zeta"), (4, None, "alpha beta gamma delta epsilon"), (5, "", "Résumé of some other longer words here"), (6, None, None)]
    asked = [
        (10, "https://doi.org/10.1000%2FabC).,", "nothing alike", 1, "doi"), (11, "https://x.org/10.1000/none", "One two three four five", None, None), (12, "https://www.bmj.com/p", "one TWO three four five", 1, "title"),
        (13, "https://a.example.org/doi/1", "alpha beta gamma delta epsilon", 3, "title"), (14, "https://example.org/p", "alpha beta gamma delta epsilon", None, None), (15, "https://ard.bmj.com/p", "alpha beta gamma delta", None, None),
        (16, None, None, None, None), (17, "https://notbmj.com/p", "one two three four five", None, None), (18, "https://jacc.org/%zz", "unseen words only one two three four", None, None), (19, "https://bmj.com/10.1000/zzz", "one two three four five", 1, "title"),
    ]
    got = resolving.resolved(spark.createDataFrame([a[:3] for a in asked], "article_id int, url string, title string"), spark.createDataFrame(index, "record_id int, doi string, title string"))
    assert sorted(map(tuple, got.collect())) == [(a[0], *a[3:]) for a in asked]


def test_titles_match_like_all_pairs(spark):
    rng = random.Random(3)
    titles = lambda n: [(i, " ".join(rng.sample(["the", "of", "aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"], rng.randint(3, 9)))) for i in range(n)]
    a, b = titles(120), titles(150)
    words = lambda rows, key: spark.createDataFrame(rows, f"{key} int, t string").select(key, F.split("t", " ").alias("__words"))
    got = {r["x"]: r["y"] for r in resolving.title_matches(words(a, "x"), words(b, "y"), "x", "y").collect()}
    want = {}
    for i, t in a:
        s = set(t.split())
        hits = [j for j, u in b if len(s) >= 5 and len(s & set(u.split())) >= 0.8 * len(s | set(u.split()))]
        if hits:
            want[i] = min(hits)
    assert got == want and len(want) > 20


def test_copies_of_titles_meet_once(spark):
    """3000 copies of a title are one set: 9 million pairs would be joined otherwise; two least keys are kept, not one."""
    from quernel.operators import contracts, matching

    copy, near, far = "one two three four five".split(), "one two three four five six".split(), "one two seven eight nine".split()
    rows = [(k, copy[k % 5 :] + copy[: k % 5]) for k in range(1, 3001)] + [(0, near), (3001, far), (3002, ["one", "two"])]
    frame = spark.createDataFrame(rows, "k long, w array<string>")
    got = {r["k"]: r["resolved"] for r in contracts.similar_titles(frame, frame, "k", "w").collect()}
    assert got == {0: 1} | {k: 0 for k in range(1, 3001)}
    named = frame.select(F.col("w").alias("__words"), matching.set_id(F.col("w")).alias("__set")).dropDuplicates(["__set"])
    met = matching.like_sets(named, named, 0.8).collect()
    assert len(met) == 6  # four sets with themselves, and one pair both ways
    words = lambda name: frame.select(F.col("k").alias(name), F.col("w").alias("__words"))
    found = {r["x"]: r["y"] for r in resolving.title_matches(words("x"), words("y"), "x", "y").collect()}
    assert found == {k: 0 for k in range(3001)} | {3001: 3001}


RECORD = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal>
<ArticleTitle>A <i>b</i> &amp; c</ArticleTitle><Abstract><AbstractText Label="AIM">One
 two</AbstractText><AbstractText>Three <sub>4</sub></AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author><Author><CollectiveName>X</CollectiveName></Author></AuthorList>
<ArticleDate><Year>2000</Year></ArticleDate><ArticleDate><Year>1999</Year></ArticleDate><PublicationTypeList><PublicationType>Review</PublicationType><PublicationType>Clinical Trial</PublicationType></PublicationTypeList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/a</ArticleId><ArticleId IdType="pmc">PMC1</ArticleId><ArticleId IdType="doi">10.1/b</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedArticle/></PubmedArticleSet>"""


def test_shredding(spark):
    rows = [(1, RECORD), (2, "<a><b></a>"), (3, None), (4, "<PubmedArticleSet/>"), (5, ""), (6, RECORD.replace("<PubmedArticle/>", "").replace("</PubmedArticleSet>", RECORD[RECORD.index("<PubmedArticle>") : RECORD.index("<PubmedArticle/>")] + "</PubmedArticleSet>"))]
    found = records.shredded(spark.createDataFrame(rows, "k int, xml string"), ["k"])
    assert sorted((r["k"], r["place"], r["fault"]) for r in found.collect()) == [(1, 0, None), (1, 1, None), (2, 0, "malformed"), (5, 0, "malformed"), (6, 0, None), (6, 1, None)]
    flat = {(r["k"], r["place"]): r for r in records.article_rows(found, ["k"]).collect()}
    r = flat[1, 0]
    assert (r["source_id"], r["title"], r["abstract"], r["authors"], r["year"], r["venue"], r["doi"], r["pmcid"], r["study_design"], r["publication_date"], r["full_text_hint"]) == ("PMID:7", "A b & c", "AIM\nOne two\nThree 4", ["L, F"], "2001", "J", "10.1/b", "PMC1", "clinical_trial", "2000", "pmc")
    empty = flat[1, 1]
    assert (empty["source_id"], empty["title"], empty["abstract"], empty["authors"], empty["study_design"], empty["abstract_available"], empty["full_text_hint"]) == (None, "", "", [], "unspecified", False, "unknown")
    assert flat[6, 0]["pmid"] == flat[6, 1]["pmid"] == "7"


def test_records_leave_a_task_in_small_batches(spark, monkeypatch):
    """Batches of records are bounded by characters and by number, whatever a batch of texts holds."""
    import pyarrow as pa

    xml = RECORD.replace("Three", "Three " * 200)
    monkeypatch.setattr(records, "CHARS", 4 * len(xml))
    seen = {}
    frame = spark.createDataFrame([(1, xml)], "k int, xml string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: seen.update(run=f) or self)
    records.shredded(frame, ["k"])
    batches = list(seen["run"](iter([pa.RecordBatch.from_pylist([{"k": i, "xml": xml} for i in range(10)])])))
    assert [b.num_rows for b in batches] == [8, 8, 4]
    assert [r for b in batches for r in b.column("k").to_pylist()] == [i for i in range(10) for _ in range(2)]


def test_read_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RECORD)
    (tmp_path / "b.xml").write_text("<broken")
    assert sorted((os.path.basename(r["path"]), r["place"], r["pmid"], r["fault"]) for r in records.read_records(spark, str(tmp_path)).collect()) == [("a.xml", 0, "7", None), ("a.xml", 1, None, None), ("b.xml", 0, None, "malformed")]


def test_replace_whole_is_all_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/out/table"
    sinks.replace_whole(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        sinks.replace_whole(bad, path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(f"{tmp_path}/out") == ["table"]
    os.makedirs(f"{tmp_path}/out/.writing-table-killed/_temporary")  # what a killed job leaves
    sinks.replace_whole(spark.range(9), path, "json")
    assert spark.read.json(path).count() == 9 and os.listdir(f"{tmp_path}/out") == ["table"]


@pytest.mark.parametrize("relative", ["", "/", "..", "../x", "a/../../x", "/etc", ".", "./", "a\\b", "s3://x/y", "a\0b", None, 3, "a/../.."])
def test_paths_stay_in_their_root(relative):
    with pytest.raises(ValueError, match="path"):
        sinks.contained("/root/store", relative)


def test_contained_paths():
    assert sinks.contained("/r/", "a/./b/../c") == "/r/a/c" and sinks.contained("hdfs://n/r", "..a/b") == "hdfs://n/r/..a/b"


def test_failures_are_recorded_once(spark, tmp_path):
    rows = spark.createDataFrame([("browse", "PMID:1", "why", "timeout", None, 2), ("browse", "PMID:1", "why", "timeout", None, 2), ("browse", "PMID:1", "other", "timeout", "X", None)], "tool_name string, source_id string, focused_query string, error_code string, error_type string, attempts int")
    path = f"{tmp_path}/failures"
    sinks.record_failures(rows, path)
    sinks.record_failures(rows, path)
    got = spark.read.json(path).collect()
    assert len(got) == 2 and all(r["bucket"] == r["manifest_sha256"][:2] for r in got)
    assert "why" not in "".join(json.dumps(r.asDict()) for r in got) and {r["focused_query_sha256"] for r in got} == {hashlib.sha256(q.encode()).hexdigest() for q in ("why", "other")}
    digests = {r["path"].removeprefix("file:"): r["sha256"] for r in sinks.file_digests(spark, path).collect()}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.startswith("part-"):
                with open(f"{folder}/{n}", "rb") as f:
                    assert hashlib.sha256(f.read()).hexdigest() == digests[f"{folder}/{n}"]


def test_evidence_proofs(spark):
    old = [("s", "a", "one two three four"), ("s", "b", None), ("t", "a", "zz")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    span = [{"start": 0, "end": 4}, {"start": 8, "end": 13}]
    new = [
        (1, "s", "a", "one two three four", None, None, "copy"), (2, "s", "b", "", None, None, "copy"), (3, "s", "a", "one … three", span, sha(old[0][2]), "exact_spans"), (4, "s", "a", "one … threE", span, sha(old[0][2]), "card_text_not_exact_spans"),
        (5, "s", "a", "one … three", span, sha("x"), "card_parent_hash"), (6, "s", "a", "one … three", span, None, "card_parent_hash"), (7, "s", "a", "one", None, None, "untraced_evidence_change"), (8, "t", "b", "", None, None, "future_or_invented_source"),
        (9, "s", "a", "", [], sha(old[0][2]), "exact_spans"), (10, "s", "a", "one", [{"start": -1, "end": 3}], sha(old[0][2]), "card_text_not_exact_spans"), (11, "s", "a", "four", [{"start": 14, "end": 99}], sha(old[0][2]), "card_text_not_exact_spans"), (11, "t", "a", "zz", None, None, "copy"), (12, None, None, None, None, None, "future_or_invented_source"),
    ]
    frame = spark.createDataFrame([n[:6] for n in new], "k int, stage_id string, source_id string, text string, spans array<struct<start:int,end:int>>, parent_sha256 string")
    got = alignment.evidence_proofs(spark.createDataFrame(old, "stage_id string, source_id string, text string"), frame)
    assert got.columns == [*frame.columns, "proof"]
    assert sorted((r["k"], r["proof"]) for r in got.collect()) == sorted((n[0], n[6]) for n in new)
    counts = {(r["table"], r["name"]): r["n"] for r in alignment.summary(evidence=got).collect()}
    assert counts["evidence", "copy"] == 3 and sum(counts.values()) == len(new)


def test_state_chains(spark):
    rows = [("q", 1, "R1", "unknown", [], "partial", ["a"], ["a", "b"], None), ("q", 2, "R1", "partial", ["a"], "direct", ["b"], ["b"], None), ("q", 3, "R1", "partial", ["a"], "direct", ["b"], ["b"], "state_prior_mismatch"), ("q", 1, "R2", "unknown", None, "missing", None, None, None),
            ("q", 2, "R2", "missing", [], "direct", ["z"], ["b"], "state_unopened_citation"), ("q", 3, "R2", "direct", ["z"], "unknown", ["b"], ["b"], "unknown_with_citation"), ("p", 1, "R1", "unknown", [], "partial", [], ["b"], "support_without_citation"), ("p", 2, "R1", "partial", [], "sure", [], [], "invalid_status"), ("p", 3, "R1", "sure", [], None, [], [], "invalid_status")]
    frame = spark.createDataFrame([r[:8] for r in rows], "q string, n int, item_id string, prior_status string, prior_ids array<string>, status string, evidence_ids array<string>, opened_ids array<string>")
    assert sorted(map(tuple, alignment.chain_faults(frame, ["q"], "n").collect())) == sorted((r[0], r[1], r[2], r[8]) for r in rows if r[8])


def test_row_faults_and_leaks(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (4, "d", 4)], "k int, t string, n int")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "x", 9), (5, "e", 5), (1, "a", 1)], "k int, t string, n int")
    assert sorted(map(tuple, alignment.row_faults(old, new, "k", ["t", "n"]).collect())) == [(1, "repeated"), (2, "n_changed"), (3, "t_changed"), (4, "missing"), (5, "added")]
    rows = spark.createDataFrame([(1, "train"), (1, "dev"), (2, "train"), (2, "train"), (3, "test"), (3, "dev"), (None, "dev")], "k int, s string")
    assert [r["k"] for r in alignment.leaked(rows, "k", "s").collect()] == [1]


