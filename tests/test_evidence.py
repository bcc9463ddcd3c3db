"""Edge cases of judged scores, histories, budgets, question sets and markup."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quernel.operators import budget, judging, trajectory
from quernel.sources import datasets, markup


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("out")).first()["out"]


def test_stage_scalar_needs_its_core(spark):
    on = F.lit(True)
    score, status = judging.stage_scalar([(F.lit(None).cast("double"), 0.5, on), (F.lit(1.0), 0.5, on)], F.lit(1), F.lit(False))
    assert one(spark, score) is None and one(spark, status) == "pending_core"
    score, _ = judging.stage_scalar([(F.lit(None).cast("double"), 0.5, ~on), (F.lit(0.5), 0.5, on)], F.lit(1), F.lit(True))
    assert one(spark, score) == 0.5
    assert one(spark, judging.stage_scalar([(F.lit(1.0), 1.0, on)], F.lit(1), F.lit(False))[0]) == 1.0
    assert one(spark, judging.stage_scalar([(F.lit(1.0), 1.0, ~on)], F.lit(1), F.lit(False))[1]) == "pending_core"


def test_atomic_support(spark):
    def status(*v):
        return one(spark, judging.atomic_support(*[F.lit(x).cast("boolean") for x in v]))

    assert [status(None, None, None, None), status(True, True, True, True), status(True, True, False, False), status(False, False, False, False)] == ["unknown", "direct", "partial", "none"]
    for bad in ((None, True, True, True), (True, False, True, True)):
        with pytest.raises(Exception, match="invalid combination"):
            status(*bad)


def test_coverage_gain_status(spark):
    kind = "k string, i int, v double, w double"
    before = spark.createDataFrame([("up", 1, 0.0, 1.0), ("down", 1, 1.0, 1.0), ("new", 1, 0.0, 1.0)], kind)
    after = spark.createDataFrame([("up", 1, 0.5, 2.0), ("down", 1, 0.5, 1.0), ("new", 1, 0.0, 1.0), ("new", 2, 1.0, 1.0)], kind)
    got = {r["k"]: (r["gain"], r["status"]) for r in judging.coverage_gain(before, after, ["k"], "i", "v", "w").collect()}
    assert got == {"up": (1.0, "observed_positive"), "down": (0.0, "needs_review"), "new": (None, "unobservable")}


def test_gaps_of_overlapping_and_outer_spans(spark):
    spans = spark.createDataFrame([(1, 2, 5), (1, 3, 4), (1, 7, 20), (2, 0, 10), (3, 12, 15)], "k int, a int, b int")
    got = sorted(map(tuple, trajectory.gaps(spans, ["k"], "a", "b", 0, 10).collect()))
    assert got == [(1, 0, 2), (1, 5, 7), (3, 0, 10)]


def test_best_match_needs_one_winner_and_the_numbers(spark):
    claims = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["a", "7"]), (1, 2, []), (1, 3, ["c"])], "k int, t int, w array<string>")
    of = spark.createDataFrame([(1, 10, ["a", "b"]), (1, 11, ["a", "7", "c"]), (1, 12, ["c"])], "k int, e int, w array<string>")
    got = {r["t"]: r["e"] for r in trajectory.best_match(claims, of, ["k"], "t", "e", "w").collect()}
    assert got == {0: 10, 1: 11, 2: None, 3: None}


def test_terminal_order_and_chain(spark):
    log = spark.createDataFrame([(1, 1, "stop"), (1, 2, "call"), (1, 3, "final"), (1, 4, "final")], "k int, o int, e string")
    got = trajectory.terminal_order(log, ["k"], "o", F.col("e") == "final", F.col("e") == "stop").collect()
    assert sorted((r["o"], r["violation"]) for r in got) == [(2, "after_stop"), (4, "after_final")]
    chain = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "b", None), (1, 3, None, "c"), (1, 4, "d", "e")], "k int, o int, x string, y string")
    assert [r["o"] for r in trajectory.broken_chain(chain, ["k"], ["o"], "x", "y").collect()] == [4]


def test_whole_chunks_skip_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, "d", 0, "a" * 9), (1, "d", 1, "b" * 5), (1, "d", 2, "c"), (1, "d", 3, "d"), (1, "e", 4, " "), (1, "f", 5, "x y"), (1, "f", 6, "x  y"), (1, "g", 7, "z")], "k int, s string, o int, t string")
    got = budget.whole_chunks(rows, ["k"], "s", "o", "t", documents=2, chunks=3, total=10)
    assert sorted(r["o"] for r in got.collect()) == [0, 2, 5]
    assert budget.whole_chunks(rows.limit(0), ["k"], "s", "o", "t").count() == 0


def test_encrypted_questions(spark, tmp_path):
    key = hashlib.sha256(b"pw").digest()
    text = 'who, "é"?'
    hidden = base64.b64encode(bytes(b ^ key[i % 32] for i, b in enumerate(text.encode()))).decode()
    (tmp_path / "q.csv").write_text(f"problem,canary\n{hidden},pw\n")
    rows = datasets.read_questions(spark, str(tmp_path / "q.csv"), instructions="go")
    got = datasets.decrypted(rows, ["problem"], "canary").first()
    assert got["problem"] == text and got["additional_instructions"] == "go" and got["id"] == hashlib.md5(hidden.encode()).hexdigest()


def test_resumed_output_has_each_row_once(spark, tmp_path):
    rows, path = spark.range(5).withColumn("v", F.lit("x")), str(tmp_path / "out")
    datasets.append_missing(rows.filter("id < 3"), path, "id")
    datasets.append_missing(rows, path, "id")
    assert [r["id"] for r in datasets.merged_shards(spark, [path], "id long, v string", "id").collect()] == [0, 1, 2, 3, 4]


def test_answers_and_byte_cut(spark):
    assert one(spark, datasets.answers(F.col("v")), json.dumps(["a", "b"])) == ["a", "b"]
    assert one(spark, datasets.answers(F.col("v")), "a") == ["a"] and one(spark, datasets.answers(F.col("v")), None) == []
    assert one(spark, datasets.set_answers(F.col("v"), F.lit(True)), " a, ,b") == ["a", "b"]
    for text in ("x" * 3 + "é" * 9, "€" * 9, "\U0001f600" * 5, "x" * 20, "", "ab" + "\U0001f600" * 5):
        want = text.encode()[:10].decode("utf-8", "ignore")
        assert one(spark, datasets.last_bytes_cut(F.col("v"), 10), text) == want


def test_markup(spark):
    assert markup.markdown_parts("intro\n# A #\ntext\n##   B\n\nmore\n# C") == [("", "intro"), ("A", "text"), ("B", "more")]
    assert markup.markdown_parts(None) == [] and markup.markdown_parts("only") == [("", "only")]
    xml = '<a><AbstractText Label="AIM">x <i>y</i></AbstractText><AbstractText NlmCategory="METHODS">z</AbstractText><AbstractText>w</AbstractText><AbstractText/></a>'
    assert markup.abstract_parts(xml) == [("AIM", "x y"), ("METHODS", "z"), ("Abstract", "w")] and markup.abstract_parts("<a>") == []
    rows = spark.createDataFrame([(1, "# A\nb"), (2, None)], "k long, t string")
    assert [tuple(r) for r in markup.sections(rows, "k", "t", markup.markdown_parts).collect()] == [(1, 0, "A", "b")]
    call = one(spark, markup.tool_call(F.col("v")), 'x <call_tool name="s" limit="8" year="2021">a\nb</call_tool>')
    assert (call["name"], call["attributes"], call["body"]) == ("s", {"limit": "8", "year": "2021"}, "a\nb")
    assert one(spark, markup.tool_call(F.col("v")), "none") is None


@pytest.mark.parametrize(("text", "ids"), [('<cite id="a,b">x</cite> <cite id="b,c">y</cite>', ["a", "b", "c"]), ("plain", []), (None, []), ('<cite id="a">x', None), ('<cite id="a"><cite id="b">x</cite></cite>', None), ('<cite id="a" x="1">x</cite>', None)])
def test_citation_ids(spark, text, ids):
    assert one(spark, markup.citation_ids(F.col("v")), text) == ids
