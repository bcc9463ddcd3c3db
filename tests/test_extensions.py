"""Extension registries, XML articles, actions and quotes, sinks of documents, and keyed state on streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quernel import extensions
from quernel.operators import caching, contracts, selection
from quernel.sources import articles, datasets
from quernel.streaming import caches


def test_registries_refuse_unknown_and_repeated_names():
    with pytest.raises(KeyError, match="no ranker named x"):
        extensions.RANKERS["x"]
    with pytest.raises(ValueError, match="registered already"):
        extensions.RANKERS.add("longest")(None)
    assert extensions.PARSERS["markdown"]("# A\nb") == [("A", "b")]


def test_searchers_and_chains(spark):
    rows = spark.createDataFrame([(1, "g", "the the cat", "en"), (2, "g", "a dog", "en"), (3, "g", "le chat", "fr")], "doc_id long, g string, text string, lang string")
    best = extensions.SEARCHERS["lexical"](rows, ["cat"], "g", "doc_id", 1).collect()
    assert [r["doc_id"] for r in best] == [1]
    both = extensions.chain(extensions.OPERATORS["only"]({"column": "lang", "value": "fr"}), extensions.OPERATORS["letters"]({"column": "text", "into": "n"}))(rows)
    assert [(r["doc_id"], r["n"]) for r in both.collect()] == [(3, 6)]


def test_models_run_only_for_what_the_cache_lacks(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(99, None)], "id long, text string")
    cache = spark.createDataFrame([("t3", "kept")], "key string, value string")
    model = extensions.model_column(lambda: lambda texts: [None if t is None else t.upper() for t in texts], "string", 4)
    got = {r["id"]: r["out"] for r in extensions.cached_model(rows, cache, F.col("text"), model, "text", "out").collect()}
    assert got[3] == "kept" and got[4] == "T4" and got[99] is None and len(got) == 21


ARTICLE = """<?xml version="1.0"?><!DOCTYPE article><a:article xmlns:a="http://x"><a:front>
<a:abstract abstract-type="teaser"><a:p>Tease</a:p></a:abstract><a:abstract abstract-type="key-points"><a:p>Points</a:p></a:abstract><a:abstract><a:p>Plain  text</a:p></a:abstract></a:front>
<a:body><a:sec><a:title>One</a:title><a:p>First</a:p><a:sec><a:title>Inner</a:title><a:p>Second</a:p></a:sec></a:sec><a:sec><a:title>Again</a:title><a:p>First</a:p></a:sec></a:body></a:article>"""


def test_article_parts():
    assert articles.article_parts(ARTICLE) == [("Abstract", "Plain text"), ("Abstract", "Points"), ("One", "First"), ("Inner", "Second")]
    assert articles.article_parts("<article><abstract abstract-type='teaser'>only</abstract><body>whole <b>body</b></body></article>") == [("Abstract", "only"), ("Body", "whole body")]
    for bad in (None, "", "<article>", "<!DOCTYPE a [<!ENTITY x 'y'>]><article><body>&x;</body></article>"):
        assert articles.article_parts(bad) == []


def test_template_nodes_go_with_a_record():
    page = "<body><div class='share'><a href=1>Share on A</a> <a href=2>Share on B</a></div><div class='text'><p>Prose that stays.</p></div><ul class='nav'><li>Not a link</li></ul></body>"
    kept, dropped = articles.without_templates(page)
    assert dropped == [("div", "links")] and "Share" not in kept and "Prose that stays." in kept and "Not a link" in kept
    assert articles.without_templates(None) == ("", [])


def test_quotes_give_the_exact_slice(spark):
    assert articles.located("He said “so  it\nis” – twice", 'said "so it is" - TWICE') == "said “so  it\nis” – twice"
    assert articles.located("abc", "") is None and articles.located(None, "x") is None and articles.located("abc", "d") is None
    assert spark.createDataFrame([("a ’b’", "'B'")], "s string, q string").select(articles.exact_quote(F.col("s"), F.col("q"))).first()[0] == "’b’"


def test_json_that_ends_a_text_and_strict_json(spark):
    rows = [('x {"a": {"b": 1}}', '{"a": {"b": 1}}', False), ('{"a": 1}\n```\n', '{"a": 1}', False), ('{"a": 1} no', None, False), (None, None, False), ('{"a": 1, "b": [2]}', '{"a": 1, "b": [2]}', True), ('{"a": {"c": 1, "c": 2}}', '{"a": {"c": 1, "c": 2}}', False), ("{x}", None, False)]
    got = spark.createDataFrame(rows, "t string, j string, s boolean").select("t", "j", "s", articles.terminal_json(F.col("t")).alias("tj"), articles.strict_json(F.col("t")).alias("ts")).collect()
    assert all(r["j"] == r["tj"] and r["s"] == r["ts"] for r in got)


def test_actions_have_exact_keys(spark):
    rows = [('{"tool": "s", "arguments": {"q": 1}}', "s"), ('{"tool": "s"}', None), ('<call_tool name="b" k="2">x</call_tool>', "b"), ('so <call_tool name="b">x</call_tool>', None), ("{", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want string").select("want", articles.action(F.col("t"))["tool"].alias("tool")).collect()
    assert all(r["want"] == r["tool"] for r in got)


def test_document_store_keeps_one_of_each_content(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1)], "id long, text string, n int")
    datasets.add_documents(rows, "id", path)
    datasets.add_documents(rows.union(spark.createDataFrame([(4, "c", 2)], rows.schema)), "id", path)
    got = datasets.stored_documents(spark, path).collect()
    assert sorted(r["text"] for r in got) == ["a", "b", "c"] and all(r["sha"].startswith(r["bucket"]) for r in got)
    assert list((tmp_path / "store").rglob("*.json.gz"))


def test_results_nest_the_original_row(spark, tmp_path):
    q = spark.createDataFrame([("i", "what")], "id string, problem string")
    datasets.write_results(q, spark.createDataFrame([("i", "that")], "id string, answer string"), "id", str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.json"))
    assert json.loads(text) == {"id": "i", "original_data": {"id": "i", "problem": "what"}, "answer": "that"}


def test_unknown_events_and_repeated_sessions_fail(spark, tmp_path):
    events = spark.createDataFrame([("s", "search"), ("s", "odd")], "session string, kind string")
    datasets.append_checked(events.filter("kind = 'search'"), str(tmp_path / "log"), "kind", ["search"])
    with pytest.raises(Exception, match="unknown kind odd"):
        datasets.append_checked(events, str(tmp_path / "log"), "kind", ["search"])
    for name, session in (("a", "one"), ("b", "two")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"session": session}))
    assert datasets.sessions(spark, str(tmp_path / "*.json"), "session", "session string").count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"session": "one"}))
    with pytest.raises(Exception, match="repeated session"):
        datasets.sessions(spark, str(tmp_path / "*.json"), "session", "session string").collect()


CONFIG = {"task": {"stop_scale": 0.1, "tool_cost": 0.0, "policy_penalty": 0.1, "coverage_values": {"unknown": 0, "partial": 0.5, "direct": 1}}, "channels": {"final": {"local": 0, "final": 1, "loss_weight": 1}}}


@pytest.mark.parametrize("where, value", [(("task", "stop_scale"), 0), (("task", "tool_cost"), -1), (("task", "coverage_values", "partial"), 2), (("channels", "final", "local"), -1)])
def test_configs_are_checked(where, value):
    contracts.checked_config(CONFIG)
    bad = json.loads(json.dumps(CONFIG))
    own = bad
    for k in where[:-1]:
        own = own[k]
    own[where[-1]] = value
    with pytest.raises(ValueError):
        contracts.checked_config(bad)


def test_headers_come_back_without_loss(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, h string")
    packed, names = caching.factored(rows, "h", "k")
    assert sorted(map(tuple, packed.join(names, "k").select("id", "h").collect())) == [(1, "x"), (2, "y"), (3, "x")] and names.count() == 2


def test_greedy_takes_what_fits(spark):
    rows = spark.createDataFrame([("One two. Three four five! Six? Seven eight",), ("",), (None,)], "t string")
    parts = selection.sentences(F.col("t"))
    items = selection.preferred(parts, lambda s: F.length(s))
    got = [r[0] for r in rows.select(selection.joined(parts, selection.greedy(items, F.lit(4)))).collect()]
    assert got == ["Three four five! Six?", "", ""]


def stream(spark, tmp_path, batches, schema):
    source = tmp_path / "in"
    source.mkdir()
    for k, batch in enumerate(batches):  # files are read in the order of their times
        file = source / f"{k}.json"
        file.write_text("\n".join(json.dumps(dict(zip(schema, r, strict=True))) for r in batch))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(", ".join(f"{n} {t}" for n, t in schema.items())).option("maxFilesPerTrigger", 1).json(str(source))


def drained(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_failures_expire_and_clear_on_success(spark, tmp_path):
    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    batches = [[("h", at(0), True), ("h", at(60), True), ("g", at(0), True)], [("h", at(120), False), ("h", at(180), True), ("g", at(1200), True)], [("h", at(1800), False)]]
    events = stream(spark, tmp_path, batches, {"host": "string", "ts": "timestamp", "failed": "boolean"})
    got = {(r["host"], r["ts"].minute): (r["failures"], r["blocked"]) for r in drained(caches.failure_state(events, "host", "ts", "failed"), tmp_path, "failures")}
    assert got == {("h", 0): (1, False), ("h", 1): (2, True), ("h", 2): (0, True), ("h", 3): (1, False), ("h", 30): (0, False), ("g", 0): (1, False), ("g", 20): (1, False)}


def test_results_are_kept_until_they_expire(spark, tmp_path):
    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    batches = [[("k", at(0), None), ("k", at(60), "a")], [("k", at(300), "b"), ("k", at(700), "c")]]
    asked = stream(spark, tmp_path, batches, {"key": "string", "ts": "timestamp", "result": "string"})
    got = {r["ts"].minute: (r["hit"], r["value"]) for r in drained(caches.result_cache(asked, "key", "ts", "result"), tmp_path, "results")}
    assert got == {0: (False, None), 1: (False, "a"), 5: (True, "a"), 11: (False, "c")}


def test_requests_expire_in_order_of_their_exact_time(spark, tmp_path):
    import datetime

    import duckdb

    from quernel.plans import registry

    at = lambda s, ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s, milliseconds=ms)
    rows = [(1, at(0, 300), 1), (2, at(86399, 600), 1), (3, at(0, 200), 2), (4, at(0, 100), 2), (5, at(0, 600), 3), (6, at(86400, 400), 3), (8, at(0, 600), 9), (9, at(864000, 400), 9)]
    rows += [(k, at(0, 900), 4) for k in range(20, 30)]
    frame = spark.createDataFrame([(e, ts, u, "view", 1.0, "{}") for e, ts, u in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        for name in ("probe_cache", "response_cache"):
            got = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()))
            assert got == sorted(con.sql(registry.oracle_sql()[name]).fetchall()), name


def test_packets_digest_every_text(spark, tmp_path):
    import hashlib

    import duckdb

    from quernel.plans import registry

    rows = [(1, k, "user", f"text {k}") for k in range(9)] + [(2, 0, "system", None), (2, 0, "system", "x"), (2, 1, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, registry.queries()["judge_packets"](spark, str(tmp_path)).collect()))
    assert got[0] == (1, 5, True, hashlib.md5("|".join(f"text {k}" for k in range(9)).encode()).hexdigest())
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert got == sorted(con.sql(registry.oracle_sql()["judge_packets"]).fetchall())


def test_bindings_of_rows_with_and_without_a_source(spark, tmp_path):
    """The digests are compared before the join: only whether they differ is shuffled, not two texts a row."""
    from quernel.plans import registry

    spark.range(40).selectExpr("id AS l_orderkey", "id % 7 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(0, 40, 2).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    rows = registry.queries()["source_binding"](spark, str(tmp_path))
    want = {k: "no source" if k % 2 or k % 7 == 0 else "hash" if k % 7 % 6 == 5 else "bound" for k in range(40)}
    assert {r["l_orderkey"]: r["state"] for r in rows.collect()} == want
    join = next(p for p in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in p)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan[: plan.index(join)] and "md5" in plan[plan.index(join) :]
