"""Queries of identities, bindings, caches, gates and inventories over the standard tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import extensions
from ..functions import text as X
from ..operators import caching, contracts, judging, ranking
from ..sources import datasets
from .catalogue import t, whole_seconds
from .registry import query


def _digest(*parts: str) -> str:
    told = ", ".join(f"coalesce(strlen(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '-')" for p in parts)
    return f"sha256(concat_ws(',', {told}))"


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""WITH r AS (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 9 = 0 THEN 'x' ELSE {_digest('s_name', 's_nationkey')} END AS id FROM supplier)
SELECT s_suppkey, CASE WHEN id <> {_digest('s_name', 's_nationkey')} THEN 'identity' WHEN s_name IS NULL THEN 'null s_name' WHEN s_nationkey IS NULL THEN 'null s_nationkey' WHEN s_nationkey NOT IN (1, 2, 3, 4, 5) THEN 'value s_nationkey' END AS fault FROM r""")
def identity_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that aren't the digest of their row, and values outside their sets."""
    rows = t(spark, sf_dir, "supplier").withColumn("id", F.when(F.col("s_suppkey") % 9 == 0, "x").otherwise(contracts.digest(F.col("s_name"), F.col("s_nationkey"))))
    return contracts.identity_faults(rows, "id", ["s_name", "s_nationkey"], {"s_nationkey": [1, 2, 3, 4, 5]}).select("s_suppkey", "fault")


@query(f"""WITH q AS (SELECT conv_id, list(text ORDER BY turn, text) AS texts, count(*) FILTER (role = 'user') AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT conv_id, CASE WHEN trim(texts[1]) <> '' AND len(texts) > 1 AND len(list_distinct(texts[2:])) = len(texts) - 1 AND n % 3 <> 0 THEN {_digest("texts[1]", "array_to_string(texts[2:], chr(10))", "''", "CASE n % 3 WHEN 1 THEN 'grounded' ELSE 'own' END")} END AS scope FROM q""")
def task_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of tasks; null where question, requirements or mode don't hold."""
    rows = t(spark, sf_dir, "conversations").filter("text is not null")
    own = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"), F.count_if(F.col("role") == "user").alias("n"))
    mode = F.when(F.col("n") % 3 == 1, "grounded").when(F.col("n") % 3 == 2, "own").otherwise("other")
    rest = F.slice("texts", F.lit(2), F.greatest(F.size("texts") - 1, F.lit(0)))
    return own.select("conv_id", contracts.task_scope(F.col("texts")[0], rest, F.array().cast("array<string>"), mode, ["grounded", "own"]).alias("scope"))


@query(f"""WITH b AS (SELECT {_LINE}, {_digest('l_orderkey', 'l_linenumber', 'l_partkey')} AS d, l_discount * 10 AS score FROM lineitem)
SELECT {_LINE}, round(1e-1 * (2 * score - 1), 6) AS value, l_linenumber % 4 <> 0 AND l_linenumber % 5 <> 0 AS bound FROM b""")
def target_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores count where their digest is the one of the sampled target; a stop's value from its score."""
    key = _LINE.split(", ")
    rows = t(spark, sf_dir, "lineitem").select(*key, (F.col("l_discount") * 10).alias("score"), contracts.digest(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("d"))
    scores = rows.withColumn("d", F.when(F.col("l_linenumber") % 4 == 0, F.lit("changed")).otherwise(F.col("d")))
    out = contracts.bound_scores(scores, rows.filter("l_linenumber % 5 <> 0"), key, "d", "score")
    return out.select(*key, F.round(contracts.stop_value(F.col("score")), 6).alias("value"), "bound")


@query("""WITH c AS (SELECT user_id, event_type, min(event_id % 5) AS lo, max(event_id % 5) AS hi FROM events WHERE event_id % 7 = 0 GROUP BY ALL), r AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT user_id, event_type, CASE WHEN lo IS NULL THEN 'miss' WHEN lo = hi THEN 'hit' ELSE 'conflict' END AS state, CASE WHEN lo = hi THEN lo END AS result FROM r LEFT JOIN c USING (user_id, event_type)""")
def validated_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a cache by exact key; a key with several results is a conflict."""
    rows = t(spark, sf_dir, "events")
    stored = rows.filter("event_id % 7 = 0").select("user_id", "event_type", (F.col("event_id") % 5).alias("value"))
    return contracts.cached(rows.select("user_id", "event_type").distinct(), stored, ["user_id", "event_type"], "value")


@query("""SELECT event_id, CASE WHEN e IS NULL THEN 'done' WHEN e = 'transport' THEN 'pending' WHEN e = 'contract' AND a = 1 THEN 'retry' ELSE 'rejected' END AS state
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'contract' WHEN 'signup' THEN 'transport' END AS e, 1 + event_id % 2 AS a FROM events)""")
def contract_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("event_type") == "error", "contract").when(F.col("event_type") == "signup", "transport")
    return t(spark, sf_dir, "events").select("event_id", contracts.retry_state(1 + F.col("event_id") % 2, error).alias("state"))


@query(f"""SELECT c_mktsegment, {_digest("string_agg(c_custkey || '=' || c_nationkey, chr(10) ORDER BY CAST(c_custkey AS VARCHAR))")} AS profile, count(*) AS n FROM customer GROUP BY c_mktsegment""")
def scorer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over all settings of a scorer, in the order of their names."""
    settings = F.transform(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("k"), F.col("c_nationkey").alias("v")))), lambda x: F.concat(x["k"], F.lit("="), x["v"].cast("string")))
    return t(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(contracts.digest(F.array_join(settings, "\n")).alias("profile"), F.count("*").alias("n"))


@query("""WITH f AS (SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'mode' WHEN value < 0 OR value > 50 THEN 'range' WHEN user_id % 10 = 0 THEN 'owner' END AS fault FROM events) SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY fault""")
def input_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the input contract, by their first fault: an unknown mode, a value out of range, a private owner."""
    rules = {"mode": ~F.col("event_type").isin("view", "click", "purchase"), "range": (F.col("value") < 0) | (F.col("value") > 50), "owner": F.col("user_id") % 10 == 0}
    fault = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return t(spark, sf_dir, "events").select(fault.alias("fault")).filter("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))


_FOLD = r"lower(trim(regexp_replace(translate(coalesce({}, ''), '‘’“”–—−', '''''""---'), '[ \t\n\r ]+', ' ', 'g')))"


@query(f"""WITH c AS (SELECT conv_id, turn, text, lead(turn) OVER w AS next_turn, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, length(q) > 0 AND contains({_FOLD.format('text')}, q) AS quoted FROM (SELECT conv_id, turn, text, {_FOLD.format("substr(text, 5, 40)")} AS q FROM c)""")
def quoted_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a quote stands in its source, but for quotes, dashes, case and white space."""
    source, quote = X.folded_quote(F.col("text")), X.folded_quote(F.substring("text", 5, 40))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.length(quote) > 0) & source.contains(quote)).alias("quoted"))


@query("""WITH w AS (SELECT l_orderkey AS k, l_linenumber AS i FROM lineitem WHERE l_linenumber <= 4), g AS (SELECT l_orderkey AS k, CASE WHEN l_quantity > 45 THEN 1 ELSE l_linenumber END AS i, CASE WHEN l_tax < 0.01 THEN 2.0 ELSE l_discount END AS s FROM lineitem),
o AS (SELECT k, i, count(*) AS n, min(s) AS lo, max(s) AS hi FROM g GROUP BY ALL), j AS (SELECT coalesce(w.k, o.k) AS l_orderkey, coalesce(w.i, o.i) AS l_linenumber, CASE WHEN n IS NULL THEN 'unanswered' WHEN w.k IS NULL THEN 'unasked' WHEN n > 1 THEN 'repeated' WHEN lo < 0 OR hi > 1 THEN 'range' END AS fault FROM w FULL JOIN o ON w.k = o.k AND w.i = o.i)
SELECT * FROM j WHERE fault IS NOT NULL""")
def response_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against the records asked for."""
    rows = t(spark, sf_dir, "lineitem")
    given = rows.select("l_orderkey", F.when(F.col("l_quantity") > 45, 1).otherwise(F.col("l_linenumber")).alias("l_linenumber"), F.when(F.col("l_tax") < 0.01, 2.0).otherwise(F.col("l_discount")).alias("s"))
    return contracts.response_faults(rows.filter("l_linenumber <= 4"), given, ["l_orderkey", "l_linenumber"], "s")


@query("""WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE event_type IN ('view', 'click')),
b AS (SELECT user_id, CASE WHEN event_id % 50 = 0 THEN 'other' ELSE event_type END AS event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE event_type IN ('view', 'click') AND event_id % 31 <> 0),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, CAST(coalesce(a.place, b.place) AS INTEGER) AS place, CASE WHEN a.event_type IS NULL THEN 'no decision' WHEN b.event_type IS NULL THEN 'no execution' WHEN a.event_type <> b.event_type THEN 'content' END AS fault FROM a FULL JOIN b ON a.user_id = b.user_id AND a.place = b.place)
SELECT * FROM j WHERE fault IS NOT NULL""")
def execution_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions against the tool log, by place."""
    rows = t(spark, sf_dir, "events").filter("event_type in ('view', 'click')").select("user_id", "event_id", "event_type")
    log = rows.filter("event_id % 31 <> 0").withColumn("event_type", F.when(F.col("event_id") % 50 == 0, "other").otherwise(F.col("event_type")))
    return contracts.positional_faults(rows, log, "user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT p_partkey, md5(p_name) AS h FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN md5(p_name || '!') ELSE md5(p_name) END AS h FROM part WHERE p_partkey % 13 <> 0),
j AS (SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' WHEN a.h <> b.h THEN 'changed' END AS fault FROM a FULL JOIN b USING (p_partkey)) SELECT * FROM j WHERE fault IS NOT NULL""")
def inventory_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against a release's list of hashes."""
    rows = t(spark, sf_dir, "part")
    found = rows.filter("p_partkey % 13 <> 0").select("p_partkey", F.md5(F.when(F.col("p_partkey") % 17 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).alias("h"))
    return contracts.inventory_faults(rows.filter("p_partkey % 11 <> 0").select("p_partkey", F.md5("p_name").alias("h")), found, "p_partkey", "h")


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'direct' WHEN 'O' THEN 'partial' ELSE 'unknown' END AS status, list(CAST(l_linenumber AS INTEGER) ORDER BY l_linenumber) AS refs FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
k AS (SELECT *, list_filter(refs, lambda x: x IN (1, 3, 4)) AS kept FROM r)
SELECT o_orderkey, CASE WHEN len(kept) = 0 AND status IN ('partial', 'direct') THEN 'unknown' WHEN len(kept) > 0 AND len(kept) < len(refs) THEN 'partial' ELSE status END AS status, array_to_string(kept, ',') AS refs FROM k""")
def visible_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that are still open, and what that leaves of a status."""
    refs = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("refs"))
    status = F.when(F.col("o_orderstatus") == "F", "direct").when(F.col("o_orderstatus") == "O", "partial").otherwise("unknown")
    rows = t(spark, sf_dir, "orders").join(refs, F.col("o_orderkey") == F.col("l_orderkey"))
    seen = rows.select("o_orderkey", contracts.visible_refs(status, F.col("refs"), F.array(F.lit(1), F.lit(3), F.lit(4))).alias("v"))
    return seen.select("o_orderkey", "v.status", F.array_join(F.transform("v.refs", lambda x: x.cast("string")), ",").alias("refs"))


@query("""SELECT a.conv_id, a.turn, md5(b.text) AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with its very next one, where both have the kinds wanted."""
    rows = t(spark, sf_dir, "conversations").withColumns({"asks": F.col("role") == "user", "tells": F.col("role") == "assistant", "h": F.md5("text")})
    return contracts.followed(rows, ["conv_id"], "turn", F.col("asks"), F.col("tells"), "h").select("conv_id", "turn", F.col("next_h").alias("answer"))


@query("""WITH l AS (SELECT n_regionkey, n_nationkey, n_name, CASE WHEN n_nationkey % 3 <> 0 THEN n_name || '*' END AS own FROM nation) SELECT s_suppkey, coalesce(own, s_name) AS title, own IS NOT NULL AS found FROM supplier LEFT JOIN l ON s_nationkey = n_nationkey""")
def provenance_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What discovery knows of a source replaces what the row says."""
    known = t(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.concat("n_name", F.lit("*"))).alias("own"))
    return t(spark, sf_dir, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("own", "s_name").alias("title"), F.col("own").isNotNull().alias("found"))


GRADES = {"A": 1.0, "R": 0.5, "N": 0.0}


@query("""WITH g AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 WHEN 'N' THEN CASE WHEN l_tax > 0.07 THEN NULL ELSE 0.0 END END AS v, l_quantity AS w, l_linenumber AS i FROM lineitem)
SELECT l_orderkey, CASE WHEN count(v) = count(*) THEN round(sum(CAST(v AS DOUBLE) * w) / sum(w), 6) END AS score, bool_and(i <= 6) AS complete, bool_or(coalesce(v = 0, false)) AS material FROM g GROUP BY l_orderkey""")
def stage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as values, their weighted mean (null if one isn't observable), whether all ids are listed, and errors."""
    value = F.when((F.col("l_returnflag") == "N") & (F.col("l_tax") > 0.07), F.lit(None).cast("double")).otherwise(judging.graded(F.col("l_returnflag"), GRADES))
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w"), value.alias("v"))
    return judging.stage_scores(rows, ["l_orderkey"], "v", "w", F.col("l_linenumber") <= 6).select("l_orderkey", F.round("score", 6).alias("score"), "complete", "material")


@query(r"""WITH r AS (SELECT source, lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS key, CASE WHEN doc_id % 7 = 6 THEN 'not_required' WHEN doc_id % 97 = 4 THEN 'unobservable' WHEN doc_id % 2 = 0 THEN 'supported' ELSE 'partial' END AS v FROM documents WHERE text IS NOT NULL),
g AS (SELECT source, key, CASE WHEN count(*) FILTER (v = 'unobservable') > 0 THEN NULL ELSE min(CASE v WHEN 'supported' THEN 1.0 ELSE 0.5 END) END AS m FROM r WHERE v <> 'not_required' GROUP BY ALL)
SELECT source, CASE WHEN count(m) = count(*) THEN round(CAST(avg(m) AS DOUBLE), 6) END AS score FROM g GROUP BY source""")
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of equal whole text count once, with their least value; rows that need no support don't count."""
    verdict = F.when(F.col("doc_id") % 7 == 6, "not_required").when(F.col("doc_id") % 97 == 4, "unobservable").when(F.col("doc_id") % 2 == 0, "supported").otherwise("partial")
    rows = t(spark, sf_dir, "documents").filter("text is not null").select("source", "text", verdict.alias("v"))
    return judging.dimension_scores(rows, "source", "text", "v", {"supported": 1.0, "partial": 0.5}, "not_required").select("source", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT l_orderkey, avg(l_discount * 10) AS a, sum(l_tax * l_quantity) / sum(l_quantity) * 12 AS b, min(l_quantity) / 50 AS c, avg(CASE WHEN l_returnflag = 'A' THEN 1.0e0 WHEN l_returnflag = 'N' THEN 0.0e0 END) AS d FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round((0.4e0 * a + 0.3e0 * b + 0.2e0 * c + CASE WHEN d IS NULL THEN 0 ELSE 0.1e0 * d END) / CASE WHEN d IS NULL THEN 0.9e0 ELSE 1.0e0 END, 9) AS score FROM p""")
def final_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, fidelity, citation and limitation coverage as one weighted mean of those that are known."""
    w = F.col("l_quantity")
    parts = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg(F.col("l_discount") * 10).alias("a"), (F.sum(F.col("l_tax") * w) / F.sum(w) * 12).alias("b"), (F.min(w) / 50).alias("c"), F.avg(F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.0)).alias("d"))
    return parts.select("l_orderkey", F.round(judging.known_mean([(F.col("a"), 0.4), (F.col("b"), 0.3), (F.col("c"), 0.2), (F.col("d"), 0.1)]), 9).alias("score"))


@query("""WITH r AS (SELECT conv_id, turn, list_distinct(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' END, CASE WHEN length(text) < 40 THEN 'short' END, CASE WHEN contains(text, '?') THEN 'open' END, CASE WHEN turn > 4 THEN 'late' END, CASE WHEN length(text) < 20 THEN 'short' END], lambda x: x IS NOT NULL)) AS reasons FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, len(reasons) = 0 AS accepted, array_to_string(list_sort(reasons), ',') AS reasons FROM r""")
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons against an answer, each once; accepted without any."""
    text = F.col("text")
    reasons = judging.reasons((text.isNull() | (F.trim(text) == ""), "empty"), (F.length(text) < 40, "short"), (text.contains("?"), "open"), (F.col("turn") > 4, "late"), (F.length(text) < 20, "short"))
    rows = t(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", reasons.alias("r"))
    return rows.select("conv_id", "turn", (F.size("r") == 0).alias("accepted"), F.array_join(F.array_sort("r"), ",").alias("reasons"))


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(epoch(ts) AS BIGINT) AS s, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, s AS stored, false AS hit FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.s - f.stored < 86400 THEN f.stored ELSE e.s END, e.s - f.stored < 86400 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, hit FROM f""")
def probe_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request meets an entry younger than a day; an entry dates from the miss that stored it."""
    rows = t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), whole_seconds(F.col("ts")).alias("s"))
    return caching.with_expiry(rows, "user_id", "s", "at", 86400).select("at.event_id", "hit")


@query("""WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seen, count(DISTINCT event_id % 3) > 1 AS mixed FROM events GROUP BY ALL) SELECT * FROM l""")
def provenance_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each id, and whether its versions disagree on what must not change."""
    return caching.upserted(t(spark, sf_dir, "events").withColumn("fixed", F.col("event_id") % 3), ["user_id", "event_type"], "event_id", "value", "fixed").select("user_id", "event_type", "value", F.col("event_id").alias("seen"), "mixed")


@query("""WITH d AS (SELECT l_orderkey, md5(string_agg(l_linenumber || ':' || l_partkey, ';' ORDER BY l_linenumber, l_partkey)) AS now, md5(string_agg(l_linenumber || ':' || CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE l_partkey END, ';' ORDER BY l_linenumber, CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE l_partkey END)) AS then_ FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, now AS digest, now <> then_ AS stale FROM d""")
def evidence_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of packed evidence, and which snapshots are stale against them."""
    rows = t(spark, sf_dir, "lineitem")

    def packed(part: Column) -> DataFrame:
        return rows.groupBy("l_orderkey").agg(caching.packed_digest("l_linenumber", part).alias("d"))

    then = packed(F.when(F.col("l_partkey") % 50 == 0, 0).otherwise(F.col("l_partkey"))).select("l_orderkey", F.col("d").alias("old"))
    return packed(F.col("l_partkey")).join(then, "l_orderkey").select("l_orderkey", F.col("d").alias("digest"), (F.col("d") != F.col("old")).alias("stale"))


@query("""WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id, md5(user_id || ':' || event_id) AS receipt FROM e WHERE event_type = 'click' AND before IN ('view', 'click')""")
def delivery_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each delivery that followed an allowed state."""
    return caching.receipts(t(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "click", ["view", "click"]).select("event_id", "receipt")


@query("""SELECT user_id, event_type, arg_max(props, event_id) AS text, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def opened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of each opened source, failures left out."""
    return t(spark, sf_dir, "events").filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("text"), F.count("*").alias("n"))


@query("""SELECT host, page_id FROM (SELECT lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host, min(page_id) AS page_id FROM pages GROUP BY 1)""")
def candidate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item of each canonical source."""
    rows = t(spark, sf_dir, "pages").select(X.host(F.col("url")).alias("host"), "page_id")
    return ranking.keep_first(rows, ["host"], [F.col("page_id")])


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN json_type(props) = 'OBJECT' THEN 'object' ELSE 'other' END AS kind, CASE WHEN event_type = 'error' THEN 0 ELSE len(json_keys(props)) END AS n FROM events""")
def output_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of any shape as one struct."""
    failed = F.col("event_type") == "error"
    kind = F.when(failed, "error").when(F.json_object_keys("props").isNotNull(), "object").otherwise("other")
    return t(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.when(failed, 0).otherwise(F.size(F.json_object_keys("props"))).cast("long").alias("n"))


@query("""SELECT 'question' AS kind, 'q' || item_id AS span_id, length(text) AS n FROM benchmark UNION ALL SELECT 'requirement', 'r' || conv_id || '.' || turn, length(text) FROM conversations WHERE role = 'user' UNION ALL SELECT 'evidence', 'e' || conv_id || '.' || turn, length(text) FROM conversations WHERE role = 'assistant'""")
def context_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of question, requirements and evidence under prefixed ids."""
    turns, size = t(spark, sf_dir, "conversations"), F.length("text").cast("long").alias("n")

    def of(role: str, kind: str) -> DataFrame:
        return turns.filter(F.col("role") == role).select(F.lit(kind).alias("kind"), F.concat(F.lit(kind[0]), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("span_id"), size)

    asked = t(spark, sf_dir, "benchmark").select(F.lit("question").alias("kind"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("span_id"), size)
    return asked.unionByName(of("user", "requirement")).unionByName(of("assistant", "evidence"))


@query("""WITH d AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 9)] AS x FROM embeddings) SELECT vec_id, round(x[1] - ln(list_sum([exp(v) FOR v IN x])), 6) AS logp FROM d""")
def constrained_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of a token among those that are allowed."""
    allowed = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(allowed, 1) - F.log(F.aggregate(allowed, F.lit(0.0), lambda a, x: a + F.exp(x))), 6).alias("logp"))


@query("""SELECT n_regionkey, sha256(string_agg(md5(n_name), chr(10) ORDER BY md5(n_name))) AS identity FROM nation GROUP BY n_regionkey""")
def model_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over the sorted hashes of a model's files."""
    return t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.md5("n_name"))), "\n"), 256).alias("identity"))


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS INTEGER) AS place, source FROM documents QUALIFY place <= 30""")
def seeded_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a shuffle that a seed fixes, of each source."""
    return datasets.seeded_head(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 42, 30, ["source"])


@query("""SELECT md5(text) AS id, text AS problem, 'Answer in short.' AS additional_instructions FROM benchmark""")
def dataset_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set by its registered name, in the shape that all of them have."""
    return extensions.DATASETS["short_answers"](t(spark, sf_dir, "benchmark"))


@query("""SELECT doc_id, source, CAST(place AS INTEGER) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 5""")
def named_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranker by its registered name."""
    return extensions.RANKERS["longest"](t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], 5).select("doc_id", "source", "place")


@query("""SELECT doc_id, source, length(regexp_replace(coalesce(text, ''), '[^a-z]+', '', 'g')) AS n FROM documents WHERE lang = 'en'""")
def chained_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered operators one after another."""
    english = extensions.OPERATORS["only"]({"column": "lang", "value": "en"})
    letters = extensions.OPERATORS["letters"]({"column": "text", "into": "n"})
    return extensions.chain(english, letters)(t(spark, sf_dir, "documents")).select("doc_id", "source", "n")


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN 'accepted' WHEN contains(text, 'the') THEN 'too short' ELSE 'unsupported' END AS verdict FROM conversations WHERE text IS NOT NULL""")
def support_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's validator: true accepts, a string is a reason, false the standard one."""
    verdict = extensions.verdict(lambda r: F.when(F.length(r["text"]) > 60, "true").when(r["text"].contains("the"), "too short").otherwise("false"))
    return t(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", verdict({"text": F.col("text")}).alias("verdict"))


@query("""SELECT c_custkey, CASE WHEN trim(coalesce(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END, '')) <> '' THEN trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END) ELSE c_mktsegment END AS preview, CASE WHEN starts_with(c_mktsegment, 'B') OR starts_with(c_mktsegment, 'M') THEN 'paper' ELSE 'web' END AS kind FROM customer""")
def candidate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public fields of a candidate: its first field with text, and its kind by the prefix of its id."""
    name = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name"))
    kind = F.when(F.col("c_mktsegment").rlike("^[BM]"), "paper").otherwise("web")
    return t(spark, sf_dir, "customer").select("c_custkey", X.first_given(name, F.col("c_mktsegment")).alias("preview"), kind.alias("kind"))


@query("""SELECT conv_id, md5('Dialogue:' || chr(10) || string_agg('[' || turn || '] ' || upper(role) || ' ' || length(coalesce(text, '')), chr(10) ORDER BY turn, role, text)) AS prompt FROM conversations GROUP BY conv_id""")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template over the ordered rows of a conversation."""
    line = lambda x: F.concat(F.lit("["), x["turn"].cast("string"), F.lit("] "), F.upper(x["role"]), F.lit(" "), F.length(F.coalesce(x["text"], F.lit(""))).cast("string"))
    rows = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.md5(F.concat(F.lit("Dialogue:\n"), F.array_join(F.transform("m", line), "\n"))).alias("prompt"))


@query("""WITH x AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<answer>' || text || '</answer>' WHEN 1 THEN 'so <answer> ' || text WHEN 2 THEN text ELSE '<answer>a</answer><answer>' || text END AS a FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'recovered' WHEN 2 THEN 'missing' ELSE 'invalid' END AS status, CASE turn % 4 WHEN 0 THEN md5(trim(a[9:-10])) WHEN 1 THEN md5(trim(a[12:])) END AS body FROM x""")
def answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of a final answer and how it was framed."""
    k, text = F.col("turn") % 4, F.col("text")
    framed = F.when(k == 0, F.concat(F.lit("<answer>"), text, F.lit("</answer>"))).when(k == 1, F.concat(F.lit("so <answer> "), text)).when(k == 2, text).otherwise(F.concat(F.lit("<answer>a</answer><answer>"), text))
    rows = t(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", X.answer_parts(framed).alias("p"))
    return rows.select("conv_id", "turn", "p.status", F.md5("p.body").alias("body"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'kept' ELSE 'plain' END AS left_as FROM conversations""")
def orphan_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading closing tags go only where an action follows at once."""
    raw = F.when(F.col("turn") % 3 == 0, "</think> </think>\n<call_tool name=\"s\">q</call_tool>").when(F.col("turn") % 3 == 1, "</think> so <call_tool name=\"s\">q</call_tool>").otherwise("no tags")
    clean = X.without_orphans(raw)
    told = F.when(clean.startswith("<call_tool"), "call").when(clean.startswith("</think>"), "kept").otherwise("plain")
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", told.alias("left_as"))
