"""The queries of the engine over the standard tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget, matching, ranking, rewards, scoring
from .registry import query

#: A stand-in for a user's question; a repeated term counts twice.
QUESTION = ["the", "tion", "of", "the", "with"]
ANCHOR = ["and", "thst", "of"]
TOKEN_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[一-鿿]')"
DESIGNS = [("meta", "synthesis"), ("trial|random", "trial"), ("cohort|was", "observational")]
AUTHORITY = [("example.org", 120), ("example.com", 80), ("ththth.example.net", 100)]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_seconds(ts: Column) -> Column:
    """Seconds since 1970, rounded half to even as SQL's CAST(epoch(ts) AS BIGINT) does; a cast of Spark's cuts them off."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)).cast("long")


def _bm25_sql(terms: list[str], name: str) -> str:
    distinct = sorted(set(terms))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) AS f{k}" for k, q in enumerate(distinct))
    df = ", ".join(f"sum(CASE WHEN f{k} > 0 THEN 1 ELSE 0 END) AS d{k}" for k in range(len(distinct)))
    parts = " + ".join(f"{terms.count(q)} * ln((n - d{k} + 0.5) / (d{k} + 0.5) + 1) * f{k} * 2.5 / (f{k} + 1.5 * (0.25 + 0.75 * l / avg_l))" for k, q in enumerate(distinct))
    return f"""{name}_w AS (SELECT doc_id, source, {TOKEN_SQL} AS w FROM documents),
{name}_f AS (SELECT doc_id, source, len(w) AS l, {tf} FROM {name}_w),
{name}_s AS (SELECT source, count(*) AS n, greatest(avg(l), 1e-9) AS avg_l, {df} FROM {name}_f GROUP BY source),
{name} AS (SELECT doc_id, source, round({parts}, 6) AS {name}_score FROM {name}_f JOIN {name}_s USING (source))"""


@query(f"""WITH {_bm25_sql(QUESTION, "bm25")}
SELECT doc_id, source, bm25_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bm25_score DESC, doc_id) AS rank FROM bm25) WHERE rank <= 20""")
def lexical_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scored = scoring.bm25(docs, QUESTION, "source", "text", "bm25_score").select("doc_id", "source", "bm25_score")
    return scoring.top_per_group(scored, ["source"], [F.col("bm25_score").desc(), F.col("doc_id")], 20)


@query(f"""WITH {_bm25_sql(QUESTION, "focus")}, {_bm25_sql(ANCHOR, "anchor")},
both_scores AS (SELECT doc_id, source, focus_score, anchor_score FROM focus JOIN anchor USING (doc_id, source)),
tops AS (SELECT source, max(focus_score) AS mf, max(anchor_score) AS ma FROM both_scores GROUP BY source),
blended AS (SELECT doc_id, b.source, round(CASE WHEN mf > 0 THEN 0.8 * focus_score / mf ELSE 0 END + CASE WHEN ma > 0 THEN 0.2 * anchor_score / ma ELSE 0 END, 6) AS score FROM both_scores b JOIN tops USING (source))
SELECT doc_id, source, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM blended) WHERE rank <= 10""")
def focus_anchor_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    two = scoring.bm25_many(docs, {"focus": QUESTION, "anchor": ANCHOR}, "source", "text").select("doc_id", "source", "focus", "anchor")
    scored = scoring.blend(two, "source", [("focus", 0.8), ("anchor", 0.2)], "score").select("doc_id", "source", "score")
    return scoring.top_per_group(scored, ["source"], [F.col("score").desc(), F.col("doc_id")], 10)


@query("""WITH c AS (SELECT label, embedding AS centre FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n = 1),
s AS (SELECT vec_id, e.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(centre AS DOUBLE[])), 6) AS score FROM embeddings e JOIN c USING (label))
SELECT vec_id, label, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def dense_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors to the first vector of their label."""
    rows = t(spark, sf_dir, "embeddings")
    centre = ranking.keep_first(rows, ["label"], [F.col("vec_id")]).select(F.col("label").alias("l"), F.col("embedding").alias("centre"))
    scored = rows.join(centre, F.col("label") == F.col("l")).select("vec_id", "label", F.round(scoring.cosine(F.col("embedding"), F.col("centre")), 6).alias("score"))
    return scoring.top_per_group(scored, ["label"], [F.col("score").desc(), F.col("vec_id")], 10)


@query(f"""WITH {_bm25_sql(QUESTION, "bm25")},
c AS (SELECT label, embedding AS centre FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n = 1),
d AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(centre AS DOUBLE[])), 6) AS dense FROM embeddings JOIN c USING (label)),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY bm25_score DESC, doc_id) AS r0, row_number() OVER (PARTITION BY source ORDER BY dense DESC, doc_id) AS r1 FROM bm25 JOIN d USING (doc_id)),
f AS (SELECT doc_id, source, round(CASE WHEN r0 <= 8 THEN 1.0 / (60 + r0) ELSE 0 END + CASE WHEN r1 <= 8 THEN 1.0 / (60 + r1) ELSE 0 END, 6) AS rrf FROM r WHERE r0 <= 8 OR r1 <= 8)
SELECT doc_id, source, rrf, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rrf DESC, doc_id) AS place FROM f) WHERE place <= 12""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lexical = scoring.bm25(docs, QUESTION, "source", "text", "bm25").select("doc_id", "source", "bm25")
    rows = t(spark, sf_dir, "embeddings")
    centre = ranking.keep_first(rows, ["label"], [F.col("vec_id")]).select(F.col("label").alias("l"), F.col("embedding").alias("centre"))
    dense = rows.join(centre, F.col("label") == F.col("l")).select(F.col("vec_id").alias("v"), F.round(scoring.cosine(F.col("embedding"), F.col("centre")), 6).alias("dense"))
    both = lexical.join(dense, F.col("doc_id") == F.col("v")).drop("v")
    return scoring.reciprocal_rank_fusion(both, ["source"], ["bm25", "dense"], ["doc_id"]).select("doc_id", "source", "rrf", "place")


_HOST_SQL = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))"


@query(f"""WITH p AS (SELECT page_id, {_HOST_SQL} AS host, CAST(length(html) % 400 AS DOUBLE) AS score, regexp_extract(url, '/([a-z]{{2}})/', 1) AS lang FROM pages),
a AS (SELECT *, round(score - 30.0 * (row_number() OVER (PARTITION BY lang, host ORDER BY score DESC, page_id) - 1), 6) AS adjusted FROM p)
SELECT page_id, host, lang, adjusted, CAST(row_number() OVER (PARTITION BY lang ORDER BY adjusted DESC, page_id) AS INTEGER) AS place FROM a""")
def domain_diverse_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t(spark, sf_dir, "pages").select("page_id", X.host(F.col("url")).alias("host"), (F.length("html") % 400).cast("double").alias("score"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"))
    return ranking.diverse(pages, ["lang"], "host", "score", [F.col("page_id")]).select("page_id", "host", "lang", "adjusted", "place")


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r,
  row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS s FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY (s > 1), r) AS place FROM r) WHERE place <= 5""")
def section_diverse_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return ranking.section_first(rows, ["l_suppkey"], "l_returnflag", order, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("""WITH l AS (SELECT o_custkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY pos, o_orderpriority) AS n FROM l) WHERE n = 1)
SELECT o_orderstatus, o_custkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY pos, o_orderpriority) AS place FROM f) WHERE place <= 50""")
def round_robin_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t(spark, sf_dir, "orders")
    orders = orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    lists = ranking.ranked(orders, ["o_orderstatus", "o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], "pos")
    return ranking.round_robin(lists, ["o_orderstatus"], "o_custkey", "pos", "o_orderpriority", 50).select("o_orderstatus", "o_custkey", "place")


@query("SELECT c_custkey, c_mktsegment, CAST(ntile(8) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS INTEGER) AS shard FROM customer")
def ntile_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.shards(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], [F.col("c_custkey")], 8)


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, event_type = 'signup' AS na FROM events)
SELECT event_id, user_id, CASE WHEN max(CASE WHEN v IS NULL AND NOT na THEN 1 ELSE 0 END) OVER w = 0 THEN round(sum(CASE WHEN na THEN 0.0 ELSE v END) OVER w, 6) END AS return_to_go
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def return_to_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return rewards.return_to_go(rows, ["user_id"], ["event_id"], "v", F.col("event_type") == "signup").select("event_id", "user_id", "return_to_go")


@query("SELECT event_id, user_id, CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS decision_index FROM events")
def decision_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return rewards.running_count(rows, ["user_id"], ["event_id"], F.col("event_type").isin("click", "purchase"), "decision_index").drop("event_type")


@query("""WITH m AS (SELECT event_type, user_id % 4 AS member, avg(value) AS own_mean FROM events GROUP BY ALL),
g AS (SELECT *, count(own_mean) OVER w AS n, sum(own_mean) OVER w AS total FROM m WINDOW w AS (PARTITION BY event_type))
SELECT event_type, member, round(own_mean, 6) AS own_mean, CASE WHEN n > 1 THEN round(own_mean - (total - own_mean) / (n - 1), 6) END AS advantage FROM g""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("member"), "value")
    return rewards.leave_one_out(rows, ["event_type"], "member", "value").withColumn("own_mean", F.round("own_mean", 6))


@query("""WITH e AS (SELECT user_id, coalesce(value, 0) / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
SELECT user_id, round(greatest(-1.0, least(1.0, sum(v * power(0.9, k)))), 6) AS discounted FROM e GROUP BY user_id""")
def discounted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 100).alias("v"))
    return rewards.discounted_return(rows, ["user_id"], ["event_id"], "v")


@query("""WITH o AS (SELECT conv_id, turn, role, min(CASE WHEN role = 'assistant' THEN turn END) OVER w AS nx, min(CASE WHEN role = 'user' THEN turn END) OVER w AS nc
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT conv_id, turn, CASE WHEN nc IS NULL OR nx < nc THEN nx END AS output_at FROM o WHERE role = 'user'""")
def paired_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return matching.paired_calls(rows, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "output_at")


_TOKENS_C = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[一-鿿]'))"


@query(f"""WITH c AS (SELECT conv_id, role, turn, {_TOKENS_C} AS w FROM conversations),
p AS (SELECT a.conv_id, a.role, a.turn, b.turn AS o, len(list_intersect(a.w, b.w)) AS s, len(a.w) AS n, len(b.w) AS m FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.role = b.role AND b.turn < a.turn)
SELECT conv_id, role, turn, count(*) AS near_before FROM p WHERE n + m = 0 OR s >= 0.85 * (n + m - s) GROUP BY ALL""")
def near_dup_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text")
    return matching.near_actions(rows, ["conv_id", "role"], "turn", X.token_set(F.col("text")))


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type FROM events)
SELECT event_id, user_id, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS recent, least(60, 20 * CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT)) AS penalty
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 900 PRECEDING AND CURRENT ROW)""")
def ttl_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("s"))
    found = matching.recent_count(rows, ["user_id"], F.col("s"), F.col("event_type") == "error")
    return found.select("event_id", "user_id", "recent", F.least(F.lit(60).cast("long"), 20 * F.col("recent")).alias("penalty"))


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'cleared' END AS o FROM events)
SELECT user_id, arg_max(o, event_id) AS last_outcome FROM e WHERE o IS NOT NULL GROUP BY user_id""")
def failed_then_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "cleared")
    return matching.last_outcome(t(spark, sf_dir, "events"), ["user_id"], ["event_id"], outcome)


@query("""WITH m AS (SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL)
SELECT doc_id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM m) WHERE rank <= 3""")
def unopened_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = matching.missing(t(spark, sf_dir, "documents").select("doc_id", "source"), t(spark, sf_dir, "labels"), ["doc_id"])
    return scoring.top_per_group(left, ["source"], [F.col("doc_id")], 3)


@query("""WITH n AS (SELECT l_orderkey AS o_orderkey, min(l_linestatus) AS status FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n.status IS NULL THEN 'dropped' ELSE 'changed' END AS violation FROM orders LEFT JOIN n USING (o_orderkey) WHERE n.status IS NULL OR o_orderstatus <> n.status""")
def append_only_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("o_orderstatus"))
    return matching.ledger_violations(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), new, "o_orderkey", "o_orderstatus")


@query("""SELECT d.source, CASE WHEN count(*) = count(l.quality) THEN round(sum(d.n_chars * l.quality) / sum(d.n_chars), 6) END AS strict_mean, round(sum(d.n_chars * l.quality) FILTER (l.quality IS NOT NULL) / sum(d.n_chars) FILTER (l.quality IS NOT NULL), 6) AS known_mean
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def weighted_mean_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = t(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("w")).join(t(spark, sf_dir, "labels"), "doc_id", "left")
    known = F.sum(F.when(F.col("quality").isNotNull(), F.col("w") * F.col("quality"))) / F.nullif(F.sum(F.when(F.col("quality").isNotNull(), F.col("w"))), F.lit(0.0))
    return both.groupBy("source").agg(F.round(rewards.weighted_mean(F.col("quality").cast("double"), F.col("w")), 6).alias("strict_mean"), F.round(known, 6).alias("known_mean"))


@query("""SELECT o_custkey, count(DISTINCT o_orderpriority) AS members, bool_and(o_totalprice IS NOT NULL) AS whole, count(DISTINCT o_orderpriority) = 4 AND bool_and(o_totalprice IS NOT NULL) AS admitted FROM orders GROUP BY o_custkey""")
def group_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.group_gate(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", 4, "o_totalprice")


@query("""WITH r AS (SELECT doc_id, 1 + quality AS rank, [CAST(doc_id AS VARCHAR)] AS refs FROM labels UNION ALL SELECT doc_id, 2 * toxic, CASE WHEN toxic = 1 THEN ['E' || doc_id] ELSE [] END FROM labels)
SELECT doc_id, ['unknown', 'partial', 'direct'][max(rank) + 1] AS status, array_to_string(list_sort(list_distinct(flatten(list(refs)))), ',') AS refs FROM r GROUP BY doc_id""")
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior and new coverage of one requirement: the higher status, the sorted union of the evidence."""
    labels = t(spark, sf_dir, "labels")
    new = F.when(F.col("toxic") == 1, F.array(F.concat(F.lit("E"), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    best = F.greatest(1 + F.col("quality"), 2 * F.col("toxic"))
    refs = F.array_sort(F.array_union(F.array(F.col("doc_id").cast("string")), new))
    return labels.select("doc_id", F.element_at(F.array(F.lit("unknown"), F.lit("partial"), F.lit("direct")), (best + 1).cast("int")).alias("status"), F.array_join(refs, ",").alias("refs"))


@query("""WITH g AS (SELECT d.source, md5(lower(d.text)) AS k, CASE WHEN count(*) = count(l.quality) THEN min(l.quality) END AS least FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL)
SELECT source, count(*) AS texts, CASE WHEN count(*) = count(least) THEN round(avg(least), 6) END AS score, round(avg(least), 6) AS known FROM g GROUP BY source""")
def min_group_then_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = t(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.lower("text")).alias("k")).join(t(spark, sf_dir, "labels"), "doc_id", "left")
    least = both.groupBy("source", "k").agg(F.when(F.count("*") == F.count("quality"), F.min("quality")).alias("least"))
    return least.groupBy("source").agg(F.count("*").alias("texts"), F.round(rewards.weighted_mean(F.col("least").cast("double")), 6).alias("score"), F.round(F.avg("least"), 6).alias("known"))


@query("""WITH p AS (SELECT l_orderkey, l_suppkey, max(l_quantity) AS w FROM lineitem GROUP BY ALL), n AS (SELECT l_orderkey, count(*) AS n FROM p GROUP BY 1)
SELECT l_suppkey, round(sum(w / n), 6) AS credit FROM p JOIN n USING (l_orderkey) GROUP BY l_suppkey""")
def split_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.split_credit(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity")


@query("SELECT l_partkey, min(l_orderkey) AS covered_by FROM lineitem WHERE l_quantity >= 40 AND l_discount <= 0.02 GROUP BY l_partkey")
def first_cover_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.first_cover(t(spark, sf_dir, "lineitem"), ["l_partkey"], "l_orderkey", (F.col("l_quantity") >= 40) & (F.col("l_discount") <= 0.02))


_SPANS = "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 300 AS BIGINT) AS a, CAST(l_partkey % 300 + l_quantity * 3 AS BIGINT) AS b, l_returnflag FROM lineitem"


@query(f"""WITH s AS ({_SPANS})
SELECT x.l_orderkey, x.l_linenumber AS token, y.l_linenumber AS span FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.a < y.b AND x.b > y.a AND x.a < x.b AND y.a < y.b WHERE x.l_returnflag = 'R' AND y.l_returnflag <> 'R'""")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("l_partkey") % 300).cast("long")
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", a.alias("a"), (a + F.col("l_quantity") * 3).cast("long").alias("b"))
    tokens = rows.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("token"), F.col("a").alias("t_start"), F.col("b").alias("t_end"))
    spans = rows.filter("l_returnflag <> 'R'").select("l_orderkey", F.col("l_linenumber").alias("span"), F.col("a").alias("s_start"), F.col("b").alias("s_end"))
    return matching.overlapping(tokens, spans, "l_orderkey").select("l_orderkey", "token", "span")


@query("""SELECT k, min(doc_id) AS first_id, max(doc_id) AS last_id, arg_max(source, doc_id) AS last_source FROM (SELECT md5(text) AS k, doc_id, source FROM documents) GROUP BY k""")
def keep_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").select(F.md5("text").alias("k"), "doc_id", "source")
    first = ranking.keep_first(rows, ["k"], [F.col("doc_id")]).select("k", F.col("doc_id").alias("first_id"))
    last = ranking.keep_last(rows, ["k"], ["doc_id"]).select("k", F.col("doc_id").alias("last_id"), F.col("source").alias("last_source"))
    return first.join(last, "k")


@query(f"""WITH p AS (SELECT page_id, {_HOST_SQL} AS host FROM pages), a(suffix, authority) AS (VALUES {", ".join(f"('{d}', {v})" for d, v in AUTHORITY)})
SELECT page_id, host, coalesce(max(authority), 60) AS authority, coalesce(max(authority), 60) >= 100 AS high FROM p LEFT JOIN a ON host = suffix OR host LIKE '%.' || suffix GROUP BY page_id, host""")
def authority_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(AUTHORITY, "suffix string, authority int")  # a fixed list, so it may be broadcast
    pages = t(spark, sf_dir, "pages").select("page_id", X.host(F.col("url")).alias("host"))
    met = pages.select("page_id", "host", F.explode(X.host_suffixes(F.col("host"))).alias("suffix")).join(F.broadcast(rules), "suffix", "left")
    best = F.coalesce(F.max("authority"), F.lit(60))
    return met.groupBy("page_id", "host").agg(best.alias("authority"), (best >= 100).alias("high"))


@query("""WITH x AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.][0-9]+)?')) AS c FROM documents)
SELECT a.doc_id, len(a.c) AS claimed, len(list_filter(a.c, lambda v: NOT list_contains(coalesce(b.c, []), v))) AS unsupported FROM x a LEFT JOIN x b ON a.doc_id + 1 = b.doc_id""")
def claim_numbers_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that each text claims and the text cited for it (the next document) doesn't have."""
    rows = t(spark, sf_dir, "documents").select("doc_id", X.numbers(F.col("text")).alias("c"))
    cited = rows.select((F.col("doc_id") - 1).alias("claim"), F.col("c").alias("n"))
    both = rows.join(cited, F.col("doc_id") == F.col("claim"), "left")
    known = F.coalesce("n", F.array().cast("array<string>"))
    return both.select("doc_id", F.size("c").cast("long").alias("claimed"), F.size(F.array_except("c", known)).cast("long").alias("unsupported"))


_SCRIPT_SQL = "CASE WHEN len(regexp_extract_all(regexp_replace(coalesce({0}, ''), '<[^>]*>', '', 'g'), '[一-鿿]')) >= 12 THEN 'cjk' WHEN len(regexp_extract_all(regexp_replace(coalesce({0}, ''), '<[^>]*>', '', 'g'), '[A-Za-z]')) >= 4 THEN 'latin' ELSE 'none' END"


@query(f"""WITH o AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
SELECT conv_id, turn, {_SCRIPT_SQL.format("text")} = {_SCRIPT_SQL.format("answer")} AS matches FROM o WHERE role = 'user' AND answer IS NOT NULL""")
def language_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = t(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.filter("role = 'user' AND answer IS NOT NULL").select("conv_id", "turn", X.language_match(F.col("text"), F.col("answer")).alias("matches"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{v}'" for p, v in DESIGNS) + " ELSE 'other' END AS design FROM documents")
def study_design_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", X.first_case(F.col("text"), DESIGNS, "other").alias("design"))


@query("""WITH x AS (SELECT l_orderkey, l_discount * 3 - l_tax AS d, l_quantity / 10 - 2 AS a FROM lineitem), r AS (SELECT *, exp(d) AS r FROM x)
SELECT l_orderkey, round(-avg(least(r * a, least(greatest(r, 0.8), 1.2) * a)), 6) AS loss, round(avg(r - 1 - d), 6) AS kl, round(avg(CASE WHEN r <> least(greatest(r, 0.8), 1.2) THEN 1.0 ELSE 0.0 END), 6) AS clip_fraction FROM r GROUP BY l_orderkey""")
def clipped_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 3).alias("current"), F.col("l_tax").alias("old"), (F.col("l_quantity") / 10 - 2).alias("advantage"))
    return rewards.clipped_loss(rows, ["l_orderkey"], "current", "old", "advantage")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return matching.missing(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("""WITH c AS (SELECT doc_id, source, least(n_chars, 5000) AS c FROM documents)
SELECT doc_id, source, CAST(least(c, greatest(0, 24000 - coalesce(sum(c) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS granted FROM c""")
def capped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return budget.prefix_budget(docs, ["source"], ["doc_id"], "n_chars", 24000, 5000).drop("n_chars")


@query("""WITH RECURSIVE r AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
f AS (SELECT l_orderkey, line, k, n, CAST(least(greatest(1, 100 // n), s, 100) AS BIGINT) AS granted, 100 - CAST(least(greatest(1, 100 // n), s, 100) AS BIGINT) AS rest FROM r WHERE k = 1
  UNION ALL SELECT r.l_orderkey, r.line, r.k, r.n, least(greatest(1, f.rest // (r.n - r.k + 1)), r.s, f.rest), f.rest - least(greatest(1, f.rest // (r.n - r.k + 1)), r.s, f.rest) FROM f JOIN r ON r.l_orderkey = f.l_orderkey AND r.k = f.k + 1)
SELECT l_orderkey, line, granted FROM f""")
def fair_share_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").cast("long").alias("size"))
    return budget.fair_share(rows, ["l_orderkey"], "line", "size", 100)


@query("""SELECT doc_id, greatest(ceil(octet_length(encode(text)) / 3.15::DOUBLE), ceil(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) * 1.1::DOUBLE)) ::BIGINT AS estimate FROM documents""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("estimate"))


@query(f"""WITH q AS (SELECT item_id, {_TOKENS_C} AS w FROM benchmark), n AS (SELECT conv_id, turn, {_TOKENS_C} AS w FROM conversations WHERE role = 'user'),
p AS (SELECT n.conv_id, n.turn, q.item_id, len(list_intersect(n.w, q.w)) AS s, len(n.w) AS a, len(q.w) AS b FROM n JOIN q ON n.conv_id % (SELECT count(*) FROM benchmark) = q.item_id)
SELECT conv_id, turn, item_id, round(CASE WHEN a + b = 0 THEN 1.0 ELSE s / (a + b - s) END, 6) AS jaccard, round(CASE WHEN s = 0 THEN 0.0 ELSE 2.0 * s / (a + b) END, 6) AS f1, round(s / greatest(a, 1), 6) AS overlap FROM p""")
def overlap_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = t(spark, sf_dir, "benchmark").select("item_id", X.token_set(F.col("text")).alias("qw"))
    n = t(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", X.token_set(F.col("text")).alias("w"))
    n = n.crossJoin(F.broadcast(q.agg(F.count("*").alias("__items")))).withColumn("item_id", F.col("conv_id") % F.col("__items")).drop("__items")  # one number
    both = n.join(q, "item_id")
    w, qw = F.col("w"), F.col("qw")
    return both.select("conv_id", "turn", "item_id", F.round(X.jaccard(w, qw), 6).alias("jaccard"), F.round(X.set_f1(qw, w), 6).alias("f1"), F.round(X.overlap_share(w, qw), 6).alias("overlap"))


@query(f"""SELECT page_id, {_HOST_SQL} AS host, split_part(url, '#', 1) AS base_id, 'WEB:' || sha256(url)[:16] AS web_id, regexp_matches(lower(url), '^https?://') AND NOT contains(url, '@') AND contains({_HOST_SQL}, '.') AS public FROM pages""")
def host_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", X.host(u).alias("host"), X.base_id(u).alias("base_id"), X.web_id(u).alias("web_id"), X.is_public_url(u).alias("public"))


@query("""SELECT doc_id, length(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) >= 120 AND NOT regexp_matches(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))[:4000]), 'access denied|captcha|enable javascript') AS readable FROM documents""")
def readable_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", X.is_readable(F.col("text")).alias("readable"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) > 100 AS over FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), (F.count("*") > 100).alias("over"))


@query("""SELECT event_id, user_id FROM (SELECT *, bool_or(event_type = 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS bad FROM events) WHERE NOT bad""")
def atomic_group_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups (a user's day) with one bad row go whole: an anti join, so a large group needs no window."""
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    bad = rows.filter("event_type = 'error'").select("user_id", "day").distinct()
    return rows.join(bad, ["user_id", "day"], "left_anti").select("event_id", "user_id")


@query("""SELECT event_id, user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS locked FROM events""")
def finalization_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    flag = F.max((F.col("event_type") == "purchase").cast("int")).over(before)
    return t(spark, sf_dir, "events").select("event_id", "user_id", (F.coalesce(flag, F.lit(0)) == 1).alias("locked"))


@query("""WITH c AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS f, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, min(event_id) FILTER (n >= 20 AND f > 0.05 * n) AS tripped_at FROM c GROUP BY user_id""")
def failure_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the failures of a user first exceed 5 % after 20 requests; null if never."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", F.sum((F.col("event_type") == "error").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"), F.row_number().over(w).alias("n"))
    return rows.groupBy("user_id").agg(F.min(F.when((F.col("n") >= 20) & (F.col("f") > 0.05 * F.col("n")), F.col("event_id"))).alias("tripped_at"))


@query("""SELECT l_orderkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS loss, max(l_tax) AS max_kl, bool_or(l_discount > 0) AS signal, max(abs(l_discount - l_tax)) <= 0.05 AS parity FROM lineitem GROUP BY l_orderkey""")
def weighted_group_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(F.round(rewards.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("loss"), F.max("l_tax").alias("max_kl"), F.bool_or(F.col("l_discount") > 0).alias("signal"), (F.max(F.abs(F.col("l_discount") - F.col("l_tax"))) <= 0.05).alias("parity"))


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import documents

    return documents.html_sections(t(spark, sf_dir, "pages"))


@query("""WITH s AS (SELECT doc_id, text, greatest(1, ceil((length(text) - 200) / 1600.0))::INT AS n FROM documents), c AS (SELECT doc_id, text, unnest(range(n)) AS k FROM s)
SELECT doc_id, k::INT AS chunk_index, (k * 1600)::INT AS start_char, least(k * 1600 + 1800, length(text))::INT AS end_char, substr(text, k * 1600 + 1, 1800) AS chunk FROM c""")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import documents

    return documents.chunks(t(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@query("""SELECT user_id, time_bucket(INTERVAL 900 SECOND, ts) AS window_start, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY ALL""")
def failure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import failures

    return failures.failure_counts(t(spark, sf_dir, "events"), "user_id")


@query("""SELECT event_id, sha256('{' || array_to_string(list_transform(list_sort(json_keys(props)), lambda k: '"' || k || '":' || CAST(json_extract(props, '$."' || k || '"') AS VARCHAR)), ',') || '}') AS digest FROM events""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.digest import canonical_digest

    return t(spark, sf_dir, "events").select("event_id", canonical_digest(F.col("props")).alias("digest"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_is_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return rows.filter("n > 1").select("l_orderkey", "n")


@query("""SELECT coalesce(d.doc_id, v.vec_id) AS id, d.doc_id IS NOT NULL AS declared, v.vec_id IS NOT NULL AS present FROM documents d FULL JOIN embeddings v ON d.doc_id = v.vec_id WHERE d.doc_id IS NULL OR v.vec_id IS NULL""")
def manifest_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "embeddings").select("vec_id")
    both = a.join(b, F.col("doc_id") == F.col("vec_id"), "full")
    return both.select(F.coalesce("doc_id", "vec_id").alias("id"), F.col("doc_id").isNotNull().alias("declared"), F.col("vec_id").isNotNull().alias("present")).filter("not declared or not present")
