"""Queries of whole flows: searches over several queries, histories, finalised batches and alignments, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import matching, ranking, selection
from ..sources import datasets
from .catalogue import t
from .packing import _PARTS
from .registry import query

_SET = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+|[一-鿿]'))"


@query(rf"""WITH p AS (SELECT item_id, text, {_PARTS} AS p FROM benchmark), s AS (SELECT item_id, text, unnest(range(len(p))) AS i, unnest(p) AS s FROM p),
f AS (SELECT item_id, text, i, s, len(list_intersect({_SET.format("s")}, ['ering', 'the', 'tion', 'of'])) AS k, len({_SET.format("s")}) AS n FROM s), g AS (SELECT *, CASE WHEN k = 0 THEN 0.0 ELSE 2.0 * k / (4 + n) END AS f1 FROM f),
b AS (SELECT item_id, arg_max(s, (f1, -i)) AS best, max(f1) AS top FROM g GROUP BY item_id)
SELECT item_id, CASE WHEN top > 0.2 THEN md5(best) ELSE md5(left(coalesce(text, ''), 80)) END AS shown, top > 0.2 AS found FROM benchmark LEFT JOIN b USING (item_id)""")
def best_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence with the greatest F1 over .2 to a question, or else the opening of the text."""
    asked = F.array(*map(F.lit, ("ering", "the", "tion", "of")))
    scored = F.transform(selection.sentences(F.col("text")), lambda s, i: F.struct(X.set_f1(asked, X.token_set(s)).alias("f"), (-i).alias("i"), s.alias("s")))
    rows = t(spark, sf_dir, "benchmark").select("item_id", "text", F.array_max(scored).alias("b"))
    found = F.coalesce(F.col("b.f") > 0.2, F.lit(False))
    return rows.select("item_id", F.md5(F.when(found, F.col("b.s")).otherwise(F.substring(F.coalesce("text", F.lit("")), 1, 80))).alias("shown"), found.alias("found"))


@query("""WITH q AS (SELECT conv_id, turn, 'focus ' || turn || chr(10) || 'focus ' || turn || chr(10) || coalesce(text, '') AS q FROM conversations), h AS (SELECT conv_id, turn, q, hex(encode(q)) AS h FROM q),
c AS (SELECT *, CASE WHEN substr(h, 193, 1) NOT IN ('8', '9', 'A', 'B') THEN 96 WHEN substr(h, 191, 1) NOT IN ('8', '9', 'A', 'B') THEN 95 WHEN substr(h, 189, 1) NOT IN ('8', '9', 'A', 'B') THEN 94 ELSE 93 END AS n FROM h)
SELECT conv_id, turn, md5(CASE WHEN length(h) <= 192 THEN q ELSE decode(unhex(substr(h, 1, 2 * n))) END) AS joint FROM c""")
def joint_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focus twice, then the question, within a number of bytes and without a split character."""
    focus = F.concat(F.lit("focus "), F.col("turn").cast("string"))
    joint = F.concat_ws("\n", focus, focus, F.coalesce("text", F.lit("")))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(datasets.last_bytes_cut(joint, 96)).alias("joint"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id * 2 AS place, event_type AS kind FROM e UNION ALL SELECT user_id, event_id * 2 - 1, 'rationale' FROM e WHERE event_type = 'purchase' AND before IS DISTINCT FROM 'view'""")
def finalised_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rationale before each call that no message precedes, at a place between its neighbours."""
    rows = t(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    put = rows.filter((F.col("event_type") == "purchase") & ~F.col("before").eqNullSafe(F.lit("view"))).select("user_id", (F.col("event_id") * 2 - 1).alias("place"), F.lit("rationale").alias("kind"))
    return rows.select("user_id", (F.col("event_id") * 2).alias("place"), F.col("event_type").alias("kind")).unionByName(put)


@query("""SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'view') AS searched, count(DISTINCT CASE WHEN event_type = 'click' THEN event_id % 9 END) AS opened, count(*) FILTER (event_type = 'error') AS failed, arg_max(event_type, event_id) = 'purchase' AS ended FROM events GROUP BY user_id""")
def runtime_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session has searched, opened and failed at, and whether it has ended."""
    kind = F.col("event_type")
    return t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(kind == "view").alias("searched"), F.count_distinct(F.when(kind == "click", F.col("event_id") % 9)).alias("opened"),
        F.count_if(kind == "error").alias("failed"), (F.max_by("event_type", "event_id") == "purchase").alias("ended"),
    )


@query("""WITH s AS (SELECT o_custkey % 5 AS part, o_orderkey AS k, o_totalprice AS now, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, o_custkey FROM orders)
SELECT part, count(*) AS n, count(DISTINCT k) AS unique_keys, count(DISTINCT o_custkey) AS groups, count(*) FILTER (before IS NULL) AS starts, count(*) FILTER (now < before) AS falls FROM s GROUP BY part""")
def alignment_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an alignment: rows, unique keys, groups, and the chain of states in each group."""
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("part"), "o_orderkey", "o_custkey", F.col("o_totalprice").alias("now"), before.alias("before"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("unique_keys"), F.count_distinct("o_custkey").alias("groups"), F.count_if(F.col("before").isNull()).alias("starts"), F.count_if(F.col("now") < F.col("before")).alias("falls"))


@query("""SELECT a.o_custkey AS shared FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 10 < 8) a JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 10 >= 8) b USING (o_custkey)""")
def leaked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that stand on both sides of a split."""
    rows = t(spark, sf_dir, "orders")
    return rows.filter("o_orderkey % 10 < 8").select(F.col("o_custkey").alias("shared")).intersect(rows.filter("o_orderkey % 10 >= 8").select("o_custkey"))


@query("""WITH c AS (SELECT p_partkey, p_size, 'q' || p_size % 3 AS q, row_number() OVER (PARTITION BY p_size % 3 ORDER BY p_retailprice DESC, p_partkey) AS r, p_brand FROM part), pool AS (SELECT *, 1.0e0 / (60 + r) + CASE p_brand WHEN 'Brand#11' THEN 2e-2 ELSE 0e0 END AS v FROM c WHERE r <= 30)
SELECT p_partkey, q, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(v, 9) DESC, p_partkey) AS rank FROM pool) WHERE rank <= 10""")
def pooled_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of several queries as one pool, ordered by rank and value, and its head."""
    rows = t(spark, sf_dir, "part").withColumn("q", F.concat(F.lit("q"), (F.col("p_size") % 3).cast("string")))
    head = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("p_retailprice").desc(), "p_partkey"))).filter("r <= 30")
    value = 1.0 / (60 + F.col("r")) + F.when(F.col("p_brand") == "Brand#11", 0.02).otherwise(0.0)
    return ranking.limited(head, [F.round(value, 9).desc(), F.col("p_partkey")], 10).select("p_partkey", "q", "rank")


@query("""WITH l AS (SELECT user_id, event_id, event_type, min(CASE WHEN event_type = 'view' THEN event_id END) OVER w AS next_call, min(CASE WHEN event_type = 'click' THEN event_id END) OVER w AS next_out FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id, count(*) AS calls, count(CASE WHEN next_call IS NULL OR next_out < next_call THEN next_out END) AS answered FROM l WHERE event_type = 'view' GROUP BY user_id""")
def tool_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a session and how many were answered before the next one."""
    paired = matching.paired_calls(t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") == "view", F.col("event_type") == "click")
    return paired.groupBy("user_id").agg(F.count("*").alias("calls"), F.count("output_at").alias("answered"))


@query("""WITH r AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN 'exempt' WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN role = 'assistant' AND turn = 0 THEN 'unasked' WHEN length(text) > 400 THEN 'long' END AS fault FROM conversations)
SELECT coalesce(fault, 'valid') AS verdict, role, count(*) AS n FROM r GROUP BY ALL""")
def result_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by the first rule that they break, with the modes that are exempt."""
    text, role = F.col("text"), F.col("role")
    verdict = F.when(role == "system", "exempt").when(text.isNull() | (F.trim(text) == ""), "empty").when((role == "assistant") & (F.col("turn") == 0), "unasked").when(F.length(text) > 400, "long").otherwise("valid")
    return t(spark, sf_dir, "conversations").groupBy(verdict.alias("verdict"), "role").agg(F.count("*").alias("n"))
