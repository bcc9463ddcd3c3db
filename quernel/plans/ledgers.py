"""Queries of public ledgers, receipts, audits and small projections, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import judging, ranking
from .catalogue import t
from .registry import query

STOP = ["the", "and", "of", "le", "que"]
_STOP_SQL = ", ".join(f"'{x}'" for x in STOP)


@query(f"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: x NOT IN ({_STOP_SQL})), lambda x: CASE WHEN length(x) > 4 AND ends_with(x, 's') THEN left(x, length(x) - 1) ELSE x END), ' ')) AS digest FROM documents""")
def stripped_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words but stop words, a plural ending of longer ones dropped."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: ~x.isin(*STOP))
    stems = F.transform(words, lambda x: F.when((F.length(x) > 4) & x.endswith("s"), F.left(x, F.length(x) - 1)).otherwise(x))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(stems, " ")).alias("digest"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN NULL WHEN contains(props, '1') THEN 'timeout' WHEN contains(props, '2') THEN 'http' ELSE 'policy_invalid' END AS failure FROM events""")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a failed row meets; rows that didn't fail have none."""
    kind = X.first_case(F.col("props"), [("1", "timeout"), ("2", "http")], "policy_invalid")
    return t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", kind).alias("failure"))


@query("""SELECT page_id, array_to_string(list_filter(['URL: ' || url, CASE WHEN page_id % 3 = 0 THEN 'Part: ' || page_id END, left(html, 2000)], lambda x: x IS NOT NULL), chr(10)) AS shown FROM pages""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional lines that are there, and a text up to the shown length."""
    part = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Part: "), F.col("page_id")))
    return t(spark, sf_dir, "pages").select("page_id", F.concat_ws("\n", F.concat(F.lit("URL: "), F.col("url")), part, F.left("html", F.lit(2000))).alias("shown"))


@query("""SELECT user_id, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS searches, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS opened, count(DISTINCT props) FILTER (event_type = 'click') AS sources, bool_or(event_type = 'error') AS failed, greatest(0, 40 - count(*) FILTER (event_type IN ('view', 'click'))) AS remaining FROM events GROUP BY user_id""")
def public_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run may show of itself: calls by kind, distinct sources, failures and the budget left."""
    kind = F.col("event_type")
    calls = F.count_if(kind.isin("view", "click"))
    return t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "view").alias("searches"),
        F.count_if(kind == "click").alias("opened"),
        F.count_distinct(F.when(kind == "click", F.col("props"))).alias("sources"),
        F.bool_or(kind == "error").alias("failed"),
        F.greatest(F.lit(0).cast("long"), 40 - calls).alias("remaining"),
    )


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, bool_or(o_orderstatus = 'F') AS ended FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_filter([CASE WHEN n < 5 THEN 'few' END, CASE WHEN kinds < 3 THEN 'narrow' END, CASE WHEN NOT ended THEN 'open' END], lambda x: x IS NOT NULL), ',') AS gaps FROM s""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps of each group in the order of their rules."""
    state = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"), F.bool_or(F.col("o_orderstatus") == "F").alias("ended"))
    found = judging.reasons((F.col("n") < 5, "few"), (F.col("kinds") < 3, "narrow"), (~F.col("ended"), "open"))
    return state.select("o_custkey", F.array_join(found, ",").alias("gaps"))


@query("""SELECT l_orderkey, round(max(abs(l_discount - l_tax)), 6) AS worst, max(abs(l_discount - l_tax)) <= 0.05 AS parity FROM lineitem GROUP BY 1""")
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two readings of every row of a group are within the tolerance."""
    worst = F.max(F.abs(F.col("l_discount") - F.col("l_tax")))
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(worst, 6).alias("worst"), (worst <= 0.05).alias("parity"))


@query("""WITH c AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type, value FROM events), m AS (
SELECT a.event_id, min(b.event_id) AS receipt FROM c a JOIN c b ON a.user_id = b.user_id AND b.k = a.k + 1 AND b.event_type = a.event_type AND b.value >= 0 GROUP BY 1)
SELECT c.event_id, receipt FROM c LEFT JOIN m USING (event_id)""")
def call_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipt right after a call, where it is of the same tool and didn't fail: one window, no self-join."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    after = F.lead(F.struct("event_id", "event_type", "value")).over(w)
    rows = t(spark, sf_dir, "events").select("event_id", "event_type", after.alias("n"))
    return rows.select("event_id", F.when((F.col("n.event_type") == F.col("event_type")) & (F.col("n.value") >= 0), F.col("n.event_id")).alias("receipt"))


@query("""WITH r AS (SELECT page_id, url, page_id % 3 AS route, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS n FROM pages), c AS (SELECT * FROM r WHERE n <= ceil(20 / 3.0)),
d AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY route, n) AS same FROM c)
SELECT page_id, route, CAST(row_number() OVER (ORDER BY n, route) AS INTEGER) AS place FROM d WHERE same = 1 ORDER BY n, route LIMIT 20""")
def routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the limit for each route, an address once, then all routes in turn up to the limit."""
    limit, routes = 20, 3
    rows = t(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % routes).alias("route"))
    share = rows.withColumn("n", F.row_number().over(Window.partitionBy("route").orderBy("page_id"))).filter(F.col("n") <= -(-limit // routes))
    once = ranking.keep_first(share, ["url"], [F.col("route"), F.col("n")])
    # at most `limit` rows and one a route are left, so one task orders them
    return once.withColumn("place", F.row_number().over(Window.orderBy("n", "route"))).filter(F.col("place") <= limit).select("page_id", "route", "place")


@query("""SELECT doc_id, text_id, n FROM (SELECT doc_id, md5(text) AS text_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE n > 1 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def new_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a shared basis that no judged row retains; copies are counted before they meet, so no window holds a group."""
    docs = t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_id"))
    shared = docs.groupBy("text_id").agg(F.count("*").alias("n")).filter("n > 1")
    return docs.join(t(spark, sf_dir, "labels"), "doc_id", "left_anti").join(shared, "text_id").select("doc_id", "text_id", "n")


@query("""SELECT l_orderkey, CASE count(*) FILTER (l_discount > 0.02) WHEN 0 THEN 'pending' WHEN count(*) THEN 'observed' ELSE 'partially_observed' END AS status FROM lineitem GROUP BY 1""")
def packet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a packet's values are known."""
    known, n = F.count_if(F.col("l_discount") > 0.02), F.count("*")
    status = F.when(known == 0, "pending").when(known == n, "observed").otherwise("partially_observed")
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(status.alias("status"))


@query("""SELECT conv_id, turn, text IS NOT NULL AND NOT (regexp_matches(lower(text), '\\b(all|always|proves)\\b') AND turn < 2) AND len(string_split(trim(text), ' ')) <= 90 AS retained FROM conversations""")
def retained_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier thought stays unless it claims much too early or is too long."""
    early = F.lower("text").rlike(r"\b(all|always|proves)\b") & (F.col("turn") < 2)
    fits = F.size(F.split(F.trim("text"), " ")) <= 90
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("text").isNotNull() & ~F.coalesce(early, F.lit(False)) & fits).alias("retained"))


@query("""SELECT vec_id, count(*) FILTER (NOT list_contains(['0', '1', '2', '3'], CAST(CAST(floor(abs(CAST(x AS DOUBLE)) * 10) AS BIGINT) AS VARCHAR))) AS outside FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1""")
def support_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each row outside the allowed set, without leaving the row."""
    outside = F.filter("embedding", lambda x: ~F.floor(F.abs(x.cast("double")) * 10).isin(0, 1, 2, 3))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.size(outside).cast("long").alias("outside"))


@query("""SELECT conv_id, count(*) AS n_turns, sum(length(coalesce(text, ''))) > 4200 OR count(*) > 3 AS over FROM conversations GROUP BY conv_id""".replace(" AS over", " AS beyond"))
def browse_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories with too many parts or too long ones."""
    n = F.count("*")
    beyond = (F.sum(F.length(F.coalesce("text", F.lit("")))) > 4200) | (n > 3)
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(n.alias("n_turns"), beyond.alias("beyond"))
