"""Queries of question sets, training rows and their gates, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trajectory
from ..sources import datasets
from .catalogue import t
from .registry import query

LEVELS = {"view": 0, "click": 1, "signup": 2, "purchase": 3}


@query("""SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'Helper' ELSE role END || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id""")
def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(messages.alias("m"))
    return rows.select("conv_id", F.md5(datasets.prompt(F.col("m"), {"user": "Human", "assistant": "Helper"})).alias("digest"))


@query("""SELECT n_nationkey, replace('rules for {variant}', '{variant}', r_name) || ';' || n_name AS rubric FROM nation JOIN region ON n_regionkey = r_regionkey""")
def rubric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General rules of a row's type, its variant filled in, before the row's own; Catalyst picks the join by size."""
    joined = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    general = F.array(F.replace(F.lit("rules for {variant}"), F.lit("{variant}"), F.col("r_name")))
    return joined.select("n_nationkey", F.array_join(F.concat(general, F.array("n_name")), ";").alias("rubric"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '|' || user_id ELSE props END AS answers FROM events""")
def decoded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(F.col("event_type"), F.col("user_id").cast("string")))).otherwise(F.col("props"))
    return t(spark, sf_dir, "events").select("event_id", F.array_join(datasets.answers(truth), "|").alias("answers"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''), '|') ELSE trim(p_name) END AS answers FROM part""")
def set_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(datasets.set_answers(F.col("p_name"), F.col("p_size") % 2 == 0, " "), "|").alias("answers"))


@query("""SELECT source, CAST(least(500, greatest(100, floor(count(*) * 0.2))) AS INTEGER) AS sampled FROM documents GROUP BY source""")
def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").groupBy("source").agg(datasets.sample_size(F.count("*")).alias("sampled"))


@query("""SELECT md5(text) AS id, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def official_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = t(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return t(spark, sf_dir, "documents").select("doc_id", "text").join(listed, "doc_id", "left_semi").select(F.md5("text").alias("id"), "doc_id")


@query("""WITH l AS (SELECT conv_id, arg_max(text, turn) AS q FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1), h AS (SELECT conv_id, q, hex(encode(q)) AS h FROM l),
c AS (SELECT conv_id, q, h, CASE WHEN substr(h, 257, 1) NOT IN ('8', '9', 'A', 'B') THEN 128 WHEN substr(h, 255, 1) NOT IN ('8', '9', 'A', 'B') THEN 127 WHEN substr(h, 253, 1) NOT IN ('8', '9', 'A', 'B') THEN 126 ELSE 125 END AS n FROM h)
SELECT conv_id, CASE WHEN length(h) <= 256 THEN q ELSE decode(unhex(substr(h, 1, 2 * n))) END AS question FROM c""")
def last_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn with text, at most 128 bytes of it and no character split."""
    asked = t(spark, sf_dir, "conversations").filter((F.col("role") == "user") & (F.trim("text") != ""))
    return asked.groupBy("conv_id").agg(F.max_by("text", "turn").alias("q")).select("conv_id", datasets.last_bytes_cut(F.col("q"), 128).alias("question"))


@query("""WITH l AS (SELECT url, arg_max(md5(html), page_id) AS digest FROM pages GROUP BY url), a AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url || '/none' ELSE url END AS asked FROM pages)
SELECT page_id, digest FROM a LEFT JOIN l ON asked = url""")
def url_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of each address; null for an unknown one. Digests travel, not pages."""
    pages = t(spark, sf_dir, "pages")
    last = pages.groupBy("url").agg(F.max_by(F.md5("html"), "page_id").alias("digest"))
    asked = pages.select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/none"))).otherwise(F.col("url")).alias("url"))
    return asked.join(last, "url", "left").select("page_id", "digest")


@query("""SELECT vec_id, CAST(i AS INTEGER) AS place, round(CAST(embedding[i + 1] AS DOUBLE), 5) AS score FROM embeddings, range(64) r(i)""")
def zipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays as rows; unequal lengths are an error."""
    places = F.sequence(F.lit(0), F.lit(63))
    same = F.when(F.size("embedding") == F.size(places), F.arrays_zip(places.alias("place"), F.col("embedding").alias("score"))).otherwise(F.raise_error(F.lit("arrays of unequal length")).cast("array<struct<place:int,score:float>>"))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.inline(same)).select("vec_id", "place", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?]) ([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n\n+', chr(1), 'g'), chr(1)) AS parts FROM documents)
SELECT doc_id, 'S' || lpad(CAST(i AS VARCHAR), 6, '0') AS span_id, md5(parts[i]) AS digest FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s)""")
def surface_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut after a sentence and at blank lines, with stable ids."""
    marked = F.regexp_replace(F.regexp_replace("text", "([.!?]) ([A-Z])", "$1\u0001$2"), "\n\n+", "\u0001")
    spans = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(marked, "\u0001", -1)).alias("i", "s"))
    return spans.select("doc_id", F.concat(F.lit("S"), F.lpad((F.col("i") + 1).cast("string"), 6, "0")).alias("span_id"), F.md5("s").alias("digest"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN round(sum(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) ELSE round(greatest(-1, least(1, value / 100)), 4) END AS credit FROM events""")
def search_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery takes the return to go, other rows their own clipped reward."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    late = F.sum(F.coalesce("value", F.lit(0.0))).over(w)
    own = F.when(F.col("value").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 100))).otherwise(-1.0)
    return t(spark, sf_dir, "events").select("event_id", F.round(F.when(F.col("event_type").isin("view", "click"), late).otherwise(own), 4).alias("credit"))


@query("""SELECT event_id, CASE WHEN n > 1 THEN -0.5 WHEN event_type = 'error' OR done = 1 THEN -0.25 ELSE 0.0 END AS credit FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM events)""")
def tool_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    seen = trajectory.first_seen(rows, ["user_id", "event_type"], "event_id", F.col("props"))
    return trajectory.tool_credit(seen, ["user_id"], "event_id", F.col("event_type") == "purchase", ~F.col("is_new"), F.col("event_type") == "error").select("event_id", "credit")


_LEVEL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEVELS.items()) + " END"


@query(f"""WITH e AS (SELECT user_id, event_id, {_LEVEL_SQL} AS v FROM events)
SELECT event_id, coalesce(max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level_before, coalesce(max(v) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS level_after FROM e""")
def coverage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_LEVEL_SQL).alias("v"))
    return trajectory.coverage_chain(rows, ["user_id"], "event_id", "v").select("event_id", "level_before", "level_after")


@query("""SELECT md5(text) AS basis, count(DISTINCT quality) AS results FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1""")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal evidence judged differently."""
    joined = t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("basis")).join(t(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("basis").agg(F.count_distinct("quality").alias("results")).filter("results > 1")


@query("""SELECT o_orderkey, c_custkey IS NOT NULL AND o_orderkey % 25 IS NOT DISTINCT FROM c_nationkey AS bound FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def stop_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ledger has the row's binding."""
    ledger = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(ledger, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", (F.col("c_custkey").isNotNull() & (F.col("o_orderkey") % 25).eqNullSafe(F.col("c_nationkey"))).alias("bound"))


@query("""SELECT vec_id, array_to_string(list_transform(range(64), lambda i: CASE WHEN i < label + 60 THEN -100 ELSE CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 100) AS BIGINT) END), ',') AS labels FROM embeddings""")
def completion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.array_join(trajectory.masked_labels(ids, F.col("label") + 60), ",").alias("labels"))


@query("""WITH g AS (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM documents)
SELECT doc_id, CASE WHEN coalesce(n_chars, 0) = 0 THEN 'empty' WHEN n > 1 THEN 'duplicate' WHEN toxic THEN 'excluded' WHEN n_chars < 100 THEN 'short' ELSE 'eligible' END AS reason FROM g""")
def dataset_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that keeps a row out of a training set."""
    rows = trajectory.first_seen(t(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5("text").alias("k")), [], "doc_id", F.col("k"))
    toxic = t(spark, sf_dir, "labels").filter("toxic = 1").groupBy("doc_id").agg(F.lit(True).alias("toxic"))
    n = F.coalesce("n_chars", F.lit(0))
    why = F.when(n == 0, "empty").when(~F.col("is_new"), "duplicate").when(F.col("toxic"), "excluded").when(n < 100, "short").otherwise("eligible")
    return rows.join(toxic, "doc_id", "left").select("doc_id", why.alias("reason"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING bool_or(l_discount <> 0 AND l_tax > 0.02 AND l_quantity > 30)""")
def signal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with any observed, weighted row that isn't zero."""
    useful = (F.col("l_discount") != 0) & (F.col("l_tax") > 0.02) & (F.col("l_quantity") > 30)
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or(useful).alias("ok")).filter("ok").drop("ok")
