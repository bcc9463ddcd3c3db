"""Queries of judged scores, gates, ledgers and histories over the standard tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget, judging, trajectory
from .catalogue import TOKEN_SQL, t
from .registry import query

#: White space and control characters that cleaning knows, for both regular expression dialects.
_CONTROL = r"[\x00-\x08\x0E-\x1F\x7F]"
_BLANK = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
TERMS = ["the", "le", "que", "of"]


@query(f"""SELECT doc_id, length(c) AS n_clean, md5(c) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{_CONTROL}', '', 'g'), '{_BLANK}', ' ', 'g')) AS c FROM documents)""")
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.trim(F.regexp_replace(F.regexp_replace("text", _CONTROL, ""), _BLANK, " "))
    return t(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("n_clean"), F.md5(c).alias("digest"))


@query("""SELECT user_id, bool_or(event_type = 'error') AND bool_and(event_type <> 'purchase') AND NOT bool_or(event_type = 'error' AND event_id % 7 = 0 AND event_id % 3 <> 0) AS retryable FROM events GROUP BY user_id""")
def retryable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed, not ended, and no client error but those that ask for a later try."""
    failed, ended = F.col("event_type") == "error", F.col("event_type") == "purchase"
    client = failed & (F.col("event_id") % 7 == 0) & (F.col("event_id") % 3 != 0)
    return t(spark, sf_dir, "events").groupBy("user_id").agg((F.bool_or(failed) & F.bool_and(~ended) & ~F.bool_or(client)).alias("retryable"))


@query(f"""WITH w AS (SELECT item_id, text, {TOKEN_SQL} AS w FROM benchmark), v AS (SELECT item_id, w, lower(trim(text)) AS whole, array_to_string(list_filter(w, lambda x: length(x) > 3)[1:12], ' ') AS brief FROM w),
o AS (SELECT item_id, unnest(CASE WHEN len(w) > 12 THEN [{{'p': 1, 'q': brief}}, {{'p': 2, 'q': whole}}] ELSE [{{'p': 1, 'q': whole}}, {{'p': 2, 'q': brief}}] END) AS x FROM v),
d AS (SELECT item_id, x.q AS variant, min(x.p) AS p FROM o WHERE x.q <> '' GROUP BY ALL)
SELECT item_id, variant, CAST(row_number() OVER (PARTITION BY item_id ORDER BY p) AS INTEGER) AS place FROM d""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question and its long words, distinct without regard to case; a question of over 12 tokens comes last."""
    w = X.tokens(F.col("text"))
    verbose, brief = F.lower(F.trim("text")), F.array_join(F.slice(F.filter(w, lambda x: F.length(x) > 3), 1, 12), " ")
    listed = F.filter(F.array_distinct(F.when(F.size(w) > 12, F.array(brief, verbose)).otherwise(F.array(verbose, brief))), lambda x: x != "")
    return t(spark, sf_dir, "benchmark").select("item_id", F.posexplode(listed).alias("p", "variant")).select("item_id", "variant", (F.col("p") + 1).alias("place"))


@query("""WITH r(k, domain, priority) AS (VALUES ('the', 'english', 1), ('que', 'romance', 2), ('der', 'german', 3), ('los', 'romance', 4))
SELECT doc_id, domain, min(priority) AS priority FROM documents JOIN r ON contains(lower(text), k) GROUP BY ALL""")
def domain_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domains whose keywords a text has, the first rule of each kept."""
    rules = [("the", "english", 1), ("que", "romance", 2), ("der", "german", 3), ("los", "romance", 4)]
    hits = F.array(*[F.when(F.lower("text").contains(k), F.struct(F.lit(d).alias("d"), F.lit(p).alias("p"))) for k, d, p in rules])
    each = t(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x"))
    return each.groupBy("doc_id", F.col("x.d").alias("domain")).agg(F.min("x.p").alias("priority"))


@query("""SELECT event_id, CAST(greatest(1, least(50, coalesce(CAST(json_extract_string(props, '$.limit') AS INTEGER), CAST(json_extract_string(props, '$.k') AS INTEGER), 10))) AS INTEGER) AS top_k FROM events""")
def canonical_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alias given, within 1 and 50; 10 by default."""
    given = F.coalesce(*[F.get_json_object("props", f"$.{k}").cast("int") for k in ("limit", "k")], F.lit(10))
    return t(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(1), F.least(F.lit(50), given)).alias("top_k"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice > 100000 WHEN '2-HIGH' THEN o_totalprice > 50000 WHEN '5-LOW' THEN o_orderstatus = 'F' ELSE false END AS met FROM orders""")
def source_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one predicate that a row's requirement names; an unknown requirement isn't met."""
    rules = {"1-URGENT": F.col("o_totalprice") > 100000, "2-HIGH": F.col("o_totalprice") > 50000, "5-LOW": F.col("o_orderstatus") == "F"}
    met = F.lit(False)
    for name, passes in rules.items():
        met = F.when(F.col("o_orderpriority") == name, passes).otherwise(met)
    return t(spark, sf_dir, "orders").select("o_orderkey", met.alias("met"))


@query(f"""SELECT {_LINE_KEY}, CASE WHEN l_tax > 0.07 THEN 'unknown' WHEN l_quantity > 40 THEN 'direct' WHEN l_discount > 0.03 AND l_quantity > 10 THEN 'partial' ELSE 'none' END AS status FROM lineitem""")
def atomic_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("l_tax") <= 0.07
    complete, outcome, some = F.col("l_quantity") > 40, F.col("l_discount") > 0.03, F.col("l_quantity") > 10
    status = judging.atomic_support(F.when(known, some | complete), F.when(known, outcome | complete), F.when(known, some | complete), F.when(known, complete))
    return t(spark, sf_dir, "lineitem").select(*_LINE_KEY.split(", "), status.alias("status"))


_TERM_SET = "[" + ", ".join(f"'{x}'" for x in TERMS) + "]"


@query(f"""WITH w AS (SELECT doc_id, n_chars, {TOKEN_SQL} AS w FROM documents), b AS (SELECT doc_id, n_chars, w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM w)
SELECT doc_id, round(80 * len(list_intersect({_TERM_SET}, w)) / 4.0 + 20 * least(2, len(list_intersect(['the le', 'le que', 'que of'], b))) + least(30, n_chars * 0.25 / 100), 6) AS value FROM b""")
def document_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap with the question, shared pairs of words and a capped bonus."""
    words, terms = X.tokens(F.col("text")), F.array(*[F.lit(x) for x in TERMS])
    score = 80 * X.overlap_share(terms, words) + 20 * F.least(F.lit(2), X.shared_bigrams(terms, words)) + F.least(F.lit(30.0), F.col("n_chars") * 0.25 / 100)
    return t(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("value"))


@query("""SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.source END, 'label ' || l.q) AS note FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)""")
def enrich_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only values that a row lacks come from the lookup."""
    found = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    own = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    return t(spark, sf_dir, "documents").join(found, "doc_id", "left").select("doc_id", F.coalesce(own, F.concat(F.lit("label "), F.col("q"))).alias("note"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN s_suppkey IS NULL THEN 'missing' ELSE 'binding' END AS violation FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey IS NULL OR s_nationkey % 5 <> l_linenumber % 5""")
def reference_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that don't resolve, or resolve to another binding."""
    lines, to = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(to, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    why = F.when(F.col("s_suppkey").isNull(), "missing").when(F.col("s_nationkey") % 5 != F.col("l_linenumber") % 5, "binding")
    return joined.select("l_orderkey", "l_linenumber", "l_suppkey", why.alias("violation")).filter("violation is not null")


@query("""SELECT event_id, user_id, expected FROM (SELECT event_id, user_id, event_type AS b, lag(event_type) OVER w AS expected, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n > 1 AND b IS DISTINCT FROM expected""")
def ledger_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("event_type").alias("after"))
    return trajectory.broken_chain(rows, ["user_id"], ["event_id"], "event_type", "after").select("event_id", "user_id", "expected")


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey % 90 AS a, o_orderkey % 90 + 1 + CAST(o_totalprice AS BIGINT) % 20 AS b FROM orders),
r AS (SELECT k, a, coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM s)
SELECT k, CAST(reach AS INTEGER) AS gap_start, CAST(least(a, 100) AS INTEGER) AS gap_end FROM r WHERE reach < least(a, 100) UNION ALL SELECT k, CAST(max(b) AS INTEGER), 100 FROM s GROUP BY k HAVING max(b) < 100""".replace("CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT)"))
def span_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderkey") % 90
    spans = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), start.cast("int").alias("a"), (start + 1 + F.floor("o_totalprice") % 20).cast("int").alias("b"))
    return trajectory.gaps(spans, ["k"], "a", "b", 0, 100)


@query("""SELECT o_orderkey, min(l_linenumber) AS covered_by FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity / 50 >= 0.8 AND 1 - 5 * l_discount >= 0.5 AND (o_orderpriority <> '1-URGENT' OR l_linestatus = 'F') GROUP BY 1""")
def slot_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first evidence of a slot that is relevant, sure, and meets its requirement."""
    sure = t(spark, sf_dir, "lineitem").filter((F.col("l_quantity") / 50 >= 0.8) & (1 - 5 * F.col("l_discount") >= 0.5)).select("l_orderkey", "l_linenumber", "l_linestatus")
    slots = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    met = slots.join(sure, (F.col("o_orderkey") == F.col("l_orderkey")) & ((F.col("o_orderpriority") != "1-URGENT") | (F.col("l_linestatus") == "F")))
    return met.groupBy("o_orderkey").agg(F.min("l_linenumber").alias("covered_by"))


@query("""WITH v AS (SELECT l_orderkey, l_quantity >= 25 AS pass, l_returnflag FROM lineitem)
SELECT o_orderkey, coalesce(bool_or(pass), false) AS supported, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS codes FROM orders LEFT JOIN v ON l_orderkey = o_orderkey GROUP BY 1""")
def verdict_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") >= 25).alias("s"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("c"))
    joined = t(spark, sf_dir, "orders").select("o_orderkey").join(v, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("s", F.lit(False)).alias("supported"), F.coalesce("c", F.lit("")).alias("codes"))


@query("""WITH c AS (SELECT item_id, unnest([item_id % 7, item_id % 7 + 50, item_id % 7 + 100000000]) AS doc_id FROM benchmark)
SELECT item_id, string_agg(d.doc_id, ',' ORDER BY d.doc_id) AS evidence FROM c JOIN documents d USING (doc_id) GROUP BY item_id""")
def citation_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence rows that each answer unit cites; unknown citations attach nothing."""
    base = F.col("item_id") % 7
    cited = t(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(base, base + 50, base + 100000000)).alias("doc_id"))
    joined = cited.join(t(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return joined.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("evidence"))


@query(f"""WITH w AS (SELECT conv_id, turn, role, list_distinct({TOKEN_SQL}) AS w FROM conversations), a AS (SELECT * FROM w WHERE role = 'user'), b AS (SELECT conv_id, turn AS evidence, w AS e FROM w WHERE role = 'assistant'),
p AS (SELECT conv_id, turn, evidence, len(list_intersect(w, e)) AS n FROM a JOIN b USING (conv_id) WHERE len(list_intersect(w, e)) > 0 AND list_has_all(e, list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$')))),
l AS (SELECT conv_id, turn, n, count(*) AS ties, min(evidence) AS evidence FROM p GROUP BY ALL), m AS (SELECT conv_id, turn, max(n) AS n FROM l GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN ties = 1 THEN evidence END AS evidence FROM a LEFT JOIN (SELECT * FROM l JOIN m USING (conv_id, turn, n)) USING (conv_id, turn)""")
def citation_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", X.token_set(F.col("text")).alias("w"))
    claims, of = rows.filter("role = 'user'"), rows.filter("role = 'assistant'").withColumnRenamed("turn", "evidence")
    return trajectory.best_match(claims, of, ["conv_id"], "turn", "evidence", "w")


@query("""WITH r AS (SELECT p_brand, p_partkey, p_retailprice, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS v FROM part),
f AS (SELECT *, CASE WHEN m <= 10 THEN round(1.0 / (20 + m) + 1.1 / (20 + v), 6) END AS fused FROM r)
SELECT p_brand, p_partkey, fused, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY fused DESC NULLS LAST, m) AS INTEGER) AS place FROM f""")
def fused_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    order = [[F.col(c).desc(), F.col("p_partkey")] for c in ("p_retailprice", "p_size")]
    return trajectory.fused_head(rows, ["p_brand"], *order).select("p_brand", "p_partkey", "fused", "place")


@query("""WITH r AS (SELECT p_brand, p_partkey, p_retailprice, p_size, p_partkey % 4 <> 0 AS ok, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS b FROM part),
s AS (SELECT p_brand, p_partkey, round(p_retailprice / 100 - CASE WHEN p_size < 10 THEN 3 ELSE 0 END, 6) AS score, a, b FROM r WHERE ok AND (a <= 10 OR b <= 10))
SELECT p_brand, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, a, b) AS n FROM s) WHERE n <= 16""")
def eligible_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligible of two top tens, ranked before eligibility counts; at most 16, by score less a penalty."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand")
    ranks = {n: F.row_number().over(w.orderBy(F.col(c).desc(), "p_partkey")) for n, c in (("a", "p_retailprice"), ("b", "p_size"))}
    pool = t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size").withColumns(ranks).filter("p_partkey % 4 <> 0 and (a <= 10 or b <= 10)")
    scored = pool.withColumn("score", F.round(F.col("p_retailprice") / 100 - F.when(F.col("p_size") < 10, 3).otherwise(0), 6))
    return scored.withColumn("n", F.row_number().over(w.orderBy(F.col("score").desc(), "a", "b"))).filter("n <= 16").select("p_brand", "p_partkey", "score")


@query("""WITH s AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM documents)
SELECT source, doc_id, CAST(least(n_chars, greatest(0, 20000 - spent)) AS BIGINT) AS granted FROM s WHERE least(n_chars, greatest(0, 20000 - spent)) > 0""")
def char_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    granted = budget.prefix_budget(rows.withColumn("rank", -F.col("n_chars")), ["source"], ["rank", "doc_id"], "n_chars", 20000)
    return granted.filter("granted > 0").select("source", "doc_id", "granted")


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 500000 END AS a, o_orderkey % 5 / 4.0 AS b, (o_orderkey % 11 / 10.0) AS c, o_orderkey % 2 = 0 AS has_b, o_orderkey % 3 - 1 AS aux, o_orderkey % 4 = 0 AS err FROM orders),
s AS (SELECT *, round((0.4 * a + CASE WHEN has_b THEN 0.35 * b ELSE 0 END + 0.25 * c) / (0.4 + CASE WHEN has_b THEN 0.35 ELSE 0 END + 0.25), 6) AS core FROM p)
SELECT o_orderkey, CASE WHEN core IS NOT NULL THEN round(least(1, greatest(0, core + CASE WHEN aux > 0 AND err THEN 0 ELSE sign(aux) * 0.025 END)), 6) END AS score, CASE WHEN core IS NULL THEN 'pending_core' ELSE 'observed' END AS status FROM s""")
def stage_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    parts = [(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 500000), 0.4, F.lit(True)), (k % 5 / 4.0, 0.35, k % 2 == 0), (k % 11 / 10.0, 0.25, F.lit(True))]
    score, status = judging.stage_scalar(parts, k % 3 - 1, k % 4 == 0)
    return t(spark, sf_dir, "orders").select("o_orderkey", score.alias("score"), status.alias("status"))


@query("""SELECT l_orderkey, CASE WHEN count(*) = count(v) THEN round(avg(v), 6) END AS state_score FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 0.0 WHEN l_linestatus = 'O' THEN 1.0 WHEN l_tax < 0.08 THEN l_discount * 10 END AS v FROM lineitem) GROUP BY 1""")
def state_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rewards import weighted_mean

    value = judging.grounded(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.when(F.col("l_tax") < 0.08, F.col("l_discount") * 10))
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(weighted_mean(value), 6).alias("state_score"))


@query("""SELECT l_orderkey, CASE WHEN count(*) = count(v) THEN round(avg(v), 6) END AS citation FROM (SELECT l_orderkey, l_suppkey % 3 AS u, CASE WHEN count(*) = count(c) THEN min(c) END AS v FROM (SELECT l_orderkey, l_suppkey, CASE WHEN l_tax < 0.08 THEN least(l_discount * 10, l_quantity / 50) END AS c FROM lineitem) GROUP BY ALL) GROUP BY 1""")
def effective_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lesser of citation and factual support, null if one is unknown; the least of a unit, the mean of units."""
    value = F.when(F.col("l_tax") < 0.08, F.least(F.col("l_discount") * 10, F.col("l_quantity") / 50))
    return judging.min_then_mean(t(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_suppkey") % 3, value, "citation")


@query("""WITH g AS (SELECT l_orderkey, array_agg(DISTINCT l_suppkey) FILTER (l_quantity > 30) AS truth, array_agg(DISTINCT l_suppkey) FILTER (l_discount > 0.02) AS cited, avg(l_discount * 10) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_has_all(coalesce(cited, []), coalesce(truth, [])) AND c < 1 AS conflict FROM g""")
def core_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [F.collect_set(F.when(on, F.col("l_suppkey"))) for on in (F.col("l_quantity") > 30, F.col("l_discount") > 0.02)]
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(judging.conflicts(*sets, F.avg(F.col("l_discount") * 10)).alias("conflict"))


@query("""WITH g AS (SELECT l_orderkey, round(sum(CASE WHEN l_quantity >= 40 THEN 1.0 WHEN l_quantity >= 25 THEN 0.5 ELSE 0 END) / count(*), 6) AS slots, count(*) AS calls, bool_and(l_quantity >= 25) AS complete, bool_and(l_linestatus = 'F') AS exact FROM lineitem GROUP BY 1)
SELECT l_orderkey, slots, exact, round(slots - CASE WHEN calls >= 5 AND NOT complete THEN 0.25 ELSE 0 END, 6) AS reward FROM g""")
def trajectory_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    g = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(judging.weighted_slots(q >= 40, q >= 25).alias("slots"), F.count("*").alias("calls"), F.bool_and(q >= 25).alias("complete"), F.bool_and(F.col("l_linestatus") == "F").alias("exact"))
    return g.select("l_orderkey", "slots", "exact", judging.trajectory_reward(F.col("slots"), F.col("complete"), F.col("calls"), 5).alias("reward"))


_STATES = "SELECT o_custkey, o_orderpriority, max(CASE WHEN o_orderstatus = '{0}' THEN o_totalprice / 1e6 END) AS v, 1.0 + max(o_orderkey % 3) AS w FROM orders WHERE o_orderkey % 9 <> {1} GROUP BY ALL"


@query(f"""WITH b AS ({_STATES.format("F", 0)}), a AS ({_STATES.format("O", 1)}), j AS (SELECT o_custkey, a.v - b.v AS d, a.w AS w FROM a FULL JOIN b USING (o_custkey, o_orderpriority)),
g AS (SELECT o_custkey, sum(CASE WHEN d > 0 THEN d * w ELSE 0 END) AS gain, bool_or(d IS NULL) AS unknown, coalesce(bool_or(d < 0), false) AS fell FROM j GROUP BY 1)
SELECT o_custkey, CASE WHEN NOT unknown THEN round(gain, 6) END AS gain, CASE WHEN unknown THEN 'unobservable' WHEN fell THEN 'needs_review' WHEN gain > 0 THEN 'observed_positive' ELSE 'observed_zero' END AS status FROM g""")
def coverage_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    def states(status: str, left_out: int) -> DataFrame:
        rows = t(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 9 != left_out)
        return rows.groupBy("o_custkey", "o_orderpriority").agg(F.max(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice") / 1e6)).alias("v"), (1.0 + F.max(F.col("o_orderkey") % 3)).alias("w"))

    return judging.coverage_gain(states("F", 0), states("O", 1), ["o_custkey"], "o_orderpriority", "v", "w")


@query("""SELECT conv_id, array_to_string(list_filter([CASE WHEN count(*) FILTER (role = 'assistant') > 3 THEN 'too_many_calls' END, CASE WHEN bool_or(coalesce(text, '') = '') THEN 'empty_text' END, CASE WHEN count(*) FILTER (role = 'assistant') <> count(*) FILTER (role = 'user') THEN 'unpaired' END, CASE WHEN count(DISTINCT turn) <> count(*) THEN 'repeated_turn' END], lambda x: x IS NOT NULL), ',') AS reasons FROM conversations GROUP BY conv_id""")
def decision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a conversation isn't accepted; an empty list accepts it."""
    calls, asked = F.count_if(F.col("role") == "assistant"), F.count_if(F.col("role") == "user")
    why = judging.reasons((calls > 3, "too_many_calls"), (F.bool_or(F.coalesce("text", F.lit("")) == ""), "empty_text"), (calls != asked, "unpaired"), (F.count_distinct("turn") != F.count("turn"), "repeated_turn"))
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(why, ",").alias("reasons"))


@query("""WITH m AS (SELECT user_id, event_id, event_type, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w, 0) AS f, coalesce(max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w, 0) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN f = 1 THEN 'after_final' ELSE 'after_stop' END AS violation FROM m WHERE f = 1 OR (s = 1 AND event_type <> 'purchase')""")
def terminal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return trajectory.terminal_order(rows, ["user_id"], "event_id", F.col("event_type") == "purchase", F.col("event_type") == "signup").select("event_id", "violation")


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) = 1 AS is_new FROM events""")
def text_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "props")
    return trajectory.first_seen(rows, ["user_id"], "event_id", F.col("props")).drop("props")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS v FROM events), f AS (SELECT user_id, event_type, min(event_id) AS o FROM e GROUP BY ALL),
l AS (SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS event_types FROM f GROUP BY 1)
SELECT user_id, v AS preview, event_types FROM (SELECT user_id, arg_max(v, event_id) FILTER (v IS NOT NULL) AS v FROM e GROUP BY 1) JOIN l USING (user_id)""")
def merged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("preview"))
    merged = trajectory.merged_history(rows, ["user_id"], "event_id", ["preview"], "event_type")
    return merged.select("user_id", "preview", F.array_join("event_type", ",").alias("event_types"))


@query("""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS state, arg_max(props, event_id) AS props FROM events GROUP BY user_id""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", F.col("event_type").alias("state"), "props"), "event_id").alias("x"))
    return last.select("user_id", "x.*")


@query("""WITH m AS (SELECT conv_id, turn, role = 'assistant' AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') <> 'user' AS need FROM conversations)
SELECT conv_id, 2 * turn AS place, false AS inserted FROM m UNION ALL SELECT conv_id, 2 * turn - 1, true FROM m WHERE need""")
def inserted_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return trajectory.with_rationales(rows, ["conv_id"], "turn", F.col("role") == "assistant", F.col("role") == "user").select("conv_id", "place", "inserted")


@query("""WITH a AS (SELECT user_id, event_type, local, final FROM (SELECT user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS local, CASE WHEN event_id % 5 > 0 THEN value / 10 END AS final FROM events))
SELECT user_id, event_type, round(sum(0.5 * coalesce(local, 0) + 2 * coalesce(final, 0)), 6) AS advantage, round(1.0 / count(*), 6) AS row_weight FROM a GROUP BY ALL""")
def combined_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local and final advantages, unknown ones as 0, and the weight of a row of its channel."""
    local, final = F.when(F.col("event_type") != "error", F.col("value")), F.when(F.col("event_id") % 5 > 0, F.col("value") / 10)
    both = 0.5 * F.coalesce(local, F.lit(0.0)) + 2 * F.coalesce(final, F.lit(0.0))
    return t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum(both), 6).alias("advantage"), F.round(1.0 / F.count("*"), 6).alias("row_weight"))


@query("""WITH a AS (SELECT o_custkey AS k, list_sort(list_distinct(array_agg(o_orderpriority))) AS refs FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, list_sort(list_distinct(array_agg(o_orderpriority))) AS refs FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, array_to_string(list_sort(list_distinct(list_concat(a.refs, b.refs))), ',') AS merged, NOT list_has_any(a.refs, b.refs) AS is_disjoint, list_has_all(b.refs, a.refs) AS subset FROM a JOIN b USING (k)""")
def reference_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted union, disjointness and subset of two sets of references."""
    rows = t(spark, sf_dir, "orders")
    of = [F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))).alias(s) for s in "FO"]
    both = rows.groupBy(F.col("o_custkey").alias("k")).agg(*of).filter("size(F) > 0 and size(O) > 0")
    return both.select("k", F.array_join(F.array_sort(F.array_union("F", "O")), ",").alias("merged"), (~F.arrays_overlap("F", "O")).alias("is_disjoint"), (F.size(F.array_except("F", "O")) == 0).alias("subset"))


@query("""SELECT item_id, translate(to_base64(encode(text)), '+/', '-_') AS envelope, text AS decoded FROM benchmark""")
def query_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as URL-safe base64 and back."""
    envelope = F.translate(F.base64(F.encode("text", "UTF-8")), "+/\r\n", "-_")
    rows = t(spark, sf_dir, "benchmark").select("item_id", envelope.alias("envelope"))
    return rows.withColumn("decoded", F.decode(F.unbase64(F.translate("envelope", "-_", "+/")), "UTF-8"))


@query("""WITH r AS (SELECT p_brand, p_partkey, p_size, p_type AS section, p_partkey % 3 = 0 AS e, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
c AS (SELECT *, r BETWEEN 2 AND 7 AND row_number() OVER (PARTITION BY p_brand ORDER BY (r BETWEEN 2 AND 7) DESC, p_size DESC, r) = 1 AS c FROM r),
u AS (SELECT *, r > 1 AND NOT c AS rest, sum(CASE WHEN r > 1 AND NOT c THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY r) AS q, section = max(CASE WHEN r = 1 THEN section END) OVER w OR section = max(CASE WHEN c THEN section END) OVER w AS used FROM c WINDOW w AS (PARTITION BY p_brand)),
l AS (SELECT *, rest AND q <= 3 AND row_number() OVER (PARTITION BY p_brand ORDER BY (rest AND q <= 3) DESC, e DESC, coalesce(used, false), r) = 1 AS last FROM u)
SELECT p_brand, p_partkey, CASE WHEN r = 1 THEN 1 WHEN c THEN 2 ELSE 3 END AS slot FROM l WHERE r = 1 OR c OR last""")
def three_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import ranking

    rows = t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_type", "p_retailprice")
    return ranking.three_slots(rows, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], "p_size", "p_type", F.col("p_partkey") % 3 == 0).select("p_brand", "p_partkey", "slot")


_FLAT = "trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))"


@query(f"""WITH g AS (SELECT conv_id, role, min(turn) AS turn, arg_min(length(text), turn) AS s FROM conversations WHERE {_FLAT} <> '' GROUP BY conv_id, role, {_FLAT}),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM g), p AS (SELECT conv_id, role, min(turn) AS t0, max(CASE WHEN n = 1 THEN s END) AS s1, max(CASE WHEN n = 2 THEN s END) AS s2, max(CASE WHEN n = 3 THEN s END) AS s3 FROM n GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t0, role) AS d FROM p), a AS (SELECT *, 600 - CASE WHEN s1 <= 600 THEN s1 ELSE 0 END AS l1 FROM d WHERE d <= 2), b AS (SELECT *, l1 - CASE WHEN s2 <= l1 THEN s2 ELSE 0 END AS l2 FROM a)
SELECT n.conv_id, n.role, n.turn FROM n JOIN b USING (conv_id, role) WHERE (n = 1 AND s1 <= 600) OR (n = 2 AND s2 <= l1) OR (n = 3 AND s3 <= l2)""")
def opened_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations")
    return budget.whole_chunks(rows, ["conv_id"], "role", "turn", "text", documents=2, chunks=3, total=600)


@query("""SELECT conv_id, turn, CASE role WHEN 'system' THEN NULL WHEN 'user' THEN 'search' ELSE 'browse' END AS tool, CASE WHEN role <> 'system' THEN CAST(turn AS VARCHAR) END AS top, CASE WHEN role <> 'system' THEN md5(trim(text)) END AS body FROM conversations""")
def parsed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import markup

    name = F.when(F.col("role") == "user", "search").otherwise("browse")
    said = F.when(F.col("role") == "system", F.col("text")).otherwise(F.concat(F.lit('so <call_tool name="'), name, F.lit('" limit="'), F.col("turn"), F.lit('">'), F.col("text"), F.lit("</call_tool> then")))
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", markup.tool_call(said).alias("c"))
    return rows.select("conv_id", "turn", F.col("c.name").alias("tool"), F.col("c.attributes")["limit"].alias("top"), F.md5("c.body").alias("body"))
