"""Queries of record resolution, record shredding and rebuilt data sets over the standard tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alignment, rebuild, resolving
from ..sources import records
from .catalogue import t
from .registry import query

_LINE = "split_part(text, chr(10), 1)"
_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+|[一-鿿]'))"


@query(f"""WITH d AS (SELECT doc_id, {_LINE} AS title, md5(text) AS h, lang FROM documents), r AS (SELECT doc_id AS record_id, title, CASE WHEN doc_id % 2 = 0 THEN '10.1000/' || h END AS doi FROM d),
a AS (SELECT doc_id AS article_id, title, CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || h END AS doi, doc_id % 3 = 0 OR lang <> 'es' AS article FROM d),
x AS (SELECT article_id, min(record_id) AS record_id FROM a JOIN r ON a.doi = r.doi GROUP BY 1),
s AS (SELECT article_id, {_TOKENS} AS w FROM a WHERE article AND article_id NOT IN (SELECT article_id FROM x)), y AS (SELECT record_id, {_TOKENS} AS w FROM r),
m AS (SELECT article_id, record_id, count(*) AS k, any_value(n) AS n, any_value(o) AS o FROM (SELECT article_id, unnest(w) AS t, len(w) AS n FROM s WHERE len(w) >= 5) JOIN (SELECT record_id, unnest(w) AS t, len(w) AS o FROM y) USING (t) GROUP BY ALL),
z AS (SELECT article_id, min(record_id) AS record_id FROM m WHERE k >= 0.8 * (n + o - k) GROUP BY 1), f AS (SELECT *, 'doi' AS by FROM x UNION ALL SELECT *, 'title' AS by FROM z)
SELECT a.article_id, f.record_id, f.by FROM a LEFT JOIN f ON f.article_id = a.article_id""")
def record_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first line as an article's title, a third with an identifier in the address, against all documents."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.md5("text").alias("h"))
    index = docs.select(F.col("doc_id").alias("record_id"), "title", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" 10.1000/"), F.upper("h"))).alias("doi"))
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://www.bmj.com/x?r=10.1000%2F"), "h", F.lit("),."))).when(F.col("lang") == "es", "https://example.org/page").when(F.col("lang") == "en", "https://www.jacc.org/p").otherwise("https://example.org/article/1")
    return resolving.resolved(docs.select(F.col("doc_id").alias("article_id"), url.alias("url"), "title"), index)


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_FLAT = r"trim(regexp_replace({}, '[ \t\n\r]+', ' ', 'g'))"


@query(rf"""WITH d AS (SELECT doc_id, text, lang, source, {_FLAT.format("split_part(text, chr(10), 1)")} AS title, {_FLAT.format("text")} AS flat FROM documents)
SELECT doc_id, 0 AS place, CASE WHEN doc_id % 10 = 9 THEN 'malformed' END AS fault, CASE WHEN doc_id % 10 < 9 THEN 'PMID:' || doc_id END AS source_id, CASE WHEN doc_id % 10 < 9 THEN title END AS title,
  CASE WHEN doc_id % 10 < 9 THEN md5('AIM' || chr(10) || title || chr(10) || flat) END AS digest, CASE WHEN doc_id % 10 < 9 THEN CASE lang WHEN 'en' THEN 'randomized_controlled_trial' WHEN 'de' THEN 'meta_analysis' WHEN 'fr' THEN 'systematic_review' ELSE 'review' END END AS study_design,
  CASE WHEN doc_id % 10 < 9 THEN CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END END AS n_authors FROM d
UNION ALL SELECT doc_id, 1, NULL, 'PMID:' || doc_id || 'b', '', md5(''), 'unspecified', 0 FROM d WHERE doc_id % 5 = 0""")
def record_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with whole texts in them, marked up, some with a second, empty record, some not well-formed."""
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.split_part(safe, F.lit("\n"), F.lit(1))
    types = F.when(F.col("lang") == "en", "<PublicationType>Clinical Trial</PublicationType><PublicationType>Randomized Controlled Trial</PublicationType>").when(F.col("lang") == "de", "<PublicationType>Review</PublicationType><PublicationType>Meta-Analysis</PublicationType>").when(F.col("lang") == "fr", "<PublicationType>Systematic Review</PublicationType>").otherwise("<PublicationType>Review</PublicationType>")
    second = F.when(F.col("doc_id") % 4 == 0, "<Author><LastName>B</LastName><ForeName>D</ForeName></Author>").otherwise("<Author><LastName>B</LastName></Author>")
    extra = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<PubmedArticle><PMID>"), "doc_id", F.lit("b</PMID></PubmedArticle>"))).otherwise("")
    xml = F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), "doc_id", F.lit("</PMID><Article><ArticleTitle><i>"), line, F.lit('</i></ArticleTitle><Abstract><AbstractText Label="AIM">'), line, F.lit("</AbstractText><AbstractText>"), safe,
        F.lit("</AbstractText></Abstract><AuthorList><Author><LastName>A</LastName><ForeName>C</ForeName></Author>"), second, F.lit("</AuthorList><PublicationTypeList>"), types, F.lit("</PublicationTypeList></Article></MedlineCitation></PubmedArticle>"), extra,
        F.when(F.col("doc_id") % 10 == 9, "</Wrong>").otherwise("</PubmedArticleSet>"),
    )
    found = records.shredded(t(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")), ["doc_id"])
    flat = records.article_rows(found, ["doc_id"]).withColumn("fault", F.lit(None).cast("string"))
    shown = flat.select("doc_id", "place", "fault", "source_id", "title", F.md5("abstract").alias("digest"), "study_design", F.size("authors").alias("n_authors"))
    faulty = found.filter("fault is not null").select("doc_id", "place", "fault", *[F.lit(None).cast(k).alias(c) for c, k in (("source_id", "string"), ("title", "string"), ("digest", "string"), ("study_design", "string"), ("n_authors", "int"))])
    return shown.unionByName(faulty)


_CARD = "trim(substr(text, 11, 30)) || ' … ' || trim(substr(text, 61, 40))"


@query(f"""WITH old AS (SELECT conv_id AS stage_id, role || ':' || turn AS source_id, coalesce(text, '') AS text, turn FROM conversations),
new AS (SELECT *, CASE WHEN turn % 5 = 4 THEN 'future_or_invented_source' WHEN turn % 5 = 0 THEN 'copy' WHEN length(text) < 100 THEN CASE WHEN turn % 5 = 3 THEN 'untraced_evidence_change' ELSE 'copy' END
  WHEN turn % 5 = 1 THEN 'exact_spans' WHEN turn % 5 = 2 THEN CASE WHEN stage_id % 2 = 0 THEN 'card_parent_hash' ELSE 'card_text_not_exact_spans' END ELSE 'untraced_evidence_change' END AS proof FROM old)
SELECT stage_id, source_id || CASE WHEN turn % 5 = 4 THEN '?' ELSE '' END AS source_id, proof FROM new""")
def evidence_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts shown again as copies or extracts, some reworded, of another parent, or of no source."""
    rows = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stage_id"), F.concat_ws(":", "role", "turn").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    n, long = F.col("turn") % 5, F.length("text") >= 100
    spans = F.array(F.struct(F.lit(10).alias("start"), F.lit(40).alias("end")), F.struct(F.lit(60).alias("start"), F.lit(100).alias("end")))
    card, extract = long & n.isin(1, 2), alignment.extract_of(F.col("text"), spans)
    text = F.when(card & ((n == 1) | (F.col("stage_id") % 2 == 0)), extract).when(card, F.concat(extract, F.lit("."))).when(n == 3, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    parent = F.when(card, F.sha2(F.when((n == 2) & (F.col("stage_id") % 2 == 0), F.lit("other")).otherwise(F.col("text")), 256))
    shown = rows.select("stage_id", F.concat("source_id", F.when(n == 4, "?").otherwise("")).alias("source_id"), text.alias("text"), F.when(card, spans).alias("spans"), parent.alias("parent_sha256"))
    return alignment.evidence_proofs(rows.drop("turn"), shown).select("stage_id", "source_id", "proof")


@query("""WITH e AS (SELECT user_id, event_id, event_type AS item_id, CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'partial' WHEN 2 THEN 'direct' WHEN 3 THEN 'missing' ELSE 'partial' END AS status, CASE WHEN event_id % 5 IN (1, 2) THEN [CAST(event_id AS VARCHAR)] WHEN event_id % 35 = 3 THEN ['x'] ELSE [] END AS ids FROM events),
l AS (SELECT *, coalesce(lag(status) OVER w, 'unknown') AS before, coalesce(lag(ids) OVER w, []) AS before_ids FROM e WINDOW w AS (PARTITION BY user_id, item_id ORDER BY event_id)),
f AS (SELECT user_id, event_id, item_id, CASE WHEN event_id % 20 = 9 AND before <> 'direct' THEN 'state_prior_mismatch' WHEN event_id % 35 = 3 OR (event_id % 30 = 1) THEN 'state_unopened_citation' WHEN event_id % 5 = 4 THEN 'support_without_citation' END AS fault FROM l)
SELECT * FROM f WHERE fault IS NOT NULL""")
def state_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of event types as items of users: broken chains, unopened citations, support without any."""
    from pyspark.sql import Window

    k = F.col("event_id")
    status = F.when(k % 5 == 0, "unknown").when(k % 5 == 1, "partial").when(k % 5 == 2, "direct").when(k % 5 == 3, "missing").otherwise("partial")
    ids = F.when((k % 5).isin(1, 2), F.array(k.cast("string"))).when(k % 35 == 3, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("item_id"), status.alias("status"), ids.alias("evidence_ids"))
    own = Window.partitionBy("user_id", "item_id").orderBy("event_id")
    prior = F.when(k % 20 == 9, "direct").otherwise(F.coalesce(F.lag("status").over(own), F.lit("unknown")))
    opened = F.when(k % 30 == 1, F.array().cast("array<string>")).otherwise(F.array(k.cast("string")))
    given = rows.select("*", prior.alias("prior_status"), F.lag("evidence_ids").over(own).alias("prior_ids"), opened.alias("opened_ids"))
    return alignment.chain_faults(given, ["user_id"], "event_id")


_RANK_SQL = "CASE {} WHEN 'direct' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END"


def _item_sql(n: int, status: str, ids: str, given: str) -> str:
    """Filtered updates of one item and the state before each, in order."""
    kept = f"list_filter({ids}, lambda x: x = opened)"
    return f"""u{n} AS (SELECT user_id, event_id, CASE WHEN {status} IN ('partial', 'direct') AND len({kept}) = 0 THEN 'unknown' WHEN len({kept}) < len({ids}) THEN 'partial' ELSE {status} END AS status, {kept} AS ids, len({kept}) < len({ids}) OR ({status} IN ('partial', 'direct') AND len({kept}) = 0) AS cut FROM e WHERE kind = 'state_update' AND {given}),
b{n} AS (SELECT *, coalesce(lag(status) OVER w, 'unknown') AS was, coalesce(lag(ids) OVER w, []) AS was_ids FROM u{n} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r{n} AS (SELECT user_id, event_id, status, cut OR {_RANK_SQL.format("status")} < {_RANK_SQL.format("was")} OR (len(was_ids) > 0 AND was_ids <> ids) AS revised FROM b{n}),
s{n} AS (SELECT e.user_id, e.event_id, r{n}.revised, coalesce(last_value(r{n}.status IGNORE NULLS) OVER (PARTITION BY e.user_id ORDER BY e.event_id ROWS UNBOUNDED PRECEDING), 'unknown') AS status FROM e LEFT JOIN r{n} USING (user_id, event_id))"""


_STATUS_1 = "CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'partial' WHEN 2 THEN 'direct' WHEN 3 THEN 'missing' ELSE 'partial' END"
_IDS_1 = "CASE WHEN event_id % 5 IN (0, 3) THEN [] WHEN event_id % 7 = 0 THEN ['e' || (event_id % 3), 'x'] ELSE ['e' || (event_id % 3)] END"


@query(f"""WITH e AS (SELECT user_id, event_id, props, CASE event_type WHEN 'purchase' THEN 'final' WHEN 'signup' THEN 'decision' ELSE 'state_update' END AS kind, CASE WHEN event_id % 11 = 0 THEN 'e9' ELSE 'e' || (event_id % 3) END AS opened FROM events),
{_item_sql(1, _STATUS_1, _IDS_1, "true")}, {_item_sql(2, "'direct'", "['e' || (event_id % 3)]", "event_id % 4 <> 0")},
a AS (SELECT e.*, s1.status || ',' || s2.status AS states, CAST(coalesce(s1.revised::INTEGER, 0) + coalesce(s2.revised::INTEGER, 0) AS INTEGER) AS revised, 5700 + event_id % 400 + length(coalesce(props, '')) AS tokens, event_id % 300 AS target, CASE kind WHEN 'final' THEN 2400 WHEN 'decision' THEN 240 ELSE 1200 END AS reserve FROM e JOIN s1 USING (user_id, event_id) JOIN s2 USING (user_id, event_id))
SELECT user_id, event_id, kind, states, revised, array_to_string(list_filter([CASE WHEN kind = 'state_update' AND event_id % 4 = 0 THEN 'item_without_update' END, CASE WHEN kind = 'decision' AND event_id % 3 = 0 THEN 'browse_target_outside_current_window' END, CASE WHEN tokens + reserve > 8192 THEN 'input_reserve_overflow' END, CASE WHEN tokens + target > 8192 THEN 'total_overflow' END, CASE WHEN target > reserve THEN 'target_exceeds_generation_cap' END], lambda x: x IS NOT NULL), ',') AS pending FROM a""")
def stage_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as stages: two items' states carried on, citations checked, budgets, and what keeps a stage out."""
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "final").when(F.col("event_type") == "signup", "decision").otherwise("state_update")
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), F.coalesce("props", F.lit("")).alias("props"))
    opened = F.when(k % 11 == 0, "e9").otherwise(F.concat(F.lit("e"), (k % 3).cast("string")))
    evidence = rows.select("user_id", "event_id", F.lit(0).alias("place"), opened.alias("source_id"), F.col("props").alias("text"), F.lit("a").alias("question"))
    texts = rebuild.scored_evidence(evidence, ["user_id", "event_id"], X.token_set)
    second = "struct('R2' AS item_id, 'direct' AS status, array('e' || (event_id % 3)) AS evidence_ids)"
    first = f"struct('R1' AS item_id, {_STATUS_1} AS status, {_IDS_1.replace('[', 'array(').replace(']', ')')} AS evidence_ids)"
    updates = F.expr(f"CASE WHEN event_id % 4 <> 0 THEN array({first}, {second}) ELSE array({first}) END")
    none = F.lit(None).cast("array<string>")
    stages = rows.join(texts, ["user_id", "event_id"]).select(
        "user_id", "event_id", "kind", "opened", updates.alias("updates"), F.when(F.col("kind") == "decision", "s").alias("chosen"), F.when(k % 3 == 0, F.array(F.lit("o"))).otherwise(F.array(F.lit("o"), F.lit("s"))).alias("candidates"),
        none.alias("cited"), (5700 + k % 400).cast("int").alias("prompt_tokens"), (k % 300).cast("int").alias("target_tokens"), F.lit(True).alias("eligible"),
    )
    items = rows.select("user_id").distinct().select("user_id", F.expr("array(struct('R1' AS item_id, 'one' AS description), struct('R2' AS item_id, 'two' AS description))").alias("items"))
    done = rebuild.rebuilt(stages, items, "user_id", "event_id")
    states = F.array_join(F.transform("after", lambda i: i["status"]), ",")
    return done.select("user_id", "event_id", "kind", states.alias("states"), F.size(F.filter("updates", lambda u: u["revised"])).alias("revised"), F.array_join("pending", ",").alias("pending"))
