"""Queries of parsed documents, actions and answers over the standard tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import extensions
from ..functions import text as X
from ..operators import caching, contracts
from ..sources import articles, documents, markup
from .catalogue import t, whole_seconds
from .registry import query

_SAFE = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .]', '', 'g'), ' +', ' ', 'g'))"


def _safe(column: str = "text"):
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(column, F.lit("")), "[^A-Za-z0-9 .]", ""), " +", " "))


@query(f"""WITH s AS (SELECT conv_id, turn, {_SAFE} AS x FROM conversations), u AS (SELECT conv_id, turn, x, row_number() OVER (PARTITION BY conv_id, x ORDER BY turn) AS n FROM s WHERE x <> '')
SELECT conv_id, 'article' AS format, 'T' || turn AS heading, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS section_index, md5(x) AS digest FROM u WHERE n = 1""")
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text articles written from conversations, a section a turn, and parsed by their format."""
    sec = F.concat(F.lit("<sec><title>T"), F.col("turn").cast("string"), F.lit("</title><p>"), _safe(), F.lit("</p></sec>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", sec.alias("s")))), lambda x: x["s"]), "")
    written = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit('<article xmlns="http://x"><body>'), body, F.lit("</body></article>")).alias("raw"))
    found = articles.parsed(written, "conv_id", "raw", {"article": articles.article_parts, "abstract": markup.abstract_parts, "html": documents.sections_of, "markdown": markup.markdown_parts})
    return found.select("conv_id", "format", "heading", "section_index", F.md5("text").alias("digest"))


@query(f"""WITH s AS (SELECT conv_id, turn, {_SAFE} AS x FROM conversations)
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'abstract' WHEN 2 THEN 'html' WHEN 3 THEN 'markdown' ELSE 'plain' END AS format FROM s""")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 5
    raw = F.when(k == 0, F.concat(F.lit("<?xml version='1.0'?><article><body>"), _safe())).when(k == 1, F.concat(F.lit("<PubmedArticleSet><PubmedArticle>"), _safe())).when(k == 2, F.concat(F.lit("<!DOCTYPE html><p>"), _safe())).when(k == 3, F.concat(F.lit("# Head\n"), _safe())).otherwise(_safe())
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", articles.format_of(raw).alias("format"))


RULES = {"bibliography": "^(the|of) ", "record": "tion", "legal": "ering|ander", "template": "^(le|que|and) ", "controls": "ndth|onthe"}


@query(rf"""WITH s AS (SELECT doc_id, coalesce(text, '') AS text, lower(split_part(coalesce(text, ''), chr(10), 1)) AS h FROM documents),
f AS (SELECT *, len(regexp_extract_all(text, '[.!?](\s|$)')) AS n FROM s), g AS (SELECT *, length(text) >= 180 AND n >= 2 AS prose, regexp_matches(h, '{RULES["template"]}') AS tmpl FROM f),
r AS (SELECT doc_id, CASE WHEN regexp_matches(h, '{RULES["bibliography"]}') AND regexp_matches(text, '{RULES["record"]}') THEN 'records' WHEN len(regexp_extract_all(text, '{RULES["legal"]}')) >= 2 AND (tmpl OR NOT prose) THEN 'legal' WHEN prose THEN 'prose'
  WHEN len(regexp_extract_all(text, '{RULES["controls"]}')) >= 2 THEN 'controls' WHEN tmpl AND n = 0 AND len(string_split(text, ' ')) >= 3 THEN 'list' ELSE 'unsure' END AS reason FROM g)
SELECT doc_id, CASE WHEN reason = 'records' THEN 'bibliography' WHEN reason IN ('legal', 'controls', 'list') THEN 'boilerplate' ELSE 'content' END AS kind, reason FROM r""")
def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts by ordered rules; a text's first line is its heading."""
    text = F.coalesce("text", F.lit(""))
    heading = F.lower(F.split_part(text, F.lit("\n"), F.lit(1)))
    return t(spark, sf_dir, "documents").select("doc_id", articles.section_kind(heading, text, RULES).alias("k")).select("doc_id", "k.*")


@query(rf"""WITH s AS (SELECT conv_id, turn, {_SAFE} AS x FROM conversations)
SELECT conv_id, count(*) FILTER (x <> '') AS sections, CAST(sum(length(x)) AS BIGINT) AS chars, bool_or(length(x) >= 120) AS readable FROM s GROUP BY conv_id""")
def preprocessed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned sections of a document, never renumbered, and whether any of them is readable."""
    rows = t(spark, sf_dir, "conversations").withColumn("x", _safe())
    return rows.groupBy("conv_id").agg(F.count_if(F.col("x") != "").alias("sections"), F.sum(F.length("x")).cast("long").alias("chars"), F.bool_or(F.length("x") >= 120).alias("readable"))


@query(r"""SELECT event_id, event_type AS tool, CAST(user_id AS VARCHAR) AS owner FROM events WHERE event_id % 3 <> 2""")
def canonical_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions in JSON or as a tag, in one form; objects with other keys are none."""
    k, name, owner = F.col("event_id") % 3, F.col("event_type"), F.col("user_id").cast("string")
    as_json = F.to_json(F.struct(name.alias("tool"), F.struct(owner.alias("owner")).alias("arguments")))
    as_tag = F.concat(F.lit('<call_tool name="'), name, F.lit('" owner="'), owner, F.lit('">'), F.col("props"), F.lit("</call_tool>"))
    raw = F.when(k == 0, as_json).when(k == 1, as_tag).otherwise(F.to_json(F.struct(name.alias("tool"), owner.alias("arguments"), F.lit(1).alias("extra"))))
    rows = t(spark, sf_dir, "events").select("event_id", articles.action(raw).alias("a")).filter("a is not null")
    return rows.select("event_id", "a.tool", F.get_json_object("a.arguments", "$.owner").alias("owner"))


_ENDED = "text || ' {\"turn\": ' || turn || ', \"say\": \"' || left(replace(replace(replace(text, chr(92), ''), '\"', ''), chr(10), ' '), 20) || '\"}' || CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) || repeat(' ', length(text) % 3) ELSE right(text, 1 + conv_id % 2) END"


@query(rf"""WITH r AS (SELECT conv_id, turn, {_ENDED} AS raw FROM conversations WHERE text IS NOT NULL), x AS (SELECT conv_id, turn, regexp_extract(raw, '(\{{[^{{}}]*\}})\s*$', 1) AS o FROM r)
SELECT conv_id, turn, CASE WHEN json_valid(o) THEN md5(o) END AS digest FROM x""")
def terminal_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object that ends an output after a whole text; none where more than white space follows."""
    raw = F.expr(_ENDED.replace("chr(92)", "char(92)").replace("chr(10)", "char(10)"))
    return t(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.md5(articles.terminal_json(raw)).alias("digest"))


_DAMAGED = "CASE event_id % 3 WHEN 0 THEN left(props, CAST(1 + event_id % (length(props) + 2) AS INTEGER)) WHEN 1 THEN '[' || props || ', ' || left(props, CAST(length(props) - event_id % 2 AS INTEGER)) || ']' ELSE replace(props, '}', ', ' || substr(props, 2)) END"


@query(f"""WITH r AS (SELECT event_id, {_DAMAGED} AS raw FROM events)
SELECT event_id, json_valid(raw) AND CASE WHEN json_valid(raw) AND left(raw, 1) = '{{' THEN len(json_keys(raw)) = len(list_distinct(json_keys(raw))) ELSE true END AS strict FROM r""")
def strict_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties cut short, in lists, and with each key twice: what a strict reader takes."""
    return t(spark, sf_dir, "events").select("event_id", articles.strict_json(F.expr(_DAMAGED)).alias("strict"))


@query("""SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand, p_type) AS INTEGER) AS header, p_brand || '/' || p_type AS expanded FROM part""")
def header_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated headers as numbers of a dictionary, and back without loss."""
    rows = t(spark, sf_dir, "part").withColumn("h", F.struct("p_brand", "p_type"))
    packed, names = caching.factored(rows.select("p_partkey", "h"), "h", "header")
    return packed.join(names, "header").select("p_partkey", "header", F.concat("h.p_brand", F.lit("/"), "h.p_type").alias("expanded"))


@query("""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT conv_id, CAST(place AS INTEGER) AS place, 'E' || turn AS id, turn % 3 <> 0 AS opened FROM p""")
def bound_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that each paragraph of an answer cites, and whether they were opened."""
    turns = t(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    tag = lambda x: F.concat(F.lit('said <cite id="E'), x.cast("string"), F.lit('">so</cite> and <cite id="E'), x.cast("string"), F.lit('">again</cite>.'))
    answers = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), tag), "\n\n").alias("a"))
    cited = answers.select("conv_id", F.inline(articles.answer_paragraphs(F.col("a")))).select("conv_id", "place", F.explode("ids").alias("id"))
    opened = turns.filter("turn % 3 <> 0").select("conv_id", F.concat(F.lit("E"), F.col("turn").cast("string")).alias("id"), F.lit(True).alias("seen"))
    return cited.join(opened, ["conv_id", "id"], "left").select("conv_id", "place", "id", F.coalesce("seen", F.lit(False)).alias("opened"))


@query(r"""WITH s AS (SELECT doc_id, coalesce(text, '') AS x FROM documents) SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(regexp_replace(x, '[ \t\n\r]+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda v: v <> '')) AS flat,
  len(list_filter(list_transform(string_split(regexp_replace(x, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda v: trim(v)), lambda v: v <> '')) AS by_line FROM s""")
def sentence_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of compacted text, and of text whose line ends count."""
    from ..operators import selection

    return t(spark, sf_dir, "documents").select("doc_id", F.size(selection.sentences(F.col("text"))).cast("long").alias("flat"), F.size(selection.line_sentences(F.col("text"))).cast("long").alias("by_line"))


@query("""WITH f AS (SELECT user_id, 0 AS part, max(event_id) AS id FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT user_id, 1, max(event_id) FROM events WHERE event_type = 'signup' AND user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT user_id, 2, max(event_id) FROM events GROUP BY 1)
SELECT user_id, CAST(min(part) AS INTEGER) AS part, arg_min(id, part) AS id FROM f GROUP BY user_id""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source of a chain that has a key."""
    rows = t(spark, sf_dir, "events")
    parts = [rows.filter(c).groupBy("user_id").agg(F.max("event_id").alias("id")) for c in ("event_type = 'purchase'", "event_type = 'signup' and user_id % 2 = 0", "true")]
    return extensions.fallback(["user_id"], *parts).select("user_id", "part", "id")


@query("""SELECT event_id, greatest(1, least(60, CAST(floor(value) AS INTEGER))) AS seconds, greatest(8192, least(8388608, CAST(floor(value * 1000) AS INTEGER))) AS bytes FROM events""")
def fetch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    clamp = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.floor(c).cast("int")))
    return t(spark, sf_dir, "events").select("event_id", clamp(F.col("value"), 1, 60).alias("seconds"), clamp(F.col("value") * 1000, 8192, 8388608).alias("bytes"))


@query("""WITH r AS (SELECT event_id, CAST(epoch(ts) AS BIGINT) AS s, md5('fetch|' || event_type || '|' || user_id) AS key, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id END AS result FROM events),
c AS (SELECT key, max(s) AS stored FROM r WHERE result IS NOT NULL AND event_id % 2 = 0 GROUP BY key)
SELECT event_id, r.key, coalesce(s >= stored AND s - stored < 864000, false) AS hit FROM r LEFT JOIN c USING (key)""")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by function and arguments (a timeout is none) against stored responses that haven't expired; nulls aren't stored."""
    rows = t(spark, sf_dir, "events").select("event_id", whole_seconds(F.col("ts")).alias("s"), caching.call_key("fetch", {"kind": F.col("event_type"), "timeout": F.lit(30), "user": F.col("user_id")}).alias("key"), F.when(F.col("event_id") % 6 != 0, F.col("event_id")).alias("result"))
    stored = rows.filter("result is not null and event_id % 2 = 0").groupBy("key").agg(F.max("s").alias("stored"))
    return caching.unexpired(rows, stored, "key", "s", "stored", 864000).select("event_id", "key", "hit")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, md5(l_orderkey || ':' || l_linenumber) AS h FROM lineitem), s AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN o_orderkey IS NULL THEN 'no source' WHEN l_linenumber % 6 = 5 THEN 'hash' ELSE 'bound' END AS state FROM b LEFT JOIN s ON l_orderkey = o_orderkey""")
def source_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against the capture that they name: there, and with the same hash."""
    own = F.md5(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    said = F.when(F.col("l_linenumber") % 6 == 5, "x").otherwise(own)
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (own != said).alias("other"))  # only the outcome is shuffled
    there = t(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select("o_orderkey").distinct()
    state = F.when(F.col("o_orderkey").isNull(), "no source").when(F.col("other"), "hash").otherwise("bound")
    return rows.join(there, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", state.alias("state"))


@query("""SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS mapped, CASE c_mktsegment WHEN 'BUILDING' THEN 'parsed' WHEN 'MACHINERY' THEN 'abstract' END AS route, coalesce(c_mktsegment = 'BUILDING', false) AS full_text FROM customer""")
def route_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of mapped sources by the kind of their scenario."""
    route = F.when(F.col("c_mktsegment") == "BUILDING", "parsed").when(F.col("c_mktsegment") == "MACHINERY", "abstract")
    return t(spark, sf_dir, "customer").select("c_custkey", route.isNotNull().alias("mapped"), route.alias("route"), F.coalesce(route == "parsed", F.lit(False)).alias("full_text"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), a AS (SELECT user_id, min(n) FILTER (NOT failed) AS first_ok FROM e WHERE n <= 3 GROUP BY 1)
SELECT user_id, CAST(coalesce(first_ok, 3) AS INTEGER) AS attempts, first_ok IS NOT NULL AS refreshed FROM a""")
def refresh_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three attempts; the state is kept where all of them fail."""
    return caching.attempts(t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "error", 3).select("user_id", "attempts", "refreshed")


@query("""SELECT conv_id, CAST(least(count(*), 5) AS INTEGER) AS items, bool_and(role <> 'system') AS valid, md5(string_agg(coalesce(text, ''), '|' ORDER BY turn, role, text)) AS packet FROM conversations GROUP BY conv_id""")
def judge_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge may see of a task: bounded items, no private row, and the digest of all its texts."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").isNull().alias("none"), "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.least(F.count("*"), F.lit(5)).cast("int").alias("items"), F.bool_and(F.col("role") != "system").alias("valid"), F.md5(F.array_join(texts, "|")).alias("packet"))


@query("""WITH n AS (SELECT s_nationkey, s_suppkey, s_name FROM supplier) SELECT n_nationkey, count(s_suppkey) AS n, min(s_name) AS first_name FROM nation LEFT JOIN n ON n_nationkey = s_nationkey GROUP BY n_nationkey""")
def id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to what they stand for; null for an unknown one."""
    found = t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_name").alias("first_name"))
    return t(spark, sf_dir, "nation").join(found, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("n"), "first_name")


@query("""SELECT event_id, json_keys(props) IS NOT NULL AS decoded, len(json_keys(props)) AS slots FROM events""")
def decoded_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubrics as objects, lists of one or JSON text, by their slots."""
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.col("props"))
    inner = F.when(F.trim(raw).startswith("["), F.get_json_object(raw, "$[0]")).otherwise(raw)
    keys = F.json_object_keys(inner)
    return t(spark, sf_dir, "events").select("event_id", keys.isNotNull().alias("decoded"), F.size(keys).cast("long").alias("slots"))


@query("""SELECT page_id, url, md5(url) AS pointer_digest FROM pages""")
def retrieval_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointer beside the visible row, digested: the pointer itself stays out of what is shown."""
    rows = t(spark, sf_dir, "pages").select("page_id", F.struct("url", F.md5("url").alias("digest")).alias("pointer"))
    return rows.select("page_id", "pointer.url", F.col("pointer.digest").alias("pointer_digest"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z0-9]+|[一-鿿]')) AS w FROM documents), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 5),
s AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM w a JOIN w b USING (w) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
j AS (SELECT x, y, k / CAST(p.n + q.n - k AS DOUBLE) AS sim FROM s JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y)
SELECT x AS doc_id, min(y) AS resolved FROM j WHERE sim >= 0.8 GROUP BY x""")
def title_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the first other one whose title, its first line, has the same words to four fifths."""
    titles = t(spark, sf_dir, "documents").select("doc_id", X.token_set(F.split_part("text", F.lit("\n"), F.lit(1))).alias("w"))
    return contracts.similar_titles(titles, titles, "doc_id", "w").select("doc_id", "resolved")
