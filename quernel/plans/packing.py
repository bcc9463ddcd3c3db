"""Queries of previews, candidate scores and budgets over the standard tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking, scoring, selection
from .catalogue import ANCHOR, QUESTION, TOKEN_SQL, _bm25_sql, t
from .registry import query

ASKED, FOCUS = "thest ering tion onthe with", "ering ander ndth"
_STOP = ", ".join(f"'{w}'" for w in X.TOPIC_STOP)
_FLAT = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'))"
_PARTS = rf"list_filter(string_split(regexp_replace({_FLAT}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: s <> '')"


def _terms(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9-]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"


def _share(asked: str, x: str) -> str:
    return f"len(list_intersect({_terms(repr(asked))}, {_terms(x)})) / CAST(greatest(1, len({_terms(repr(asked))})) AS DOUBLE)"


def _greedy_sql(score: str, budget: int, until: int | None = None, extra: int = 0) -> str:
    fits = f"f.used + r.cost + {extra} <= {budget}" + (f" AND f.used < {until}" if until else "")
    return rf"""WITH RECURSIVE parts AS (SELECT item_id, {_PARTS} AS p FROM benchmark),
s AS (SELECT item_id, CAST(unnest(range(len(p))) AS INTEGER) AS place, unnest(p) AS s FROM parts),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round({score}, 9) DESC, place) AS k, len(string_split(s, ' ')) AS cost FROM s),
f AS (SELECT item_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST([] AS INTEGER[]) AS taken FROM parts
  UNION ALL SELECT f.item_id, r.k, CASE WHEN {fits} THEN f.used + r.cost + {extra} ELSE f.used END, CASE WHEN {fits} THEN list_append(f.taken, r.place) ELSE f.taken END FROM f JOIN r ON r.item_id = f.item_id AND r.k = f.k + 1)
SELECT item_id, array_to_string(list_sort(arg_max(taken, k)), ',') AS places FROM f GROUP BY item_id"""


def _previews(spark: SparkSession, sf_dir: str, score, budget: int, until: int | None = None, extra: int = 0, first_kept: bool = False) -> DataFrame:
    rows = t(spark, sf_dir, "benchmark").select("item_id", selection.sentences(F.col("text")).alias("p"))
    items = selection.preferred(F.col("p"), lambda s: F.round(score(s), 9), first_kept)
    places = selection.greedy(items, F.lit(budget), None if until is None else F.lit(until), extra)
    return rows.select("item_id", F.array_join(F.transform(places, lambda x: x.cast("string")), ",").alias("places"))


def _shared(asked: str, s: Column) -> Column:
    return X.overlap_share(X.topic_terms(F.lit(asked)), X.topic_terms(s))


@query(f"SELECT doc_id, len({_terms('text')}) AS n_terms, round({_share(ASKED, 'text')}, 6) AS relevance FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def topic_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.size(X.topic_terms(F.col("text"))).cast("long").alias("n_terms"), F.round(_shared(ASKED, F.col("text")), 6).alias("relevance"))


@query(_greedy_sql(f"CAST(0.7 AS DOUBLE) * ({_share(ASKED, 's')}) + CAST(0.3 AS DOUBLE) * ({_share(FOCUS, 's')})", 96, 64))
def preview_from_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the best sentence on, while under the target and within the ceiling."""
    return _previews(spark, sf_dir, lambda s: 0.7 * _shared(ASKED, s) + 0.3 * _shared(FOCUS, s), 96, 64)


@query(_greedy_sql(f"CASE WHEN place = 0 THEN 1000000000.0 ELSE {_share(ASKED, 's')} END", 80))
def preview_first_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _previews(spark, sf_dir, lambda s: _shared(ASKED, s), 80, first_kept=True)


@query(_greedy_sql(f"CAST(0.6 AS DOUBLE) * ({_share(FOCUS, 's')}) + CAST(0.4 AS DOUBLE) * ({_share(ASKED, 's')}) + CASE WHEN regexp_matches(lower(s), '\\bwith\\b|\\bthat\\b') THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", 100, None, 3))
def preview_by_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sentences by overlap and a cue of results; each costs three more than its words."""
    return _previews(spark, sf_dir, lambda s: 0.6 * _shared(FOCUS, s) + 0.4 * _shared(ASKED, s) + F.when(F.lower(s).rlike("\\bwith\\b|\\bthat\\b"), 0.15).otherwise(0.0), 100, extra=3)


_WORDS = rf"(CASE WHEN {_FLAT} = '' THEN 0 ELSE len(string_split({_FLAT}, ' ')) END)"
_CAPPED = ", ".join(f"sum(least(ceiling, {c})) AS s{c}" for c in [128, *selection.CAPS])
_FIRST = "coalesce(" + ", ".join(f"CASE WHEN s{c} <= 200 THEN {c} END" for c in [128, *selection.CAPS]) + ")"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+", " "))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", selection.words(flat).cast("int").alias("cost"))


@query(f"""WITH r AS (SELECT conv_id, turn, {_WORDS} AS cost, least(128, 1024 // count(*) OVER (PARTITION BY conv_id)) AS share FROM conversations),
c AS (SELECT conv_id, turn, CAST(least(cost, share) AS INTEGER) AS ceiling FROM r), s AS (SELECT conv_id, {_CAPPED} FROM c GROUP BY conv_id)
SELECT conv_id, turn, ceiling, CAST({_FIRST} AS INTEGER) AS cap FROM c JOIN s USING (conv_id)""")
def preview_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cap under which the region fits; no row is dropped."""
    return selection.first_cap(_sized(spark, sf_dir), "conv_id", "cost", 128, 200, 1024).select("conv_id", "turn", "ceiling", "cap")


@query(f"""WITH r AS (SELECT conv_id, turn, role, length({_FLAT}) AS size, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CAST(least(size, CASE WHEN role = 'user' THEN 240 ELSE 160 END, 1200 // n) AS INTEGER) AS shown FROM r""")
def preview_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+", " "))
    rows = t(spark, sf_dir, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    return rows.select("conv_id", "turn", F.least(F.length(flat), F.when(F.col("role") == "user", 240).otherwise(160), F.floor(F.lit(1200) / F.col("n"))).cast("int").alias("shown"))


@query(f"""WITH RECURSIVE r AS (SELECT conv_id, turn, {_WORDS} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations),
c AS (SELECT conv_id, list(CAST(least(w, 128) AS INTEGER) ORDER BY n) AS c FROM r WHERE n <= 8 GROUP BY conv_id),
f AS (SELECT conv_id, 0 AS k, c FROM c UNION ALL SELECT conv_id, k + 1, list_transform(c, lambda x, i: CASE WHEN i = list_position(c, list_max(c)) THEN greatest(x - 16, 0) ELSE x END) FROM f WHERE list_sum(c) > 150 AND k < 128)
SELECT conv_id, array_to_string(arg_max(c, k), ',') AS costs FROM f GROUP BY conv_id""")
def candidate_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight candidates, the greatest preview shrunk step by step until the region fits."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+", " "))
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.least(selection.words(flat), F.lit(128)).cast("int").alias("cost"))
    first = scoring.top_per_group(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], 8, "n")
    costs = first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "cost"))), lambda x: x["cost"]).alias("c"))
    return costs.select("conv_id", F.array_join(F.transform(selection.shrunk(F.col("c"), 150), lambda x: x.cast("string")), ",").alias("costs"))


@query(f"""WITH r AS (SELECT conv_id, turn, {_WORDS} AS cost FROM conversations), s AS (SELECT conv_id, count(*) AS n, sum(cost) AS total FROM r GROUP BY conv_id)
SELECT conv_id, turn, CAST(CASE WHEN total <= 300 THEN cost ELSE least(cost, greatest(48, 300 // n - 45)) END AS INTEGER) AS granted FROM r JOIN s USING (conv_id)""")
def evidence_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source may show: all of it, or on overflow an even card."""
    rows = _sized(spark, sf_dir)
    sums = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("cost").alias("total"))
    card = F.greatest(F.lit(48), F.floor(F.lit(300) / F.col("n")) - 45)
    return rows.join(sums, "conv_id").select("conv_id", "turn", F.when(F.col("total") <= 300, F.col("cost")).otherwise(F.least("cost", card)).cast("int").alias("granted"))


_KIND = "CASE role WHEN 'user' THEN 'search' WHEN 'assistant' THEN 'browse' ELSE 'thought' END"


@query(f"""WITH r AS (SELECT conv_id, turn, {_KIND} AS kind, {_WORDS} AS w FROM conversations), m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn DESC) = 1 AS last FROM r),
a AS (SELECT *, CASE WHEN kind = 'search' THEN least(w, 20) ELSE w END AS w1 FROM m), b AS (SELECT *, CASE WHEN kind = 'browse' AND NOT last THEN least(w1, 30) ELSE w1 END AS w2 FROM a),
c AS (SELECT *, CASE WHEN kind = 'thought' AND NOT last THEN 0 ELSE w2 END AS w3, sum(w) OVER g AS t0, sum(w1) OVER g AS t1, sum(w2) OVER g AS t2 FROM b WINDOW g AS (PARTITION BY conv_id))
SELECT conv_id, turn, CAST(CASE WHEN t0 <= 120 THEN 0 WHEN t1 <= 120 THEN 1 WHEN t2 <= 120 THEN 2 ELSE 3 END AS INTEGER) AS stage, CAST(CASE WHEN t0 <= 120 THEN w WHEN t1 <= 120 THEN w1 WHEN t2 <= 120 THEN w2 ELSE w3 END AS INTEGER) AS kept FROM c""")
def context_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "search").when(F.col("role") == "assistant", "browse").otherwise("thought")
    rows = _sized(spark, sf_dir).withColumn("kind", kind)
    return selection.compacted(rows, "conv_id", "turn", "kind", "cost", 120, 20, 30).select("conv_id", "turn", "stage", "kept")


GATES = [([r"\blatest\b", r"\bwith\b.*\bthat\b"], True), ([r"\bbias\b", "^le "], False), ([r"\bthe\b"], True)]


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(c, '{"|".join(f"(?:{p})" for p in GATES[0][0])}') THEN true WHEN regexp_matches(c, '{"|".join(f"(?:{p})" for p in GATES[1][0])}') THEN false WHEN regexp_matches(c, '{GATES[2][0][0]}') THEN true ELSE false END AS search
FROM (SELECT doc_id, lower({_FLAT}) AS c FROM documents)""")
def search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", X.gate(F.col("text"), GATES, False).alias("search"))


_QUALITY = ("ering|tion", "copyright|subscribe", "^the ", "^(and|of) ")


@query(f"""WITH q AS (SELECT doc_id, coalesce(text, '') AS text, lower(split_part(coalesce(text, ''), chr(10), 1)) AS heading FROM documents),
r AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{_QUALITY[1]}') AND NOT regexp_matches(text, '{_QUALITY[0]}') THEN 'boilerplate' WHEN regexp_matches(heading, '{_QUALITY[2]}') AND regexp_matches(text, '{_QUALITY[0]}') THEN 'signal_over_heading'
  WHEN regexp_matches(heading, '{_QUALITY[2]}') THEN 'foreign_heading' WHEN regexp_matches(heading, '{_QUALITY[3]}') THEN 'weak_heading' WHEN length(text) < 320 AND NOT regexp_matches(text, '{_QUALITY[0]}') THEN 'short' WHEN regexp_matches(text, '{_QUALITY[0]}') THEN 'signal' ELSE 'general' END AS reason FROM q)
SELECT doc_id, CASE WHEN reason = 'boilerplate' THEN 'excluded' WHEN reason IN ('foreign_heading', 'weak_heading', 'short') THEN 'context' ELSE 'evidence' END AS quality, reason <> 'boilerplate' AS eligible,
  CAST(CASE WHEN reason = 'boilerplate' THEN 100 WHEN reason IN ('foreign_heading', 'weak_heading', 'short') THEN 2 ELSE 0 END AS DOUBLE) AS penalty, reason FROM r""")
def passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts by their words; a text's first line is its heading."""
    text = F.coalesce("text", F.lit(""))
    heading = F.lower(F.split_part(text, F.lit("\n"), F.lit(1)))
    return t(spark, sf_dir, "documents").select("doc_id", X.passage_quality(heading, text, *_QUALITY).alias("q")).select("doc_id", "q.*")


@query(f"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host, {TOKEN_SQL.replace("text", "url")} AS w FROM pages),
s AS (SELECT page_id, url, host, len(list_intersect(['ththth', 'example', 'feed', 'en'], list_distinct(w))) / 4.0e0 AS f, len(list_intersect(['blog', 'example'], list_distinct(w))) / 2.0e0 AS q FROM p)
SELECT page_id, round(CASE WHEN host LIKE '%example.org' THEN 120 ELSE 40 END + 70e0 * (6e-1 * f + 4e-1 * q) + CASE WHEN contains(url, 'feed') THEN 12 ELSE 0 END + CASE WHEN starts_with(host, 'www.') THEN 30 ELSE 0 END
  - CASE WHEN starts_with(host, 'blog.') THEN 80 ELSE 0 END - CASE WHEN contains(url, 'page=') THEN 10 ELSE 0 END - greatest(0, least(page_id % 400 - 100, 180)), 6) AS score FROM s""")
def web_candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, url = X.host(F.col("url")), F.col("url")
    focus, asked = F.array(*map(F.lit, ("ththth", "example", "feed", "en"))), F.array(F.lit("blog"), F.lit("example"))
    authority = F.when(name.endswith("example.org"), 120.0).otherwise(40.0)
    score = X.candidate_score(focus, asked, X.token_set(url), authority, [(url.contains("feed"), 12.0), (name.startswith("www."), 30.0)], [(name.startswith("blog."), 80.0), (url.contains("page="), 10.0)], (F.col("page_id") % 400 - 100).cast("double"))
    return t(spark, sf_dir, "pages").select("page_id", F.round(score, 6).alias("score"))


_GAP = ["ering", "ndth"]


@query(f"""WITH {_bm25_sql(QUESTION, "now")}, {_bm25_sql(_GAP, "gaps")}, {_bm25_sql(ANCHOR, "asked")},
j AS (SELECT doc_id, source, now_score AS x, gaps_score AS y, asked_score AS z FROM now JOIN gaps USING (doc_id, source) JOIN asked USING (doc_id, source)),
m AS (SELECT source, max(x) AS mx, max(y) AS my, max(z) AS mz FROM j GROUP BY source),
b AS (SELECT doc_id, j.source, round(CASE WHEN mx > 0 THEN 0.6 * x / mx ELSE 0 END + CASE WHEN my > 0 THEN 0.25 * y / my ELSE 0 END + CASE WHEN mz > 0 THEN 0.15 * z / mz ELSE 0 END, 6) AS score FROM j JOIN m USING (source))
SELECT doc_id, source, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 8""")
def candidate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the present query, what is still open, and the question."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    three = scoring.bm25_many(docs, {"now": QUESTION, "gaps": _GAP, "asked": ANCHOR}, "source", "text").select("doc_id", "source", "now", "gaps", "asked")
    scored = scoring.blend(three, "source", [("now", 0.6), ("gaps", 0.25), ("asked", 0.15)], "score").select("doc_id", "source", "score")
    return scoring.top_per_group(scored, ["source"], [F.col("score").desc(), F.col("doc_id")], 8)


@query("""WITH e AS (SELECT o_orderkey, o_orderpriority AS g, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r0, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r1, o_orderstatus <> 'P' AS ok, o_totalprice AS ce FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r0) AS e0, row_number() OVER (PARTITION BY g ORDER BY r1) AS e1 FROM e WHERE ok),
c AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY 1e0 / (60 + r0) + 1e0 / (60 + r1) DESC, o_orderkey) AS place FROM f WHERE e0 <= 10 OR e1 <= 10)
SELECT o_orderkey, g AS o_orderpriority, CAST(r0 AS INTEGER) AS r0, CAST(r1 AS INTEGER) AS r1, CAST(row_number() OVER (PARTITION BY g ORDER BY ce DESC, r0, r1) AS INTEGER) AS rank FROM c WHERE place <= 16""")
def gated_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks over all rows; of the eligible ones the ten first by either rank, cut by fused rank, ordered by a last score."""
    rows = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate", (F.col("o_orderstatus") != "P").alias("ok"))
    return scoring.gated_fusion(rows, ["o_orderpriority"], [[F.col("o_totalprice").desc(), F.col("o_orderkey")], [F.col("o_orderdate"), F.col("o_orderkey")]], F.col("ok"), F.col("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderpriority", "r0", "r1", "rank")


@query("""SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linenumber) AS INTEGER) AS place FROM lineitem""")
def cited_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(F.col("l_returnflag") != "R", "l_linenumber")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("place"))


@query("""SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, doc_id) AS INTEGER) AS place FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)""")
def stable_resort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows back in the order of a known ordinal, those without one last, ties as they came."""
    known = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = t(spark, sf_dir, "documents").select("doc_id", "source").join(known, "doc_id", "left")
    return ranking.ranked(rows, ["source"], [F.col("quality").desc_nulls_last(), F.col("doc_id")], "place").select("doc_id", "source", "place")
