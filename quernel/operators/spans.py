"""Spans of texts: unions and complements of intervals, what of a section can be retrieved, and windows over it.

Intervals are arrays of struct<start, end, ...> in a row, in code points, ends exclusive. Everything here is in place: no
row meets another, so there is no shuffle, and work grows with the length of the arrays.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import places as P

# --- intervals


def by_start(*intervals: Column) -> Column:
    """One array of all the intervals, in order."""
    return F.array_sort(F.concat(*intervals))


def gaps(ordered: Column, reach: Column, length: Column) -> Column:
    """array<struct<start, end, at>> of what lies before, between and after intervals: the complement of their union.

    ordered are the intervals by start, reach the running maximum of their ends; touching intervals leave no gap. `at` is
    the place in ordered of the interval that ends the gap. The first and last gap are there even if they are empty.
    """

    def before(x: Column, i: Column) -> Column:
        return F.struct(F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("start"), x["start"].alias("end"), i.alias("at"))

    inner = F.filter(F.transform(ordered, before), lambda g: (g["at"] == 0) | (g["end"] > g["start"]))
    n = F.size(ordered)
    last = F.struct(F.coalesce(F.get(reach, n - 1), F.lit(0)).alias("start"), length.alias("end"), n.alias("at"))
    return F.concat(inner, F.array(last))


def islands(gap: Column, ordered: Column, reason: str = "reason") -> Column:
    """array<struct<start, end, reason>> of the union: what lies between neighbouring gaps, with the reasons of its parts."""
    n = F.greatest(F.size(gap) - 1, F.lit(0))

    def between(g: Column, h: Column) -> Column:
        parts = F.slice(ordered, g["at"] + 1, F.greatest(h["at"] - g["at"], F.lit(0)))
        return F.struct(g["end"].alias("start"), h["start"].alias("end"), F.array_join(F.transform(parts, lambda x: x[reason]), ";").alias("reason"))

    return F.zip_with(F.slice(gap, 1, n), F.slice(gap, 2, n), between)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def worded(text: Column, intervals: Column) -> Column:
    """array<struct<start, end>>: intervals without white space around, if a word character is left in them."""

    def one(t: str | None, found) -> list[dict]:
        out = []
        for g in () if t is None or found is None else found:
            part = t[g["start"] : g["end"]]
            if any(c == "_" or c.isalnum() for c in part):
                start = g["start"] + len(part) - len(part.lstrip())
                out.append({"start": start, "end": start + len(part.strip())})
        return out

    @F.pandas_udf(_SPANS)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in parts:
            yield pd.Series([one(t, g) for t, g in zip(texts, lists, strict=True)], dtype=object)

    return run(text, intervals)


# --- fixed values: what of a section is no body text

CODE = r"```.*?```|`[^`]*`"
IMAGE = r"!\[[^\]]*\]\(\s*[^\s()]+(?:\s+\"[^\"]*\")?\s*\)"
ORPHAN_IMAGE = r"\A(?i:[A-Za-z0-9][\w./:%?&=+#~-]*\.(?:png|jpe?g|gif|webp|svg)(?:[?#][^\s)]*)?\))"
PLACEHOLDER = r"\{\{\s*(?i:javascript\s*:[^{}]*|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+(?:[^{}]*))\s*\}\}"
REFERENCE_MARKER = r"(?i:参考文献|\bReferences\b|\bBibliography\b)(?=\s*[:：]?\s*(?:\d+\s*[.、)]|[A-Z][a-z]+\b))"
REFERENCE_RECORD = r"(?:\b|(?<=参考文献))(?:19|20)\d{2}\b|(?i:\bdoi\b|\bPMID\b|\bet al\.)|\d+\s*:\s*\d+\s*[-–]\s*\d+"
REFERENCE_SIGN = r"(?i:\bdoi\b|\bPMID\b)|\d+\s*:\s*\d+\s*[-–]\s*\d+|(?:\b|(?<=参考文献))2\s*[.、)]"
TEMPLATE_HEADING = "导航|热门产品|热门推荐|更多推荐|扫码|扫一扫|分享|技术支持|版权|友情链接|社区|活动|圈层|开发者|" r"\b(?:navigation|related|recommended|share|cookie|support|products|community|newsletter|copyright)\b"
LEGAL = "copyright|版权所有|all rights reserved|ICP备|公网安备"
SUPPORT = "技术支持|technical support|本系统由"
BROWSER = r"浏览器|分辨率|IE\s*\d|浏览本页面|browser|resolution"
FORMATS = r"APA|MLA|GB/T\s*7714|格式引文"
PAGE_UI = "欢迎访问|官方网站|分享到|Author information|作者信息|文章历史|原文顺序|文献年度倒序|文中引用次数倒序"
SORT_UI = "原文顺序|文献年度倒序|文中引用次数倒序|sort by|citation count"
FOLLOW = "扫码关注|扫一扫|subscribe|sign up"
OFFER = "领取|代金券|newsletter|subscribe"
SENTENCE_MARK = r"[。！？!?]|(?<!\d)\.(?=\s|$)"
REFERENCE_HEADINGS = ["references", "bibliography", "works cited", "literature cited", "参考文献"]


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?iU){pattern}"))


def cleaned(text: Column) -> Column:
    """Text without control characters, white space as single spaces, none around; null is empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def plain_heading(heading: Column) -> Column:
    """A heading in lower case without a number before it or marks around it."""
    bare = F.regexp_replace(F.coalesce(heading, F.lit("")), r"(?iU)\APDF version:\s*[^|]+\|\s*", "")
    bare = F.regexp_replace(bare, r"(?U)\A\s*(?:\d+[.\s]+|[IVX]+[.\s]+)", "")
    return F.lower(F.regexp_replace(bare, r"\A[ #*.:]+|[ #*.:]+\z", ""))


def section_verdict(heading: Column, text: Column, reasons: Collection[str] | None = None) -> Column:
    """struct<kind, reason> of a section with cleaned text: content, bibliography or web_boilerplate; the first rule that holds,
    of those that give one of `reasons`, or of all."""
    heading = F.coalesce(heading, F.lit(""))
    plain = F.regexp_replace(text, rf"(?sU)({CODE})|(?:{PLACEHOLDER})", "$1")
    unrendered = plain != text
    prose, sentences, chars = _count(plain, SENTENCE_MARK), _count(text, SENTENCE_MARK), F.length(text)
    placeholders = F.regexp_count(text, F.lit(rf"(?sU)(?:{PLACEHOLDER})")) - F.regexp_count(plain, F.lit(rf"(?sU)(?:{PLACEHOLDER})"))
    full, titled = (chars >= 180) & (sentences >= 2), _has(heading, TEMPLATE_HEADING)
    rules = [
        (unrendered & (F.regexp_replace(plain, r"[ |:\-+*]", "") == ""), "web_boilerplate", "unrendered_placeholder_only"),
        ((placeholders >= 2) & (prose < 2) & (_count(plain, PAGE_UI) >= 2), "web_boilerplate", "unrendered_metadata_shell"),
        ((_count(text, SORT_UI) >= 2) & (chars <= 800) & (prose < 2), "web_boilerplate", "reference_sort_controls"),
        (plain_heading(heading).isin(REFERENCE_HEADINGS) & text.rlike(f"(?U){REFERENCE_RECORD}"), "bibliography", "bibliographic_records_not_article_body"),
        ((_count(text, LEGAL) >= 2) & (chars <= 1200) & (titled | ~full), "web_boilerplate", "multiple_legal_template_cues"),
        (titled & (chars <= 400) & _has(text, FOLLOW) & _has(text, OFFER), "web_boilerplate", "subscription_or_promotion_controls"),
        (full, "content", "substantive_prose_preserved"),
        (_has(text, SUPPORT) & _has(text, BROWSER) & (chars <= 600), "web_boilerplate", "support_and_browser_ui"),
        ((_count(text, FORMATS) >= 2) & (chars <= 400), "web_boilerplate", "citation_format_controls"),
        (titled & (chars <= 400) & (sentences == 0) & (F.regexp_count(text, F.lit(r"\S+")) >= 3), "web_boilerplate", "template_heading_and_short_list"),
    ]
    of = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    out = of("content", "insufficient_template_evidence")
    for test, kind, reason in reversed(rules):
        out = F.when(test, of(kind, reason)).otherwise(out) if reasons is None or reason in reasons else out
    return out


def preprocessed(sections: DataFrame, heading: str = "heading", text: str = "text", reasons: Collection[str] | None = None) -> DataFrame:
    """sections with their text cleaned, and what of it can be retrieved; no row is dropped or renumbered.

    New columns: kind, reason; spans, array<struct<start, end>> of body text; excluded, array<struct<start, end, reason>>
    of the rest; original_sha256, original_chars, cleaned_chars (of the spans), eligible. Left out of the body are image
    links, a link's rest at the start, unrendered placeholders (none of these where they begin inside code), and from a
    mark of references with records after it everything to the end. A section that is no content has no spans; `reasons`
    names the rules that judge it (see section_verdict).
    """
    own = lambda found, why: F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(why).alias("reason")))
    given, raw = F.col("__text"), F.coalesce(F.col(text), F.lit(""))
    found = sections.withColumn("__text", cleaned(F.col(text))).select(
        *sections.columns,
        "__text",
        section_verdict(F.col(heading), given, reasons).alias("__verdict"),
        P.matches(given, IMAGE, CODE).alias("__image"),
        P.matches(given, ORPHAN_IMAGE).alias("__orphan"),
        P.matches(given, PLACEHOLDER, CODE).alias("__placeholder"),
        P.matches(given, REFERENCE_MARKER, CODE).alias("__marker"),
        P.matches(given, REFERENCE_RECORD).alias("__record"),
        P.matches(given, REFERENCE_SIGN).alias("__sign"),
    )
    last_sign, last_but_one = F.get("__sign", F.size("__sign") - 1)["start"], F.get("__record", F.size("__record") - 2)["start"]
    listed = F.get(F.filter("__marker", lambda m: (last_sign >= m["end"]) & (last_but_one >= m["end"])), F.lit(0))
    rest = F.when(listed.isNotNull(), F.array(F.struct(listed["start"].alias("start"), F.length("__text").alias("end"), F.lit("embedded_bibliography").alias("reason"))))
    parts = [own(F.col("__image"), "markdown_image_asset"), own(F.col("__orphan"), "orphan_image_link_fragment"), own(F.col("__placeholder"), "unrendered_template_expression")]
    parts.append(F.coalesce(rest, F.array().cast("array<struct<start:int,end:int,reason:string>>")))
    keep = [*sections.columns, "__text", "__verdict"]
    ordered = found.select(*keep, by_start(*parts).alias("__ordered"))
    reached = ordered.select(*keep, "__ordered", P.running_max(F.transform("__ordered", lambda x: x["end"])).alias("__reach"))
    split = reached.select(*keep, "__ordered", gaps(F.col("__ordered"), F.col("__reach"), F.length("__text")).alias("__gaps"))
    body = split.select(*keep, islands(F.col("__gaps"), F.col("__ordered")).alias("__islands"), worded(given, F.col("__gaps")).alias("__spans"))
    content = F.col("__verdict.kind") == "content"
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.length("__text").alias("end"), F.col("__verdict.reason").alias("reason")))
    spans = F.when(content, F.col("__spans")).otherwise(F.array().cast(_SPANS))
    return body.select(
        *[c for c in sections.columns if c != text],
        given.alias(text),
        "__verdict.kind",
        "__verdict.reason",
        spans.alias("spans"),
        F.when(content, F.col("__islands")).otherwise(all_of_it).alias("excluded"),
        F.sha2(raw, 256).alias("original_sha256"),
        F.length(raw).alias("original_chars"),
        F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"]).alias("cleaned_chars"),
        (F.size(spans) > 0).alias("eligible"),
    )


def document_readability(sections: DataFrame, key: list[str]) -> DataFrame:
    """Per document of preprocessed sections: sections, those that are excluded, and readable_body or no_readable_body."""
    readable = F.when(F.bool_or("eligible"), "readable_body").otherwise("no_readable_body")
    return sections.groupBy(*key).agg(F.count("*").alias("sections"), F.count_if(~F.col("eligible")).alias("excluded_sections"), readable.alias("readability"))


# --- windows


def _windows(text: str, start: int, stop: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Bounds of the windows over text[start:stop], cut at the last space of their second half, without white space around."""
    while start < stop:
        end = min(stop, start + size)
        if end < stop and (space := text.rfind(" ", start + size // 2, end)) > start:
            end = space
        part = text[start:end]
        if part.strip():
            yield start + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())
        start = stop if end >= stop else max(start + 1, end - overlap)


def section_chunks(sections: DataFrame, key: list[str], text: str = "text", spans: str = "spans", size: int = 1800, overlap: int = 200) -> DataFrame:
    """key, chunk_index (from 0 in each section, over its spans), start_char, end_char, span_start, span_end, chunk, chunk_sha256.

    No chunk leaves its span; neighbours overlap by about `overlap`, at most a third of `size`. The offsets slice back to
    the chunk.
    """
    if size < 200:
        raise ValueError("a chunk has 200 characters at least")
    over = max(0, min(overlap, size // 3))
    kinds = ", ".join(f"{c} {sections.schema[c].dataType.simpleString()}" for c in key)
    names = ["chunk_index", "start_char", "end_char", "span_start", "span_end", "chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                t, found = row[-2] or "", row[-1]
                bounds = ((w, s) for s in (() if found is None else found) for w in _windows(t, s["start"], s["end"], size, over))
                rows += [(*row[:-2], k, a, b, s["start"], s["end"], t[a:b]) for k, ((a, b), s) in enumerate(bounds)]
                if len(rows) >= 1000:
                    yield pd.DataFrame(rows, columns=[*key, *names])
                    rows = []
            yield pd.DataFrame(rows, columns=[*key, *names])

    cut = sections.select(*key, text, spans).mapInPandas(run, f"{kinds}, chunk_index int, start_char int, end_char int, span_start int, span_end int, chunk string")
    return cut.withColumn("chunk_sha256", F.sha2("chunk", 256))
