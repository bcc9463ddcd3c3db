"""Articles in XML, the format of a text, kinds of sections, actions, terminal JSON, and quotes located in their source."""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markup

#: Abstracts by type, the plain one first; a teaser stands only where there is no other.
ABSTRACTS = ["", "key-points", "other", "teaser"]


def _flat(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def article_parts(text: str | None) -> list[tuple[str, str]]:
    """(heading, text) of a full-text article: its abstracts, then every section's own paragraphs; equal texts once.

    An article without sections gives its body as one part; entities and documents that aren't well-formed give none.
    """
    text = text or ""
    if "<!ENTITY" in text:
        return []
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", text))
    except ET.ParseError:
        return []
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    place = {name: k for k, name in enumerate(ABSTRACTS)}
    abstracts = sorted(root.iter("abstract"), key=lambda e: place.get(e.get("abstract-type", ""), place["other"]))
    kept = [e for e in abstracts if e.get("abstract-type") != "teaser"] or abstracts
    parts = [("Abstract", _flat(e)) for e in kept]
    body = root.find(".//body")
    found = [] if body is None else list(body.iter("sec"))
    for sec in found:
        title = sec.find("title")
        parts.append(("" if title is None else _flat(title), " ".join(filter(None, (_flat(p) for p in sec.findall("p"))))))
    if body is not None and not any(x for _, x in parts[len(kept) :]):
        parts.append(("Body", _flat(body)))
    out, met = [], set()
    for heading, own in parts:
        if own and own not in met:
            met.add(own)
            out.append((heading, own))
    return out


def format_of(text: Column) -> Column:
    """article, abstract, html, markdown or plain, by a text's first 200 characters."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 200))
    return (
        F.when(head.rlike("<article[\\s>]|<pmc-articleset"), "article").when(head.rlike("<pubmedarticle|<abstracttext"), "abstract")
        .when(head.rlike("<!doctype html|<html|<body|<div[\\s>]|<p[\\s>]"), "html").when(head.rlike("(?m)^#{1,6}[ \\t]"), "markdown").otherwise("plain")
    )


def parsed(rows: DataFrame, key: str, text: str, parsers: dict) -> DataFrame:
    """key, format, section_index, heading, text: every document by the parser of its format; plain ones are one section."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for i, form, raw in zip(batch[key], batch["format"], batch[text], strict=True):
                parts = parsers[form](raw) if form in parsers else [("", (raw or "").strip())]
                found += [(i, form, k, *x) for k, x in enumerate(parts) if x[1]]
            yield pd.DataFrame(found, columns=[key, "format", "section_index", "heading", "text"])

    named = rows.select(key, format_of(F.col(text)).alias("format"), text)
    return named.mapInPandas(run, f"{key} {kind}, format string, section_index int, heading string, text string")


def section_kind(heading: Column, text: Column, rules: dict[str, str], long: int = 180) -> Column:
    """A struct (kind, reason): bibliography under its heading, prose of `long` characters and two sentences stays whatever
    its topic, then controls and short lists under a template heading.

    rules: patterns named bibliography, record, legal, template, controls.
    """
    n_sentences = F.regexp_count(text, F.lit("[.!?](\\s|$)"))
    prose = (F.length(text) >= long) & (n_sentences >= 2)
    template = heading.rlike(rules["template"])
    reason = (
        F.when(heading.rlike(rules["bibliography"]) & text.rlike(rules["record"]), "records")
        .when((F.regexp_count(text, F.lit(rules["legal"])) >= 2) & (template | ~prose), "legal").when(prose, "prose")
        .when(F.regexp_count(text, F.lit(rules["controls"])) >= 2, "controls")
        .when(template & (n_sentences == 0) & (F.size(F.split(text, " ")) >= 3), "list").otherwise("unsure")
    )
    kind = F.when(reason == "records", "bibliography").when(reason.isin("legal", "controls", "list"), "boilerplate").otherwise("content")
    return F.struct(kind.alias("kind"), reason.alias("reason"))


def action(text: Column) -> Column:
    """A struct (tool, arguments as JSON) of an action that is a JSON object with exactly tool and arguments, or one call tag."""
    flat = F.trim(text)
    # null under a closed set of keys unless they are exactly these
    own = F.array_sort(F.json_object_keys(flat)) == F.array(F.lit("arguments"), F.lit("tool"))
    of_json = F.struct(F.get_json_object(flat, "$.tool").alias("tool"), F.get_json_object(flat, "$.arguments").alias("arguments"))
    call = markup.tool_call(flat)
    whole = flat.rlike(r'(?s)^<call_tool\s+name="[^"]+"[^>]*>(?:(?!<call_tool).)*</call_tool>$')
    of_tag = F.struct(call["name"].alias("tool"), F.to_json(F.map_concat(call["attributes"], F.create_map(F.lit("query"), call["body"]))).alias("arguments"))
    return F.when(F.coalesce(own, F.lit(False)), of_json).when(whole, of_tag)


def _ends_with_json(text: str | None) -> str | None:
    raw = re.sub(r"\s*```\s*$", "", (text or "").rstrip()).rstrip()
    if not raw.endswith("}"):
        return None
    for m in re.finditer(r"\{", raw):
        try:
            got, end = json.JSONDecoder().raw_decode(raw, m.start())
        except ValueError:
            continue
        if end == len(raw) and isinstance(got, dict):
            return raw[m.start() :]
    return None


def terminal_json(text: Column) -> Column:
    """The JSON object that ends a text, a closing fence aside; null without one."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([_ends_with_json(x) for x in t], dtype=object)

    return run(text)


def _is_strict(text: str | None) -> bool:
    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def no(name: str) -> None:
        raise ValueError(name)

    try:
        json.loads(text or "", object_pairs_hook=once, parse_constant=no)
    except ValueError:
        return False
    return True


def strict_json(text: Column) -> Column:
    """Whether a text is JSON without repeated keys, NaN or infinities."""

    @F.pandas_udf("boolean")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([_is_strict(x) for x in t])

    return run(text)


def located(source: str | None, quote: str | None) -> str | None:
    """The exact stretch of source that the quote stands for, but for quotes, dashes, case and white space."""
    fold = str.maketrans("‘’“”–—−", "''\"\"---")

    def plain(text: str) -> tuple[str, list[int]]:
        out, at, gap = [], [], False
        for k, c in enumerate(text):
            if c.isspace():
                gap = bool(out)
                continue
            for x in c.translate(fold).lower():
                if gap:
                    out.append(" ")
                    at.append(k)
                    gap = False
                out.append(x)
                at.append(k)
        return "".join(out), at

    (whole, at), (part, _) = plain(source or ""), plain(quote or "")
    k = whole.find(part) if part else -1
    return None if k < 0 else (source or "")[at[k] : at[k + len(part) - 1] + 1]


def exact_quote(source: Column, quote: Column) -> Column:
    """located() of two columns."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, quotes in parts:
            yield pd.Series([located(a, b) for a, b in zip(sources, quotes, strict=True)], dtype=object)

    return run(source, quote)


_NODE = re.compile(r"<(aside|div|section|ul)\b([^>]*)>", re.I)


def without_templates(page: str | None, hints: str = r"share|related|promo|footer|nav", most: int = 1400, density: float = 0.65) -> tuple[str, list[tuple[str, str]]]:
    """A page without template nodes, and (element, reason) of each: a hint in its attributes, few characters, mostly links, no prose."""
    page, dropped, at = page or "", [], 0
    while m := _NODE.search(page, at):
        depth, end = 1, len(page)
        for t in re.finditer(rf"<(/?){m[1]}\b[^>]*>", page[m.end() :], re.I):
            depth += -1 if t[1] else 1
            if not depth:
                end = m.end() + t.end()
                break
        inner = page[m.end() : end]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        links = sum(len(" ".join(re.sub(r"<[^>]*>", " ", x).split())) for x in re.findall(r"(?is)<a\b[^>]*>(.*?)</a>", inner))
        prose = len(text) >= 180 and len(re.findall(r"[.!?](?:\s|$)", text)) >= 2
        if re.search(hints, m[2], re.I) and len(text) <= most and not prose and links >= density * max(1, len(text)):
            dropped.append((m[1].lower(), "links"))
            page, at = page[: m.start()] + page[end:], m.start()
        else:
            at = m.end()
    return page, dropped


def answer_paragraphs(answer: Column) -> Column:
    """array<struct<place, ids>>: the paragraphs of an answer (cut at blank lines) with the distinct ids that each cites, in order."""
    parts = F.filter(F.split(answer, "\\n[ \\t]*\\n"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p, i: F.struct(i.alias("place"), F.coalesce(markup.citation_ids(p), F.array().cast("array<string>")).alias("ids")))
