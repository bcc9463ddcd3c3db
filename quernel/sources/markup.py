"""Markdown, abstract XML, tool calls and citation tags as rows and columns."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEAD = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", re.M)


def markdown_parts(text: str | None) -> list[tuple[str, str]]:
    """(heading, text) between headings in order, blank texts left out; text without a heading is one section."""
    out, heading, at = [], "", 0
    text = text or ""
    for m in _HEAD.finditer(text):
        out.append((heading, text[at : m.start()].strip()))
        heading, at = m[2], m.end()
    out.append((heading, text[at:].strip()))
    return [x for x in out if x[1]]


def abstract_parts(text: str | None) -> list[tuple[str, str]]:
    """The labelled parts of an article's abstract; a document that isn't well-formed has none.

    A part's heading is its Label, else its NlmCategory, else Abstract.
    """
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    parts = ((e.get("Label") or e.get("NlmCategory") or "Abstract", " ".join("".join(e.itertext()).split())) for e in root.iter("AbstractText"))
    return [x for x in parts if x[1]]


def sections(rows: DataFrame, key: str, text: str, parts: Callable[[str | None], list[tuple[str, str]]]) -> DataFrame:
    """key, section_index, heading and text of every document, in Arrow batches."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, k, *x) for i, t in zip(batch[key], batch[text], strict=True) for k, x in enumerate(parts(t))]
            yield pd.DataFrame(found, columns=[key, "section_index", "heading", "text"])

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, section_index int, heading string, text string")


def tool_call(text: Column) -> Column:
    """Name, attributes and body of the first tool call of a text; null without one."""
    pattern = r'(?s)<call_tool\s+name="([^"]+)"([^>]*)>(.*?)</call_tool>'
    keys, values = (F.regexp_extract_all(F.regexp_extract(text, pattern, 2), F.lit(r'([A-Za-z_]\w*)="([^"]*)"'), F.lit(g)) for g in (1, 2))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.struct(F.regexp_extract(text, pattern, 1).alias("name"), F.map_from_arrays(keys, values).alias("attributes"), F.trim(F.regexp_extract(text, pattern, 3)).alias("body")))


def citation_ids(text: Column) -> Column:
    """Ids of the <cite id="a,b"> tags in order, each once; null where tags nest, stay open or carry anything else."""
    tags = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"</?cite\b[^>]*>"), F.lit(0))
    fits = F.transform(tags, lambda x, i: F.when(i % 2 == 0, x.rlike(r'^<cite id="[^",]+(,[^",]+)*">$')).otherwise(x == "</cite>"))
    groups = F.flatten(F.transform(F.filter(tags, lambda x: x.startswith("<cite")), lambda x: F.split(F.regexp_extract(x, 'id="([^"]*)"', 1), ",")))
    return F.when((F.size(tags) % 2 == 0) & F.forall(fits, lambda x: x), F.array_distinct(F.transform(groups, lambda x: F.trim(x))))
