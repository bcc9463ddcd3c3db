"""Documents as section and chunk rows, and JSON lines in and out."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", re.S | re.I)
_HEADING = re.compile(r"h[1-6]")
_BLOCK = {"p", "div", "li", "tr", "section", "article", "br", "blockquote", "pre", "ul", "ol", "table"}


def sections_of(page: str | None) -> list[tuple[str, str]]:
    """(heading, text) in page order: text up to the next heading, white space compacted; empty texts are left out."""
    out, heading, parts, in_heading, title = [], "", [], False, []
    at = 0

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((heading, text))

    for m in _PARTS.finditer(page or ""):
        (title if in_heading else parts).append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[3] or "").lower()
        if _HEADING.fullmatch(name):
            if m[2]:
                heading, in_heading = " ".join("".join(title).split()), False
            else:
                close()
                title, in_heading = [], True
        elif name in _BLOCK:
            (title if in_heading else parts).append(" ")
    parts.append(entities.unescape((page or "")[at:]))
    close()
    return out


def html_sections(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """id, section_index, heading, text of every page's sections."""
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, h, text) for i, page in zip(batch[id_column], batch[html_column], strict=True) for k, (h, text) in enumerate(sections_of(page))]
            yield pd.DataFrame(rows, columns=[id_column, "section_index", "heading", "text"])

    return pages.select(id_column, html_column).mapInPandas(run, f"{id_column} {kind}, section_index int, heading string, text string")


def chunks(sections: DataFrame, key: list[str], text: str = "text", size: int = 1800, overlap: int = 200) -> DataFrame:
    """Windows of `size` characters that overlap by `overlap`, with offsets that slice back to the text."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    cut = sections.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("chunk_index") * step
    return cut.select(*key, "chunk_index", start.alias("start_char"), F.least(start + size, F.length(text)).alias("end_char"), F.substr(F.col(text), start + 1, F.lit(size)).alias("chunk"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a closed schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)
