"""Bibliographic records in XML as typed rows: one Arrow pass over the texts, one row a record."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a record's parts are, by their place in it.
SHAPE = "pmid string, title string, abstract array<struct<label:string,text:string>>, authors array<string>, year string, venue string, publication_year string, doi string, pmcid string, publication_types array<string>"
_TEXTS = {"pmid": ".//PMID", "title": ".//Article//ArticleTitle", "year": ".//Article//Journal/JournalIssue/PubDate/Year", "venue": ".//Article//Journal/Title", "publication_year": ".//Article//ArticleDate/Year"}
_TEXT, _PART = pa.string(), pa.struct([("label", pa.string()), ("text", pa.string())])
_KINDS = {"abstract": pa.list_(_PART), "authors": pa.list_(_TEXT), "publication_types": pa.list_(_TEXT)}
_FIELDS = [pa.field("place", pa.int32()), *[pa.field(n, _KINDS.get(n, _TEXT)) for n in (p.split()[0] for p in SHAPE.split(", "))], pa.field("fault", _TEXT)]
#: A task hands on its records after so many characters of texts, or so many records.
CHARS, ROWS = 4_000_000, 1000
_IDS = {"doi": "doi", "pmc": "pmcid"}

#: Designs by the words of publication types, the first that is met.
DESIGNS = [
    ("randomized controlled trial", "randomized_controlled_trial"),
    ("clinical trial", "clinical_trial"),
    ("meta-analysis", "meta_analysis"),
    ("systematic review", "systematic_review"),
    ("review", "review"),
]


def _said(node: ElementTree.Element | None) -> str | None:
    """All text in an element and its children, white space compacted; null for no element."""
    return None if node is None else " ".join("".join(node.itertext()).split())


def _record(node: ElementTree.Element) -> dict:
    out = {name: _said(node.find(path)) for name, path in _TEXTS.items()}
    dates = node.findall(".//Article//ArticleDate")
    out["publication_year"] = _said(dates[0].find("Year")) if dates else None
    out["abstract"] = [{"label": p.get("Label") or None, "text": _said(p)} for p in node.findall(".//Article//Abstract/AbstractText")]
    names = [(_said(a.find("LastName")), _said(a.find("ForeName"))) for a in node.findall(".//Article//Author")]
    out["authors"] = [f"{last}, {fore}" for last, fore in names if last is not None and fore is not None]
    out["publication_types"] = [t for t in map(_said, node.findall(".//Article//PublicationTypeList/PublicationType")) if t]
    for given in node.findall(".//PubmedData/ArticleIdList/ArticleId"):
        if (name := _IDS.get(given.get("IdType", ""))) is not None:
            out[name] = _said(given)
    return out


def _found(text: str | None) -> list[dict]:
    """A text's records with their places, or its fault."""
    try:
        root = ElementTree.fromstring(text) if text is not None else None
    except ElementTree.ParseError:
        return [{"place": 0, "fault": "malformed"}]
    return [] if root is None else [{"place": k} | _record(a) for k, a in enumerate(root.iter("PubmedArticle"))]


def shredded(rows: DataFrame, key: list[str], xml: str = "xml") -> DataFrame:
    """key, place (from 0 in a text), the parts of SHAPE, and fault: a row a PubmedArticle, in order.

    A text that isn't well-formed gives one row with the fault `malformed` and nothing else of it; one without a record, or
    null, gives none. Parts that are missing are null, or empty arrays; of repeated ids the last counts, of other repeated
    parts the first; authors need both names; a record that stands twice gives two rows.
    """
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*[batch.schema.field(c) for c in key], *_FIELDS])
            given, texts = [batch.column(c) for c in key], batch.column(xml)
            out, chars = [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                own = {c: values[i].as_py() for c, values in zip(key, given, strict=True)}
                out += [own | found for found in _found(text)]
                chars += len(text or "")
                if chars >= CHARS or len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, chars = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select(*key, xml).mapInArrow(run, f"{kinds}, place int, {SHAPE}, fault string")


def design(types: Column) -> Column:
    """The study design that publication types name, the strongest first; unspecified if none does."""
    said = F.lower(F.array_join(types, " "))
    out = None
    for words, name in DESIGNS:
        out = F.when(F.contains(said, F.lit(words)), name) if out is None else out.when(F.contains(said, F.lit(words)), name)
    return out.otherwise("unspecified")


def labelled(abstract: Column) -> Column:
    """An abstract's parts, a line each, after a line with its label if it has one."""
    return F.array_join(F.transform(abstract, lambda p: F.concat_ws("\n", p["label"], p["text"])), "\n")


def article_rows(records: DataFrame, key: list[str]) -> DataFrame:
    """Shredded records as flat rows with source-qualified ids; those at fault are left out (see shredded for them)."""
    text = labelled(F.col("abstract"))
    return records.filter("fault is null").select(
        *key, "place", F.concat(F.lit("PMID:"), "pmid").alias("source_id"), "pmid", F.coalesce("title", F.lit("")).alias("title"), text.alias("abstract"), "authors", "year", "venue", "doi", "pmcid",
        (F.trim(text) != "").alias("abstract_available"), F.when(F.col("pmcid").isNotNull(), "pmc").otherwise("unknown").alias("full_text_hint"), design(F.col("publication_types")).alias("study_design"), "publication_types", F.col("publication_year").alias("publication_date"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, and the records of every XML file there, one file a text."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))
    return shredded(files, ["path"])
