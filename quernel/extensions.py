"""What callers can add by name: data sets, searchers, parsers, rankers, operators, validators and model transports.

A name that isn't registered, or is registered twice, is an error. Everything works on DataFrames or columns, so Catalyst
plans an added part like a built-in one; `model_column` is for parts that need Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import scoring
from .sources import documents, markup


class Registry(dict):
    """Parts of one kind by name."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        self.kind = kind

    def __missing__(self, name: str):
        raise KeyError(f"no {self.kind} named {name}; there are {', '.join(sorted(self)) or 'none'}")

    def add(self, name: str):
        def put(part):
            if name in self:
                raise ValueError(f"{self.kind} {name} is registered already")
            self[name] = part
            return part

        return put


Transform = Callable[[DataFrame], DataFrame]
DATASETS, SEARCHERS, PARSERS, RANKERS, OPERATORS = (Registry(k) for k in ("data set", "searcher", "parser", "ranker", "operator"))


@DATASETS.add("short_answers")
def _short_answers(rows: DataFrame) -> DataFrame:
    return rows.select(F.md5("text").alias("id"), F.col("text").alias("problem"), F.lit("Answer in short.").alias("additional_instructions"))


@SEARCHERS.add("lexical")
def lexical(chunks: DataFrame, terms: list[str], group: str, key: str, k: int) -> DataFrame:
    scored = scoring.bm25(chunks, terms, group, "text", "score").select(group, key, "score")
    return scoring.top_per_group(scored, [group], [F.col("score").desc(), F.col(key)], k)


PARSERS.add("markdown")(markup.markdown_parts)
PARSERS.add("abstract")(markup.abstract_parts)
PARSERS.add("html")(documents.sections_of)


@RANKERS.add("longest")
def longest(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    return scoring.top_per_group(rows, group, [F.col("n_chars").desc(), F.col("doc_id")], k, "place")


@OPERATORS.add("only")
def only(options: dict) -> Transform:
    return lambda df: df.filter(F.col(options["column"]) == options["value"])


@OPERATORS.add("letters")
def letters(options: dict) -> Transform:
    return lambda df: df.withColumn(options["into"], F.length(F.regexp_replace(F.coalesce(options["column"], F.lit("")), "[^a-z]+", "")).cast("long"))


def chain(*steps: Transform) -> Transform:
    """Operators one after another, as one operator; Catalyst plans them together."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def fallback(key: list[str], *parts: DataFrame) -> DataFrame:
    """For each key the row of the first part that has it, with `part`, the place of that part: a chain of sources."""
    every = None
    for k, part in enumerate(parts):
        own = part.withColumn("part", F.lit(k))
        every = own if every is None else every.unionByName(own)
    first = Window.partitionBy(*key).orderBy("part")
    return every.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def verdict(validator: Callable[[dict[str, Column]], Column]) -> Callable[[dict[str, Column]], Column]:
    """A caller's validator as a column: 'true' accepts, 'false' and null give the standard reason, all else is the reason."""

    def run(row: dict[str, Column]) -> Column:
        said = validator(row)
        return F.when(said == "true", "accepted").when(said.isNull() | (said == "false"), "unsupported").otherwise(said)

    return run


def model_column(load: Callable[[], Callable[[list], list]], kind: str, batch: int = 16):
    """A column function of a caller's model, such as an encoder or a reranker: loaded once a worker, called in batches."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            values = part.tolist()
            yield pd.Series([x for a in range(0, len(values), batch) for x in model(values[a : a + batch])], dtype=object)

    return run


def cached_model(rows: DataFrame, cache: DataFrame, key: Column, column: Callable[[Column], Column], source: str, into: str) -> DataFrame:
    """rows with a model's value from the cache (key, value), and from the model only where the cache has none."""
    keyed = rows.withColumn("__key", key)
    known = keyed.join(cache.select(F.col("key").alias("__key"), F.col("value").alias("__value")), "__key", "left")
    met = known.filter(F.col("__value").isNotNull()).withColumn(into, F.col("__value"))
    new = known.filter(F.col("__value").isNull()).withColumn(into, column(F.col(source)))
    return met.unionByName(new).drop("__key", "__value")
