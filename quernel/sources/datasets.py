"""Question sets: readers, decoding of their columns, resumable and merged outputs."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_questions(spark: SparkSession, path: str, question: str = "problem", instructions: str = "", most: int | None = None) -> DataFrame:
    """A CSV of questions with id = md5 of the question and constant instructions."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.withColumns({"id": F.md5(question), "additional_instructions": F.lit(instructions)})
    return rows.limit(most) if most is not None else rows


def decrypted(rows: DataFrame, columns: list[str], secret: str) -> DataFrame:
    """Base64 columns XORed with the repeated SHA-256 of the row's secret; null stays null."""

    @F.pandas_udf("string")
    def plain(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, word in texts:
            yield pd.Series([_xor(a, b) for a, b in zip(text, word, strict=True)], dtype=object)

    return rows.withColumns({c: plain(F.col(c), F.col(secret)) for c in columns})


def _xor(text: str | None, secret: str | None) -> str | None:
    if text is None or secret is None:
        return None
    data = np.frombuffer(base64.b64decode(text), np.uint8)
    return (data ^ np.resize(np.frombuffer(hashlib.sha256(secret.encode()).digest(), np.uint8), len(data))).tobytes().decode()


def prompt(messages: Column, names: dict[str, str]) -> Column:
    """'name: content' of every message, joined by blank lines; an empty conversation is an error."""
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    text = F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(name[m["role"]], m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n\n")
    return F.when(F.size(messages) > 0, text).otherwise(F.raise_error(F.lit("empty conversation")).cast("string"))


def answers(truth: Column) -> Column:
    """The strings of a JSON list, or the one string itself; null has none."""
    return F.when(truth.isNull(), F.array().cast("array<string>")).when(truth.startswith("["), F.from_json(truth, "array<string>")).otherwise(F.array(truth))


def set_answers(answer: Column, is_set: Column, separator: str = ",") -> Column:
    """The non-blank trimmed parts of a set, else the one answer; none if that is blank."""
    many = F.transform(F.split(F.coalesce(answer, F.lit("")), separator), lambda x: F.trim(x))
    return F.filter(F.when(is_set, many).otherwise(F.array(F.trim(F.coalesce(answer, F.lit(""))))), lambda x: x != "")


def sample_size(n: Column) -> Column:
    """A fifth of a set, at least 100 and at most 500."""
    return F.least(F.greatest(F.lit(100), F.floor(n * 0.2)), F.lit(500)).cast("int")


def last_bytes_cut(text: Column, most: int) -> Column:
    """The text's first `most` UTF-8 bytes, less a character that they would split."""
    h = F.hex(F.encode(text, "UTF-8"))
    out = F.decode(F.unhex(F.substring(h, 1, 2 * (most - 3))), "UTF-8")
    for back in (2, 1, 0):
        splits = F.substring(h, 2 * (most - back) + 1, 1).isin("8", "9", "A", "B")
        out = F.when(~splits, F.decode(F.unhex(F.substring(h, 1, 2 * (most - back))), "UTF-8")).otherwise(out)
    return F.when(F.octet_length(text) <= most, text).otherwise(out)


def append_missing(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the JSON lines at path lack: a run that broke off goes on where it was."""
    from pyspark.errors import AnalysisException

    try:
        done = rows.sparkSession.read.schema(rows.select(key).schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = None
    left = rows if done is None else rows.join(done, key, "left_anti")
    left.write.mode("append").option("ignoreNullFields", "false").json(path)


def merged_shards(spark: SparkSession, paths: list[str], schema: str, order: str) -> DataFrame:
    """All shards as one ordered table; a missing shard is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths).orderBy(F.col(order).asc_nulls_last())


def seeded_head(rows: DataFrame, key: str, seed: int, most: int, group: list[str]) -> DataFrame:
    """The first `most` rows of each group in an order that the seed fixes, whatever the partitions."""
    from pyspark.sql import Window

    order = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def write_results(questions: DataFrame, results: DataFrame, key: str, path: str) -> None:
    """Questions with their results, the original row nested, as JSON."""
    original = questions.select(key, F.struct(*questions.columns).alias("original_data"))
    original.join(results, key, "left").write.option("ignoreNullFields", "false").json(path)


def content_addressed(rows: DataFrame, key: str) -> DataFrame:
    """rows with `sha` (SHA-256 of the row without its key, as JSON) and `bucket`, its first two digits."""
    rest = F.to_json(F.struct(*[c for c in rows.columns if c != key]), {"ignoreNullFields": "false"})
    return rows.withColumn("sha", F.sha2(rest, 256)).withColumn("bucket", F.substring("sha", 1, 2))


def add_documents(rows: DataFrame, key: str, path: str) -> None:
    """Appends the documents whose content the store lacks, gzipped, in a folder per bucket; what is there stays."""
    from pyspark.errors import AnalysisException

    new = content_addressed(rows, key).dropDuplicates(["sha"])
    try:
        new = new.join(rows.sparkSession.read.json(path).select("sha"), "sha", "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION"):
            raise
    new.write.mode("append").partitionBy("bucket").option("compression", "gzip").json(path)


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store, gzipped or not."""
    return spark.read.json(path)


def append_checked(rows: DataFrame, path: str, kind: str, allowed: list[str]) -> None:
    """Appends events as JSON lines; an unknown kind fails the job before anything is committed."""
    fits = F.when(F.col(kind).isin(allowed), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null")))).cast("string"))
    rows.withColumn(kind, fits).write.mode("append").json(path)


def sessions(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Session files as one table; a session id that stands twice is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    n = rows.groupBy(key).agg(F.count("*").alias("__n")).select(F.col(key).alias("__k"), "__n")
    seen = rows.join(n, F.col(key) == F.col("__k"))
    return seen.withColumn(key, F.when(F.col("__n") == 1, F.col(key)).otherwise(F.raise_error(F.lit("repeated session")).cast(rows.schema[key].dataType))).drop("__k", "__n")
