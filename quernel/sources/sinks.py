"""Outputs that are there in whole or not at all, failures on record, and files by digest."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def contained(root: str, relative: str) -> str:
    """root/relative; an error if that is root itself, absolute, or leaves root by its parts."""
    if not isinstance(relative, str) or not relative.strip("/.") or relative.startswith("/") or "://" in relative or "\\" in relative or "\0" in relative:
        raise ValueError("a path within the root is needed")
    inner = posixpath.normpath(relative)
    if inner == "." or inner.split("/")[0] == "..":
        raise ValueError("the path leaves its root")
    return f"{root.rstrip('/')}/{inner}"


def _files(spark: SparkSession, path: str):
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(sc._jsc.hadoopConfiguration()), lambda p: sc._jvm.org.apache.hadoop.fs.Path(p)


def replace_whole(df: DataFrame, path: str, format: str = "parquet", **options: str) -> None:
    """Writes df to path in place of what is there: readers see the old table or the new one, never a part.

    The table is written beside path first; a job that fails or is killed leaves path as it was, and at most a folder named
    .writing-* that the next call for path removes. The rename is one operation of the file system; where the old table is
    in the way it steps aside just before, and comes back if the rename fails.
    """
    spark, (parent, name) = df.sparkSession, posixpath.split(path.rstrip("/"))
    fs, at = _files(spark, path)
    for left in fs.globStatus(at(f"{parent}/.writing-{name}-*")) or ():
        fs.delete(left.getPath(), True)
    tag = uuid.uuid4().hex
    staged, aside = f"{parent}/.writing-{name}-{tag}", f"{parent}/.replaced-{name}-{tag}"
    try:
        df.write.format(format).options(**options).save(staged)
        if not fs.exists(at(f"{staged}/_SUCCESS")):
            raise OSError(f"{staged} is not complete")
        old = fs.exists(at(path))
        if old and not fs.rename(at(path), at(aside)):
            raise OSError(f"{path} can't be moved")
        if not fs.rename(at(staged), at(path)):
            if old:
                fs.rename(at(aside), at(path))
            raise OSError(f"{staged} can't be moved")
        if old:
            fs.delete(at(aside), True)
    finally:
        fs.delete(at(staged), True)


#: What a record of a failure holds: the query by digest only, no traceback, no credentials.
FAILURE = ["tool_name", "source_id", "focused_query_sha256", "error_code", "error_type", "attempts"]


def failures(rows: DataFrame, query: str = "focused_query") -> DataFrame:
    """Failures (tool_name, source_id, query, error_code, error_type, attempts) with their `manifest_sha256`, each once."""
    shown = rows.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("tool_name", "source_id")],
        F.sha2(F.coalesce(F.col(query), F.lit("")), 256).alias("focused_query_sha256"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("error_code", "error_type")],
        F.coalesce(F.col("attempts").cast("int"), F.lit(0)).alias("attempts"),
    )
    return shown.withColumn("manifest_sha256", F.sha2(F.to_json(F.struct(*FAILURE)), 256)).dropDuplicates(["manifest_sha256"])


def record_failures(rows: DataFrame, path: str, query: str = "focused_query") -> None:
    """Appends to the manifest at path the failures that it lacks, in folders by the digest's first two digits."""
    spark, found = rows.sparkSession, failures(rows, query)
    fs, at = _files(spark, path)
    if fs.exists(at(path)):
        known = spark.read.schema("manifest_sha256 string").json(path)
        found = found.join(known, "manifest_sha256", "left_anti")
    found.withColumn("bucket", F.left("manifest_sha256", F.lit(2))).write.mode("append").partitionBy("bucket").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file below path, none read by the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
