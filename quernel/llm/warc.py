"""Merkle fixity audit of WARC archives.

Pages become WARC records, dealt to archives of RECORDS consecutive page ids. A record's place in its archive is its
slot (page_id modulo RECORDS), so a record that is lost, added or of another length moves no other record's place. A leaf
is the SHA-256 of a record's size, number of equal copies and SHA-256; a node is the SHA-256 of the sizes and digests of
its children in order, so it vouches for an ordered range of bytes; the levels are slots, FANOUT slots, the archive.
A slot of very many records (repeated page ids) gets further levels by leading digits of the records' digests, as many
as keep a node near FULL children in either replica.

Two replicas are compared root by root; only below a root that differs are the next level's nodes compared, and so on,
until the records that differ are located. Untouched branches are never descended into. A node's offset is its parent's
plus the sizes of the siblings before it, so offsets are worked out on the way down, for mismatching branches only.

`read_warc` reads archive files (found by Content-Length, so a payload may hold anything) and `write_warc` writes them
through Spark's own writer, so any file system that Spark knows serves.

Defined cases: a null url or html counts as empty; pages without an id go to archives of their own, by a hash of their
content; a changed record is located as one that only the first replica holds and one that only the second holds;
equal copies of a record are one leaf with their number; an empty table has no archives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

RECORDS = 256
FANOUT = 16
#: Records of one slot that are children of one node; beyond, digits of their digests make levels between.
FULL = 256
DATE = "1970-01-01T00:00:00Z"
KEY = ["archive", "part", "path"]


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of one WARC record, its closing empty lines included."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """archive, part (the slot), path (the record's SHA-256), page_id, n (equal copies), size (of all), digest."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    lost = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 40))
    archive = F.coalesce(F.floor(F.col("page_id") / RECORDS).cast("long"), lost)
    slot = F.coalesce(F.pmod(F.col("page_id"), F.lit(RECORDS)), F.lit(0)).cast("int")
    rows = pages.select("page_id", archive.alias("archive"), slot.alias("part"), F.sha2(text, 256).alias("path"), F.octet_length(text).cast("long").alias("size"))
    found = rows.groupBy(*KEY).agg(F.first("page_id").alias("page_id"), F.count("*").alias("n"), F.sum("size").alias("size"))
    return found.withColumn("digest", F.sha2(F.concat_ws(":", F.col("size").cast("string"), F.col("n").cast("string"), F.col("path")), 256))


def _up(level: int, deep: int) -> tuple[Column, Column]:
    """Part and path of the parent of a node of this level: records, digits of digests, slots, FANOUT slots, archive."""
    part, path = F.col("part"), F.lit("")
    if level < deep:
        path = F.substring("path", 1, deep - level)
    elif level == deep + 1:
        part = F.floor(part / FANOUT).cast("int")
    elif level > deep + 1:
        part = F.lit(0)
    return part, path


def tree(leaf: DataFrame, deep: int = 0) -> list[DataFrame]:
    """The levels (archive, part, path, size, digest) from the leaves to the roots."""
    levels = [leaf.select(*KEY, "size", "digest")]
    for level in range(deep + 3):
        part, path = _up(level, deep)
        child = levels[-1].select("archive", part.alias("up"), path.alias("way"), F.struct("part", "path", "size", "digest").alias("c"))
        told = F.transform(F.array_sort(F.collect_list("c")), lambda c: F.concat(c["size"].cast("string"), F.lit(":"), c["digest"], F.lit(";")))
        up = child.groupBy("archive", "up", "way").agg(F.sum("c.size").alias("size"), F.sha2(F.array_join(told, ""), 256).alias("digest"))
        levels.append(C.cut(up.select("archive", F.col("up").alias("part"), F.col("way").alias("path"), "size", "digest")))
    return levels


def _deep(*leaf: DataFrame) -> int:
    """How many levels of digits the fullest slot of the replicas needs."""
    most = max(x.groupBy("archive", "part").count().agg(F.max("count")).first()[0] or 0 for x in leaf)
    return max(0, math.ceil(math.log(max(most, 1) / FULL, FANOUT)))


def audit(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves() of two replicas. The roots (archive, root, replica_root) and the located records.

    A located record: archive, slot, sha, at and replica_at, of which one is null if only one replica holds it.
    """
    deep = _deep(first, second)
    one, two = tree(first, deep), tree(second, deep)
    roots = one[-1].select("archive", F.col("digest").alias("root")).join(two[-1].select("archive", F.col("digest").alias("replica_root")), "archive", "full")
    bad = None
    for level in range(len(one) - 1, -1, -1):
        sides = []
        for nodes, own, at in ((one[level], "left", "at"), (two[level], "right", "replica_at")):
            if bad is None:
                placed = nodes.withColumn(at, F.lit(0).cast("long"))
            else:
                part, path = _up(level, deep)
                start = bad.select(F.col("archive").alias("a"), F.col("part").alias("p"), F.col("path").alias("w"), F.coalesce(at, F.lit(0)).alias("start"))
                below = nodes.join(start, (F.col("archive") == F.col("a")) & (part == F.col("p")) & (path == F.col("w")))
                siblings = Window.partitionBy("a", "p", "w").orderBy("part", "path").rowsBetween(Window.unboundedPreceding, -1)
                placed = below.withColumn(at, F.col("start") + F.coalesce(F.sum("size").over(siblings), F.lit(0)))
            sides.append(placed.select(*KEY, F.col("digest").alias(own), at))
        bad = sides[0].join(sides[1], KEY, "full").filter(~F.col("left").eqNullSafe(F.col("right"))).select(*KEY, "at", "replica_at")
    return roots, bad.select("archive", F.col("part").alias("slot"), F.col("path").alias("sha"), "at", "replica_at")


def write_warc(pages: DataFrame, path: str) -> None:
    """One uncompressed archive file per partition."""
    body = record(F.col("page_id"), F.col("url"), F.col("html"))
    pages.select(F.substring_index(body, "\r\n\r\n", -1).alias("rest"), body.alias("value")).select(F.expr("substr(value, 1, length(value) - 4)").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def parse(content: bytes) -> Iterator[tuple[int, int, str | None, str]]:
    """at, size, target and payload of each record of an archive file."""
    at = 0
    while at < len(content):
        head_end = content.find(b"\r\n\r\n", at)
        if head_end < 0:
            return
        head = dict(line.split(b": ", 1) for line in content[at:head_end].split(b"\r\n")[1:] if b": " in line)
        n = int(head.get(b"Content-Length", b"0"))
        end = head_end + 4 + n
        yield at, end + 4 - at, head.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), content[head_end + 4 : end].decode("utf-8", "replace")
        at = end + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, at, size, url, html of the records of archive files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = list(parse(content))
                columns = [list(c) for c in zip(*found, strict=True)] or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["path", "at", "size", "url", "html"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, at long, size long, url string, html string")


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica for the audit to find fault with: records changed in place, longer, shorter, lost and added."""
    kind = F.col("page_id") % 97
    changed = (
        F.when((kind == 13) & (F.length("html") > 0), F.concat(F.expr("substr(html, 1, length(html) - 1)"), F.lit("#")))
        .when(kind == 40, F.concat(F.coalesce("html", F.lit("")), F.lit("more")))
        .when((kind == 66) & (F.length("html") > 3), F.expr("substr(html, 1, length(html) - 3)"))
        .otherwise(F.col("html"))
    )
    there = pages.filter(F.coalesce(kind != 81, F.lit(True))).withColumn("html", changed)
    return there.union(pages.filter(kind == 7).withColumn("html", F.lit("added")))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per archive its size, both roots and the pages whose records differ between the table and a damaged replica."""
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    first, second = C.cut(leaves(pages)), C.cut(leaves(damaged(pages)))
    roots, bad = audit(first, second)
    slots = bad.select("archive", (F.col("archive") * RECORDS + F.col("slot")).alias("page_id")).distinct()
    located = slots.groupBy("archive").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("pages"))
    sizes = first.groupBy("archive").agg(F.sum("n").alias("n_records"), F.sum("size").alias("n_bytes"))
    out = sizes.join(roots, "archive").join(located, "archive", "left")
    return out.select("archive", "n_records", "n_bytes", "root", "replica_root", F.coalesce("n", F.lit(0)).cast("long").alias("n_bad"), F.coalesce("pages", F.lit("")).alias("bad_pages"))


def _tree_sql(source: str, name: str) -> str:
    return f"""
{name}_text AS (SELECT page_id // {RECORDS} AS archive, page_id % {RECORDS} AS slot, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10)
  || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(body, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(body, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM ({source})),
{name}_leaf AS (SELECT archive, slot, sha256(rec) AS sha, count(*) AS n, CAST(sum(strlen(rec)) AS BIGINT) AS size FROM {name}_text GROUP BY ALL),
{name}_digest AS (SELECT *, sha256(size || ':' || n || ':' || sha) AS digest FROM {name}_leaf),
{name}_1 AS (SELECT archive, slot, CAST(sum(size) AS BIGINT) AS size, sha256(string_agg(size || ':' || digest || ';', '' ORDER BY sha)) AS digest FROM {name}_digest GROUP BY ALL),
{name}_2 AS (SELECT archive, slot // {FANOUT} AS part, CAST(sum(size) AS BIGINT) AS size, sha256(string_agg(size || ':' || digest || ';', '' ORDER BY slot)) AS digest FROM {name}_1 GROUP BY ALL),
{name}_root AS (SELECT archive, sha256(string_agg(size || ':' || digest || ';', '' ORDER BY part)) AS root FROM {name}_2 GROUP BY archive)"""


_DAMAGED = """SELECT page_id, url, CASE WHEN page_id % 97 = 13 AND length(html) > 0 THEN html[:-2] || '#' WHEN page_id % 97 = 40 THEN coalesce(html, '') || 'more'
  WHEN page_id % 97 = 66 AND length(html) > 3 THEN html[:-4] ELSE html END AS body FROM pages WHERE page_id % 97 <> 81
  UNION ALL SELECT page_id, url, 'added' FROM pages WHERE page_id % 97 = 7"""

OP2_SQL = f"""
WITH {_tree_sql("SELECT page_id, url, html AS body FROM pages", "a")}, {_tree_sql(_DAMAGED, "b")},
slots AS (SELECT DISTINCT archive, archive * {RECORDS} + slot AS page_id FROM a_digest a FULL JOIN b_digest b USING (archive, slot, sha) WHERE a.digest IS DISTINCT FROM b.digest),
bad AS (SELECT archive, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS pages FROM slots GROUP BY archive)
SELECT l.archive, CAST(sum(l.n) AS BIGINT) AS n_records, CAST(sum(l.size) AS BIGINT) AS n_bytes, a.root, b.root AS replica_root,
  coalesce(any_value(bad.n), 0) AS n_bad, coalesce(any_value(bad.pages), '') AS bad_pages
FROM a_digest l JOIN a_root a USING (archive) JOIN b_root b USING (archive) LEFT JOIN bad USING (archive)
GROUP BY l.archive, a.root, b.root
"""
