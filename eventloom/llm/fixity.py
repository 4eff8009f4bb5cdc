"""Merkle fixity audit of WARC files.

Pages become WARC response records in files of ``records_per_file`` consecutive ids. Each
record's bytes are hashed; a leaf binds the hash to its ordered offset range (offset and
length), and nodes bind ``fanout`` children with the range they span, up to one root a file.
Two replicas are compared at their roots first; only children of differing nodes are looked
at on each following level, down to the records that are damaged, missing or added.

Everything is DataFrame functions. Offsets are summed by range partitions, so that a file that
nothing bounds (repeated ids, or none) is no task's alone; equal ids share a file and are ordered
by content.

Defined results: null url or html are empty strings; an empty table has no files and audits
as no rows; repeated rows are records of their own; a record found in one replica only is
reported as missing or added; columns other than page_id, url and html are unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import Scratch

CRLF = "\r\n"


def _record(url: Column, html: Column) -> Column:
    """The record as text: WARC header, HTTP block, two line ends."""
    body = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF), html)
    head = F.concat(F.lit("WARC/1.1" + CRLF + "WARC-Type: response" + CRLF + "WARC-Target-URI: "), url, F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(head, body, F.lit(CRLF + CRLF))


def _in_order(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Records with pos and offset in their file, however many rows share a file or an id.

    Rows are range-partitioned by file, id and hash, equal ones spread by a number of their own;
    each partition is numbered by itself, and starts where the records of the file before it end.
    """
    key = ["file_id", "page_id", "record_sha256"]
    dealt = records.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*key, "_tie").withColumn("_part", F.spark_partition_id())
    rows = scratch.save(dealt, "rows")
    own = Window.partitionBy("file_id", "_part").orderBy(*key[1:], "_tie")
    held = rows.groupBy("file_id", "_part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    earlier = Window.partitionBy("file_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = held.select(F.col("file_id").alias("_file"), F.col("_part").alias("_own"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_bytes"))
    numbered = rows.withColumns({"pos": F.row_number().over(own) - 1, "offset": F.coalesce(F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    out = numbered.join(base, (F.col("file_id") == F.col("_file")) & (F.col("_part") == F.col("_own")))
    return out.withColumns({"pos": (F.col("pos") + F.col("_n")).cast("long"), "offset": (F.col("offset") + F.col("_bytes")).cast("long")}).drop("_tie", "_part", "_file", "_own", "_n", "_bytes")


def leaves(pages: DataFrame, records_per_file: int = 1000) -> DataFrame:
    """(file_id, pos, page_id, offset, length, record_sha256, node): the leaves of each file's tree, in order."""
    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    rec = pages.select(F.col("page_id").cast("long").alias("page_id"), _record(url, html).alias("rec"))
    small = rec.select("page_id", F.octet_length("rec").cast("long").alias("length"), F.sha2(F.col("rec").cast("binary"), 256).alias("record_sha256"), F.coalesce(F.floor(F.col("page_id") / records_per_file), F.lit(-1)).cast("long").alias("file_id"))
    placed = _in_order(small, Scratch(pages.sparkSession, "fixity-leaves"))
    node = F.sha2(F.concat_ws("|", F.lit("leaf"), "offset", "length", "record_sha256").cast("binary"), 256)
    return placed.withColumn("node", node).select("file_id", "pos", "page_id", "offset", "length", "record_sha256", "node")


def _parents(level: DataFrame, fanout: int) -> DataFrame:
    """One level up: children in order, bound to the byte range they span."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"])
    return level.groupBy("file_id", F.floor(F.col("pos") / fanout).cast("long").alias("pos")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_join(kids, "").alias("kids")).select("file_id", "pos", "start", "stop", F.sha2(F.concat_ws("|", F.lit("node"), "start", "stop", "kids").cast("binary"), 256).alias("node"))


def trees(leaf: DataFrame, depth: int, fanout: int = 10, scratch: Scratch | None = None, label: str = "tree") -> list[DataFrame]:
    """The levels of all files' trees, leaves first, each written once; the last holds one root a file."""
    scratch = scratch or Scratch(leaf.sparkSession, "fixity")
    levels = [leaf.select("file_id", "pos", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), "node")]
    for _ in range(depth):
        levels.append(scratch.save(_parents(levels[-1], fanout), f"{label}{len(levels)}"))
    return levels


def _depth(leaf: DataFrame, records_per_file: int, fanout: int) -> int:
    """Levels above the leaves: for a full file, or for the longest where ids repeat."""
    most, depth = max(records_per_file, (leaf.agg(F.max("pos").alias("m")).first()["m"] or 0) + 1), 1
    while fanout**depth < most:
        depth += 1
    return depth


def audit(original: DataFrame, replica: DataFrame, records_per_file: int = 1000, fanout: int = 10, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bad, roots, leaf): leaf positions that differ as (file_id, pos, fault: damaged, moved, missing or added), roots of the original's files, and its leaves."""
    scratch = scratch or Scratch(original.sparkSession, "fixity")
    a = scratch.save(leaves(original, records_per_file), "a")
    b = scratch.save(leaves(replica, records_per_file), "b")
    depth = max(_depth(a, records_per_file, fanout), _depth(b, records_per_file, fanout))
    up_a, up_b = trees(a, depth, fanout, scratch, "a"), trees(b, depth, fanout, scratch, "b")
    suspects = None
    for level in range(depth, -1, -1):
        here, there = up_a[level].select("file_id", "pos", F.col("node").alias("x")), up_b[level].select("file_id", "pos", F.col("node").alias("y"))
        if suspects is not None:
            here, there = (t.join(suspects, (t["file_id"] == suspects["s_file"]) & (F.floor(t["pos"] / fanout) == suspects["s_pos"]), "left_semi") for t in (here, there))
        differ = here.join(there, ["file_id", "pos"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
        differ = scratch.save(differ, f"differ{level}")
        suspects = differ.select(F.col("file_id").alias("s_file"), F.col("pos").cast("long").alias("s_pos"))
    own = [t.select("file_id", "pos", F.col("record_sha256").alias(n)) for t, n in ((a, "r_a"), (b, "r_b"))]
    differ = differ.join(own[0], ["file_id", "pos"], "left").join(own[1], ["file_id", "pos"], "left")
    fault = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "added").when(F.col("r_a") == F.col("r_b"), "moved").otherwise("damaged")
    return differ.select("file_id", "pos", fault.alias("fault")), up_a[depth].select("file_id", F.col("node").alias("root")), a


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A replica in which the first character of some records' html is overwritten, chosen by the hash of their id (a fixture for audits)."""
    hit = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2) < "05"
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", F.when(hit & (F.length(html) > 0), F.concat(F.lit("\u0001"), F.substring(html, 2, 1 << 30))).otherwise(html).alias("html"))


def fixity_report(pages: DataFrame, replica: DataFrame, records_per_file: int = 1000, fanout: int = 10) -> DataFrame:
    """Each record of the original: its place, its hash, its file's root and what the audit found."""
    bad, roots, leaf = audit(pages, replica, records_per_file, fanout)
    rows = leaf.drop("node").join(bad, ["file_id", "pos"], "left").join(roots, "file_id")
    return rows.select("page_id", "file_id", "pos", "offset", "length", "record_sha256", "root", F.coalesce("fault", F.lit("ok")).alias("status"))


ORACLE = r"""
WITH src AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    substring(md5(CAST(page_id AS VARCHAR)), 1, 2) < '05' AND length(coalesce(html, '')) > 0 AS bad,
    chr(13) || chr(10) AS nl
  FROM pages
), rec AS (
  SELECT page_id, bad, 'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Target-URI: ' || url || nl
    || 'Content-Type: application/http; msgtype=response' || nl || 'Content-Length: ' || CAST(strlen(body) AS VARCHAR) || nl || nl || body || nl || nl AS r
  FROM (SELECT *, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || nl || html AS body FROM src)
), leaf0 AS (
  SELECT page_id, bad, CAST(strlen(r) AS BIGINT) AS length, sha256(r) AS record_sha256, coalesce(CAST(floor(page_id / 1000) AS BIGINT), -1) AS file_id FROM rec
), leaf AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS pos, CAST(sum(length) OVER w - length AS BIGINT) AS "offset"
  FROM leaf0 WINDOW w AS (PARTITION BY file_id ORDER BY page_id, record_sha256 ROWS UNBOUNDED PRECEDING)
), n0 AS (
  SELECT file_id, pos, "offset" AS a, "offset" + length AS b, sha256('leaf|' || "offset" || '|' || length || '|' || record_sha256) AS node FROM leaf
), n1 AS (
  SELECT file_id, pos // 10 AS pos, min(a) AS a, max(b) AS b, sha256('node|' || min(a) || '|' || max(b) || '|' || string_agg(node, '' ORDER BY pos)) AS node FROM n0 GROUP BY file_id, pos // 10
), n2 AS (
  SELECT file_id, pos // 10 AS pos, min(a) AS a, max(b) AS b, sha256('node|' || min(a) || '|' || max(b) || '|' || string_agg(node, '' ORDER BY pos)) AS node FROM n1 GROUP BY file_id, pos // 10
), n3 AS (
  SELECT file_id, pos // 10 AS pos, sha256('node|' || min(a) || '|' || max(b) || '|' || string_agg(node, '' ORDER BY pos)) AS root FROM n2 GROUP BY file_id, pos // 10
)
SELECT page_id, leaf.file_id AS file_id, leaf.pos AS pos, "offset", length, record_sha256, root, CASE WHEN bad THEN 'damaged' ELSE 'ok' END AS status
FROM leaf JOIN n3 ON leaf.file_id = n3.file_id
"""
