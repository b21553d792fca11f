"""WARC fixity audit by Merkle trees.

A replica is a set of WARC files, each a sequence of records. ``leaves`` gives
every record its place (file, position, byte offset, length) and the SHA-256
of its bytes. ``tree`` hashes runs of ``FANOUT`` neighbouring records to a node
for their offset range, a file's ranges to the file's node, and runs of
``FANOUT`` files upwards to one root. ``audit`` compares the roots of two
replicas and descends level by level, joining only the children of nodes that
differ; equal branches are never read further. In the offset ranges that
differ at the bottom, records are matched by id and classified:

* ``changed``: other bytes (``found_*`` tells which),
* ``missing`` / ``extra``: in one replica only,
* ``moved``: the same bytes at another offset, behind a loss or a change of length.

Every node is made of at most ``FANOUT`` children (a file of at most
``FILE_RECORDS`` records for its file node), so no group grows with the
archive; all levels above the records are a fifteenth of them.

Cases: a null url or payload is written as empty; a null id is an id like any
other; records repeated under one id are matched in their order in the file;
an empty replica has no root, and all records of the other are missing or extra;
very long payloads are hashed whole; equal replicas give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import query, read, stage
from quarry.operators.ranking import ordered_rank

FANOUT = 16
FILE_RECORDS = 256        # production parameters


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """The record as written: headers, payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def sha256(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def leaves(records: DataFrame) -> DataFrame:
    """Position and offset of each record of (file, place, id, length,
    digest), ``place`` giving the order inside a file."""
    inside = Window.partitionBy("file").orderBy("place")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return records.select(
        "file", (F.row_number().over(inside) - 1).cast("bigint").alias("part"), "id", "length", "digest",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"))


def _up(level: DataFrame, file: Column, part: Column) -> DataFrame:
    """Nodes over runs of children."""
    kids = level.groupBy(file.alias("file"), part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("file").alias("f"), F.col("part").alias("p"), "offset", "length",
                                             "digest"))).alias("kids"))
    return kids.select(
        "file", "part", F.element_at("kids", 1)["offset"].alias("offset"),
        F.aggregate("kids", F.lit(0).cast("bigint"), lambda a, k: a + k["length"]).alias("length"),
        F.sha2(F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["offset"], k["length"], k["digest"])), ","),
               256).alias("digest"))


def tree(bottom: DataFrame, most_file: int) -> list[DataFrame]:
    """The levels of a replica: records, offset ranges, files, runs of files
    ... up to one root, each (file, part, offset, length, digest).
    ``most_file`` is the largest file number of any replica to compare."""
    zero = F.lit(0).cast("bigint")
    levels = [bottom, stage(_up(bottom, F.col("file"), F.floor(F.col("part") / FANOUT)), "warc-ranges")]
    levels.append(stage(_up(levels[-1], F.col("file"), zero), "warc-files"))
    files = most_file
    while files > 0:
        levels.append(stage(_up(levels[-1], F.floor(F.col("file") / FANOUT), zero), "warc-runs"))
        files //= FANOUT
    return levels


def _parents(level: int) -> tuple[Column, Column]:
    """A node's parent's (file, part) at the level above."""
    if level == 0:
        return F.col("file"), F.floor(F.col("part") / FANOUT)
    return (F.col("file") if level == 1 else F.floor(F.col("file") / FANOUT)), F.lit(0).cast("bigint")


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Where ``found`` differs from ``expected``, both tables of leaves:
    file, id, offset, length, digest, found_offset, found_length,
    found_digest, kind."""
    most = expected.select("file").unionByName(found.select("file")).agg(F.max("file")).first()[0] or 0
    a, b = tree(expected, most), tree(found, most)
    differ = None                                         # (file, part) at the level above
    for level in range(len(a) - 1, 0, -1):
        up_file, up_part = _parents(level)
        sides = []
        for nodes, name in ((a[level], "digest"), (b[level], "found")):
            side = nodes.select("file", "part", F.col("digest").alias(name), up_file.alias("up_file"), up_part.alias("up_part"))
            if differ is not None:
                side = side.join(differ, ["up_file", "up_part"], "left_semi")
            sides.append(side.drop("up_file", "up_part"))
        both = sides[0].join(sides[1], ["file", "part"], "full")
        differ = stage(both.filter(~F.col("digest").eqNullSafe(F.col("found"))).select(
            F.col("file").alias("up_file"), F.col("part").alias("up_part")), "warc-differ")
        if differ.isEmpty():                              # equal roots: nothing to descend to
            break
    up_file, up_part = _parents(0)
    occurrence = F.row_number().over(Window.partitionBy("file", "id").orderBy("part"))
    ranges = []
    for records in (expected, found):
        inside = records.withColumns({"up_file": up_file, "up_part": up_part}).join(differ, ["up_file", "up_part"], "left_semi")
        ranges.append(inside.withColumn("nth", occurrence).select("file", "id", "nth", "offset", "length", "digest"))
    x, y = ranges[0].alias("x"), ranges[1].alias("y")
    same = (F.col("x.file") == F.col("y.file")) & F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.nth") == F.col("y.nth"))
    kind = (F.when(F.col("y.digest").isNull(), "missing").when(F.col("x.digest").isNull(), "extra")
            .when(F.col("x.digest") != F.col("y.digest"), "changed")
            .when(F.col("x.offset") != F.col("y.offset"), "moved"))
    return x.join(y, same, "full").select(
        F.coalesce("x.file", "y.file").alias("file"), F.coalesce("x.id", "y.id").alias("id"),
        F.col("x.offset").alias("offset"), F.col("x.length").alias("length"), F.col("x.digest").alias("digest"),
        F.col("y.offset").alias("found_offset"), F.col("y.length").alias("found_length"),
        F.col("y.digest").alias("found_digest"), kind.alias("kind")).filter(F.col("kind").isNotNull())


def packed(records: DataFrame, order: str, file_records: int = FILE_RECORDS) -> DataFrame:
    """Add ``file`` and ``place``: records in ``order``, so many to a file."""
    ranked = ordered_rank(records, [], [order], out="place")
    return ranked.withColumn("file", F.floor(F.col("place") / file_records))


def damaged_payload(page_id: Column, html: Column) -> Column:
    """The payload as a damaged replica holds it: one character overwritten
    in every 101st page, the last tenth lost in every 503rd."""
    middle = F.floor(F.length(html) / 2).cast("int")
    over = F.concat(html.substr(F.lit(1), middle), F.lit("\u0001"), html.substr(middle + 2, F.length(html)))
    return F.when(page_id % 101 == 7, over).when(page_id % 503 == 11, html.substr(
        F.lit(1), F.length(html) - F.ceil(F.length(html) / 10).cast("int"))).otherwise(html)


@query("op4_merkle_fixity", oracle=r"""
WITH r AS (SELECT page_id AS id, coalesce(url, '') AS url, coalesce(html, '') AS html,
  CASE WHEN page_id % 101 = 7 THEN coalesce(left(html, (length(html) // 2)::INTEGER) || chr(1) || substr(html, (length(html) // 2 + 2)::INTEGER), '')
       WHEN page_id % 503 = 11 THEN coalesce(left(html, (length(html) - ceil(length(html) / 10.0))::INTEGER), '')
       ELSE coalesce(html, '') END AS bad FROM pages),
w AS (SELECT id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(id::VARCHAR, '')
   || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
   || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head, html, bad, chr(13) || chr(10) || chr(13) || chr(10) AS eol FROM r),
f AS (SELECT id, head || strlen(html) || eol || html || eol AS a, head || strlen(bad) || eol || bad || eol AS b,
   (row_number() OVER (ORDER BY id) - 1) // 256 AS file, row_number() OVER (ORDER BY id) AS place FROM w),
x AS (SELECT file, id, strlen(a) AS length, sha256(a) AS digest, coalesce(sum(strlen(a)) OVER (PARTITION BY file ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM f),
y AS (SELECT file, id, strlen(b) AS length, sha256(b) AS digest, coalesce(sum(strlen(b)) OVER (PARTITION BY file ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM f
      WHERE id % 1009 <> 5)
SELECT x.file::BIGINT AS file, x.id AS page_id, x.off::BIGINT AS "offset", x.length::BIGINT AS length, x.digest, y.off::BIGINT AS found_offset,
  y.length::BIGINT AS found_length, y.digest AS found_digest,
  CASE WHEN y.digest IS NULL THEN 'missing' WHEN x.digest <> y.digest THEN 'changed' ELSE 'moved' END AS kind
FROM x LEFT JOIN y ON x.file = y.file AND x.id = y.id WHERE y.digest IS NULL OR x.digest <> y.digest OR x.off <> y.off
""")
def op4_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica is derived from the table with known damage: overwritten
    and truncated payloads, and every 1009th record lost."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    page_id = F.col("page_id")
    good = warc_record(page_id, F.col("url"), F.col("html"))
    bad = warc_record(page_id, F.col("url"), damaged_payload(page_id, F.col("html")))
    records = pages.select(
        page_id.alias("id"), F.octet_length(good).cast("bigint").alias("length"), sha256(good).alias("digest"),
        F.octet_length(bad).cast("bigint").alias("bad_length"), sha256(bad).alias("bad_digest"))
    records = stage(packed(records, "id"), "warc-records")
    expected = stage(leaves(records), "warc-expected")
    lost = F.coalesce(F.col("id") % 1009 == 5, F.lit(False))
    found = stage(leaves(records.filter(~lost).select("file", "place", "id", F.col("bad_length").alias("length"),
                                                      F.col("bad_digest").alias("digest"))), "warc-found")
    return audit(expected, found).withColumnRenamed("id", "page_id")
