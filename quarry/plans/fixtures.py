"""Stand-ins for the reference's warehouse tables, derived by Spark from the
driver's test tables (member snapshot, bookings view, diffs).

Each builder has a SQL twin (``*_SQL``) used by the oracle queries, so the
oracle recomputes the same inputs independently in DuckDB.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import load_table

# Fixed parameters of the test queries.
E_ASOF = dt.date(2024, 1, 30)      # reference day for the events table
H = 10                             # look-back in days
O_ASOF = dt.date(2001, 8, 1)       # reference day for orders
RECENT_CLICK_DAY = E_ASOF                  # clicks on the reference day itself
BOOK_START = dt.date(1998, 1, 10)
BOOK_END = dt.date(1998, 3, 31)
FILE_LINES = 10                    # lines of a document per synthetic diff file
DIFF_EXTS = ("py", "sql", "md")


def d(x: dt.date) -> str:
    """DuckDB date literal."""
    return f"DATE '{x.isoformat()}'"


# Tables whose rows carry long texts processed by regexes row by row. The
# session setting ``quarry.spreadTexts`` (a number of partitions) deals them
# out first; the bench sets it, as each test table is one row group.
TEXT_TABLES = ("documents", "pages", "conversations")
SPREAD_TEXTS = "quarry.spreadTexts"


class Tables:
    """Lazy accessor: ``Tables(spark, root).orders`` scans ``orders.parquet``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        spread = int(self.spark.conf.get(SPREAD_TEXTS, "0")) if name in TEXT_TABLES else 0
        return load_table(self.spark, self.root, name, spread=spread)


# ---------------------------------------------------------------- members

def members(t: Tables) -> DataFrame:
    """Member snapshot: one row per customer with event-derived features.

    Customers without events get NULL features (90 % of them at every
    scale); ``recent_click_count`` is NULL for anyone without a click since
    ``RECENT_CLICK_DAY``. One aggregation over events feeds every feature.
    """
    e = t.events
    et = F.col("event_type")
    ev = e.groupBy(F.col("user_id").alias("registration_id")).agg(
        F.count_if(et == "view").alias("view_count"),
        F.count_if(et == "click").alias("click_count"),
        F.count_if(et == "purchase").alias("purchase_count"),
        F.count_if(et == "error").alias("error_count"),
        F.count_if(et == "signup").alias("signup_count"),
        F.round(F.sum("value"), 2).alias("event_value_sum"),
        F.max(F.to_date("ts")).alias("last_login_date"),
        F.min(F.to_date("ts")).alias("prior_login_date"),
        F.when(F.count_if(et == "signup") > 0, F.lit("Y")).otherwise(F.lit("N")).alias("newsletter_flag"),
        F.nullif(F.count_if((et == "click") & (F.to_date("ts") >= F.lit(RECENT_CLICK_DAY))),
                 F.lit(0)).alias("recent_click_count"),
    )
    c = t.customer.select(
        F.col("c_custkey").alias("registration_id"), "c_name", "c_mktsegment", "c_nationkey",
        "c_acctbal", F.nullif(F.col("c_mktsegment"), F.lit("AUTOMOBILE")).alias("segment_code"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_building"))
    return c.join(ev, "registration_id", "left")


MEMBERS_SQL = f"""
members AS (
  SELECT c.c_custkey AS registration_id, c.c_name, c.c_mktsegment, c.c_nationkey, c.c_acctbal,
         nullif(c.c_mktsegment, 'AUTOMOBILE') AS segment_code,
         c.c_mktsegment = 'BUILDING' AS is_building,
         e.view_count, e.click_count, e.purchase_count, e.error_count, e.signup_count,
         e.event_value_sum, e.last_login_date, e.prior_login_date, e.newsletter_flag,
         e.recent_click_count
  FROM customer c LEFT JOIN (
    SELECT user_id,
           CAST(count_if(event_type = 'view') AS BIGINT) AS view_count,
           CAST(count_if(event_type = 'click') AS BIGINT) AS click_count,
           CAST(count_if(event_type = 'purchase') AS BIGINT) AS purchase_count,
           CAST(count_if(event_type = 'error') AS BIGINT) AS error_count,
           CAST(count_if(event_type = 'signup') AS BIGINT) AS signup_count,
           round(sum(value), 2) AS event_value_sum,
           max(CAST(ts AS DATE)) AS last_login_date,
           min(CAST(ts AS DATE)) AS prior_login_date,
           CASE WHEN count_if(event_type = 'signup') > 0 THEN 'Y' ELSE 'N' END AS newsletter_flag,
           CAST(nullif(count_if(event_type = 'click' AND CAST(ts AS DATE) >= {d(RECENT_CLICK_DAY)}), 0)
                AS BIGINT) AS recent_click_count
    FROM events GROUP BY user_id) e
  ON c.c_custkey = e.user_id)"""

MEMBER_COLUMNS = ["registration_id", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal",
                  "segment_code", "is_building", "view_count", "click_count", "purchase_count",
                  "error_count", "signup_count", "event_value_sum", "last_login_date",
                  "prior_login_date", "newsletter_flag", "recent_click_count"]


# --------------------------------------------------------------- bookings

def bookings(t: Tables) -> DataFrame:
    """Booking view: orders joined to their customer.

    ``rvtype`` is NULL for nation 17 and 16 is an unmapped code;
    ``user_age`` is NULL for one age in fifty.
    """
    o, c = t.orders, t.customer
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    return j.select(
        F.col("o_orderkey").alias("booking_id"),
        F.to_date("o_orderdate").alias("booking_date"),
        (F.col("c_nationkey") % 3).alias("country"),
        F.nullif(F.col("c_nationkey") % 18, F.lit(17)).alias("rvtype"),
        F.nullif(F.lit(18) + F.col("c_custkey") % 50, F.lit(60)).alias("user_age"),
        F.col("o_totalprice").alias("total_gmv"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1.0)).otherwise(F.lit(0.0)).alias("payment_rate"),
    )


BOOKINGS_SQL = """
bookings AS (
  SELECT o.o_orderkey AS booking_id, CAST(o.o_orderdate AS DATE) AS booking_date,
         c.c_nationkey % 3 AS country,
         nullif(c.c_nationkey % 18, 17) AS rvtype,
         nullif(18 + c.c_custkey % 50, 60) AS user_age,
         o.o_totalprice AS total_gmv,
         CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS payment_rate
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


# ------------------------------------------------------------------ diffs

def _section(line, i):
    first = F.substring(line, 1, 1)
    return (F.when(first == "A", F.concat(F.lit("def block_"), i.cast("string"), F.lit("():")))
             .when(first == "T", F.concat(F.lit("class Block"), i.cast("string"), F.lit(":")))
             .otherwise(F.lit("")))


def _file(doc_id, k):
    """A file's path, and the path as git writes it after ``a/`` and ``b/``:
    every fifth name holds a blank (a tab ends it on the name lines), every
    fifth is quoted."""
    ext = F.element_at(F.array(*[F.lit(x) for x in DIFF_EXTS]),
                       ((doc_id + k) % len(DIFF_EXTS) + 1).cast("int"))
    kind = (doc_id + k) % 5
    stem = lambda odd: F.when(kind == 1, F.lit("my part")).when(kind == 2, F.lit(odd)).otherwise(F.lit("part"))
    whole = lambda odd: F.concat(F.lit("doc"), doc_id.cast("string"), F.lit("/"), stem(odd), k.cast("string"), F.lit("."), ext)
    path, written = whole("p\u00e4rt"), whole(r"p\303\244rt")
    side = lambda x: F.when(kind == 2, F.concat(F.lit(f'"{x}/'), written, F.lit('"'))).otherwise(F.concat(F.lit(f"{x}/"), written))
    tab = F.when(kind == 1, F.lit("\t")).otherwise(F.lit(""))
    return path, F.concat(F.lit("diff --git "), side("a"), F.lit(" "), side("b"), F.lit("\n--- "), side("a"), tab,
                          F.lit("\n+++ "), side("b"), tab, F.lit("\n"))


def diffs(t: Tables) -> DataFrame:
    """One unified diff (no context lines) per document: every
    ``FILE_LINES`` lines form one file, every line is one hunk adding that
    line. Lines starting with ``A``/``T`` get a ``def``/``class`` section
    header. Built row-locally with array functions (no shuffle).
    """
    doc = t.documents.select("doc_id", "source", "lang", "text")
    lines = F.split(F.col("text"), "\n")

    def hunk(line, i):
        k = F.floor(i / FILE_LINES).cast("bigint")
        _, header = _file(F.col("doc_id"), k)
        sec = _section(line, i)
        n = (i + 1).cast("string")
        at = F.concat(F.lit("@@ -"), n, F.lit(",0 +"), n, F.lit(",1 @@"),
                      F.when(sec == "", F.lit("")).otherwise(F.concat(F.lit(" "), sec)),
                      F.lit("\n+"), line, F.lit("\n"))
        return F.concat(F.when(i % FILE_LINES == 0, header).otherwise(F.lit("")), at)

    text = F.array_join(F.transform(lines, hunk), "")
    return doc.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("diff_id"),
                      "doc_id", "source", "lang", text.alias("text"))


# Per-line view of the same diffs, for oracles that check the parse.
DIFF_LINES_SQL = rf"""
doc_lines AS (
  SELECT doc_id, source, lang, unnest(arr) AS line, generate_subscripts(arr, 1) - 1 AS i
  FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS arr FROM documents)),
diff_names AS (
  SELECT *, i // {FILE_LINES} AS file_idx, (doc_id + i // {FILE_LINES}) % 5 AS kind,
         (i // {FILE_LINES}) || '.' || ['{DIFF_EXTS[0]}', '{DIFF_EXTS[1]}', '{DIFF_EXTS[2]}'][((doc_id + i // {FILE_LINES}) % 3) + 1] AS tail
  FROM doc_lines),
diff_lines AS (
  SELECT doc_id, source, lang, i, line, file_idx,
         'doc' || doc_id || '/' || CASE kind WHEN 1 THEN 'my part' WHEN 2 THEN 'pärt' ELSE 'part' END || tail AS path,
         CASE kind WHEN 1 THEN replace('diff --git a/@ b/@' || chr(10) || '--- a/@' || chr(9) || chr(10) || '+++ b/@' || chr(9) || chr(10),
                                       '@', 'doc' || doc_id || '/my part' || tail)
                   WHEN 2 THEN replace('diff --git "a/@" "b/@"' || chr(10) || '--- "a/@"' || chr(10) || '+++ "b/@"' || chr(10),
                                       '@', 'doc' || doc_id || '/p\303\244rt' || tail)
                   ELSE replace('diff --git a/@ b/@' || chr(10) || '--- a/@' || chr(10) || '+++ b/@' || chr(10),
                                '@', 'doc' || doc_id || '/part' || tail) END AS hdr,
         CASE kind WHEN 1 THEN 12 ELSE 8 END AS hdr_tokens,
         CASE WHEN substr(line, 1, 1) = 'A' THEN 'def block_' || i || '():'
              WHEN substr(line, 1, 1) = 'T' THEN 'class Block' || i || ':'
              ELSE '' END AS section
  FROM diff_names),
diff_hunks AS (
  SELECT *, '@@ -' || (i + 1) || ',0 +' || (i + 1) || ',1 @@' ||
            CASE WHEN section = '' THEN '' ELSE ' ' || section END || chr(10) || '+' || line AS hunk
  FROM diff_lines)"""
