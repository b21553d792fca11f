"""Click-propensity dataset queries on the test tables (q01-q17).

Stand-ins: member = customer, click / email / slot events = ``events``,
transactions = ``lineitem`` + ``orders``, SKU = ``part``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.clean import CleanSpec, clean_members, drop_columns, fill_by_group
from quarry.operators.features import (assemble, count_by_key, count_in_window,
                                       distinct_count_by, sum_over_union)
from quarry.operators.label import add_existence_label, distinct_keys_since, label_counts
from quarry.operators.profile import complete_columns, drop_sparse, null_profile, top_missing
from quarry.operators.relational import in_subquery, not_in, remove_keys, row_difference
from quarry.plans.fixtures import (E_ASOF, H, MEMBER_COLUMNS, MEMBERS_SQL, O_ASOF, Tables, d,
                                   members)
from quarry.plans.registry import query
from quarry.sources.tables import snapshot_scan

DAY = dt.timedelta(days=1)
CLICK_SINCE = E_ASOF - H * DAY
MEMBER_SPEC = CleanSpec(
    snapshot_day=E_ASOF, last_login="last_login_date", prior_login="prior_login_date",
    flag_like=("newsletter_flag",), fill_zero_named=("event_value_sum",),
    drop_constant=("c_name",), sparse_threshold=90.0)
# Fixed parameters of the renewal feature.
RENEWAL_BRANDS = ("Brand#12", "Brand#21")
RENEWAL_MAX_SIZE = 25


def split_is_train(key) -> F.Column:
    """M2: stable hash split, 99.5 % train (same expression in the oracle)."""
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return (h % 1000) < 995


SPLIT_SQL = "(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT % 1000) < 995"


def clickers(t: Tables) -> DataFrame:
    return distinct_keys_since(t.events, "user_id", "ts", CLICK_SINCE,
                               where=F.col("event_type") == "click")


CLICKERS_SQL = f"""clickers AS (SELECT user_id FROM events
  WHERE event_type = 'click' AND CAST(ts AS DATE) >= {d(CLICK_SINCE)} GROUP BY 1)"""


# q01 ---------------------------------------------------------------------
@query("q01_click_label_counts", f"""
WITH {CLICKERS_SQL}
SELECT clicked_or_not, count(*) AS n FROM (
  SELECT CASE WHEN k.user_id IS NULL THEN 'False' ELSE 'True' END AS clicked_or_not
  FROM customer c LEFT JOIN clickers k ON c.c_custkey = k.user_id) GROUP BY 1""")
def q01(spark, root):
    t = Tables(spark, root)
    base = t.customer.select(F.col("c_custkey").alias("registration_id"))
    return label_counts(add_existence_label(base, "registration_id", clickers(t)))


# q02 ---------------------------------------------------------------------
@query("q02_snapshot_scan", f"""
SELECT event_id, ts, user_id, event_type, value FROM events
WHERE CAST(ts AS DATE) = {d(E_ASOF - H * DAY)} AND event_type <> 'error'""")
def q02(spark, root):
    t = Tables(spark, root)
    return snapshot_scan(t.events, "ts", E_ASOF - H * DAY,
                         where=F.col("event_type") != "error", drop=["props"])


# q03 ---------------------------------------------------------------------
def _profile_sql(cols, src):
    parts = [f"""SELECT '{c}' AS feature_name, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count,
  round(CAST(count_if({c} IS NULL) AS DOUBLE) * 100.0 / count(*), 4) AS missing_pct FROM {src}"""
             for c in cols]
    return "\nUNION ALL\n".join(parts)


@query("q03_null_profile", f"WITH {MEMBERS_SQL}\n{_profile_sql(MEMBER_COLUMNS, 'members')}")
def q03(spark, root):
    return null_profile(members(Tables(spark, root))).drop("row_count")


@query("q03b_profile_top5", f"""WITH {MEMBERS_SQL}, p AS ({_profile_sql(MEMBER_COLUMNS, 'members')})
SELECT * FROM p ORDER BY null_count DESC, feature_name ASC LIMIT 5""")
def q03b(spark, root):
    return top_missing(null_profile(members(Tables(spark, root))), 5).drop("row_count")


# q56 ---------------------------------------------------------------------
COMPLETE = [c for c in MEMBER_COLUMNS[:5] + ["is_building"]]


@query("q56_complete_columns", f"WITH {MEMBERS_SQL}\nSELECT {', '.join(COMPLETE)} FROM members")
def q56(spark, root):
    """Keep the columns without any missing value, by a strict
    drop of the others."""
    m = members(Tables(spark, root))
    complete = set(complete_columns(null_profile(m)))
    return drop_columns(m, [c for c in m.columns if c not in complete], strict=True)


# q04 ---------------------------------------------------------------------
_KEPT = [c for c in MEMBER_COLUMNS if c != "recent_click_count"]


@query("q04_drop_sparse", f"WITH {MEMBERS_SQL}\nSELECT {', '.join(_KEPT)} FROM members")
def q04(spark, root):
    return drop_sparse(members(Tables(spark, root)), 90.0)[0]


# q05 ---------------------------------------------------------------------
_COUNTS = ["view_count", "click_count", "purchase_count", "error_count", "signup_count"]
FILLED_SQL = f"""filled AS (
  SELECT registration_id, coalesce(c_name, 'Others') AS c_name,
         coalesce(c_mktsegment, 'Others') AS c_mktsegment, c_nationkey, c_acctbal,
         coalesce(segment_code, 'Others') AS segment_code, is_building,
         {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNTS)},
         coalesce(event_value_sum, 0) AS event_value_sum,
         last_login_date, prior_login_date, newsletter_flag
  FROM members)"""


@query("q05_fill_by_group", f"WITH {MEMBERS_SQL}, {FILLED_SQL}\nSELECT * FROM filled")
def q05(spark, root):
    return fill_by_group(members(Tables(spark, root)), MEMBER_SPEC)[0]


# q06 ---------------------------------------------------------------------
_CLEAN_COLS = ["registration_id", "c_mktsegment", "c_nationkey", "c_acctbal", "segment_code",
               "is_building", *_COUNTS, "event_value_sum", "newsletter_flag",
               "days_since_last_login", "days_bw_last_two_logins"]
CLEAN_SQL = f"""clean0 AS (
  SELECT registration_id, c_mktsegment, c_nationkey, c_acctbal, segment_code, is_building,
         {', '.join(_COUNTS)}, event_value_sum, newsletter_flag,
         CAST(coalesce(date_diff('day', last_login_date, {d(E_ASOF)}), 0) AS BIGINT) AS days_since_last_login,
         CAST(coalesce(date_diff('day', prior_login_date, last_login_date), 0) AS BIGINT) AS days_bw_last_two_logins
  FROM filled),
clean AS (SELECT * FROM clean0 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _CLEAN_COLS)})"""


@query("q06_drop_any_null", f"WITH {MEMBERS_SQL}, {FILLED_SQL}, {CLEAN_SQL}\nSELECT * FROM clean")
def q06(spark, root):
    return clean_members(members(Tables(spark, root)), MEMBER_SPEC)[0]


# q07 ---------------------------------------------------------------------
@query("q07_date_gaps", f"""
SELECT o_custkey AS registration_id,
       CAST(date_diff('day', max(CAST(o_orderdate AS DATE)), {d(O_ASOF - 30 * DAY)}) AS BIGINT) AS days_since_last_order,
       CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS BIGINT) AS days_first_to_last_order
FROM orders GROUP BY o_custkey""")
def q07(spark, root):
    t = Tables(spark, root)
    day = F.to_date("o_orderdate")
    g = t.orders.groupBy(F.col("o_custkey").alias("registration_id")).agg(
        F.max(day).alias("last_day"), F.min(day).alias("first_day"))
    return g.select(
        "registration_id",
        F.datediff(F.lit(O_ASOF - 30 * DAY), F.col("last_day")).cast("bigint").alias("days_since_last_order"),
        F.datediff(F.col("last_day"), F.col("first_day")).cast("bigint").alias("days_first_to_last_order"))


# q08-q11: feature tables ---------------------------------------------------
SLOTS_SQL = """slots AS (SELECT user_id AS registration_id,
  count(nullif(event_type, 'error')) AS lifetime_slots_count FROM events GROUP BY user_id)"""
EMAILS_SQL = f"""emails AS (SELECT user_id AS registration_id, count(event_id) AS generated_email_msg_count
  FROM events WHERE CAST(ts AS DATE) >= {d(E_ASOF - 2 * H * DAY)} AND CAST(ts AS DATE) <= {d(E_ASOF - H * DAY)}
  GROUP BY user_id)"""
TXNS_SQL = """txns AS (SELECT o_custkey AS registration_id, count(o_orderkey) AS customer_transall_count
  FROM orders GROUP BY o_custkey)"""
RENEWALS_SQL = f"""
dos AS (
  SELECT o.o_custkey AS registration_id, l.l_partkey AS sku_id, l.l_orderkey AS trans_id,
         l.l_shipdate AS start_date,
         CASE WHEN l.l_linestatus = 'F' THEN l.l_shipdate END AS last_renewed_date,
         CASE WHEN l.l_returnflag = 'R' THEN o.o_orderdate END AS cancelled_date,
         l.l_quantity, o.o_orderstatus
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
classic AS (
  SELECT a.registration_id, sku.p_size AS term_length, CAST(a.start_date AS DATE) AS start_date,
         'renewals' AS transaction_type, count(DISTINCT a.trans_id) AS transactions
  FROM (SELECT * FROM dos WHERE 1 = 1 AND last_renewed_date IS NOT NULL AND l_quantity > 5
          AND o_orderstatus <> 'P'
          AND (cancelled_date IS NULL OR CAST(cancelled_date AS DATE) = CAST(start_date AS DATE))) a
  JOIN part sku ON a.sku_id = sku.p_partkey
  WHERE CAST(a.start_date AS DATE) < {d(O_ASOF)}
    AND a.sku_id IN (SELECT dpc.p_partkey FROM part dpc,
                       (SELECT DISTINCT p_brand AS display_name FROM part) dp
                     WHERE dpc.p_brand = dp.display_name
                       AND dp.display_name IN ('{RENEWAL_BRANDS[0]}', '{RENEWAL_BRANDS[1]}'))
    AND a.sku_id IN (SELECT p_partkey FROM part WHERE p_size <= {RENEWAL_MAX_SIZE})
  GROUP BY 1, 2, 3, 4),
shop AS (
  SELECT e.user_id AS registration_id, sku.p_size AS term_length, CAST(e.ts AS DATE) AS start_date,
         'renewals' AS transaction_type, count(DISTINCT e.event_id) AS transactions
  FROM events e JOIN part sku ON CAST(regexp_extract(e.props, '[0-9]+') AS BIGINT) = sku.p_partkey
  WHERE e.event_type = 'purchase' AND e.value > 1
    AND e.user_id NOT IN (
      SELECT user_id FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) = {d(E_ASOF - DAY)}
        AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error'
                        AND CAST(ts AS DATE) = {d(E_ASOF - DAY)} AND props LIKE '%9%'))
    AND CAST(e.ts AS DATE) < {d(E_ASOF)}
  GROUP BY 1, 2, 3, 4),
renewals AS (
  SELECT registration_id, CAST(sum(transactions) AS BIGINT) AS renewals
  FROM (SELECT * FROM classic UNION ALL SELECT * FROM shop) x GROUP BY 1)"""


def slots(t: Tables) -> DataFrame:
    return count_by_key(t.events, "user_id", F.nullif(F.col("event_type"), F.lit("error")),
                        "lifetime_slots_count", out_key="registration_id")


def emails(t: Tables) -> DataFrame:
    return count_in_window(t.events, "user_id", "event_id", "ts", E_ASOF - 2 * H * DAY,
                           E_ASOF - H * DAY, "generated_email_msg_count", out_key="registration_id")


def txns(t: Tables) -> DataFrame:
    return count_by_key(t.orders, "o_custkey", "o_orderkey", "customer_transall_count",
                        out_key="registration_id")


def retried_users(t: Tables, day: dt.date) -> DataFrame:
    """J7 inner part: purchasers on ``day`` that also had a matching error."""
    ev = t.events
    on_day = F.to_date("ts") == F.lit(day)
    buyers = ev.filter((F.col("event_type") == "purchase") & on_day).select("user_id")
    errs = ev.filter((F.col("event_type") == "error") & on_day & F.col("props").like("%9%"))
    return in_subquery(buyers, "user_id", errs, "user_id")


def renewals(t: Tables) -> DataFrame:
    li, o, p = t.lineitem, t.orders, t.part
    sku = p.select(F.col("p_partkey").alias("sku_id"), F.col("p_size").alias("term_length"))
    # Everything that the part decides comes first, on lineitem alone; the
    # orders join then shuffles what is left, once.
    product = p.select(F.col("p_brand").alias("display_name")).distinct()
    branded = (p.join(product, p["p_brand"] == product["display_name"])
                .filter(F.col("display_name").isin(*RENEWAL_BRANDS)).select("p_partkey"))
    typed = p.filter(F.col("p_size") <= RENEWAL_MAX_SIZE).select("p_partkey")
    skus = in_subquery(in_subquery(sku, "sku_id", branded, "p_partkey"), "sku_id", typed, "p_partkey")
    lines = li.select(
        F.col("l_partkey").alias("sku_id"), F.col("l_orderkey").alias("trans_id"),
        F.col("l_shipdate").alias("start_date"), "l_quantity", "l_returnflag",
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("last_renewed_date"))
    lines = lines.filter(F.col("last_renewed_date").isNotNull() & (F.col("l_quantity") > 5)
                         & (F.to_date("start_date") < F.lit(O_ASOF)))
    classic = lines.join(skus, "sku_id").join(o, F.col("trans_id") == o["o_orderkey"]).select(
        F.col("o_custkey").alias("registration_id"), "term_length", "trans_id", "start_date", "o_orderstatus",
        F.when(F.col("l_returnflag") == "R", F.col("o_orderdate")).alias("cancelled_date"))
    classic = classic.filter(
        (F.col("o_orderstatus") != "P")
        & (F.col("cancelled_date").isNull() | (F.to_date("cancelled_date") == F.to_date("start_date"))))
    keys = [F.col("registration_id"), F.col("term_length"),
            F.to_date("start_date").alias("start_date"), F.lit("renewals").alias("transaction_type")]
    classic = distinct_count_by(classic, keys, "trans_id", "transactions")

    ev = t.events.filter((F.col("event_type") == "purchase") & (F.col("value") > 1))
    ev = ev.withColumn("sku_id", F.regexp_extract("props", "[0-9]+", 0).try_cast("bigint"))
    shop = ev.join(sku, "sku_id")
    shop = not_in(shop, "user_id", retried_users(t, E_ASOF - DAY), "user_id")
    shop = shop.filter(F.to_date("ts") < F.lit(E_ASOF)).withColumnRenamed("user_id", "registration_id")
    keys = [F.col("registration_id"), F.col("term_length"),
            F.to_date("ts").alias("start_date"), F.lit("renewals").alias("transaction_type")]
    shop = distinct_count_by(shop, keys, "event_id", "transactions")
    return sum_over_union([classic, shop], "registration_id", "transactions", "renewals")


@query("q08_slot_counts", f"WITH {SLOTS_SQL} SELECT * FROM slots")
def q08(spark, root):
    return slots(Tables(spark, root))


@query("q09_email_window_counts", f"WITH {EMAILS_SQL} SELECT * FROM emails")
def q09(spark, root):
    return emails(Tables(spark, root))


@query("q10_txn_counts", f"WITH {TXNS_SQL} SELECT * FROM txns")
def q10(spark, root):
    return txns(Tables(spark, root))


@query("q11_renewals", f"WITH {RENEWALS_SQL} SELECT * FROM renewals")
def q11(spark, root):
    return renewals(Tables(spark, root))


# q12-q16: relational operators ---------------------------------------------
@query("q12_retry_exclusion", f"""
SELECT event_id, user_id, event_type FROM events
WHERE user_id NOT IN (
  SELECT user_id FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) = {d(E_ASOF - DAY)}
    AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error'
                    AND CAST(ts AS DATE) = {d(E_ASOF - DAY)} AND props LIKE '%9%'))""")
def q12(spark, root):
    t = Tables(spark, root)
    ev = t.events.select("event_id", "user_id", "event_type")
    return not_in(ev, "user_id", retried_users(t, E_ASOF - DAY), "user_id")


@query("q13_null_aware_anti", """
SELECT p_partkey, p_name FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def q13(spark, root):
    t = Tables(spark, root)
    sub = t.lineitem.filter(F.col("l_quantity") > 49)
    return not_in(t.part.select("p_partkey", "p_name"), "p_partkey", sub, "l_partkey")


@query("q14_null_aware_anti_null", """
SELECT count(*) AS n FROM part
WHERE p_partkey NOT IN (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey END
                        FROM lineitem WHERE l_quantity > 49)""")
def q14(spark, root):
    t = Tables(spark, root)
    sub = t.lineitem.filter(F.col("l_quantity") > 49).select(
        F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_partkey")).alias("k"))
    return not_in(t.part, "p_partkey", sub, "k").agg(F.count(F.lit(1)).alias("n"))


_PART_KEYS = "SELECT CASE WHEN p_size = 7 THEN NULL ELSE p_partkey END AS p_partkey, p_name FROM part"


@query("q14b_not_in_spark_sql", f"""
SELECT p_name FROM ({_PART_KEYS})
WHERE p_partkey NOT IN (SELECT CASE WHEN l_quantity >= 50 AND l_discount > 0.2 THEN NULL ELSE l_partkey END
                        FROM lineitem WHERE l_quantity > 49)
UNION ALL
SELECT 'with a NULL key: ' || count(*) FROM ({_PART_KEYS})
WHERE p_partkey NOT IN (SELECT CASE WHEN l_quantity >= 50 THEN NULL ELSE l_partkey END
                        FROM lineitem WHERE l_quantity > 49)
UNION ALL
SELECT 'not in nothing: ' || count(*) || ', of NULL keys ' || count_if(p_partkey IS NULL) FROM ({_PART_KEYS})
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 99)""")
def q14b(spark, root):
    """S2 + J8 as SQL on registered views, without keys, without and with a
    NULL key, and with NULL keys outside: NOT EXISTS plans as a shuffled anti
    join, and a scalar subquery of one row adds the NULL rules, so nothing needs a broadcast."""
    from quarry.sources.tables import register_tables
    register_tables(spark, root, ("part", "lineitem"))

    def not_in_keys(key: str, where: str, result: str) -> str:
        keys = f"SELECT {key} AS k FROM lineitem WHERE {where}"
        return f"""SELECT {result} FROM ({_PART_KEYS})
            WHERE NOT EXISTS (SELECT 1 FROM ({keys}) s WHERE s.k = p_partkey)
              AND (SELECT CASE WHEN count(*) = 0 THEN 2 WHEN count_if(k IS NULL) = 0 THEN 1 ELSE 0 END FROM ({keys}) s)
                  > CASE WHEN p_partkey IS NULL THEN 1 ELSE 0 END"""

    rare, often = (f"CASE WHEN l_quantity >= 50{c} THEN NULL ELSE l_partkey END" for c in (" AND l_discount > 0.2", ""))
    return spark.sql("\nUNION ALL\n".join([
        not_in_keys(rare, "l_quantity > 49", "p_name"),
        not_in_keys(often, "l_quantity > 49", "concat('with a NULL key: ', count(*)) AS p_name"),
        not_in_keys("l_partkey", "l_quantity > 99",
                    "concat('not in nothing: ', count(*), ', of NULL keys ', count_if(p_partkey IS NULL)) AS p_name")]))


@query("q15_training_removed", f"""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE {SPLIT_SQL.format(k='c_custkey')})""")
def q15(spark, root):
    t = Tables(spark, root)
    train = t.customer.filter(split_is_train(F.col("c_custkey")))
    return remove_keys(t.customer.select("c_custkey", "c_name"), "c_custkey", train)


@query("q16_row_difference", """
SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0
EXCEPT
SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal >= 8000""")
def q16(spark, root):
    c = Tables(spark, root).customer
    a = c.filter(F.col("c_acctbal") < 0).select("c_nationkey", "c_mktsegment")
    b = c.filter(F.col("c_acctbal") >= 8000).select("c_nationkey", "c_mktsegment")
    return row_difference(a, b)


# q17: assembled dataset ----------------------------------------------------
def feature_dataset(t: Tables) -> tuple[DataFrame, list[str]]:
    """Clean members, click label, four feature tables, second sparsity
    drop (features keep their NULLs before it, D6)."""
    clean, _ = clean_members(members(t), replace(MEMBER_SPEC, stage=True))
    labelled = add_existence_label(clean, "registration_id", clickers(t))
    full = assemble(labelled, "registration_id", [emails(t), txns(t), slots(t), renewals(t)])
    return drop_sparse(full, 90.0, stage=True)


ASSEMBLED_SQL = f"""WITH {MEMBERS_SQL}, {FILLED_SQL}, {CLEAN_SQL}, {CLICKERS_SQL},
{SLOTS_SQL}, {EMAILS_SQL}, {TXNS_SQL}, {RENEWALS_SQL},
assembled AS (
  SELECT cl.*, CASE WHEN k.user_id IS NULL THEN 'False' ELSE 'True' END AS clicked_or_not,
         em.generated_email_msg_count, tx.customer_transall_count, sl.lifetime_slots_count,
         rn.renewals
  FROM clean cl
  LEFT JOIN clickers k ON cl.registration_id = k.user_id
  LEFT JOIN emails em ON cl.registration_id = em.registration_id
  LEFT JOIN txns tx ON cl.registration_id = tx.registration_id
  LEFT JOIN slots sl ON cl.registration_id = sl.registration_id
  LEFT JOIN renewals rn ON cl.registration_id = rn.registration_id)"""


@query("q17_feature_assembly", ASSEMBLED_SQL + "\nSELECT * FROM assembled")
def q17(spark, root):
    return feature_dataset(Tables(spark, root))[0]
