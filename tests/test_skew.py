"""Operators stay exact when one key holds a third of all rows."""

from pyspark.sql import functions as F

from quarry.operators.features import distinct_count_by
from quarry.operators.label import add_existence_label
from quarry.operators.relational import in_subquery, not_in
from quarry.session import scale_conf


def skewed(spark, n=30_000):
    # key 7 holds a third of the rows; the rest spread over 1,000 keys
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).alias("k"),
        (F.col("id") % 97).alias("v"))


def test_semi_anti_label_and_distinct_with_a_hot_key(spark):
    big = skewed(spark)
    keys = spark.range(0, 1000, 2).select(F.col("id").alias("k"))
    semi = in_subquery(big, "k", keys, "k").count()
    anti = not_in(big, "k", keys, "k").count()
    assert semi + anti == big.count()
    exp_semi = big.filter(F.col("k") % 2 == 0).count()
    assert semi == exp_semi
    members = spark.range(1000).select(F.col("id").alias("k"))
    lab = add_existence_label(members, "k", big.select("k"))     # hot key de-duplicated first
    assert lab.count() == 1000 and lab.filter("clicked_or_not = 'True'").count() == 1000
    d = distinct_count_by(big, [F.col("k")], "v", "n")
    assert d.filter("k = 7").first().n == 97


def test_scale_conf_for_100_tb():
    c = scale_conf(100 * 1024 ** 4, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409_600
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 << 20)


def test_ordered_rank_keeps_null_groups(spark):
    from quarry.operators.ranking import ordered_rank
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5), ("a", 4)], "g string, o int")
    got = sorted(((r.g or "-", r.o, r["rank"]) for r in ordered_rank(df, ["g"], ["o"]).collect()))
    assert got == [("-", 1, 0), ("-", 2, 1), ("a", 4, 0), ("a", 5, 1)]


def test_profile_thresholds_use_exact_counts(spark):
    from quarry.operators.profile import complete_columns, sparse_columns
    profile = spark.createDataFrame([("over", 3_600_001, 4_000_000, 90.0), ("at", 3_600_000, 4_000_000, 90.0),
                                     ("one", 1, 4_000_000, 0.0), ("none", 0, 4_000_000, 0.0)],
                                    "feature_name string, null_count long, row_count long, missing_pct double")
    assert sparse_columns(profile, 90.0) == ["over"] and complete_columns(profile) == ["none"]


def test_a_level_2_chunk_is_the_whole_patch(spark):
    from quarry.operators.diffs import create_chunks
    rename = ("diff --git a/old.py b/new.py\nsimilarity index 90%\nrename from old.py\nrename to new.py\nindex 1..2 100644\n"
              "--- a/old.py\n+++ b/new.py\n@@ -1 +1 @@ def f():\n-a b c\n+--- a/not.py\n")
    mode = "diff --git a/m.sql b/m.sql\nold mode 100644\nnew mode 100755\n"
    gone = "diff --git a/gone.py b/gone.py\ndeleted file mode 100644\n--- a/gone.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n-y\n"
    big = "diff --git a/big.py b/big.py\ndeleted file mode 100644\n--- a/big.py\n+++ /dev/null\n" + "".join(
        f"@@ -{i} +0,0 @@\n-" + "w " * 30 + "\n" for i in range(4))
    df = spark.createDataFrame([("d", rename + mode + gone + big)], "diff_id string, text string")
    got = {(r.path, r.part): (r.level, r.text) for r in create_chunks(df, 60).collect()}
    assert got["new.py", 0] == (2, rename.rstrip("\n")) and got["m.sql", 0] == (2, mode.rstrip("\n"))
    assert got["gone.py", 0] == (2, gone.rstrip("\n"))
    parts = [v for (p, _), v in got.items() if p == "big.py"]
    assert len(parts) == 4 and all(lv == 3 and "+++ /dev/null\n@@ " in t and "deleted file mode" in t for lv, t in parts)
