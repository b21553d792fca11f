"""NOT IN semantics, anti/semi joins, row difference, profile boundaries."""

from pyspark.sql import functions as F

from quarry.operators.profile import column_groups, drop_sparse, null_profile, top_missing
from quarry.operators.relational import (in_subquery, not_in, remove_keys,
                                         row_difference)

PRODUCTS = [(1, "a"), (2, "b"), (3, "c"), (None, "n")]


def products(spark):
    return spark.createDataFrame(PRODUCTS, "pid long, name string")


def items(spark, rows):
    return spark.createDataFrame(rows, "pid long, qty long")


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_not_in_without_null_keys(spark):
    sub = items(spark, [(1, 9), (1, 7), (2, 1)]).filter(F.col("qty") > 5)
    assert names(not_in(products(spark), "pid", sub, "pid")) == ["b", "c"]


def test_not_in_with_a_null_key_is_empty(spark):
    sub = items(spark, [(1, 9), (None, 7)])
    assert names(not_in(products(spark), "pid", sub, "pid")) == []


def test_not_in_empty_subquery_keeps_everything(spark):
    sub = items(spark, [(1, 1)]).filter(F.col("qty") > 5)
    assert names(not_in(products(spark), "pid", sub, "pid")) == ["a", "b", "c", "n"]


def test_anti_plus_semi_is_whole_for_non_null_keys(spark):
    p = products(spark).filter(F.col("pid").isNotNull())
    sub = items(spark, [(1, 9), (3, 7)])
    semi = in_subquery(p, "pid", sub, "pid")
    anti = not_in(p, "pid", sub, "pid")
    assert semi.count() + anti.count() == p.count()
    assert not set(names(semi)) & set(names(anti))


def test_remove_keys_and_difference(spark):
    p = products(spark)
    used = items(spark, [(2, 0), (2, 1)])
    assert names(remove_keys(p, "pid", used)) == ["a", "c", "n"]
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(2,)], "x int")
    assert sorted(r.x for r in row_difference(a, b).collect()) == [1]
    assert sorted(r.x for r in row_difference(a, b, keep_duplicates=True).collect()) == [1, 1]


def test_sparse_threshold_is_strict(spark):
    rows = [(i, None if i < 9 else 1, None if i < 10 else 1) for i in range(10)]
    # col a: 9 of 10 NULL = 90 % (kept); col b: 10 of 10 NULL (dropped)
    df = spark.createDataFrame(rows, "id int, a int, b int")
    prof = {r.feature_name: r.missing_pct for r in null_profile(df).collect()}
    assert prof == {"id": 0.0, "a": 90.0, "b": 100.0}
    kept, dropped = drop_sparse(df, 90.0)
    assert kept.columns == ["id", "a"] and dropped == ["b"]
    top = [r.feature_name for r in top_missing(null_profile(df), 2).collect()]
    assert top == ["b", "a"]


def test_empty_profile_has_null_share(spark):
    df = spark.createDataFrame([], "a int")
    assert [r.missing_pct for r in null_profile(df).collect()] == [None]


def test_column_groups_flag_like_and_dates(spark):
    df = spark.createDataFrame([], "a string, f string, d date, t timestamp, n double, b boolean")
    g = column_groups(df, flag_like=["f"])
    assert g["bool"] == ["f", "b"] and g["string"] == ["a"]
    assert g["date"] == ["d", "t"] and g["numeric"] == ["n"]


def test_fill_skips_incompatible_types(spark):
    from quarry.operators.clean import fill_values
    df = spark.createDataFrame([(None, None, None)], "n long, s string, d double")
    r = fill_values(df, {"n": 0, "s": 0, "d": 0}).first()
    assert (r.n, r.s, r.d) == (0, None, 0.0)
    r = fill_values(df, {"s": "Others", "n": "Others"}).first()
    assert (r.n, r.s) == (None, "Others")


def test_lookup_label_from_a_table(spark):
    from quarry.operators.relational import lookup_label
    df = spark.createDataFrame([(1,), (2,), (9,), (None,)], "c int")
    import tempfile
    path = tempfile.mkdtemp(prefix="quarry-dim-") + "/dim"
    spark.createDataFrame([(1, "CANADA"), (2, "USA"), (2, "USA")], "k int, name string") \
        .write.parquet(path)
    dim = spark.read.parquet(path)
    got = lookup_label(df, "c", dim, "k", "name", "country", "OTHERS")
    assert sorted((r.c or -1, r.country) for r in got.collect()) == [
        (-1, "OTHERS"), (1, "CANADA"), (2, "USA"), (9, "OTHERS")]
    assert "strategy=broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_not_in_reads_its_subquery_once_and_broadcasts_on_size_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sub = items(spark, [(1, 9), (2, 7)])
        df = not_in(products(spark), "pid", sub, "pid")
        assert names(df) == ["c"]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
