"""Ordered packing (T6), diff splitting (T1-T8) and exact ranks."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators.diffs import create_chunks, split_files, with_hunks
from quarry.operators.packing import pack_chunks
from quarry.operators.ranking import ordered_rank


def greedy(weights, blocks, budget, header):
    """Plain-Python statement of the splitter rule."""
    out, cur, start = [], 0, 0
    for i, (w, b) in enumerate(zip(weights, blocks)):
        if i > start and (b or header + cur + w > budget):
            out.append((start, i - 1, cur))
            start, cur = i, 0
        cur += w
    if weights:
        out.append((start, len(weights) - 1, cur))
    return out


def run_pack(spark, cases, budget, header):
    df = spark.createDataFrame([(i, w, b) for i, (w, b) in enumerate(cases)],
                               "id int, w array<bigint>, b array<boolean>")
    rows = df.select("id", pack_chunks(F.col("w"), budget, header, F.col("b")).alias("c")) \
        .orderBy("id").collect()
    return [[(c.first, c.last, c.tokens) for c in r.c] for r in rows]


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=60), st.integers(min_value=0, max_value=10),
       st.integers(min_value=0, max_value=10_000))
def test_pack_matches_reference_rule(spark, budget, header, seed):
    rnd = random.Random(seed)
    cases = []
    for _ in range(40):
        n = rnd.randint(0, 30)
        cases.append(([rnd.randint(0, 25) for _ in range(n)], [rnd.random() < 0.2 for _ in range(n)]))
    got = run_pack(spark, cases, budget, header)
    for (w, b), chunks in zip(cases, got):
        assert chunks == greedy(w, b, budget, header)
        # chunks cover the items in order, each within budget unless alone
        pos = [i for c in chunks for i in range(c[0], c[1] + 1)]
        assert pos == list(range(len(w)))
        for first, last, tok in chunks:
            assert tok == sum(w[first:last + 1])
            assert first == last or header + tok <= budget


def test_pack_edge_cases(spark):
    cases = [([], []), ([500], [False]), ([5, 500, 5], [False, False, False]),
             ([5, 5, 5], [True, True, False]), ([3, 3], [False, True])]
    got = run_pack(spark, cases, 10, 0)
    assert got[0] == []
    assert got[1] == [(0, 0, 500)]                       # lone over-budget item
    assert got[2] == [(0, 0, 5), (1, 1, 500), (2, 2, 5)]  # over-budget in the middle
    assert got[3] == [(0, 0, 5), (1, 2, 10)]              # block start flushes a non-empty chunk
    assert got[4] == [(0, 0, 3), (1, 1, 3)]


DIFF = (
    "diff --git a/x/a.py b/x/a.py\n--- a/x/a.py\n+++ b/x/a.py\n"
    "@@ -1,0 +1,1 @@ def f():\n+one two three\n"
    "@@ -5,0 +6,2 @@\n+four\n+five six\n"
    "@@ -9,0 +11,1 @@ class K:\n+seven\n"
    "diff --git a/y/b.md b/y/b.md\n--- a/y/b.md\n+++ b/y/b.md\n@@ -1 +1 @@\n+doc\n"
    "diff --git a/z/c.sql b/z/c.sql\n--- a/z/c.sql\n+++ b/z/c.sql\n@@ -1,0 +1,1 @@\n+select 1\n"
)


def test_split_files_and_hunks(spark):
    df = spark.createDataFrame([("d1", DIFF)], "diff_id string, text string")
    files = with_hunks(split_files(df)).orderBy("file_idx").collect()
    assert [f.path for f in files] == ["x/a.py", "y/b.md", "z/c.sql"]
    a = files[0]
    assert a.sections == ["def f():", "", "class K:"]
    assert a.is_block == [True, False, True]
    assert a.hunks[1] == "@@ -5,0 +6,2 @@\n+four\n+five six"
    assert a.header_tokens == 8


def test_levels_and_names(spark):
    df = spark.createDataFrame([("d1", DIFF)], "diff_id string, text string")
    whole = create_chunks(df, budget=10_000).collect()
    assert [(c.level, c.chunk_name, c.text) for c in whole] == [(1, "full_diff_chunk_0.diff", DIFF)]
    # budget between the small files and a.py: a.py is split, b.md is skipped
    parts = create_chunks(df, budget=20).orderBy("path", "part").collect()
    names = [(c.level, c.chunk_name) for c in parts]
    assert (2, "c.sql.diff") in names
    assert all(not n.startswith("b.md") for _, n in names)
    a_parts = [c for c in parts if c.path == "x/a.py"]
    assert [c.chunk_name for c in a_parts] == [f"a.py_part_{i}.diff" for i in range(1, len(a_parts) + 1)]
    assert all(c.text.startswith("diff --git a/x/a.py b/x/a.py\n--- a/x/a.py\n+++ b/x/a.py\n")
               for c in a_parts)


def test_ordered_rank_handles_a_hot_group(spark):
    rows = [("hot", f"n{i:05d}") for i in range(3000)] + \
           [(f"g{i % 7}", f"n{i:05d}") for i in range(700)]
    df = spark.createDataFrame(rows, "g string, name string")
    got = ordered_rank(df, ["g"], ["name"], num_partitions=6)
    exp = df.withColumn("rank", (F.row_number().over(Window.partitionBy("g").orderBy("name")) - 1)
                        .cast("bigint"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_empty_diff_has_no_chunks(spark):
    df = spark.createDataFrame([("e", ""), ("n", None), ("d", DIFF)], "diff_id string, text string")
    got = create_chunks(df, budget=10_000).collect()
    assert [r.diff_id for r in got] == ["d"]


def test_long_rows_span_many_pages(spark):
    from quarry.operators import packing
    rnd = random.Random(7)
    n = 4 * packing.PAGE * 5 + 17
    cases = [([rnd.randint(0, 30) for _ in range(n)], [rnd.random() < 0.1 for _ in range(n)]),
             ([rnd.randint(0, 30) for _ in range(n)], [False] * n)]
    got = run_pack(spark, cases, 100, 3)
    for (w, b), chunks in zip(cases, got):
        assert len(chunks) > 2 * packing.PAGE and chunks == greedy(w, b, 100, 3)


def test_ordered_rank_splits_identical_keys(spark):
    rows = [("hot", "same", i) for i in range(4000)] + [("g", "a", 1)]
    df = spark.createDataFrame(rows, "g string, name string, v int")
    got = ordered_rank(df, ["g"], ["name"], num_partitions=8)
    ranks = sorted(r["rank"] for r in got.filter("g = 'hot'").select("rank").collect())
    assert ranks == list(range(4000))
    # the hot run was spread over several range partitions
    parts = df.withColumn("__tie", F.xxhash64("g", "name", "v")) \
        .repartitionByRange(8, "g", "name", "__tie").filter("g = 'hot'") \
        .select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
