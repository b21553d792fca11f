"""Operator 6 against brute force, and connected components."""

import random
from collections import defaultdict

import pytest

from quarry.llm import op6_lsh_forest as near
from quarry.llm.components import components

from .test_words_and_vectors import plain_shingles

SCHEMA = "doc_id long, text string, node string, n int, component_id string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", "c") for i, t in rows], SCHEMA)


def brute(rows, n=3, similar=(85, 100)):
    sets = [(i, frozenset(plain_shingles(t, n))) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and similar[1] * len(x & y) >= similar[0] * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)].append(i)
    name = lambda a: sets[a][0] if not sets[a][1] else min(least[find(a)], default=None)
    return sorted(((i, len(s), name(a), i == name(a)) for a, (i, s) in enumerate(sets)), key=str)


def made(seed=5, groups=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([2, 5, 40, 120, 400]))]
        for _ in range(rng.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy)))
            i += 1
    shared = " ".join(word() for _ in range(60))                # a passage that many texts share
    rows += [(i + k, shared + " " + " ".join(word() for _ in range(rng.choice([3, 30, 60])))) for k in range(60)]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("seed", [5, 6])
def test_made_groups(spark, seed):
    rows = made(seed)
    assert result(near.near_duplicates(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("block", [1024, 50])
def test_fringe_of_a_large_region(spark, monkeypatch, block):
    """Many near copies of one text, some of them similar to few others, and
    texts that only share a passage with each other."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 220):
        copy = list(base)
        for at in rng.sample(range(2, 98), rng.choice([1, 1, 2, 3, 4, 5])):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    rows += [(300 + i, " ".join(base[:80] + [word() for _ in range(20)])) for i in range(60)]
    rng.shuffle(rows)
    expected = brute(rows)
    assert len({r[2] for r in expected}) > 50
    assert result(near.near_duplicates(table(spark, rows))) == expected


def test_five_words_and_other_limit(spark):
    rows = made(9, 12)
    assert result(near.near_duplicates(table(spark, rows), 5, (80, 100))) == brute(rows, 5, (80, 100))


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(7, None), (8, ""), (9, " \n\t"), (10, "one"), (11, "ONE "), (12, "one two"), (13, "a b c"), (14, "A  B\nC"),
            (14, "a b c"), (None, "a b c"), (None, "alone in the world"), (20, long), (21, long + " more"), (5, long.upper()),
            (30, "x y z q"), (31, "x y z q")]
    assert result(near.near_duplicates(table(spark, rows))) == brute(rows)
    assert near.near_duplicates(table(spark, [])).count() == 0
    assert result(near.near_duplicates(table(spark, [(1, "only one text here")]))) == [(1, 2, 1, True)]


def test_one_of_each(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (2, "a b c d"), (4, "other text of it"), (4, "third text of it"), (9, None),
            (9, None), (None, "words without a number"), (None, "words without a number")]
    docs = table(spark, rows)
    out = near.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(2, "a b c d"), (4, "other text of it"), (4, "third text of it"), (9, None), (None, "words without a number")], key=str)


def test_one_of_each_group_under_one_id_or_none(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (1, text.upper()), (1, text + " more"), (2, text + " again"), (1, "something else entirely"),
            (None, text.replace("w", "n")), (None, text.replace("w", "N")), (None, text.replace("w", "n") + " more"),
            (None, "a b c d"), (5, text.replace("w", "k")), (None, text.replace("w", "k") + " more"), (None, None), (3, "")]
    got = near.one_of_each(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:1].lower()) for r in got) == [
        ("1", "s"), ("1", "w"), ("3", ""), ("5", "k"), ("None", ""), ("None", "a"), ("None", "n")]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1, x) for x in range(2, 90)] + [(300, 300), (90, 89)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    links = defaultdict(set)
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    for start in links:
        seen, todo = {start}, [start]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got.get(start, start) == min(seen)


def test_regions_that_pass_in_pieces():
    """A region cut by the buffer stays large to its last row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    n = 50
    rows = {"region": np.full(n, 7), "k0": np.zeros(n, int), "k1": np.zeros(n, int), "k2": np.zeros(n, int),
            "c0": np.arange(n), "c1": np.zeros(n, int), "n": np.full(n, 10)}
    batches = [pa.RecordBatch.from_arrays([pa.array(v[i:i + 8]) for v in rows.values()], names=list(rows)) for i in range(0, n, 8)]
    out = pa.Table.from_batches(near._candidates((85, 100), most=20)(iter(batches)))
    dense = out.filter(pa.compute.is_valid(out["region"]))
    assert set(dense["a0"].to_pylist()) == set(range(n))
    pairs = out.filter(pa.compute.is_null(out["region"]))
    assert {(i, i + d) for i in range(n) for d in (1, 2, 3) if i + d < n} <= set(
        zip(pairs["a0"].to_pylist(), pairs["b0"].to_pylist()))
