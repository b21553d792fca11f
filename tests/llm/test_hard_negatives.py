"""Operator 11 against brute force, its bounds, its pruning and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import op11_zone_mapped_negatives as mining

SCHEMA = "vec_id long, embedding array<float>, label int, id string, block string, file string, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "b", "f", 1.0) for i, v, y in rows], SCHEMA)


def mine(spark, rows, **more):
    df = mining.mine(table(spark, rows), F.col("vec_id") % 100 == 0, **more)
    return sorted(tuple(r) for r in df.collect())


def usable(rows):
    out = []
    for i, v, y in rows:
        if i is None or y is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        out.append((i, [math.floor(256 * float(np.float32(x))) for x in v], y))
    width = max([len(v) for _, v, _ in out], default=0)
    return [(i, v + [0] * (width - len(v)), y) for i, v, y in out]


def brute(rows, positives=5, negatives=10):
    rows = usable(rows)
    out = []
    for a in sorted({i for i, _, _ in rows if i % 100 == 0}):
        av, ay = min((v, y) for i, v, y in rows if i == a)
        scored = [(-sum(x * z for x, z in zip(av, v)), i, y) for i, v, y in rows if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == ay)[:positives]:
            fit = sorted(x for x in scored if x[2] != ay and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


def clusters(n, labels, seed, spread=0.4, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dims))
    y = rng.integers(0, labels, n)
    v = centres[y] + spread * rng.standard_normal((n, dims))
    return [(i, [float(x) for x in v[i]], int(y[i])) for i in range(n)]


def small_blocks(monkeypatch):
    monkeypatch.setattr(mining, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mining, "FILE_ROWS", 32)
    monkeypatch.setattr(mining, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(mining, "ZONE_FILES", 2)


def test_equals_brute_force_with_edges(spark, monkeypatch):
    small_blocks(monkeypatch)
    rows = clusters(620, 4, 1)
    same = rows[5][1]
    rows += [(700 + i, same, i % 2) for i in range(12)]                       # ties
    rows += [(701, same, 0), (300, same, 1), (300, rows[9][1], 2)]            # repeated rows, also of an anchor
    rows += [(900, None, 1), (1000, same, None), (1100, [float("nan")] * 8, 1), (1200, [None] + [1.0] * 7, 1),
             (None, same, 1), (1300, [0.0] * 8, 1), (1400, [], 1), (1500, [2.0, 1.0], 1), (1600, [float("inf")] * 8, 0)]
    assert mine(spark, rows) == brute(rows)


def test_label_without_others_and_small_tables(spark):
    assert mine(spark, []) == []
    assert mine(spark, [(100, [1.0, 0.5], 1)]) == []
    assert mine(spark, [(100, [1.0, 0.5], 1), (1, [1.0, 1.0], 1)]) == []               # no negatives
    assert mine(spark, [(100, [1.0, 0.5], 1), (1, [1.0, 1.0], 2)]) == []               # no positives
    rows = [(100, [1.0, 0.5], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [9.0, 9.0], 2), (4, [-1.0, -1.0], 2)]
    assert mine(spark, rows) == brute(rows) == [(100, 1, 1, 2, 98304, 49152)]


def test_negative_and_zero_positive_scores(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 2), (4, [0.0, 0.0], 2), (5, [-0.5, 0.0], 2)]
    assert mine(spark, rows) == brute(rows)
    assert {r[1] for r in brute(rows)} == {2}                  # score 0: negatives of score 0; below 0: an empty window


def test_large_numbers(spark):
    rows = [(i, [float(i) * 3e3, 2e3 - i], i % 3) for i in range(0, 900, 50)]
    assert mine(spark, rows) == brute(rows)
    with pytest.raises(OverflowError):
        mine(spark, [(100, [1e30], 1), (1, [1e30], 2)])


def test_bounds_hold_every_row():
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (60, 5)).astype(float)
    a = rng.integers(-500, 500, (20, 5)).astype(float)
    least, most = mining.score_bounds(a, x.min(0)[None], x.max(0)[None])
    scores = a @ x.T
    assert (scores >= least).all() and (scores <= most).all()
    corner = np.where(a[0] > 0, x.max(0), x.min(0))
    assert most[0, 0] == a[0] @ corner


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 2), (3, 3), (5, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = mining.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    """On clustered vectors most blocks are not read, and the result is exact."""
    small_blocks(monkeypatch)
    rows = clusters(1200, 12, 4, spread=0.05)
    asked = []
    choose = mining.Blocks.choose

    def counted(self, anchors, same, seeds):
        out = choose(self, anchors, same, seeds)
        if seeds is None:
            n = out.agg(F.sum(F.size("blocks"))).first()[0]
            asked.append((same, n / anchors.count(), self.zones.select("block").distinct().count()))
        return out

    monkeypatch.setattr(mining.Blocks, "choose", counted)
    assert mine(spark, rows) == brute(rows)
    for same, per_anchor, blocks in asked:
        assert per_anchor < (0.1 if same else 0.6) * blocks


def test_only_chosen_files_are_joined(spark, monkeypatch):
    small_blocks(monkeypatch)
    df = table(spark, clusters(400, 4, 5))
    rows = df.select(F.col("vec_id").alias("id"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>").alias("vec"))
    b = mining.Blocks(rows)
    b.chunks = 1
    anchors = rows.filter("id = 100").select("id", "label", "vec", F.lit(0).alias("chunk"), F.array(F.lit(-10 ** 9)).cast("array<bigint>").alias("lows"),
                                             F.array(F.lit(10 ** 9)).cast("array<bigint>").alias("tops"))
    chosen = b.choose(anchors, True, 1)
    assert chosen.count() == 1 and chosen.first()["chunk"] == 0
    found = b.read(anchors, chosen, True, 3).collect()
    held = {r["id"] for r in b.table.filter(F.col("block").isin(chosen.first()["blocks"])).collect()}
    assert {r["found"] for r in found} <= held
