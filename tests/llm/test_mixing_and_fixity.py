"""Operators 3 and 4: SQL twins, brute force and edge cases."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import op3_temperature_mixing as mix
from quarry.llm import op4_merkle_fixity as warc
from quarry.llm import catalog  # noqa: F401  (registers every query)
from quarry.llm.common import ORACLES, QUERIES
from tests.conftest import SF001


def rows_of(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    assert rows_of(QUERIES[name](spark, SF001).toPandas()) == rows_of(con.sql(ORACLES[name]).df())


# -- 3

def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 1) for i, s, t in rows], "doc_id long, source string, text string, src string, block int")


def corpus():
    rows = [(i, "big", "word " * 20) for i in range(400)]
    rows += [(1000 + i, "mid", "a b c d e") for i in range(200)]
    rows += [(2000 + i, None, "one two") for i in range(100)]
    rows += [(3000 + i, "", "one") for i in range(50)]
    return rows + [(4000, "mute", None), (4001, "mute", ""), (None, "big", "x y"), (7, "big", "word " * 20)]


def test_exponent_reaches_its_targets(spark):
    tokens = {"a": 80000, "b": 9000, "c": 400, "d": 20}
    stats = spark.createDataFrame(list(tokens.items()), "source string, tokens long")

    def weights(a):
        z = sum(t ** a for t in tokens.values())
        return {s: t ** a / z for s, t in tokens.items()}

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    a = mix.exponent(stats, target_entropy=1.2)
    assert entropy(a) >= 1.2 - 1e-5 and entropy(a + 2e-5) < 1.2
    assert mix.exponent(stats, target_entropy=9.0) == 0.0                       # flatter than flat
    a = mix.exponent(stats, max_repeats=3.0)
    repeats = lambda a: max((t / 80000) ** (a - 1) for t in tokens.values())
    assert repeats(a) <= 3.0 + 1e-5 < repeats(a - 1e-5) + 1e-3
    a = mix.exponent(stats, max_repeats=2.0, budget=100000.0)
    assert max(w * 100000 / tokens[s] for s, w in weights(a).items()) <= 2.0 + 1e-4
    assert mix.exponent(stats, target_entropy=1.2, max_repeats=1.5) == max(
        mix.exponent(stats, target_entropy=1.2), mix.exponent(stats, max_repeats=1.5))
    assert mix.exponent(stats.limit(0), max_repeats=2.0) == 1.0
    assert mix.exponent(stats) == 1.0


def test_draw(spark):
    rows = corpus()
    out = mix.draw(docs(spark, rows), max_repeats=2.0)
    assert [c for c in out.columns if c not in mix.RESULT] == ["doc_id", "source", "text", "src"]
    got = out.toPandas()
    first = got[got["pass"] == 0]
    key = lambda f: sorted((str(i), str(s), str(t)) for i, s, t in f)
    plain = [(float(i) if i is not None else float("nan"), s, t) for i, s, t in rows]
    assert key(first[["doc_id", "source", "text"]].itertuples(index=False)) == key(plain)     # no document is lost
    for source, part in got.groupby("source", dropna=False):
        total = first[first.source.isna()].tokens.sum() if source != source else first[first.source == source].tokens.sum()
        if not total:
            assert len(part) == 2
            continue
        quota = part.quota.iloc[0]
        drawn = part.tokens.sum()
        assert drawn <= quota <= 2 * total + 1 and quota >= total
        blocks = part.groupby(["pass", "block"]).tokens.sum()
        assert quota - drawn <= max(part[part["pass"] == 0].groupby("block").tokens.sum().max(), 0)
        for p, run in part.drop_duplicates(["pass", "block"]).groupby("pass"):
            run = run.sort_values("block_start")                   # blocks follow one another without gaps
            assert run.block_start.tolist() == [0, *blocks[p].reindex(run.block).cumsum().tolist()[:-1]]
    orders = [got[(got.source == "") & (got["pass"] == p)].drop_duplicates("block").sort_values("block_start").block.tolist()
              for p in (0, 1)]
    assert orders[0][:len(orders[1])] != orders[1]                  # each pass has its own permutation


def test_draw_with_a_small_budget_and_no_rows(spark):
    got = mix.draw(docs(spark, corpus()), max_repeats=2.0, budget=3000.0).toPandas()
    assert 0.8 * 3000 <= got.tokens.sum() <= 3002
    assert mix.draw(docs(spark, []), max_repeats=2.0).count() == 0
    assert mix.draw(docs(spark, [(1, None, None)]), max_repeats=2.0).count() == 1


# -- 4

RECORD = "file long, place long, id long, length long, digest string"


def tables(spark, good, bad):
    make = lambda rows: warc.leaves(spark.createDataFrame(rows, RECORD))
    return make(good), make(bad)


def test_equal_and_empty_replicas(spark):
    rows = [(i // 5, i, i, 10 + i, f"d{i}") for i in range(23)]
    assert warc.audit(*tables(spark, rows, rows)).count() == 0
    assert warc.audit(*tables(spark, [], [])).count() == 0
    assert {r.kind for r in warc.audit(*tables(spark, rows, [])).collect()} == {"missing"}
    extra = warc.audit(*tables(spark, [], rows)).collect()
    assert {r.kind for r in extra} == {"extra"} and len(extra) == 23


def test_damage_is_located(spark):
    good = [(i // 40, i, i if i != 90 else None, 10, f"d{i}") for i in range(5000)]
    good += [(3, 10000 + k, 7777, 5, "same") for k in range(3)]                 # one id three times
    bad = [(f, p, i, 12 if p == 205 else n, "broken" if p in (17, 90, 205) else d) for f, p, i, n, d in good if p != 399]
    bad += [(124, 20000, 99999, 3, "new")]
    got = {(r.file, r.id, r.kind) for r in warc.audit(*tables(spark, good, bad)).collect()}
    moved = {(5, i, "moved") for i in range(206, 240)}
    assert got == {(0, 17, "changed"), (2, None, "changed"), (5, 205, "changed"), (9, 399, "missing"),
                   (124, 99999, "extra")} | moved


def test_packing_and_records(spark):
    pages = spark.createDataFrame([(3, "u", "é"), (None, None, None), (1, "u", ""), (1, "u", "")],
                                  "id long, url string, html string")
    record = warc.warc_record(F.col("id"), F.col("url"), F.col("html"))
    text = [r[0] for r in pages.select(record).collect()]
    assert text[0].endswith("Content-Length: 2\r\n\r\né\r\n\r\n") and "urn:page:3>" in text[0]
    assert text[1].endswith("Content-Length: 0\r\n\r\n\r\n\r\n")
    packed = warc.packed(pages.select("id", F.octet_length(record).alias("length"), warc.sha256(record).alias("digest")),
                         "id", 2).collect()
    assert sorted((r.file, r.place) for r in packed) == [(0, 0), (0, 1), (1, 2), (1, 3)]


