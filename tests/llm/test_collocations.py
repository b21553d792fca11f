"""Operator 13 against brute force and its edge cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import op13_collocations as col

SCHEMA = "text string, lang string, grp string, phrase string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(t, g, "x", "y", 1) for t, g in rows], SCHEMA)


def brute(rows, least, most=4, contained=(80, 100), top=None):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, found in counts.items():
        found = {p: c for p, c in found.items() if c >= least}
        inside = lambda p, q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rank = []
        for p, a in found.items():
            if len(p) < 2 or any(len(q) > len(p) and contained[1] * c >= contained[0] * a and inside(p, q)
                                 for q, c in found.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]])
                                        for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), left, right))
        for n, (score, a, phrase, left, right) in enumerate(sorted(rank)[:top]):
            out.append((lang, n + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in col.collocations(df, **more).collect())


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["a", "B", "the", "Ünder", "x\x01", "x", "ß ß", "日本", "#"]
    marks = [" ", " ", " ", "\t ", ", ", ".", "\n", "! ", "\x0b", " "]
    rows = []
    for _ in range(n):
        rows.append(("".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(40))),
                     rng.choice(["en", "de", None, "und", "e n"])))
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(col, "CHUNK", 500)                  # several chunks, also within a batch
    rows = random_rows(400, parts) + [(None, "en"), ("", "en"), ("...", None), ("!", "empty")]
    got = mined(docs(spark, rows).repartition(parts), min_count=6, top=None)
    assert got == brute(rows, 6)


def test_partitions_that_start_inside_a_phrase(spark):
    """One first word and one last word hold nearly all phrases: the walk's
    partitions start among their extensions."""
    rows = [(f"hot w{i} z{i % 7} cold", "en") for i in range(60) for _ in range(3)] + [("hot hot hot hot hot", "en")] * 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert mined(docs(spark, rows), min_count=3, top=None) == brute(rows, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_contained_and_ties(spark):
    rows = [("alpha beta gamma", "en")] * 40 + [("alpha beta", "en")] * 5 + [("beta gamma", "en")] * 20 + [("delta eps", "en")] * 40
    got = mined(docs(spark, rows))
    assert got == brute(rows, 30, top=2000)
    assert {r[2] for r in got} == {"alpha beta gamma", "beta gamma", "delta eps"}      # 40 of 45 is contained, 40 of 60 not
    assert [r[2] for r in mined(docs(spark, rows), top=1)] == ["delta eps"]


def test_overlaps_count(spark):
    rows = [("na " * 35, "en")]
    got = mined(docs(spark, rows), top=None)
    assert got == brute(rows, 30) and got[0][2:4] == ("na na na na", 32)


def test_empty_and_rare(spark):
    assert mined(docs(spark, [])) == []
    assert mined(docs(spark, [("one two three", "en"), (None, None)])) == []


def test_a_full_bitmap_only_spares_less(spark, monkeypatch):
    monkeypatch.setattr(col, "FILTER_BITS", 1 << 15)
    rows = random_rows(200, 9)
    assert mined(docs(spark, rows), min_count=4, top=None) == brute(rows, 4)


def test_very_long_text(spark):
    text = " ".join(f"w{i % 50} q{i % 49}" for i in range(100_000))
    got = mined(docs(spark, [(text, "en")]), top=None)
    assert got == brute([(text, "en")], 30)


def test_score_beyond_64_bits(spark):
    """The score's product is exact where it passes 64 bits."""
    a, both = 4 * 10 ** 13, 9 * 10 ** 13
    x = spark.range(1).select(F.expr(col.score_sql(f"{a}L", f"{both}L")).alias("s"))
    assert x.first()["s"] == 2_000_000 * a // both
