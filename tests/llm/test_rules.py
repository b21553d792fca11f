"""Operator 12: measures and cutoffs against brute force, edge cases."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import op12_risk_controlled_rules as rules

DOCS = "doc_id long, text string, lang string, m string, stratum string, word string, windows string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "m", "s", "w", "x") for i, t, g in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame([(i, q, 0) for i, q in rows], "doc_id long, quality int, toxic int")


def brute_measures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def texts():
    rng = random.Random(12)
    out = [None, "", " \n\t ", "one", "a b c d e f g", "a b c d e f g h", "a " * 30, "x\ny\nx\n\n\ny \nx", "日本 ü# $%&|<> 𝒳 \x0b z\x0c"]
    for _ in range(60):
        base = [rng.choice(["the", "of", "Ünd", "#x", "y.", "z"]) for _ in range(rng.randrange(1, 60))]
        out.append(" ".join(base) + rng.choice(["\n", " ", "\n\n"]) + " ".join(base[rng.randrange(len(base)):] * rng.randrange(3)))
    out.append(" ".join(f"w{i % 3000}" for i in range(20_000)))
    return out


def test_measures_equal_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    got = rules.measured(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "stratum", "word", "windows", "m"]
    for r in got.select("doc_id", "m").collect():
        assert r["m"].asDict() == brute_measures(rows[r["doc_id"]][1]), rows[r["doc_id"]]


def binomial(n, x, p):
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(x + 1))


def test_exact_binomial(spark):
    cases = [(n, x, p) for n in (1, 7, 50, 400) for x in (0, 1, 3, 19) if x <= n for p in (0.0125, 0.05, 0.3)]
    for p in (0.0125, 0.05, 0.3):
        df = spark.createDataFrame([(n, x) for n, x, q in cases if q == p], "n long, x long")
        for r in df.select("n", "x", rules.at_most(F.col("n"), F.col("x"), p).alias("v")).collect():
            expected = 1.0 if r["x"] > r["n"] * p else binomial(r["n"], r["x"], p)
            assert r["v"] == pytest.approx(expected, rel=1e-9)
    big = spark.createDataFrame([(2_000_000, 24_000)], "n long, x long")          # underflows outside logarithms
    assert 0 < big.select(rules.at_most(F.col("n"), F.col("x"), 0.0125)).first()[0] < 1e-9


def holdout(spark, values):
    """Rows of (stratum, measure in thousandths)."""
    return spark.createDataFrame([(s, (1000, v)) for s, v in values], "stratum string, m struct<n_words: bigint, v: bigint>")


def test_cutoffs_control_the_risk(spark):
    """The cutoff is the last one before the first that fails its test."""
    one = {"r": (lambda m: m["v"], (900, 500, 200, 100))}
    rng = random.Random(3)
    values = [("en", rng.choice([0, 0, 0, 50, 150, 150, 300, 600])) for _ in range(900)]
    values += [("de", v) for v in [0] * 400 + [550] * 2] + [("few", 0)] * 20
    got = {r["stratum"]: r for r in rules.choose_cutoffs(holdout(spark, values), one, risk=0.2, delta=0.05).collect()}
    for stratum in ("en", "de", "few"):
        mine = [v for s, v in values if s == stratum]
        cutoff = None
        for c in (900, 500, 200, 100):
            if binomial(len(mine), sum(v > c for v in mine), 0.2) > 0.05 / 3:
                break
            cutoff = c
        assert got[stratum]["cutoff"] == cutoff
    assert got["en"]["cutoff"] == 500 and got["de"]["cutoff"] == 100
    assert got["few"]["cutoff"] is not None        # 0.8 ** 20 is below 0.05 / 3
    tight = rules.choose_cutoffs(holdout(spark, values), one, risk=0.05, delta=0.05)
    assert {r["stratum"]: r["cutoff"] for r in tight.collect()}["few"] is None      # 0.95 ** 20 proves nothing


def test_strata_share_the_error(spark):
    """More strata make each test stricter (Bonferroni)."""
    one = {"r": (lambda m: m["v"], (10,))}
    alone = rules.choose_cutoffs(holdout(spark, [("s0", 0)] * 60), one, risk=0.05, delta=0.05).collect()
    many = rules.choose_cutoffs(holdout(spark, [(f"s{k}", 0) for k in range(8) for _ in range(60)]), one, risk=0.05, delta=0.05).collect()
    assert alone[0]["cutoff"] == 10 and all(r["cutoff"] is None for r in many)


def plain(rng, n=40):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + rng.choice(["", "s", "ed"]) for _ in range(n))


def odd(marks):
    return "".join(f" {marks}{k}" for k in range(60))


def test_query_form_and_edges(spark):
    rng = random.Random(7)
    rows = [(i, plain(rng), "en") for i in range(700)]
    rows += [(1000 + i, plain(rng) + odd("$$$"), "en") for i in range(20)]             # symbols
    rows += [(2000, None, "en"), (2001, "", None), (None, plain(rng), None), (2002, "few words", "en"), (2003, plain(rng, 9) + (" " + plain(rng, 9)) * 1, "en")]
    rows += [(2004, ("same eight words again and again they come " * 9).strip(), "en"), (5, rows[5][1], "en"), (6, plain(rng) + odd("%%%"), "en")]
    marks = [(i, 1) for i in range(700)] + [(1000 + i, 0) for i in range(20)] + [(None, 1), (3, None), (7, 0), (7, 1), (99999, 1)]
    out = rules.risk_controlled(docs(spark, rows), labels(spark, marks)).collect()
    assert len(out) == len(rows)
    assert out[0].asDict().keys() == {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["kept"] for i in range(700) if i != 6 for r in by[i])
    assert not any(r["kept"] for i in range(1000, 1020) for r in by[i])                  # rejected by the symbol cutoff
    assert sorted(r["kept"] for r in by[6]) == [False, True]                             # two texts under one id
    for i in (2000, 2001, 2002, 2003, 2004):
        assert by[i][0]["base_failed"] and not by[i][0]["kept"]
    assert by[None][0]["kept"]                                                           # stratum without labels
    assert len(by[5]) == 2 and by[5][0] == by[5][1]


def test_copies_prove_once(spark):
    rng = random.Random(8)
    text = plain(rng)
    d = docs(spark, [(i, text, "en") for i in range(900)]).select(
        "doc_id", "text", F.col("lang").alias("stratum"), F.md5("text").alias("digest"))
    held = rules.good_documents(rules.measured(d), labels(spark, [(i, 1) for i in range(900)]))
    assert held.count() == 1


def test_no_labels_and_no_documents(spark):
    rng = random.Random(9)
    rows = [(1, plain(rng) + odd("$$$"), "en"), (2, "short", "en")]
    out = {r["doc_id"]: r["kept"] for r in rules.risk_controlled(docs(spark, rows), labels(spark, [])).collect()}
    assert out == {1: True, 2: False}
    assert rules.risk_controlled(docs(spark, []), labels(spark, [(1, 1)])).count() == 0
