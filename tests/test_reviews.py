"""Review pipeline: blank files, per-row failures, JSON contract, trim,
consolidation and the directory source."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators.reviews import (SKIP_TEXT, build_prompts, call_model, consolidate,
                                      consolidation_batches, findings, parse_reviews,
                                      split_status, stub_reviewer, trim_by_severity)
from quarry.sources.text import read_text_dir


def sources(spark):
    rows = [("r1", "a.py", "r1/a.py", "x = 1\n"), ("r1", "a.sql", "r1/a.sql", "select 1"),
            ("r1", "b.py", "r1/b.py", "   \n\t"), ("r1", "c.py", "r1/c.py", "boom!")]
    return spark.createDataFrame(rows, "source string, file_name string, path string, text string")


@pytest.mark.parametrize("threads", [1, 4])
def test_blank_skip_and_error_isolation(spark, threads):
    res = call_model(build_prompts(sources(spark)), stub_reviewer("!"),
                     keep=("source", "file_name", "path"), max_concurrency=threads)
    by_path = {r.path: r for r in res.collect()}
    assert by_path["r1/b.py"].response == SKIP_TEXT and by_path["r1/b.py"].error is None
    assert by_path["r1/c.py"].response is None and "refused" in by_path["r1/c.py"].error
    assert json.loads(by_path["r1/a.py"].response)["summary"].startswith("2 lines")
    ok, bad = split_status(res)
    # equal stems a.py / a.sql stay two results (keyed by full path)
    assert sorted(r.path for r in ok.collect()) == ["r1/a.py", "r1/a.sql", "r1/b.py"]
    assert [r.path for r in bad.collect()] == ["r1/c.py"]


ANSWERS = [
    (1, json.dumps({"summary": "s", "detailed_findings": [
        {"file_path": "a", "severity": "Low", "line_number": 3, "finding": "long text here"},
        {"file_path": "a", "severity": "Critical", "line_number": 1, "finding": "bad",
         "function_context": "f", "snippet": "x"}], "key_recommendations": []})),
    (2, json.dumps({"summary": "s", "detailed_findings": [
        {"file_path": "a", "severity": "Severe", "line_number": 3, "finding": "x"},
        {"file_path": "a", "severity": "High", "finding": "no line"}], "key_recommendations": []})),
    (3, '{"summary": "cut'),
    (4, json.dumps({"summary": "s", "detailed_findings": [
        {"file_path": "a", "severity": "High", "line_number": 2, "finding": "y",
         "function_context": "f", "snippet": "x"}], "key_recommendations": [], "extra": 1})),
    (5, json.dumps({"summary": "s", "detailed_findings": [
        {"file_path": "a", "severity": "High", "line_number": 2, "finding": "y",
         "function_context": "f", "snippet": "x", "note": "extra"}], "key_recommendations": []})),
]


def test_contract_validation(spark):
    df = spark.createDataFrame(ANSWERS, "rid int, response string")
    f = findings(parse_reviews(df), keep=["rid"]).orderBy("rid", "finding_idx").collect()
    got = [(r.rid, r.finding_idx, r.is_valid, r.is_strict_valid) for r in f]
    assert got == [(1, 0, True, False), (1, 1, True, True), (2, 0, False, False),
                   (2, 1, False, False), (3, None, False, False), (4, 0, True, False),
                   (5, 0, True, False)]


def test_severity_trim(spark):
    df = spark.createDataFrame(ANSWERS[:1], "rid int, response string")
    f = findings(parse_reviews(df), keep=["rid"])
    kept = trim_by_severity(f, ["rid"], limit=5).collect()
    assert [(r.severity, r.running_chars) for r in kept] == [("Critical", 3)]


def test_consolidation_batches_and_tree(spark):
    rows = [("s", f"f{i:03d}.py", f"review {i}") for i in range(20)] + [("t", "z.py", "only")]
    df = spark.createDataFrame(rows, "source string, file_name string, response string")
    b = consolidation_batches(df, ["source"], "file_name", "response", fan_in=8) \
        .orderBy("source", "batch").collect()
    assert [(r.source, r.batch, r.n_reviews) for r in b] == [("s", 0, 8), ("s", 1, 8), ("s", 2, 4),
                                                             ("t", 0, 1)]
    assert b[0].text.startswith("--- Review for f000.py ---\nreview 0\n\n--- Review for f001.py")
    summ = consolidate(df, lambda p: f"summary of {p.count('--- Review for')}", ["source"],
                       fan_in=8, max_chars=12).orderBy("source").collect()
    assert [(r.source, r.levels, r.summary, r.was_truncated) for r in summ] == [
        ("s", 2, "summary of 3", False), ("t", 1, "summary of 1", False)]
    cut = consolidate(df, lambda p: "x" * 20, ["source"], fan_in=8, max_chars=12) \
        .orderBy("source").collect()
    assert [(r.summary, r.was_truncated) for r in cut] == [("x" * 12, True), ("x" * 12, True)]


def test_contract_types_and_empty_findings(spark):
    rows = [(1, '{"summary": "s", "detailed_findings": [], "key_recommendations": []}'),
            (2, '{"summary": "s", "detailed_findings": [{"file_path": "a", "severity": "Low", "line_number": 12.0, '
                '"finding": "f"}], "key_recommendations": ["r"]}'),
            (3, '{"summary": null, "detailed_findings": [], "key_recommendations": []}'),
            (4, '{"summary": "s", "detailed_findings": [], "key_recommendations": "oops"}'),
            (5, '{"summary": "s", "detailed_findings": {}, "key_recommendations": []}'), (6, "[1]"), (7, "nonsense"), (8, None)]
    parsed = parse_reviews(spark.createDataFrame(rows, "rid int, response string"))
    assert {r.rid: (bool(r.is_json), r.top_ok) for r in parsed.collect()} == {
        1: (True, True), 2: (True, True), 3: (True, False), 4: (True, False), 5: (True, False),
        6: (False, False), 7: (False, False), 8: (False, False)}
    got = {(r.rid, r.finding_idx, r.line_number, r.is_valid) for r in findings(parsed, ["rid"]).collect()}
    assert got == {(2, 0, 12, True), (6, None, None, False), (7, None, None, False), (8, None, None, False)}


def test_null_groups_and_fan_in(spark):
    rows = [(None, "a.py", "x"), (None, "b.py", "y"), ("g", "c.py", "z"), (None, "d.py", "w")]
    df = spark.createDataFrame(rows, "source string, file_name string, response string")
    got = {r.source: (r.levels, r.summary) for r in consolidate(
        df, lambda p: str(p.count("--- Review for ")), ["source"], fan_in=2).collect()}
    assert got == {None: (2, "2"), "g": (1, "1")}
    with pytest.raises(ValueError):
        consolidate(df, str, ["source"], fan_in=1)


def test_unicode_blanks_are_blank(spark):
    df = spark.createDataFrame([("\u00a0\u2003\n",), ("\u00a0x",), (None,), ("",)], "text string")
    assert [r.is_blank for r in build_prompts(df).collect()] == [True, False, True, True]


def test_text_directory_source(spark):
    d = tempfile.mkdtemp(prefix="quarry-src-")
    for name, text in [("a.py", "print(1)\n"), ("b.sql", "select 1;"), ("c.md", "# no"), ("e.py", "")]:
        with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    files = read_text_dir(spark, d).orderBy("file_name").collect()
    assert [(f.file_name, f.text) for f in files] == [("a.py", "print(1)\n"), ("b.sql", "select 1;"),
                                                     ("e.py", "")]
    blank = build_prompts(read_text_dir(spark, d)).filter(F.col("is_blank")).collect()
    assert [r.file_name for r in blank] == ["e.py"]
