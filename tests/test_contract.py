"""The contract compiler and the answer store."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators.contract import violations
from quarry.operators.reviews import (SKIP_TEXT, answer_schema, build_prompts, call_model, call_model_once, findings,
                                      parse_reviews, stored_answers)

SCHEMA = {"type": "object", "required": ["a", "list"], "additionalProperties": False, "properties": {
    "a": {"type": "string", "enum": ["x", "y"]}, "n": {"type": ["integer", "null"], "minimum": 0, "maximum": 9},
    "s": {"type": "string", "minLength": 2, "maxLength": 3}, "b": {"type": "boolean"}, "any": {},
    "list": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {
        "k": {"type": "number"}, "deep": {"type": "array", "items": {"type": "string"}}}}}}}
CASES = [
    ('{"a": "x", "list": []}', []),
    ('{"a": "x", "n": null, "list": [{"k": 1}, {"k": 1.5, "deep": ["t"]}]}', []),
    ('{"a": "z", "n": 3.0, "list": []}', ["$.a: enum"]),
    ('{"a": 5, "n": 3.5, "list": {}}', ["$.a: type", "$.n: type", "$.list: type"]),
    ('{"a": null}', ["$.list: required", "$.a: type"]),
    ('{"n": 11, "s": "long one", "b": 1, "more": 1, "also": 2, "list": [1, {"k": "t"}, {}, {"k": 2, "deep": ["a", 3, null]}]}',
     ["$.a: required", "$.n: maximum", "$.s: maxLength", "$.b: type", "$.list[0]: type", "$.list[1].k: type", "$.list[2].k: required",
      "$.list[3].deep[1]: type", "$.list[3].deep[2]: type", "$.also: additionalProperties", "$.more: additionalProperties"]),
    ('{"a": "x", "n": -1, "s": "é", "any": [1, {"z": 2}], "list": []}', ["$.n: minimum", "$.s: minLength"]),
    ("[1]", ["$: type"]), ("not json", ["$: json"]), ("", ["$: json"]), ("null", ["$: type"]), (None, None),
    ('{"a": "x", "n": 99999999999999999999, "list": []}', ["$.n: maximum"]),
]


def test_violations(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", violations(F.col("t"), SCHEMA).alias("v")).collect()}
    for i, (text, expected) in enumerate(CASES):
        assert got[i] == expected if expected is None else sorted(got[i]) == sorted(expected), text


def test_unknown_keywords_are_refused():
    with pytest.raises(ValueError):
        violations(F.lit("{}"), {"type": "object", "oneOf": []})
    with pytest.raises(ValueError):
        violations(F.lit("{}"), {"enum": [1]})


def finding(**changed):
    f = {"file_path": "a.py", "severity": "Low", "line_number": 3, "function_context": "f", "finding": "t", "snippet": "s", **changed}
    return {k: v for k, v in f.items() if v != "drop"}


def test_types_inside_findings(spark):
    cases = [(finding(), True, True), (finding(file_path=5), False, False), (finding(line_number="3"), False, False),
             (finding(line_number=3.0), True, True), (finding(line_number=3.5), False, False), (finding(severity="low"), False, False),
             (finding(snippet=None), True, False), (finding(snippet="drop"), True, False), (finding(note="x"), True, False),
             (finding(finding=["t"]), False, False), (finding(function_context=7), False, False)]
    answer = json.dumps({"summary": "s", "detailed_findings": [c[0] for c in cases], "key_recommendations": []})
    found = findings(parse_reviews(spark.createDataFrame([(1, answer)], "id int, response string")), ["id"]).orderBy("finding_idx").collect()
    assert [(r.is_valid, r.is_strict_valid) for r in found] == [c[1:] for c in cases]
    paths = spark.range(1).select(F.explode(violations(F.lit(answer), answer_schema())).alias("v")).collect()
    assert {r.v for r in paths} >= {"$.detailed_findings[1].file_path: type", "$.detailed_findings[8].note: additionalProperties",
                                    "$.detailed_findings[7].snippet: required", "$.detailed_findings[5].severity: enum"}


def counting(folder, fail=""):
    def fn(prompt):
        import uuid
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if fail and fail in prompt:
            raise ValueError("no")
        return f"answer {len(prompt)}"
    return fn


def test_each_prompt_is_called_once(spark, tmp_path):
    calls, store = str(tmp_path / "calls"), str(tmp_path / "answers")
    os.makedirs(calls)
    rows = [(f"p{i}", "same code" if i % 3 else f"code {i}") for i in range(30)] + [("blank", " "), ("bad", "boom"), ("bad2", "boom")]
    prompts = build_prompts(spark.createDataFrame(rows, "path string, text string"))
    plain = {r.path: (r.prompt_md5, r.response, r.error) for r in call_model(prompts, counting(str(tmp_path), "boom")).collect()}
    one = call_model_once(prompts, counting(calls, "boom"), store, "r1").collect()
    assert {r.path: (r.prompt_md5, r.response, r.error) for r in one} == plain and len(one) == len(rows)
    assert len(os.listdir(calls)) == 12                       # 10 of their own, the repeated one and the failing one
    again = call_model_once(prompts, counting(calls, "boom"), store, "r1").collect()
    assert {r.path: (r.prompt_md5, r.response, r.error) for r in again} == plain
    assert len(os.listdir(calls)) == 13                       # only the failed call is tried again
    mended = {r.path: r for r in call_model_once(prompts, counting(calls), store, "r2").collect()}
    assert mended["bad"].error is None and mended["bad"].response == mended["bad2"].response and mended["blank"].response == SKIP_TEXT
    assert len(os.listdir(calls)) == 14
    call_model_once(prompts, counting(calls, "code"), store, "r3").collect()
    assert len(os.listdir(calls)) == 14                       # a rerun calls nothing
    assert stored_answers(prompts, store).count() == 12


def test_a_new_file_is_the_only_call(spark, tmp_path):
    calls, store = str(tmp_path / "calls"), str(tmp_path / "answers")
    os.makedirs(calls)
    df = spark.createDataFrame([("a", "x = 1")], "path string, text string")
    call_model_once(build_prompts(df), counting(calls), store, "r1").collect()
    more = df.unionByName(spark.createDataFrame([("b", "y = 2")], "path string, text string"))
    out = call_model_once(build_prompts(more), counting(calls), store, "r2").collect()
    assert len(os.listdir(calls)) == 2 and all(r.response for r in out)
