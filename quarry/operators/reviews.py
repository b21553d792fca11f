"""Review pipeline.

Sources are rows ``(file_name, path, text)``; a caller-supplied function
stands in for the model. Calls run per partition through ``mapInPandas``
(Arrow batches); a failure of one row becomes an error row. Spark may
retry a task, so the outside service can see a call more than once
(at-least-once); results are keyed by ``(path, md5(prompt))``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import truncate_chars
from quarry.operators.contract import violations, walk_value
from quarry.operators.ranking import ordered_rank
from quarry.operators.segments import batches_by_size
from quarry.session import ensure_checkpoint_dir
from quarry.sinks.tables import materialize, write_part

# Limits, skip text, severities and JSON contract of the
# reference review job.
MAX_CHARS_FOR_FINAL_SUMMARY = 65_000
SKIP_TEXT = "No code found in file, skipping review."
SEVERITIES = ("Low", "Medium", "High", "Critical")
PLACEHOLDER = "{PY_CONTENT}"
SUMMARY_PLACEHOLDER = "{ALL_REVIEWS_CONTENT}"
# Fixed value: the text that stands for a review that failed.
ERROR_TEXT = "ERROR: Could not generate review for this file. Reason: "
REVIEW_HEADING = "=== change under review ==="

# Own prompt wording; the placeholder contract is what matters.
REVIEW_PROMPT = """Review the following code diff as a senior reviewer.
Only comment on added or changed lines. Rate every finding Low, Medium,
High or Critical, cite the new line number, and keep the whole answer under
65,000 characters, dropping Low findings first if needed.
Answer as JSON with keys summary, detailed_findings, key_recommendations.

=== change under review ===

{PY_CONTENT}
"""
SUMMARY_PROMPT = """Consolidate the individual code reviews below into one
summary: merge repeated issues, keep file names and line numbers, put High
and Critical findings first, stay under 65,000 characters.

=== reviews, one block per file ===

{ALL_REVIEWS_CONTENT}
"""

FINDING = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("line_number", T.DoubleType()),      # JSON number: 12 and 12.0 are the same
    T.StructField("function_context", T.StringType()),
    T.StructField("finding", T.StringType()),
    T.StructField("snippet", T.StringType()),
])
REVIEW = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("detailed_findings", T.ArrayType(FINDING)),
    T.StructField("key_recommendations", T.ArrayType(T.StringType())),
])
TOP_KEYS = ("summary", "detailed_findings", "key_recommendations")
FINDING_KEYS = tuple(f.name for f in FINDING.fields)
REQUIRED = ("file_path", "severity", "line_number", "finding")
STRICT_REQUIRED = (*REQUIRED, "function_context", "snippet")


def review_schema(strict: bool) -> dict:
    """The contract as a JSON Schema. ``detailed_findings`` without its
    items' rules (``finding_schema``), so that one bad finding does not fail the answer."""
    schema = {"type": "object", "required": list(TOP_KEYS), "properties": {
        "summary": {"type": "string"}, "detailed_findings": {"type": "array"},
        "key_recommendations": {"type": "array", "items": {"type": "string"}}}}
    return {**schema, "additionalProperties": False} if strict else schema


def finding_schema(strict: bool) -> dict:
    """The rules of a finding. Optional fields may be null in the lenient form."""
    text = lambda k: {"type": "string" if strict or k in REQUIRED else ["string", "null"]}
    schema = {"type": "object", "required": list(STRICT_REQUIRED if strict else REQUIRED), "properties": {
        **{k: text(k) for k in FINDING_KEYS}, "line_number": {"type": "integer"},
        "severity": {"type": "string", "enum": list(SEVERITIES)}}}
    return {**schema, "additionalProperties": False} if strict else schema


def answer_schema(strict: bool = True) -> dict:
    """The whole contract, for ``contract.violations``."""
    schema = review_schema(strict)
    properties = {**schema["properties"], "detailed_findings": {"type": "array", "items": finding_schema(strict)}}
    return {**schema, "properties": properties}


def is_blank(text: Column) -> Column:
    """empty or whitespace-only source (any Unicode white space)."""
    return ~F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def build_prompts(df: DataFrame, text: str = "text", template: str = REVIEW_PROMPT,
                  placeholder: str = PLACEHOLDER, out: str = "prompt") -> DataFrame:
    """prompt = template with the code in place of the
    placeholder; NULL for blank sources (they get ``SKIP_TEXT``)."""
    t = F.col(text)
    return df.withColumns({
        "is_blank": is_blank(t),
        out: F.when(is_blank(t), F.lit(None).cast("string"))
              .otherwise(F.replace(F.lit(template), F.lit(placeholder), t)),
    })


def call_model(df: DataFrame, fn: Callable[[str], str], prompt: str = "prompt",
               keep: Sequence[str] = ("path",), max_concurrency: int = 1) -> DataFrame:
    """``fn(prompt) -> response`` for every non-NULL prompt.

    Output ``(…keep, prompt_md5, response, error)``: ``error`` holds the
    exception text of a failed call (its ``response`` is NULL); NULL
    prompts pass through with ``response = SKIP_TEXT``. Calls run inside
    each task over Arrow batches; ``max_concurrency`` > 1 overlaps the
    (network-bound) calls of a batch on a thread pool, keeping row order.
    """
    cols = [*keep, prompt]
    schema = T.StructType([df.schema[c] for c in keep] + [
        T.StructField("prompt_md5", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType())])

    def one(p):
        import hashlib
        if p is None:
            return None, SKIP_TEXT, None
        digest = hashlib.md5(p.encode("utf-8")).hexdigest()
        try:
            return digest, fn(p), None
        except Exception as e:  # noqa: BLE001 - per-row isolation
            return digest, None, f"{type(e).__name__}: {e}"

    def run(batches):
        import pandas as pd
        pool = None
        if max_concurrency > 1:
            from concurrent.futures import ThreadPoolExecutor
            pool = ThreadPoolExecutor(max_concurrency)
        try:
            for pdf in batches:
                prompts = list(pdf[prompt])
                outs = list(pool.map(one, prompts)) if pool else [one(p) for p in prompts]
                res = pdf[list(keep)].copy()
                for i, c in enumerate(("prompt_md5", "response", "error")):
                    res[c] = pd.Series([o[i] for o in outs], dtype=object, index=res.index)
                yield res
        finally:
            if pool:
                pool.shutdown()

    return df.select(*cols).mapInPandas(run, schema)


ANSWER = T.StructType([T.StructField("digest", T.StringType()), T.StructField("response", T.StringType())])


def stored_answers(df: DataFrame, path: str) -> DataFrame:
    """The answers ``(digest, response)`` at ``path``, one for each prompt (of
    several the smallest); none if nothing was stored yet."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], ANSWER)
    return spark.read.schema(ANSWER).parquet(path).groupBy("digest").agg(F.min("response").alias("response"))


def call_model_once(df: DataFrame, fn: Callable[[str], str], answers: str, run_id: str, prompt: str = "prompt",
                    keep: Sequence[str] = ("path",), max_concurrency: int = 1) -> DataFrame:
    """T10 with an answer store: as ``call_model``, but equal prompts are
    called once, and prompts whose answer is in the table at ``answers`` not
    at all. New answers are added to the table by run; failed calls are not
    stored, so the next run tries them again.

    Prompts are told apart by their SHA-256. Each run writes a folder of its
    own, whose data appears when it is complete, so a run that broke off leaves
    the answers of the runs before. Two runs at the same time may both call a
    prompt; either answer then stands for both from the next run on."""
    digest = F.sha2(F.col(prompt).cast("binary"), 256)
    asked = df.select(*keep, prompt, digest.alias("__digest"))
    known = stored_answers(df, answers)
    todo = asked.filter(F.col(prompt).isNotNull()).groupBy("__digest").agg(F.min(prompt).alias(prompt)) \
        .join(known.select("digest"), F.col("__digest") == F.col("digest"), "left_anti")
    # staged: a call is not made again when a later step is recomputed
    new = materialize(call_model(todo, fn, prompt, keep=["__digest"], max_concurrency=max_concurrency), "new-answers")
    fresh = new.filter(F.col("error").isNull()).select(F.col("__digest").alias("digest"), "response")
    if not fresh.isEmpty():
        write_part(fresh, answers, f"{run_id}-{uuid.uuid4().hex[:8]}")
    told = stored_answers(df, answers).select("digest", "response", F.lit(None).cast("string").alias("error")).unionByName(
        new.filter(F.col("error").isNotNull()).select(F.col("__digest").alias("digest"), "response", "error"))
    out = asked.join(told, F.col("__digest") == F.col("digest"), "left")
    blank = F.col(prompt).isNull()
    return out.select(*keep, F.md5(F.col(prompt).cast("binary")).alias("prompt_md5"),
                      F.when(blank, F.lit(SKIP_TEXT)).otherwise(F.col("response")).alias("response"), "error")


def split_status(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5 (D12): ``(reviews, errors)`` keyed by the full path."""
    ok = results.filter(F.col("error").isNull())
    bad = results.filter(F.col("error").isNotNull())
    return ok, bad


def parse_reviews(df: DataFrame, text: str = "response") -> DataFrame:
    """Parse the JSON answer and flag contract violations.

    Adds ``review`` (struct), ``is_json`` (well-formed object),
    ``top_ok`` (required top-level keys present, with values of the
    contract's types), ``strict_top_ok`` (no key outside the contract) and, for
    each finding, ``finding_rules``: its violations of the lenient and of the
    strict form. The checks are compiled from JSON Schemas (``contract``).
    """
    t = F.col(text)
    none = lambda found: F.coalesce(F.size(found) == 0, F.lit(False))
    items = F.try_variant_get(F.try_parse_json(t), "$.detailed_findings", "array<variant>")
    rules = F.transform(items, lambda x: F.struct(
        walk_value(x, finding_schema(False)).alias("lenient"), walk_value(x, finding_schema(True)).alias("strict")))
    return df.withColumns({
        "review": F.from_json(t, REVIEW),
        "finding_rules": rules,
        "is_json": F.json_object_keys(t).isNotNull(),
        "top_ok": none(violations(t, review_schema(False))),
        "strict_top_ok": none(violations(t, review_schema(True))),
    })


def findings(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per finding (``finding_idx`` 0-based); a review that is
    not valid JSON keeps one row with NULL finding fields, a review without
    findings has no row. A line number that is no integer is NULL. ``is_strict_valid``
    also requires ``function_context``, ``snippet`` and no key outside the
    contract, at the top level or inside the finding."""
    pairs = F.arrays_zip(F.col("review.detailed_findings").alias("f"),
                         F.col("finding_rules").alias("k"))
    rows = parsed.select(*keep, "is_json", "top_ok", "strict_top_ok",
                         F.posexplode_outer(F.when(F.col("is_json"), pairs)).alias("finding_idx", "z")) \
        .filter(F.col("finding_idx").isNotNull() | ~F.col("is_json"))
    kept = lambda form: F.coalesce(F.size(f"z.k.{form}") == 0, F.lit(False))
    line = F.when(F.col("z.f.line_number") == F.floor("z.f.line_number"), F.col("z.f.line_number")).try_cast("bigint")
    fields = [line.alias(c) if c == "line_number" else F.col(f"z.f.{c}") for c in FINDING_KEYS]
    return rows.select(*keep, "finding_idx", *fields,
                       (F.col("top_ok") & kept("lenient")).alias("is_valid"),
                       (F.col("top_ok") & F.col("strict_top_ok") & kept("strict")).alias("is_strict_valid"))


def severity_rank(sev: Column) -> Column:
    """Critical first, Low last; unknown after Low."""
    return (F.when(sev == "Critical", 1).when(sev == "High", 2).when(sev == "Medium", 3)
             .when(sev == "Low", 4).otherwise(5))


def trim_by_severity(found: DataFrame, review_key: Sequence[str],
                     limit: int = MAX_CHARS_FOR_FINAL_SUMMARY,
                     text: str = "finding") -> DataFrame:
    """Order findings by severity then position, keep them while the
    running length of their text stays within ``limit``.

    The window's partition is one review: its findings come from a single
    model answer, which is itself bounded by the answer limit.
    """
    w = Window.partitionBy(*review_key).orderBy(F.col("sev_rank"), F.col("finding_idx")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = found.withColumn("sev_rank", severity_rank(F.col("severity")))
    ranked = ranked.withColumn("running_chars",
                               F.sum(F.coalesce(F.length(text), F.lit(0)).cast("bigint")).over(w))
    return ranked.filter(F.col("running_chars") <= limit)


def review_block(name: Column, text: Column) -> Column:
    """A13 item: ``--- Review for <name> ---\\n<text>\\n``."""
    return F.concat(F.lit("--- Review for "), name, F.lit(" ---\n"), F.coalesce(text, F.lit("")),
                    F.lit("\n"))


def consolidation_batches(reviews: DataFrame, group: Sequence[str], name: str, text: str,
                          fan_in: int | None = 8, budget: int | None = None, least: int = 1) -> DataFrame:
    """A13/T15 input: reviews of a group in file-name order (D13), cut into
    consecutive batches; each batch's text is its review blocks joined by a
    newline. A batch takes the next reviews up to ``fan_in`` of them and up to
    ``budget`` characters of text (None: no such limit), but ``least`` at least;
    so its text is above the budget only if it holds no more than ``least``.

    Only names, row numbers and lengths are ranked and batched (no single task
    per group); the texts are written once, and joined by their number.
    """
    group = list(group)
    if fan_in is None and budget is None:
        raise ValueError("a batch needs a limit")
    block = review_block(F.col("__name"), F.col("__text"))
    held = reviews.select(*group, F.col(name).alias("__name"), F.col(text).alias("__text"),
                          F.monotonically_increasing_id().alias("__id"))
    held = materialize(held, "reviews-to-batch")                   # the numbers stay what they are
    size = (F.char_length(block) + 1).cast("bigint")               # with the newline between blocks
    narrow = held.select(*group, "__name", "__id", size.alias("__size"))
    limit = None if budget is None else budget + 1
    if fan_in is None:
        placed = batches_by_size(narrow, group, ["__name", "__id"], "__size", limit, least=least)
    else:
        placed = ordered_rank(narrow, group, ["__name"], out="pos", total="__all") \
            .withColumn("batch", F.floor(F.col("pos") / fan_in).cast("bigint")) \
            .withColumn("batches", F.ceil(F.col("__all") / fan_in).cast("bigint"))
        # where every batch of fan_in reviews fits, taking reviews while they fit gives the same batches
        over = limit is not None and not placed.groupBy(*group, "batch").agg(F.sum("__size").alias("s")) \
            .filter(F.col("s") > limit).isEmpty()
        if over:
            placed = batches_by_size(narrow, group, ["__name", "__id"], "__size", limit, most=fan_in, least=least)
    numbers = placed.select(F.col("__id").alias("__of"), "pos", "batch", "batches")
    g = held.join(numbers, F.col("__id") == F.col("__of")).groupBy(*group, "batch").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), block.alias("t")))).alias("items"),
        F.max("batches").alias("group_batches"))
    return g.select(*group, "batch", F.size("items").cast("bigint").alias("n_reviews"), "group_batches",
                    F.array_join(F.transform("items", lambda x: x["t"]), "\n").alias("text"))


def consolidate(reviews: DataFrame, fn: Callable[[str], str], group: Sequence[str],
                name: str = "file_name", text: str = "response", fan_in: int = 8,
                max_chars: int = MAX_CHARS_FOR_FINAL_SUMMARY, budget: int | None = MAX_CHARS_FOR_FINAL_SUMMARY) -> DataFrame:
    """Summary per group, built as a tree: batches of reviews are
    summarised, then batches of those summaries, until one
    remains per group; the result is cut to ``max_chars`` (C16).

    A batch holds up to ``fan_in`` reviews of ``budget`` characters in all,
    so a prompt is bounded: a review above the budget goes alone, and a later
    round takes two summaries at least, so that every round ends with half as
    many. ``fan_in`` is 2 at least. A NULL group has its summary like any other.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more: one review per batch never ends in one summary")
    ensure_checkpoint_dir(reviews.sparkSession)
    level, finals = 0, None
    cur = reviews.select(*group, F.col(name).alias("__name"), F.col(text).alias("__text"))
    while True:
        level += 1
        b = consolidation_batches(cur, group, "__name", "__text", fan_in, budget, least=1 if level == 1 else 2)
        b = b.withColumn("prompt", F.replace(F.lit(SUMMARY_PROMPT), F.lit(SUMMARY_PLACEHOLDER),
                                             F.col("text")))
        # Each round's answers are checkpointed to the shared folder: the
        # model is not called again when a later stage is recomputed.
        done = call_model(b, fn, "prompt", keep=[*group, "batch", "group_batches"]).checkpoint(eager=True)
        several = F.col("group_batches") > 1
        answer = F.coalesce("response", "error")
        fin = done.filter(~several).select(
            *group, F.lit(level).alias("levels"), truncate_chars(answer, max_chars).alias("summary"),
            (F.length(answer) > max_chars).alias("was_truncated"))
        finals = fin if finals is None else finals.unionByName(fin)
        rest = done.filter(several)
        if rest.isEmpty():
            return finals
        cur = rest.select(*group, F.format_string("summary_%019d", F.col("batch")).alias("__name"),
                          answer.alias("__text"))


def stub_reviewer(fail_marker: str = "!") -> Callable[[str], str]:
    """Deterministic model stand-in used by tests and the fixture queries:
    answers a JSON review of the code part of the prompt and fails for
    code containing ``fail_marker``."""

    def review(prompt: str) -> str:
        code = prompt.split(REVIEW_HEADING + "\n\n", 1)[-1]
        if fail_marker and fail_marker in code:
            raise ValueError("model refused the input")
        lines = code.count("\n")
        return json.dumps({"summary": f"{lines} lines, {len(code)} chars",
                           "detailed_findings": [],
                           "key_recommendations": ["keep functions short"]})

    return review
