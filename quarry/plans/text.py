"""Text-pipeline queries on the test tables (q32-q43, q46).

Documents stand in for source files (``doc<id>.py|sql|md`` under their
``source``), for files of a diff (lines = hunks) and, through
``fixtures.diffs``, for whole unified diffs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import parse_day_or_null
from quarry.functions.safe import safe_add, safe_divide
from quarry.functions.text import (WORD_PUNCT, base_name, stem, token_count, truncate_chars,
                                   truncate_tokens)
from quarry.operators.diffs import (create_chunks, is_reviewable, plan_levels, split_files,
                                    with_hunks)
from quarry.operators.ml import fold_col, stratified_split
from quarry.operators.contract import violations
from quarry.operators.packing import pack_chunks
from quarry.operators.reviews import (ERROR_TEXT, REVIEW_PROMPT, answer_schema, build_prompts, call_model,
                                      consolidate, consolidation_batches, findings,
                                      parse_reviews, stub_reviewer, trim_by_severity)
from quarry.plans.jobs import review_tables
from quarry.plans.fixtures import DIFF_EXTS, DIFF_LINES_SQL, FILE_LINES, Tables, diffs
from quarry.plans.registry import query

TRUNCATE_TOKENS = 500
PACK_BUDGET = 200
LEVEL_BUDGET = 400
TRIM_LIMIT = 15
FAN_IN = 8
FAIL_MARKER = "!"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- sources

def source_files(t: Tables) -> DataFrame:
    """Documents as files: ``(source, file_name, path, text)``."""
    ext = F.element_at(F.array(*[F.lit(x) for x in DIFF_EXTS]),
                       (F.col("doc_id") % len(DIFF_EXTS) + 1).cast("int"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return t.documents.select("source", name.alias("file_name"),
                              F.concat(F.col("source"), F.lit("/"), name).alias("path"), "text")


SOURCE_FILES_SQL = f"""source_files AS (
  SELECT source, 'doc' || doc_id || '.' || ['{DIFF_EXTS[0]}', '{DIFF_EXTS[1]}', '{DIFF_EXTS[2]}'][doc_id % 3 + 1] AS file_name,
         source || '/doc' || doc_id || '.' || ['{DIFF_EXTS[0]}', '{DIFF_EXTS[1]}', '{DIFF_EXTS[2]}'][doc_id % 3 + 1] AS path,
         text
  FROM documents)"""


# q32 ---------------------------------------------------------------------
@query("q32_token_counts", rf"""
SELECT doc_id,
       CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS ws_tokens,
       CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')) AS BIGINT) AS wp_tokens,
       len(p) > {TRUNCATE_TOKENS} AS truncated,
       md5(CASE WHEN len(p) <= {TRUNCATE_TOKENS} THEN text
                ELSE array_to_string(p[1:{TRUNCATE_TOKENS}], '') END) AS head_md5
FROM (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+') AS p FROM documents)""")
def q32(spark, root):
    d = Tables(spark, root).documents
    ws = token_count("text")
    return d.select("doc_id", ws.alias("ws_tokens"), token_count("text", WORD_PUNCT).alias("wp_tokens"),
                    (ws > TRUNCATE_TOKENS).alias("truncated"),
                    F.md5(truncate_tokens("text", TRUNCATE_TOKENS)).alias("head_md5"))


# q33 ---------------------------------------------------------------------
@query("q33_split_files_hunks", rf"""WITH {DIFF_LINES_SQL}
SELECT 'doc' || doc_id AS diff_id, CAST(file_idx AS INTEGER) AS file_idx, path,
       regexp_replace(path, '^.*/', '') AS file_name,
       regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') AS file_stem,
       (path LIKE '%.py' OR path LIKE '%.sql') AS reviewable,
       count(*) AS n_hunks,
       CAST(count_if(regexp_matches(trim(section), '^(class|def)\s+')) AS BIGINT) AS n_blocks,
       CAST(sum(len(regexp_extract_all(hunk, '\S+'))) AS BIGINT) AS hunk_tokens,
       CAST(max(hdr_tokens) AS BIGINT) AS header_tokens
FROM diff_hunks GROUP BY doc_id, file_idx, path""")
def q33(spark, root):
    files = with_hunks(split_files(diffs(Tables(spark, root))))
    return files.select(
        "diff_id", "file_idx", "path", base_name(F.col("path")).alias("file_name"),
        stem(F.col("path")).alias("file_stem"), is_reviewable(F.col("path")).alias("reviewable"),
        F.size("hunks").cast("bigint").alias("n_hunks"),
        F.size(F.filter("is_block", lambda b: b)).cast("bigint").alias("n_blocks"),
        F.aggregate("hunk_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("hunk_tokens"),
        "header_tokens")


# q34 / q35 ----------------------------------------------------------------
def _pack_lines(spark, root, blocks: bool):
    d = Tables(spark, root).documents
    lines = F.split(F.col("text"), "\n")
    w = F.transform(lines, lambda ln: token_count(ln))
    b = F.transform(lines, lambda ln: ln.rlike("^A")) if blocks else None
    packed = d.select("doc_id", F.posexplode(pack_chunks(w, PACK_BUDGET, 0, b)).alias("pos", "c"))
    return packed.select("doc_id", (F.col("pos") + 1).alias("chunk"), F.col("c.tokens").alias("tokens"),
                         (F.col("c.last") - F.col("c.first") + 1).cast("bigint").alias("lines"))


def _pack_sql(block_expr: str) -> str:
    return rf"""WITH RECURSIVE
lines AS (SELECT doc_id, unnest(arr) AS line, generate_subscripts(arr, 1) - 1 AS pos
          FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents)),
w AS (SELECT doc_id, pos, CAST(len(regexp_extract_all(line, '\S+')) AS BIGINT) AS w,
             {block_expr} AS b FROM lines),
walk AS (
  SELECT doc_id, pos, w, 1 AS chunk, w AS cur FROM w WHERE pos = 0
  UNION ALL
  SELECT n.doc_id, n.pos, n.w,
         CASE WHEN n.b OR walk.cur + n.w > {PACK_BUDGET} THEN walk.chunk + 1 ELSE walk.chunk END,
         CASE WHEN n.b OR walk.cur + n.w > {PACK_BUDGET} THEN n.w ELSE walk.cur + n.w END
  FROM walk JOIN w n ON n.doc_id = walk.doc_id AND n.pos = walk.pos + 1)
SELECT doc_id, chunk, CAST(sum(w) AS BIGINT) AS tokens, count(*) AS lines FROM walk GROUP BY 1, 2"""


@query("q34_pack_lines", _pack_sql("false"))
def q34(spark, root):
    return _pack_lines(spark, root, blocks=False)


@query("q35_pack_with_blocks", _pack_sql("regexp_matches(line, '^A')"))
def q35(spark, root):
    return _pack_lines(spark, root, blocks=True)


# q36 / q37 ----------------------------------------------------------------
_DIFF_TOKENS_SQL = rf"""
hw AS (SELECT doc_id, file_idx, path, hdr, hdr_tokens, i, hunk, section,
              CAST(len(regexp_extract_all(hunk, '\S+')) AS BIGINT) AS w,
              regexp_matches(trim(section), '^(class|def)\s+') AS b,
              i - file_idx * {FILE_LINES} AS pos FROM diff_hunks),
files AS (SELECT doc_id, file_idx, path, max(hdr_tokens) + sum(w) AS file_tokens FROM hw GROUP BY 1, 2, 3),
dt AS (SELECT doc_id, sum(file_tokens) AS diff_tokens FROM files GROUP BY 1),
big AS (SELECT f.* FROM files f JOIN dt USING (doc_id)
        WHERE dt.diff_tokens > {LEVEL_BUDGET} AND (f.path LIKE '%.py' OR f.path LIKE '%.sql'))"""


@query("q36_level_choice", f"""WITH {DIFF_LINES_SQL}, {_DIFF_TOKENS_SQL}
SELECT 'doc' || doc_id AS diff_id, 1 AS level, CAST(NULL AS VARCHAR) AS path,
       CAST(diff_tokens AS BIGINT) AS tokens FROM dt WHERE diff_tokens <= {LEVEL_BUDGET}
UNION ALL
SELECT 'doc' || doc_id, CASE WHEN file_tokens <= {LEVEL_BUDGET} THEN 2 ELSE 3 END, path,
       CAST(file_tokens AS BIGINT) FROM big""")
def q36(spark, root):
    x = plan_levels(diffs(Tables(spark, root)), LEVEL_BUDGET)
    return x.select("diff_id", "level", "path",
                    F.when(F.col("level") == 1, F.col("diff_tokens"))
                     .otherwise(F.col("file_tokens")).alias("tokens"))


CHUNKS_SQL = rf"""WITH RECURSIVE {DIFF_LINES_SQL}, {_DIFF_TOKENS_SQL},
walk AS (
  SELECT h.doc_id, h.file_idx, h.pos, h.w, 1 AS chunk, h.w AS cur
  FROM hw h JOIN big USING (doc_id, file_idx) WHERE big.file_tokens > {LEVEL_BUDGET} AND h.pos = 0
  UNION ALL
  SELECT n.doc_id, n.file_idx, n.pos, n.w,
         CASE WHEN n.b OR n.hdr_tokens + walk.cur + n.w > {LEVEL_BUDGET} THEN walk.chunk + 1 ELSE walk.chunk END,
         CASE WHEN n.b OR n.hdr_tokens + walk.cur + n.w > {LEVEL_BUDGET} THEN n.w ELSE walk.cur + n.w END
  FROM walk JOIN hw n ON n.doc_id = walk.doc_id AND n.file_idx = walk.file_idx AND n.pos = walk.pos + 1),
chunks AS (
  SELECT 'doc' || h.doc_id AS diff_id, 1 AS level, CAST(NULL AS VARCHAR) AS path, 0 AS part,
         'full_diff_chunk_0.diff' AS chunk_name,
         string_agg(CASE WHEN h.i % {FILE_LINES} = 0 THEN h.hdr ELSE '' END
                    || h.hunk || chr(10), '' ORDER BY h.i) AS text,
         CAST(max(dt.diff_tokens) AS BIGINT) AS tokens
  FROM hw h JOIN dt USING (doc_id) WHERE dt.diff_tokens <= {LEVEL_BUDGET} GROUP BY h.doc_id
  UNION ALL
  SELECT 'doc' || h.doc_id, 2, h.path, 0, regexp_replace(h.path, '^.*/', '') || '.diff',
         max(h.hdr) || string_agg(h.hunk, chr(10) ORDER BY h.i),
         CAST(max(big.file_tokens) AS BIGINT)
  FROM hw h JOIN big USING (doc_id, file_idx) WHERE big.file_tokens <= {LEVEL_BUDGET}
  GROUP BY h.doc_id, h.file_idx, h.path
  UNION ALL
  SELECT 'doc' || w.doc_id, 3, h.path, w.chunk,
         regexp_replace(h.path, '^.*/', '') || '_part_' || w.chunk || '.diff',
         max(h.hdr) || string_agg(h.hunk, chr(10) ORDER BY h.i),
         CAST(sum(w.w) AS BIGINT)
  FROM walk w JOIN hw h ON h.doc_id = w.doc_id AND h.file_idx = w.file_idx AND h.pos = w.pos
  GROUP BY w.doc_id, w.file_idx, h.path, w.chunk)
SELECT diff_id, level, path, part, chunk_name, CAST(length(text) AS BIGINT) AS n_chars, tokens,
       md5(text) AS text_md5
FROM chunks"""


def chunk_digests(chunks: DataFrame) -> DataFrame:
    return chunks.select("diff_id", "level", "path", "part", "chunk_name",
                         F.length("text").cast("bigint").alias("n_chars"), "tokens",
                         F.md5("text").alias("text_md5"))


@query("q37_chunk_text", CHUNKS_SQL)
def q37(spark, root):
    return chunk_digests(create_chunks(diffs(Tables(spark, root)), LEVEL_BUDGET))


# q55 ---------------------------------------------------------------------
PATCH_BUDGET = 40
# (path, patch): {h} stands for the MD5 of the document's text.
PATCHES = (
    ("new.py", "diff --git a/old.py b/new.py\nsimilarity index 90%\nrename from old.py\nrename to new.py\n"
               "--- a/old.py\n+++ b/new.py\n@@ -1 +1 @@ def f():\n-x\n+{h}\n"),
    ("run.sql", "diff --git a/run.sql b/run.sql\nold mode 100644\nnew mode 100755\n"),
    ("gone.py", "diff --git a/gone.py b/gone.py\ndeleted file mode 100644\n--- a/gone.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-{h}\n-y\n"),
    ("x z.py", "diff --git a/x y.py b/x z.py\nsimilarity index 100%\nrename from x y.py\nrename to x z.py\n"),
    ('ü "q".py', 'diff --git "a/\\303\\274 \\"q\\".py" "b/\\303\\274 \\"q\\".py"\nnew file mode 100644\n--- /dev/null\n'
                      '+++ "b/\\303\\274 \\"q\\".py"\n@@ -0,0 +1 @@\n+{h}\n'),
    ("a b.sql", "diff --git a/a b.sql b/a b.sql\nold mode 100644\nnew mode 100755\n"),
    # a removed and an added line that look like another patch's header
    ("h.py", "diff --git a/h.py b/h.py\n--- a/h.py\n+++ b/h.py\n@@ -1 +1 @@\n--- a/x.py\n+++ b/y.py\n@@ -5 +5 @@\n-p\n+{h}\n"),
    # a patch without a git line
    ("plain.py", "--- a/plain.py\t2024-01-01\n+++ b/plain.py\t2024-01-02\n@@ -1,2 +1,2 @@\n same\n-a\n+{h}\n"),
)
SIGNATURE = "-- \n2.40.1\n"


@query("q55_whole_patches", "\nUNION ALL ".join(
    f"SELECT 'doc' || doc_id AS diff_id, 2 AS level, {sql_str(path)} AS path, {sql_str(path.rsplit('/', 1)[-1] + '.diff')} AS chunk_name, "
    f"md5(replace({sql_str(patch[:-1])}, '{{h}}', md5(text))) AS text_md5 FROM documents" for path, patch in PATCHES))
def q55(spark, root):
    """T1, T5-T8 on renames, mode changes, a deletion, quoted names and names
    with blanks, lines like headers and a patch without a git line, for every
    document: each chunk is the whole patch."""
    text = F.replace(F.lit("".join(patch for _, patch in PATCHES) + SIGNATURE), F.lit("{h}"), F.md5("text"))
    docs = Tables(spark, root).documents.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("diff_id"),
                                                text.alias("text"))
    return create_chunks(docs, PATCH_BUDGET).select("diff_id", "level", "path", "chunk_name", F.md5("text").alias("text_md5"))


# q38 ---------------------------------------------------------------------
@query("q38_prompt_build", f"""WITH {SOURCE_FILES_SQL}
SELECT path, trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' AS is_blank,
       CAST(length(p) AS BIGINT) AS prompt_chars, md5(p) AS prompt_md5,
       length(p) > 65000 AS over_limit
FROM (SELECT *, replace({sql_str(REVIEW_PROMPT)}, '{{PY_CONTENT}}', text) AS p FROM source_files)
WHERE path LIKE '%.py' OR path LIKE '%.sql'""")
def q38(spark, root):
    f = source_files(Tables(spark, root)).filter(is_reviewable(F.col("path")))
    p = build_prompts(f)
    return p.select("path", "is_blank", F.length("prompt").cast("bigint").alias("prompt_chars"),
                    F.md5("prompt").alias("prompt_md5"),
                    (F.length("prompt") > 65000).alias("over_limit"))


# q46 (stub model) --------------------------------------------------------
def stub_results(t: Tables) -> DataFrame:
    f = source_files(t).filter(is_reviewable(F.col("path")))
    return call_model(build_prompts(f), stub_reviewer(FAIL_MARKER), keep=("source", "file_name", "path"))


_STUB_RESPONSE_SQL = ("""'{"summary": "' || (length(text) - length(replace(text, chr(10), '')) + 1) ||
  ' lines, ' || (length(text) + 1) || ' chars", "detailed_findings": [], "key_recommendations": ["keep functions short"]}'""")
STUB_SQL = f"""stub AS (
  SELECT source, file_name, path,
         CASE WHEN contains(text, '{FAIL_MARKER}') THEN NULL ELSE {_STUB_RESPONSE_SQL} END AS response,
         CASE WHEN contains(text, '{FAIL_MARKER}') THEN 'ValueError: model refused the input' END AS error
  FROM source_files WHERE path LIKE '%.py' OR path LIKE '%.sql')"""


@query("q46_stub_review", f"""WITH {SOURCE_FILES_SQL}, {STUB_SQL}
SELECT path, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status,
       md5(response) AS response_md5, error FROM stub""")
def q46(spark, root):
    r = stub_results(Tables(spark, root))
    return r.select("path", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"),
                    F.md5("response").alias("response_md5"), "error")


# q39 / q40 ----------------------------------------------------------------
def review_json(t: Tables) -> DataFrame:
    """A JSON answer per labelled document, with contract violations built
    in: unknown severity (toxic), missing ``line_number`` (quality 0), an
    extra top-level key (fr) and a cut-off answer (toxic and de). By doc_id
    modulo 11: no findings (0), a line number ``n.0`` (1), a null summary (2)
    and a text for the recommendations (3)."""
    j = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    did = F.col("doc_id").cast("string")
    case = F.col("doc_id") % 11
    sev = (F.when(F.col("toxic") == 1, "Severe").when(F.col("quality") == 0, "High")
            .otherwise("Medium"))
    txt = F.concat(
        F.when(case == 2, F.lit('{"summary": null')).otherwise(F.concat(F.lit('{"summary": "doc '), did, F.lit('"'))),
        F.lit(', "detailed_findings": ['), F.when(case == 0, F.lit("")).otherwise(F.concat(
        F.lit('{"file_path": "doc'), did,
        F.lit('.py", "severity": "'), sev, F.lit('", "line_number": '), (F.col("n_chars") % 97).cast("string"),
        F.when(case == 1, F.lit(".0")).otherwise(F.lit("")),
        F.lit(', "function_context": "'), F.col("lang"), F.lit('", "finding": "length '),
        F.col("n_chars").cast("string"), F.lit('", "snippet": "s"'),
        F.when(F.col("lang") == "es", F.lit(', "note": "x"')).otherwise(F.lit("")),
        F.lit('}, {"file_path": "doc'), did,
        F.lit('.py", "severity": "Low", '),
        F.when(F.col("quality") == 1, F.lit('"line_number": 1, ')).otherwise(F.lit("")),
        F.lit('"finding": "quality '), F.col("quality").cast("string"),
        F.lit('", "snippet": "x"}'))), F.lit('], "key_recommendations": '),
        F.when(case == 3, F.lit('"oops"')).otherwise(F.lit('["r"]')),
        F.when(F.col("lang") == "fr", F.lit(', "extra": 1')).otherwise(F.lit("")),
        F.when((F.col("toxic") == 1) & (F.col("lang") == "de"), F.lit("")).otherwise(F.lit("}")))
    return j.select("doc_id", txt.alias("response"))


REVIEW_JSON_SQL = """answers AS (
  SELECT l.doc_id,
    CASE WHEN l.doc_id % 11 = 2 THEN '{"summary": null' ELSE '{"summary": "doc ' || l.doc_id || '"' END ||
    ', "detailed_findings": [' || CASE WHEN l.doc_id % 11 = 0 THEN '' ELSE '{"file_path": "doc' || l.doc_id ||
    '.py", "severity": "' || CASE WHEN l.toxic = 1 THEN 'Severe' WHEN l.quality = 0 THEN 'High' ELSE 'Medium' END ||
    '", "line_number": ' || (d.n_chars % 97) || CASE WHEN l.doc_id % 11 = 1 THEN '.0' ELSE '' END || ', "function_context": "' || d.lang || '", "finding": "length ' ||
    d.n_chars || '", "snippet": "s"' || CASE WHEN d.lang = 'es' THEN ', "note": "x"' ELSE '' END ||
    '}, {"file_path": "doc' || l.doc_id || '.py", "severity": "Low", ' ||
    CASE WHEN l.quality = 1 THEN '"line_number": 1, ' ELSE '' END || '"finding": "quality ' || l.quality ||
    '", "snippet": "x"}' END || '], "key_recommendations": ' ||
    CASE WHEN l.doc_id % 11 = 3 THEN '"oops"' ELSE '["r"]' END ||
    CASE WHEN d.lang = 'fr' THEN ', "extra": 1' ELSE '' END ||
    CASE WHEN l.toxic = 1 AND d.lang = 'de' THEN '' ELSE '}' END AS response
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
good AS (SELECT doc_id, response FROM answers WHERE json_valid(response)),
parsed AS (
  SELECT doc_id, response, json_type(response) = 'OBJECT' AS is_json, json_keys(response) AS keys,
         json_transform(response,
           '{"summary":"VARCHAR","detailed_findings":[{"file_path":"VARCHAR","severity":"VARCHAR","line_number":"DOUBLE","function_context":"VARCHAR","finding":"VARCHAR","snippet":"VARCHAR"}],"key_recommendations":["VARCHAR"]}') AS r
  FROM good
  UNION ALL
  SELECT doc_id, response, false, NULL, NULL FROM answers WHERE NOT json_valid(response)),
flags AS (
  SELECT *, is_json AND list_contains(keys, 'summary') AND list_contains(keys, 'detailed_findings')
            AND list_contains(keys, 'key_recommendations')
            AND json_type(response, '$.summary') = 'VARCHAR' AND json_type(response, '$.detailed_findings') = 'ARRAY'
            AND json_type(response, '$.key_recommendations') = 'ARRAY' AS top_ok,
         is_json AND len(list_filter(keys, lambda k: k NOT IN ('summary', 'detailed_findings', 'key_recommendations'))) = 0 AS strict_top_ok
  FROM parsed),
rows AS (
  SELECT doc_id, top_ok, strict_top_ok, unnest(r.detailed_findings) AS f,
         unnest(json_extract(response, '$.detailed_findings[*]')) AS fj,
         generate_subscripts(r.detailed_findings, 1) - 1 AS finding_idx
  FROM flags WHERE is_json
  UNION ALL
  SELECT doc_id, false, false, NULL, NULL, NULL FROM flags WHERE NOT is_json),
found AS (
  SELECT doc_id, CAST(finding_idx AS INTEGER) AS finding_idx, f.file_path AS file_path, f.severity AS severity,
         CAST(f.line_number AS BIGINT) AS line_number, f.function_context AS function_context, f.finding AS finding,
         f.snippet AS snippet,
         coalesce(top_ok AND f IS NOT NULL AND f.file_path IS NOT NULL AND f.severity IS NOT NULL
                  AND f.line_number IS NOT NULL AND f.finding IS NOT NULL
                  AND f.severity IN ('Low', 'Medium', 'High', 'Critical'), false) AS is_valid,
         coalesce(top_ok AND strict_top_ok AND f IS NOT NULL
                  AND len(list_filter(json_keys(fj), lambda k: k NOT IN ('file_path', 'severity', 'line_number',
                      'function_context', 'finding', 'snippet'))) = 0
                  AND f.file_path IS NOT NULL
                  AND f.severity IS NOT NULL AND f.line_number IS NOT NULL AND f.finding IS NOT NULL
                  AND f.function_context IS NOT NULL AND f.snippet IS NOT NULL
                  AND f.severity IN ('Low', 'Medium', 'High', 'Critical'), false) AS is_strict_valid
  FROM rows)"""


def found_findings(t: Tables) -> DataFrame:
    return findings(parse_reviews(review_json(t)), keep=["doc_id"])


@query("q39_findings", f"WITH {REVIEW_JSON_SQL}\nSELECT * FROM found")
def q39(spark, root):
    return found_findings(Tables(spark, root))


@query("q62_contract_violations", f"""WITH {REVIEW_JSON_SQL},
t AS (SELECT a.doc_id, json_valid(a.response) AS ok, l.toxic, l.quality, d.lang, a.doc_id % 11 AS k
      FROM answers a JOIN labels l USING (doc_id) JOIN documents d USING (doc_id)),
v AS (
  SELECT doc_id, '$: json' AS violation FROM t WHERE NOT ok
  UNION ALL SELECT doc_id, '$.summary: type' FROM t WHERE ok AND k = 2
  UNION ALL SELECT doc_id, '$.detailed_findings[0].severity: enum' FROM t WHERE ok AND k <> 0 AND toxic = 1
  UNION ALL SELECT doc_id, '$.detailed_findings[0].note: additionalProperties' FROM t WHERE ok AND k <> 0 AND lang = 'es'
  UNION ALL SELECT doc_id, '$.detailed_findings[1].line_number: required' FROM t WHERE ok AND k <> 0 AND quality <> 1
  UNION ALL SELECT doc_id, '$.detailed_findings[1].function_context: required' FROM t WHERE ok AND k <> 0
  UNION ALL SELECT doc_id, '$.key_recommendations: type' FROM t WHERE ok AND k = 3
  UNION ALL SELECT doc_id, '$.extra: additionalProperties' FROM t WHERE ok AND lang = 'fr')
SELECT doc_id, violation FROM v""")
def q62(spark, root):
    """Each violation of the strict contract with its path."""
    j = review_json(Tables(spark, root))
    return j.select("doc_id", F.explode(violations(F.col("response"), answer_schema(strict=True))).alias("violation"))


@query("q40_severity_trim", f"""WITH {REVIEW_JSON_SQL},
ranked AS (
  SELECT doc_id, finding_idx, severity, finding,
         CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 4 ELSE 5 END AS sev_rank
  FROM found WHERE is_valid),
run AS (
  SELECT *, CAST(sum(coalesce(length(finding), 0)) OVER (PARTITION BY doc_id ORDER BY sev_rank, finding_idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_chars
  FROM ranked)
SELECT doc_id, finding_idx, severity, sev_rank, running_chars FROM run WHERE running_chars <= {TRIM_LIMIT}""")
def q40(spark, root):
    f = found_findings(Tables(spark, root)).filter(F.col("is_valid"))
    kept = trim_by_severity(f, ["doc_id"], TRIM_LIMIT)
    return kept.select("doc_id", "finding_idx", "severity", "sev_rank", "running_chars")


# q41 ---------------------------------------------------------------------
@query("q41_consolidate", f"""WITH {SOURCE_FILES_SQL}, {STUB_SQL},
texts AS (
  SELECT source, file_name,
         '--- Review for ' || file_name || ' ---' || chr(10) ||
         coalesce(response, '{ERROR_TEXT}' || error) || chr(10) AS block,
         row_number() OVER (PARTITION BY source ORDER BY file_name) - 1 AS pos
  FROM stub)
SELECT source, CAST(pos // {FAN_IN} AS BIGINT) AS batch, count(*) AS n_reviews,
       CAST(length(string_agg(block, chr(10) ORDER BY pos)) AS BIGINT) AS n_chars,
       md5(string_agg(block, chr(10) ORDER BY pos)) AS text_md5
FROM texts GROUP BY source, pos // {FAN_IN}""")
def q41(spark, root):
    r = stub_results(Tables(spark, root))
    r = r.withColumn("text", F.coalesce(
        F.col("response"),
        F.concat(F.lit(ERROR_TEXT), F.col("error"))))
    b = consolidation_batches(r, ["source"], "file_name", "text", FAN_IN)
    return b.select("source", "batch", "n_reviews", F.length("text").cast("bigint").alias("n_chars"),
                    F.md5("text").alias("text_md5"))


# q59 ---------------------------------------------------------------------
BATCH_BUDGET, BATCH_MOST = 9_000, 12


@query("q59_batches_by_size", f"""WITH RECURSIVE {SOURCE_FILES_SQL},
blocks AS (
  SELECT source, '--- Review for ' || file_name || ' ---' || chr(10) || text || chr(10) AS block,
         row_number() OVER (PARTITION BY source ORDER BY file_name) - 1 AS pos FROM source_files),
sized AS (SELECT source, pos, length(block) + 1 AS size FROM blocks),
walk AS (
  SELECT source, pos, 0 AS batch, size AS used, 1 AS n FROM sized WHERE pos = 0
  UNION ALL
  SELECT s.source, s.pos, CASE WHEN used + size > {BATCH_BUDGET + 1} OR n = {BATCH_MOST} THEN batch + 1 ELSE batch END,
         CASE WHEN used + size > {BATCH_BUDGET + 1} OR n = {BATCH_MOST} THEN size ELSE used + size END,
         CASE WHEN used + size > {BATCH_BUDGET + 1} OR n = {BATCH_MOST} THEN 1 ELSE n + 1 END
  FROM walk JOIN sized s ON s.source = walk.source AND s.pos = walk.pos + 1)
SELECT source, CAST(batch AS BIGINT) AS batch, count(*) AS n_reviews,
       CAST(length(string_agg(block, chr(10) ORDER BY pos)) AS BIGINT) AS n_chars,
       md5(string_agg(block, chr(10) ORDER BY pos)) AS text_md5
FROM walk JOIN blocks USING (source, pos) GROUP BY source, batch""")
def q59(spark, root):
    """Batches by size and number; a text above the budget goes alone."""
    b = consolidation_batches(source_files(Tables(spark, root)), ["source"], "file_name", "text", BATCH_MOST, BATCH_BUDGET)
    return b.select("source", "batch", "n_reviews", F.length("text").cast("bigint").alias("n_chars"),
                    F.md5("text").alias("text_md5"))


# q42 ---------------------------------------------------------------------
@query("q42_safe_arith", r"""
WITH x AS (
  SELECT event_id, user_id, value, regexp_extract(props, '[0-9]+') AS k,
         CASE event_type WHEN 'view' THEN ' ' || regexp_extract(props, '[0-9]+') || ' '
                         WHEN 'click' THEN regexp_extract(props, '[0-9]+') || '.5'
                         WHEN 'error' THEN 'n/a' WHEN 'signup' THEN ''
                         ELSE regexp_extract(props, '[0-9]+') END AS xs
  FROM events)
SELECT event_id,
       CASE WHEN regexp_matches(trim(xs), '^[+-]?[0-9]+$') THEN CAST(trim(xs) AS BIGINT) + user_id END AS safe_sum,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE round(value / (user_id % 3), 4) END AS ratio,
       CAST(try_strptime('2024-02-' || lpad(k, 2, '0'), '%Y-%m-%d') AS DATE) AS day
FROM x""")
def q42(spark, root):
    e = Tables(spark, root).events
    k = F.regexp_extract("props", "[0-9]+", 0)
    et = F.col("event_type")
    xs = (F.when(et == "view", F.concat(F.lit(" "), k, F.lit(" ")))
           .when(et == "click", F.concat(k, F.lit(".5")))
           .when(et == "error", F.lit("n/a")).when(et == "signup", F.lit("")).otherwise(k))
    return e.select("event_id",
                    safe_add(xs, F.col("user_id").cast("string")).alias("safe_sum"),
                    F.round(safe_divide(F.col("value"), F.col("user_id") % 3), 4).alias("ratio"),
                    parse_day_or_null(F.concat(F.lit("2024-02-"), F.lpad(k, 2, "0"))).alias("day"))


# q43 ---------------------------------------------------------------------
FOLD_SQL = "CAST((('0x' || substr(md5(CAST({k} AS VARCHAR)), 9, 8))::BIGINT % 5) AS INTEGER)"


def stratified_sql(source: str, key: str, label: str) -> str:
    """The stratified split as SQL: all columns of ``source`` and ``is_train``."""
    return f"""SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({key} AS VARCHAR)), {key}) - 1 >=
    CASE WHEN count(*) OVER (PARTITION BY {label}) < 2 THEN 0
         ELSE greatest(1, round(count(*) OVER (PARTITION BY {label}) * 0.005)) END AS is_train FROM {source}"""


@query("q43_split_folds", f"""
SELECT quality, split, fold, count(*) AS n FROM (
  SELECT quality, CASE WHEN is_train THEN 'train' ELSE 'holdout' END AS split,
         CASE WHEN is_train THEN {FOLD_SQL.format(k='doc_id')} END AS fold
  FROM ({stratified_sql('labels', 'doc_id', 'quality')})) GROUP BY 1, 2, 3""")
def q43(spark, root):
    lab = stratified_split(Tables(spark, root).labels, "doc_id", "quality")
    return lab.select("quality", F.when(F.col("is_train"), "train").otherwise("holdout").alias("split"),
                      F.when(F.col("is_train"), fold_col(F.col("doc_id"))).alias("fold")) \
              .groupBy("quality", "split", "fold").agg(F.count(F.lit(1)).alias("n"))


# q50-q53: outputs of the text jobs ------------------------------------------
@query("q50_review_tables", f"""WITH {SOURCE_FILES_SQL}, {STUB_SQL}, {REVIEW_JSON_SQL},
calls AS (SELECT 'stub' AS run, path AS name, response IS NULL AS failed FROM stub)
SELECT 'reviews' AS table_name, count(*) AS n FROM calls WHERE NOT failed
UNION ALL SELECT 'review_errors', count(*) FROM calls WHERE failed
UNION ALL SELECT 'findings', CAST(0 AS BIGINT)
UNION ALL SELECT 'top_findings', CAST(0 AS BIGINT)
UNION ALL SELECT 'answers: reviews', count(*) FROM answers
UNION ALL SELECT 'answers: review_errors', (SELECT count(*) FROM flags WHERE NOT (is_json AND top_ok))
   + (SELECT count(*) FROM found WHERE NOT is_valid AND finding_idx IS NOT NULL)
UNION ALL SELECT 'answers: findings', count(*) FROM found WHERE is_valid
UNION ALL SELECT 'answers: top_findings', count(*) FROM found WHERE is_valid""")
def q50(spark, root):
    """K5: the tables of the review job, from the stub's answers (which have
    no findings) and from answers with violations built in."""
    t = Tables(spark, root)
    made = review_json(t).select("doc_id", F.md5("response").alias("prompt_md5"), "response",
                                 F.lit(None).cast("string").alias("error"))
    out = None
    for prefix, tables in (("", review_tables(stub_results(t), ["source", "file_name", "path"])),
                           ("answers: ", review_tables(made, ["doc_id"]))):
        for name, df in tables.items():
            row = df.agg(F.lit(prefix + name).alias("table_name"), F.count(F.lit(1)).alias("n"))
            out = row if out is None else out.unionByName(row)
    return out


@query("q51_consolidate_tree", f"""WITH {SOURCE_FILES_SQL},
n AS (SELECT CASE WHEN source = 'src1' THEN NULL ELSE source END AS source, count(*) AS n FROM source_files GROUP BY 1)
SELECT source, CASE WHEN n <= {FAN_IN} THEN 1 WHEN n <= {FAN_IN ** 2} THEN 2 WHEN n <= {FAN_IN ** 3} THEN 3
                    WHEN n <= {FAN_IN ** 4} THEN 4 ELSE 5 END AS levels,
       'summary of ' || ((n - 1) // {FAN_IN} ** (CASE WHEN n <= {FAN_IN} THEN 0 WHEN n <= {FAN_IN ** 2} THEN 1
         WHEN n <= {FAN_IN ** 3} THEN 2 WHEN n <= {FAN_IN ** 4} THEN 3 ELSE 4 END) + 1)::BIGINT AS summary,
       false AS was_truncated
FROM n""")
def q51(spark, root):
    """One summary per group (a NULL group among them), as a tree; the
    model stand-in says how many blocks it was given."""
    files = source_files(Tables(spark, root)).select(
        F.nullif(F.col("source"), F.lit("src1")).alias("source"), "file_name", F.lit("fine").alias("response"))

    def count_blocks(prompt: str) -> str:
        return f"summary of {prompt.count('--- Review for ')}"

    return consolidate(files, count_blocks, ["source"], fan_in=FAN_IN)


@query("q52_truncate_chars", """
SELECT doc_id, CAST(length(left(text, 1000)) AS BIGINT) AS n_chars, md5(left(text, 1000)) AS head_md5 FROM documents""")
def q52(spark, root):
    """The character cut of the final summary, here at 1,000."""
    d = Tables(spark, root).documents
    head = truncate_chars("text", 1000)
    return d.select("doc_id", F.length(head).cast("bigint").alias("n_chars"), F.md5(head).alias("head_md5"))
