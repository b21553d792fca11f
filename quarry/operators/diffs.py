"""Unified-diff splitting into token-budgeted chunks.

Diffs are rows ``(diff_id, text)``, or records ``(diff_id, pos, text)`` of
diffs too large for a row. Parsing is regex ``split`` plus array functions
inside each row: pieces begin at lines that no hunk body can hold, and the
counts in a hunk's line say where its body ends.
The three levels of the reference splitter are decided per row in one
pass (``plan_levels``) and each row emits its own chunks:

1. the whole diff fits the budget -> one chunk ``full_diff_chunk_0.diff``
   (no suffix filter at this level);
2. otherwise each ``.py`` / ``.sql`` file that fits -> ``<name>.diff``;
3. each larger file -> hunks packed in order -> ``<name>_part_<n>.diff``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import WHITESPACE, base_name, token_count
from quarry.operators.packing import pack_chunks
from quarry.sinks.tables import materialize, overwrite, staged_scope

# Chunk budget and reviewable suffixes of the reference.
CONTEXT_WINDOW_TOKENS = 100_000
REVIEW_SUFFIXES = (".py", ".sql")
# (?d): only \n ends a line; (?m): ^ at every line start.
# Lines that no hunk body can hold: a patch's first line and a hunk's.
STRUCTURE = r"(?dm)^(?=diff --(?:git|cc|combined) |@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@|@@@+ -)"
HUNK_START = r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@"
# The header of a patch without a git line, where it ends a piece of text.
PLAIN_HEADER = r"(?dm)((?:^(?:diff -|Index: |={10,}$)[^\n]*\n)*^--- [^\n]*\n\+\+\+ [^\n]*\n)\z"
# What may follow a complete hunk without being part of it.
AFTER_HUNK = r"\A(?:-- ?\r?(?:\n|\z)|--- [^\n]*\n\+\+\+ |\r?\n|[^ +\-\\])"
BLOCK_START = r"^(class|def)\s+"
QUOTED = r'"((?:[^"\\]|\\.)*)"'
# The letters that stand for control characters in quoted names.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D"}


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later lambdas may read many times: Catalyst would
    put a projected expression into each of them; a generator's output stays."""
    return df.withColumn(name, F.explode(F.array(value)))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?dm)" + pattern)).cast("bigint")


def _hunk_end(piece: Column) -> Column:
    """Number of characters of a piece (a hunk's line and all up to the next
    structural line) that belong to the hunk, by the counts in its line.

    Nearly always that is all of it, which three counts tell. Otherwise the
    lines are taken one by one until both counts are used up, and the last
    line's ``\\`` remark with them. What follows is cut off only if it can be
    no body line; a hunk whose counts are wrong keeps everything."""
    given = lambda k: F.coalesce(F.nullif(F.regexp_extract(piece, HUNK_START, k), F.lit("")), F.lit("1")).cast("bigint")
    first = F.locate("\n", piece)
    body = F.when(first > 0, piece.substr(first + 1, F.length(piece))).otherwise(F.lit(""))
    exact = (_count(body, r"^(?:[ \-]|\r?$)") == given(1)) & (_count(body, r"^(?:[ +]|\r?$)") == given(2)) \
        & (_count(body, r"^[^ +\-\\\r\n]") == 0)

    def take(a, line):
        start = F.substring(line, 1, 1)
        context = start.isin(" ", "\r", "")
        more = (a["old"] > 0) | (a["new"] > 0)
        foreign = more & ~start.isin(" ", "+", "-", "\\", "\r", "")
        takes = ~a["over"] & ~foreign & (more | (start == "\\"))
        return F.struct(
            F.when(takes & (context | (start == "-")), a["old"] - 1).otherwise(a["old"]).alias("old"),
            F.when(takes & (context | (start == "+")), a["new"] - 1).otherwise(a["new"]).alias("new"),
            F.when(takes, a["chars"] + F.length(line) + 1).otherwise(a["chars"]).alias("chars"),
            (~takes).alias("over"), (a["wrong"] | foreign).alias("wrong"))

    state = F.struct(given(1).alias("old"), given(2).alias("new"), F.lit(0).alias("chars"),
                     F.lit(False).alias("over"), F.lit(False).alias("wrong"))
    lines = F.split(F.regexp_replace(body, r"\n\z", ""), "\n")
    end = F.aggregate(lines, state, take, lambda a: F.when(
        ~a["wrong"] & (a["old"] == 0) & (a["new"] == 0), F.least(first + a["chars"], F.length(piece))).otherwise(F.length(piece)))
    return F.when(~piece.startswith("@@ -") | (first == 0) | exact, F.length(piece)).otherwise(end)


def with_patches(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add ``out``, the patches of a diff in order: an array of
    ``(header, hunks)``, the texts of all lines before the first hunk and of
    each hunk, line ends included. NULL where ``text`` is.

    A patch begins at a git line, or at a ``---`` / ``+++`` pair that the counts
    of the hunk before leave over. Text between patches (mail headers,
    signatures) is no part of them."""
    piece, cut = "p", "cut"
    items = F.transform(F.split(text, STRUCTURE), lambda p: F.struct(p.alias(piece), F.when(
        p.startswith("@@"), _hunk_end(p)).otherwise(F.lit(0)).alias(cut)))

    def parts(x):
        part = lambda starts, t: F.struct(F.lit(starts).alias("starts"), t.alias("t"))
        rest = F.when(x[cut] < F.length(x[piece]), x[piece].substr(x[cut] + 1, F.length(x[piece]))).otherwise(F.lit(""))
        kept = F.when((rest == "") | rest.rlike(AFTER_HUNK), x[piece].substr(F.lit(1), x[cut])).otherwise(x[piece])
        plain = F.regexp_extract(rest, PLAIN_HEADER, 1)
        header = F.when(plain != "", F.array(part(True, plain))).otherwise(F.array().cast("array<struct<starts:boolean,t:string>>"))
        return F.when(x[piece].startswith("diff --"), F.array(part(True, x[piece]))).when(
            x[piece].startswith("@@"), F.concat(F.array(part(False, kept)), F.when(kept == x[piece], F.array().cast(
                "array<struct<starts:boolean,t:string>>")).otherwise(header))).otherwise(header)

    df = _once(df, "__parts", F.flatten(F.transform(items, parts)))
    starts = F.filter(F.transform("__parts", lambda x, i: F.when(x["starts"], i + 1)), lambda i: i.isNotNull())
    df = _once(df, "__starts", starts)
    spans = F.arrays_zip(F.col("__starts").alias("a"), F.slice("__starts", F.lit(2), F.size("__starts")).alias("b"))
    patch = lambda z: F.struct(
        F.element_at("__parts", z["a"])["t"].alias("header"),
        F.transform(F.slice("__parts", z["a"] + 1, F.coalesce(z["b"], F.size("__parts") + 1) - z["a"] - 1), lambda x: x["t"]).alias("hunks"))
    return df.withColumn(out, F.transform(spans, patch)).drop("__parts", "__starts")


def unquoted(name: Column) -> Column:
    """A file name as git writes it: quoted, with escapes and the bytes of
    its UTF-8 form in octal, or as it stands up to a tab."""
    inner = F.regexp_extract(name, "^" + QUOTED, 1)
    letters = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def byte(t):
        octal = F.lpad(F.conv(F.substring(t, 2, 3), 8, 16), 2, "0")
        letter = F.substring(t, 2, 1)
        return F.when(t.rlike(r"^\\[0-3][0-7]{2}$"), octal) \
                .when(t.startswith("\\"), F.coalesce(F.try_element_at(letters, letter), F.hex(F.encode(letter, "utf-8")))) \
                .otherwise(F.hex(F.encode(t, "utf-8")))

    pieces = F.regexp_extract_all(inner, F.lit(r"\\[0-3][0-7]{2}|\\.|[^\\]+"), 0)
    plain = F.regexp_extract(name, r"(?d)^([^\t\n]*?)\r?(?:\t|$)", 1)
    return F.when(name.startswith('"'), F.unhex(F.array_join(F.transform(pieces, byte), "")).cast("string")).otherwise(plain)


def _side(name: Column) -> Column:
    """A named side without its ``a/`` or ``b/``; empty for none and /dev/null."""
    whole = unquoted(name)
    return F.when(whole == "/dev/null", F.lit("")).otherwise(F.regexp_replace(whole, r"^[abciow]/", ""))


def patch_paths(header: Column) -> dict[str, Column]:
    """``path`` and ``old_path`` from the lines before a patch's first
    hunk. Names may hold blanks and may be quoted. The ``---`` / ``+++``
    lines decide, then rename and copy lines, then the git line, whose two
    names are told apart by their being the same."""
    line = lambda start: F.regexp_extract(header, f"(?dm)^{start}(.*)$", 1)
    new, old = _side(line(r"\+\+\+ ")), _side(line("--- "))
    to, source = unquoted(line("(?:rename|copy) to ")), unquoted(line("(?:rename|copy) from "))
    both = F.regexp_replace(line("diff --git "), r"\r$", "")
    quoted = F.regexp_extract(both, " (" + QUOTED + ")$", 1)
    same = F.regexp_extract(both, r"^(?:[a-z]/(.*) [a-z]/\1)$", 1)
    bare = F.regexp_extract(both, r"^(.*) \1$", 1)
    last = F.regexp_extract(both, r" (\S+)$", 1)
    combined = unquoted(line("diff --(?:cc|combined) "))
    git = F.when(quoted != "", _side(quoted)).when(same != "", same).when(bare != "", bare) \
           .when(both != "", _side(last)).otherwise(combined)
    path = F.when(new != "", new).when(to != "", to).when(old != "", old).otherwise(git)
    return {"path": path, "old_path": F.when(old != "", old).when(source != "", source).otherwise(path)}


def split_files(diffs: DataFrame, text: str = "text", keep: Sequence[str] = ("diff_id",)) -> DataFrame:
    """One row per file patch ``(…keep, file_idx, old_path, path,
    header, patch_hunks, file_text)``; ``file_text`` is the header and all hunks."""
    d = with_patches(diffs.select(*keep, F.col(text).alias("__text")), F.col("__text"), "__patches")
    x = d.select(*keep, F.posexplode("__patches").alias("file_idx", "z"))
    return _named(x.select(*keep, "file_idx", "z.header", F.col("z.hunks").alias("patch_hunks")))


def _named(x: DataFrame) -> DataFrame:
    columns = [c for c in x.columns if c not in ("header", "patch_hunks")]
    names = patch_paths(F.col("header"))
    return x.select(*columns, names["old_path"].alias("old_path"), names["path"].alias("path"), "header", "patch_hunks",
                    F.concat("header", F.array_join("patch_hunks", "")).alias("file_text"))


def with_hunks(files: DataFrame, pattern: str = WHITESPACE, where: Column | None = None) -> DataFrame:
    """T2-T4 inside each file row: ``hunks`` (text without the trailing
    newline), ``sections`` (text after the second ``@@``), ``is_block``
    (section starts with ``class``/``def``), per-hunk ``hunk_tokens`` and
    ``header_tokens`` of the patch's header. Rows for which ``where`` does
    not hold get NULL arrays and no work.
    """
    hunks = F.transform("patch_hunks", lambda h: F.regexp_replace(h, r"\n\z", ""))
    out = files.withColumn("hunks", hunks if where is None else F.when(where, hunks)).drop("patch_hunks")
    sections = F.transform("hunks", lambda h: F.regexp_extract(h, r"^@@+ [^\n]*? @@+ ?([^\n]*)", 1))
    out = out.withColumn("sections", sections)
    header = token_count("header", pattern)
    return out.withColumns({
        "is_block": F.transform("sections", lambda s: F.trim(s).rlike(BLOCK_START)),
        "hunk_tokens": F.transform("hunks", lambda h: token_count(h, pattern)),
        "header_tokens": header if where is None else F.when(where, header),
    })


def is_reviewable(path: Column, suffixes: Sequence[str] = REVIEW_SUFFIXES) -> Column:
    """path ends with one of the suffixes."""
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | path.endswith(s)
    return cond


def plan_levels(diffs: DataFrame, budget: int = CONTEXT_WINDOW_TOKENS,
                pattern: str = WHITESPACE, suffixes: Sequence[str] = REVIEW_SUFFIXES) -> DataFrame:
    """T5 in one pass: one row per diff that fits (``level`` 1, its text in
    ``whole_text``) and one row per reviewable file of every other diff
    (``level`` 2 when the file fits, else 3), with the file's hunk arrays.

    Files are exploded only for diffs over the budget; the diff text is
    never copied onto file rows. Nothing upstream is computed twice.
    """
    # An empty diff yields no chunk at all.
    d = diffs.filter(F.length("text") > 0).withColumn("diff_tokens", token_count("text", pattern))
    big = F.col("diff_tokens") > budget
    d = with_patches(d, F.when(big, F.col("text")), "patches")
    x = d.select("diff_id", F.when(~big, F.col("text")).alias("whole_text"), "diff_tokens",
                 F.explode_outer("patches").alias("z"))
    return _leveled(x.filter(F.col("whole_text").isNotNull() | F.col("z").isNotNull()), budget, pattern, suffixes)


def plan_patch_levels(patches: DataFrame, budget: int = CONTEXT_WINDOW_TOKENS,
                      pattern: str = WHITESPACE, suffixes: Sequence[str] = REVIEW_SUFFIXES) -> DataFrame:
    """``plan_levels`` for the records ``(diff_id, pos, text)`` of
    ``read_patches``: a diff need not fit a row, only its patches do. The
    diff's tokens are summed over its records (patterns do not match across
    lines); only diffs that fit the budget are put together again."""
    p = patches.withColumn("tokens", token_count("text", pattern))
    totals = p.groupBy("diff_id").agg(F.sum("tokens").alias("diff_tokens"))
    small = p.join(totals.filter(F.col("diff_tokens") <= budget), "diff_id").groupBy("diff_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "").alias("whole_text"),
        F.max("diff_tokens").alias("diff_tokens"))
    big = p.join(totals.filter(F.col("diff_tokens") > budget), "diff_id")
    found = with_patches(big.select("diff_id", "diff_tokens", "text"), F.col("text"), "patches")
    x = found.select("diff_id", F.lit(None).cast("string").alias("whole_text"), "diff_tokens", F.explode("patches").alias("z"))
    return _leveled(x.unionByName(small, allowMissingColumns=True), budget, pattern, suffixes)


def _leveled(x: DataFrame, budget: int, pattern: str, suffixes: Sequence[str]) -> DataFrame:
    """Names, tokens and levels of rows ``(diff_id, whole_text, diff_tokens,
    z)``, ``z`` being the patch of a diff that does not fit."""
    x = _named(x.select("diff_id", "whole_text", "diff_tokens", "z.header", F.col("z.hunks").alias("patch_hunks")))
    small = F.col("header").isNull()
    x = x.filter(small | is_reviewable(F.col("path"), suffixes))
    x = x.withColumn("file_tokens", token_count("file_text", pattern))
    level = F.when(small, F.lit(1)).when(F.col("file_tokens") <= budget, F.lit(2)).otherwise(F.lit(3))
    x = x.withColumn("level", level)
    return with_hunks(x, pattern, where=F.col("level") == 3)     # only split files need their hunks


def create_chunks(diffs: DataFrame, budget: int = CONTEXT_WINDOW_TOKENS,
                  pattern: str = WHITESPACE, suffixes: Sequence[str] = REVIEW_SUFFIXES,
                  header_weight: str = "header") -> DataFrame:
    """``(diff_id, level, path, part, chunk_name, text, tokens)`` of
    diffs ``(diff_id, text)``, or of records ``(diff_id, pos, text)``.

    Each row of the plan builds its own array of chunks (one for
    levels 1 and 2, the packed parts for level 3), then a single explode
    produces the output. A level-2 chunk is the whole file patch as it
    stands; a level-3 part is the patch's header and some of its hunks.
    ``header_weight="header"`` weighs each level-3
    chunk's header by the header text itself (D19); ``"none"`` gives 0.
    Level-3 ``tokens`` are the chunk's hunk tokens (header excluded).
    """
    plan = plan_patch_levels if "pos" in diffs.columns else plan_levels
    x = plan(diffs, budget, pattern, suffixes)
    header = F.col("header")
    name = base_name(F.col("path"))
    hw = F.col("header_tokens") if header_weight == "header" else F.lit(0)
    lvl = F.col("level")
    packed = F.when(lvl == 3, pack_chunks(F.col("hunk_tokens"), budget, hw, F.col("is_block")))
    x = x.withColumn("packed", packed)

    def part(c, i):
        first, n = c["first"] + 1, c["last"] - c["first"] + 1
        return F.struct((i + 1).alias("part"),
                        F.concat(name, F.lit("_part_"), (i + 1).cast("string"), F.lit(".diff")).alias("chunk_name"),
                        F.concat(header, F.array_join(F.slice(F.col("hunks"), first, n), "\n")).alias("text"),
                        c["tokens"].alias("tokens"))

    one = lambda p, nm, t, tok: F.array(F.struct(F.lit(p).alias("part"), nm.alias("chunk_name"),
                                                 t.alias("text"), tok.alias("tokens")))
    chunks = (F.when(lvl == 1, one(0, F.lit("full_diff_chunk_0.diff"), F.col("whole_text"),
                                   F.col("diff_tokens")))
               .when(lvl == 2, one(0, F.concat(name, F.lit(".diff")),
                                   F.regexp_replace("file_text", r"\n\z", ""), F.col("file_tokens")))
               .otherwise(F.transform("packed", part)))
    out = x.select("diff_id", "level", "path", F.explode(chunks).alias("c"))
    return out.select("diff_id", "level", "path", "c.part", "c.chunk_name", "c.text", "c.tokens")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """K4: the chunks by diff and name (``diff_id`` and ``chunk_name`` stay
    columns), in ranges of ``(diff_id, path, part)``: as many tasks and files
    as the data asks for, and a large diff is spread over several."""
    key = ("diff_id", "path", "part")
    with staged_scope(chunks.sparkSession):
        # the bounds of the ranges take a pass of their own: over written chunks, not over all the splitting
        staged = materialize(chunks, "chunks")
        overwrite(staged.repartitionByRange(*key).sortWithinPartitions(*key), path)


def read_chunks(spark: SparkSession, path: str, diff_id: str | None = None) -> DataFrame:
    """The written chunks; of one diff only the files and row groups whose
    range of ids holds it are read (the files' statistics)."""
    chunks = spark.read.parquet(path)
    return chunks if diff_id is None else chunks.filter(F.col("diff_id") == diff_id)
