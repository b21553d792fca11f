"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens raised to an exponent, then
normalised: 1 keeps the corpus as it is, 0 makes all sources equal. The
exponent is bisected to the largest one that reaches a target entropy, and to
the smallest one that keeps every source within a repetition limit; the larger
of the two holds. Each Spark job evaluates 15 exponents at once, that is four
halvings, as one row of sums over the sources.

Each source gets a quota of tokens: its weight times the budget, by default the
smallest budget for which no source is drawn less than once, so that no
document is lost. The quota is realised as passes over the source. A pass
draws the source's blocks of documents in a permutation of its own; the last
pass stops before the block that would exceed the quota. Only DataFrame
functions are used, and documents are never sorted or windowed: their block
decides, through a join with the table of blocks.

Prefix sums over a source's blocks are taken in two levels, over 1024 ranges
of the permutation and inside each, so a hot source is no single task.

Cases: a null source is a source of its own; documents without words count 0
tokens and are drawn with their block; a source without tokens has no weight
and is drawn once; null keys share a block; equal rows share a block and are
each drawn; an empty table gives an empty result; all columns are kept, except
that the result columns replace columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import free_name, query, read, stage

MAX_REPEATS = 2.0        # production parameter
BLOCKS = 64              # blocks of a source at least,
BLOCK_TOKENS = 1 << 18   # and one for each so many tokens
POINTS = 15              # exponents evaluated by one job
LAST_RANGE = 1 << 60     # hashes are below

RESULT = ("tokens", "pass", "block", "block_start", "quota")


def hash60(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15),
                  16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def bisect(stats: DataFrame, measure, holds, low: float, high: float, digits: int = 9) -> float:
    """The smallest exponent in [low, high] for which ``holds(value)``, which
    is true from some exponent on; ``high`` if none. ``measure(a)`` is an
    aggregate over the sources at exponent a."""
    while high - low > 10.0 ** -digits:
        points = [low + (high - low) * (k + 1) / (POINTS + 1) for k in range(POINTS)]
        row = stats.agg(*[measure(a).alias(f"m{k}") for k, a in enumerate(points)]).first()
        right = next((k for k in range(POINTS) if holds(row[k])), POINTS)
        low, high = (points[right - 1] if right else low), (points[right] if right < POINTS else high)
    return high


def exponent(stats: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
             budget: float | None = None) -> float:
    """The exponent for sources with ``tokens`` > 0. It is rounded to six
    decimals, to the side that keeps both targets within 1e-6."""
    total, most, n = stats.agg(F.sum("tokens").cast("double"), F.max("tokens").cast("double"),
                               F.count(F.lit(1))).first()
    if not n:
        return 1.0
    x = F.log(F.col("tokens").cast("double") / F.lit(most))         # at most 0: no overflow
    z = lambda a: F.sum(F.exp(F.lit(a) * x))
    found = 0.0 if target_entropy is not None or max_repeats is not None else 1.0
    if max_repeats is not None:
        if budget is None:      # the longest source is drawn once
            repeats = lambda a: F.max(F.exp(F.lit(a - 1) * x))
        else:
            repeats = lambda a: F.max(F.exp(F.lit(a - 1) * x)) * F.lit(budget / most) / z(a)
        least = bisect(stats, repeats, lambda r: r <= max_repeats, 0.0, 1.0)
        found = max(found, math.ceil(round(least * 1e6, 3)) / 1e6)
    if target_entropy is not None:
        entropy = lambda a: F.log(z(a)) - F.lit(a) * F.sum(x * F.exp(F.lit(a) * x)) / z(a)
        reached = bisect(stats, entropy, lambda h: h < target_entropy, 0.0, 16.0)
        found = max(found, math.floor(round(reached * 1e6, 3)) / 1e6)
    return found


def _before(df: DataFrame, group: list[str], h: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group's rows of smaller (h, block)."""
    ranged = df.withColumn("range", F.floor(F.col(h) / F.lit(LAST_RANGE // 1024)).cast("int"))
    upto = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*group, "range").agg(F.sum(value).alias("in_range")) \
        .withColumn("ranges_before", F.coalesce(F.sum("in_range").over(upto), F.lit(0)))
    inside = Window.partitionBy(*group, "range").orderBy(h, "block").rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0))) \
        .join(ranges.drop("in_range"), [*group, "range"])
    return joined.withColumn(out, F.col("ranges_before") + F.col("inside")).drop("range", "inside", "ranges_before")


def draw(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id",
         target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None,
         seed: int = 1) -> DataFrame:
    """The documents drawn, a row for each draw, with tokens, pass (from 0),
    block, block_start (tokens of the pass drawn before the block) and the
    source's quota. ``docs`` is read twice and must give the same rows."""
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"),
                       F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("")).alias("src"),
                       word_count(F.col(f"`{text}`")).alias("tokens"),
                       hash60(F.col(f"`{key}`"), F.lit(seed)).alias("h"))
    # blocks as fine as the source allows, then as many as its tokens ask for
    stats = stage(rows.groupBy("src").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    weighted = stats.filter(F.col("tokens") > 0)
    a = exponent(weighted, target_entropy, max_repeats, budget)
    sums = weighted.agg(F.max("tokens").cast("double"),
                        F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a)))).first()
    most, z = sums[0] or 1.0, sums[1] or 1.0
    weight = F.pow(F.col("tokens").cast("double"), F.lit(a))
    quota = F.round(weight * F.lit(most ** (1.0 - a)) if budget is None else weight * F.lit(budget / z)).cast("bigint")
    sources = stats.select(
        "src", F.col("tokens").alias("source_tokens"),
        F.when(F.col("tokens") > 0, quota).otherwise(F.lit(0)).alias("quota"),
        F.greatest(F.lit(BLOCKS), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS))).cast("bigint").alias("blocks"))
    sources = stage(sources.withColumn("passes", F.when(F.col("source_tokens") == 0, F.lit(1)).otherwise(
        F.floor((F.col("quota") + F.col("source_tokens") - 1) / F.greatest("source_tokens", F.lit(1)))).cast("bigint")),
        "mix-quotas")
    placed = rows.join(sources.select("src", "blocks"), "src") \
        .withColumn("block", F.pmod("h", "blocks")).drop("blocks", "h")
    blocks = placed.groupBy("src", "block").agg(F.sum("tokens").alias("block_tokens")).join(sources, "src") \
        .filter(F.col("passes") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)))
    blocks = blocks.withColumn("order", hash60(F.lit(seed), F.col("src"), F.col("pass"), F.col("block")))
    blocks = _before(blocks, ["src", "pass"], "order", "block_tokens", "block_start")
    left = F.col("quota") - F.col("pass") * F.col("source_tokens")            # of the quota, for this pass
    blocks = stage(blocks.filter((F.col("source_tokens") == 0) | (F.col("block_start") + F.col("block_tokens") <= left))
                   .select("src", "block", "pass", "block_start", "quota"), "mix-blocks")
    return placed.join(blocks, ["src", "block"]).select("doc.*", *RESULT)


@query("op3_temperature_mixing", oracle=r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
                  coalesce('s' || source, '') AS src,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|1'), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT src, sum(tokens)::BIGINT AS t FROM d GROUP BY src),
m AS (SELECT max(t)::DOUBLE AS hi, min(t)::DOUBLE AS lo FROM s WHERE t > 0),
e AS (SELECT hi, CASE WHEN hi <= 2 * lo THEN 0.0 ELSE ceil(round((1 - ln(2.0) / ln(hi / lo)) * 1e6, 3)) / 1e6 END AS a FROM m),
q AS (SELECT src, t, CASE WHEN t > 0 THEN round(pow(t::DOUBLE, a) * pow(hi, 1 - a))::BIGINT ELSE 0 END AS quota,
             greatest(64, ceil(t / 262144.0))::BIGINT AS blocks FROM s, e),
p AS (SELECT *, CASE WHEN t = 0 THEN 1 ELSE (quota + t - 1) // t END AS passes FROM q),
l AS (SELECT d.*, d.h % blocks AS block FROM d JOIN p USING (src)),
b AS (SELECT src, block, sum(tokens)::BIGINT AS bt FROM l GROUP BY ALL),
x AS (SELECT b.*, t, quota, unnest(range(passes)) AS pass FROM b JOIN p USING (src)),
o AS (SELECT *, ('0x' || substr(md5('1|' || src || '|' || pass || '|' || block), 1, 15))::BIGINT AS o FROM x),
y AS (SELECT *, coalesce(sum(bt) OVER (PARTITION BY src, pass ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_start FROM o)
SELECT l.doc_id, l.source, l.tokens, y.pass::BIGINT AS pass, l.block::BIGINT AS block, y.block_start, y.quota
FROM l JOIN y USING (src, block) WHERE y.t = 0 OR y.block_start + y.bt <= y.quota - y.pass * y.t
""")
def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return draw(docs, max_repeats=MAX_REPEATS).select("doc_id", "source", *RESULT)
