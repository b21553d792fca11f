"""Quality rules with risk-controlled thresholds.

A rule rejects a document when one of its measures (a whole number, in
thousandths) is above a cutoff. The cutoff of each rule and stratum is chosen
on labelled documents: the rule's cutoffs are tried from the mildest to the
strictest, and the last one is taken before a test fails to show that the rule
rejects at most its share of the good documents of the stratum. The test is
exact: with n good documents, x of them above the cutoff, the probability of x or
fewer under the binomial law at that share has to be ``delta`` at most, which is
the same as that the upper Clopper-Pearson bound is not above the share.

All cutoffs hold at once with the probability 1 - ``DELTA``: the tests of one
rule are a fixed sequence that ends at the first failure (so its first failing
hypothesis alone can err), and ``DELTA`` is divided by the number of rules and
strata (Bonferroni). The risk limit is divided by the number of rules, so that
all rules together reject at most ``RISK`` of the good documents of a stratum.
A stratum with too few labels to prove anything gets no cutoff, and nothing is
rejected there.

The holdout is every good document that passes the base rules, each text
once (copies would count as independent proofs). A doc_id with any label that
is not good is not good.

Only DataFrame functions are used. A document's arrays live in its own row;
``explode`` of a one-element array hands an array on, so that it is computed
once and not again for every use in a later lambda.

Cases: null, empty and wordless texts have zero measures and fail the base
rules; very long texts are measured whole; a null stratum is ``und``; null and
unlabelled doc_ids are judged but prove nothing; labels whose doc_id or quality is null are
ignored; without any label nothing but the base rules rejects; equal texts of
one stratum get equal results, each row has its own; an empty table gives an empty result; extra columns
are ignored by the query and kept by ``judge``. Windows are compared by their
64-bit hash within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import free_name, query, read, stage

RISK = 0.05              # of the good documents of a stratum, rejected by the rules at most
DELTA = 0.05             # probability that this fails anywhere
WINDOW = 8
FEWEST_WORDS, REPEATED_PERCENT = 20, 30      # base rules
BLANK, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Rules: a measure of m (the measures of a document), and its cutoffs from the mildest on.
RULES = {
    "symbols": (lambda m: _per_mille(m["n_symbols"], m["n_words"]), (2000, 1000, 500, 300, 200, 150, 100, 70, 50)),
    "dup_lines": (lambda m: _per_mille(m["n_dup_lines"], m["n_lines"]), (900, 800, 700, 600, 500, 400, 300, 200)),
    "repeat_words": (lambda m: _per_mille(m["n_repeat_words"], m["n_words"]), (280, 250, 200, 150, 100, 70, 50)),
    "word_length": (lambda m: _per_mille(m["word_chars"], m["n_words"]), (30000, 20000, 15000, 12000, 10000, 9000, 8000)),
}


def _per_mille(part: Column, of: Column) -> Column:
    return F.floor(F.lit(1000) * part / F.greatest(of, F.lit(1))).cast("bigint")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions may use many times."""
    for name, value in columns.items():
        df = df.withColumn(name, F.explode(F.array(value)))
    return df


def measured(df: DataFrame, text: str = "text", out: str = "m") -> DataFrame:
    """Add (or replace) ``out``: n_words, word_chars, n_symbols, n_lines (with a word),
    n_dup_lines and n_repeat_words of the whole text."""
    t, w, h, s, p = (free_name([*df.columns, out], x) for x in ("body", "word", "windows", "sorted", "repeated"))
    columns = df.columns
    df = df.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = _once(df, **{w: F.array_remove(F.split(t, BLANK), "")})
    n = F.size(w)
    inside = F.arrays_zip(*[F.slice(w, F.lit(k + 1), n - (WINDOW - 1)).alias(f"w{k}") for k in range(WINDOW)])
    df = _once(df, **{h: F.when(n >= WINDOW, F.transform(inside, lambda x: F.xxhash64(x)))})
    placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    df = _once(df, **{s: F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(placed))})
    pairs = F.arrays_zip(F.col(s).alias("a"), F.slice(s, F.lit(2), F.size(s) - 1).alias("b"))
    again = F.filter(pairs, lambda x: x["a"]["h"] == x["b"]["h"])
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["a"]["i"], x["b"]["i"])))))
    df = _once(df, **{p: F.when(F.col(s).isNotNull(), starts)})
    # a repeated window adds the words up to the next repeated one
    steps = F.arrays_zip(F.col(p).alias("a"), F.slice(p, F.lit(2), F.size(p)).alias("b"))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, x: n + F.least(
        F.lit(WINDOW), F.coalesce(x["b"] - x["a"], F.lit(WINDOW))))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    df = _once(df, **{h: lines})
    length = lambda c: F.char_length(c).cast("bigint")
    long = lambda c: c.cast("bigint")
    return df.select(*[F.col(f"`{c}`") for c in columns if c.lower() != out.lower()], F.struct(
        long(n).alias("n_words"), length(F.array_join(w, "")).alias("word_chars"),
        (length(t) - length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        long(F.size(h)).alias("n_lines"), long(F.size(h) - F.size(F.array_distinct(h))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).alias("n_repeat_words")).alias(out))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < FEWEST_WORDS) | (100 * m["n_repeat_words"] > REPEATED_PERCENT * m["n_words"])


def at_most(n: Column, x: Column, share: float) -> Column:
    """The exact probability of ``x`` or fewer of ``n`` under the binomial law,
    by its terms' ratios, in logarithms; 1 where x is above the mean."""
    odds = F.lit(math.log(share) - math.log1p(-share))
    first = n.cast("double") * F.lit(math.log1p(-share))

    def add(a, i):
        term = a["term"] + F.log(((n - i + 1) / i).cast("double")) + odds
        top = F.greatest(a["all"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["all"] - top) + F.exp(term - top))).alias("all"))

    start = F.struct(first.alias("term"), first.alias("all"))
    upto = F.when(x > 0, F.sequence(F.lit(1).cast("bigint"), x)).otherwise(F.array().cast("array<bigint>"))
    return F.when(x > n * F.lit(share), F.lit(1.0)).otherwise(
        F.exp(F.aggregate(upto, start, add, lambda a: a["all"])))


def choose_cutoffs(holdout: DataFrame, rules=None, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The chosen cutoffs: stratum, rule, cutoff (null: none), n, rejected and
    probability (of the chosen cutoff, else of the mildest one). ``holdout``: stratum
    and m of good documents, each text once."""
    rules = rules or RULES
    tests = [(name, k, c, measure) for name, (measure, cutoffs) in rules.items() for k, c in enumerate(cutoffs)]
    m = F.col("m")
    counts = stage(holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.count_if(measure(m) > c) for _, _, c, measure in tests]).alias("rejected")), "risk-counts")
    strata = max(counts.count(), 1)
    share, level = risk / len(rules), delta / (len(rules) * strata)
    named = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(k).alias("k"), F.lit(c).cast("bigint").alias("cutoff"))
                      for name, k, c, _ in tests])
    each = counts.select("stratum", "n", F.explode(F.arrays_zip(named.alias("t"), F.col("rejected").alias("x"))).alias("z"))
    each = each.select("stratum", "n", "z.t.rule", "z.t.k", "z.t.cutoff", F.col("z.x").alias("rejected"))
    each = each.withColumn("probability", at_most(F.col("n"), F.col("rejected"), share))
    # up to the first failure; a rule has as many rows in a stratum as it has cutoffs
    done = each.groupBy("stratum", "rule").agg(
        F.max("n").alias("n"), F.min(F.when(F.col("probability") > level, F.col("k"))).alias("stop"),
        F.array_sort(F.collect_list(F.struct("k", "cutoff", "rejected", "probability"))).alias("seq"))
    taken = F.coalesce(F.col("stop"), F.size("seq"))
    at = F.get("seq", F.greatest(taken - 1, F.lit(0)))
    return done.select("stratum", "rule", F.when(taken > 0, at["cutoff"]).alias("cutoff"), "n",
                       at["rejected"].alias("rejected"), at["probability"].alias("probability"))


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, m) of the labelled good documents in ``docs`` (stratum, m,
    digest, ``key``) that pass the base rules, each text of a stratum once."""
    good = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()) \
        .groupBy(F.col(key).alias("good_id")).agg(F.min(label).alias("worst")).filter(F.col("worst") == 1)
    held = docs.filter(~base_failed(F.col("m"))).select(F.col(f"`{key}`").alias("good_id"), "stratum", "m", "digest")
    return held.join(good, "good_id", "left_semi").groupBy("stratum", "digest").agg(F.min("m").alias("m"))


def judge(docs: DataFrame, cutoffs: DataFrame, rules=None) -> DataFrame:
    """Add ``failed`` (the rules whose cutoff in the stratum is exceeded) to
    ``docs`` (stratum, m)."""
    rules = rules or RULES
    limits = cutoffs.filter(F.col("cutoff").isNotNull()).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))      # one row per rule
    m = F.col("m")
    over = F.array(*[F.when(measure(m) > F.try_element_at("limits", F.lit(name)), F.lit(name))
                     for name, (measure, _) in rules.items()])
    return docs.join(limits, "stratum", "left").withColumn("failed", F.array_compact(over)).drop("limits")


def risk_controlled(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the measures, base_failed, the rules failed and kept of every
    document (doc_id, lang, text), with cutoffs from ``labels`` (doc_id, quality)."""
    rows = measured(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum"), "text",
                                F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest")))
    rows = stage(rows.drop("text"), "rule-measures")
    cutoffs = stage(choose_cutoffs(good_documents(rows, labels), risk=risk, delta=delta), "rule-cutoffs")
    failed = base_failed(F.col("m"))
    return judge(rows, cutoffs).select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.size("failed") == 0)).alias("kept"))


def _oracle() -> str:
    """The same in SQL: windows as joined words, the binomial law by log-gamma."""
    measure = {"symbols": "1000 * n_symbols // greatest(n_words, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
               "repeat_words": "1000 * n_repeat_words // greatest(n_words, 1)", "word_length": "1000 * word_chars // greatest(n_words, 1)"}
    share = RISK / len(RULES)
    tests = ", ".join(f"('{name}', {k}, {c})" for name, (_, cutoffs) in RULES.items() for k, c in enumerate(cutoffs))
    value = "CASE rule " + " ".join(f"WHEN '{name}' THEN {sql}" for name, sql in measure.items()) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^ 	-
]+') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(8) t(k) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^ 	-
]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, stratum, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid)),
b AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM m),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
hold AS (SELECT DISTINCT ON (stratum, text) * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
rules AS (SELECT * FROM (VALUES {tests}) v(rule, k, cutoff)),
x AS (SELECT stratum, rule, k, cutoff, count(*) AS n, count_if({value} > cutoff)::BIGINT AS x FROM hold, rules GROUP BY ALL),
p AS (SELECT *, x > n * {share!r} OR list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r}))
        FOR i IN range(x + 1)]) > {DELTA!r} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM hold)) AS fails FROM x),
c AS (SELECT stratum, rule, arg_max(cutoff, k) AS cutoff FROM p
      WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.stratum = p.stratum AND q.rule = p.rule AND q.k <= p.k AND q.fails) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM c WHERE c.stratum = b.stratum AND {value} > cutoff) AS kept FROM b"""


@query("op12_risk_controlled_rules", oracle=_oracle())
def op12_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_controlled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
