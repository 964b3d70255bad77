"""Quality rules with risk-controlled thresholds.

A rule is a score of a document; the rule rejects it if the score is greater than a cutoff. Cutoffs are not set by
hand: labelled documents are a holdout on which, per stratum, a ladder of joint cutoffs is tested. Step i of the ladder
takes the i-th cutoff of every rule at once, so each step rejects what the step before rejected and more. The
hypothesis of a step is that it rejects more than `risk` of the stratum's good documents; its p-value is the exact
binomial tail P(Bin(n good, risk) <= good ones rejected). Steps are tested from the loosest to the strictest and testing
stops at the first that fails (fixed sequence, no correction needed within a stratum). Over strata the level is
corrected by Holm's step-down on whole ladders: of m strata each starts with delta / m, and a stratum whose ladder has
passed to its end hands its level on to the others in equal parts. So, with probability 1 - delta, in every stratum at
once, the rules together reject at most `risk` of the good documents. Of the certified steps the one is taken which
rejects most bad documents net of good ones, the loosest of equal ones.

A stratum without a wrong rejection needs ln(delta / m) / ln(1 - risk) good labels: 174 with the parameters below and
four strata; 300 certify with one wrong rejection for up to ten strata.

Defined results: null or empty text has no words, so every count is 0 and the base rules reject it. A null stratum is a
stratum of its own. Labels with a null id or null quality do not count; several labels of one id count as bad if any
says so. A stratum without labels, or with too few to certify anything, has no cutoffs and rejects nothing. Repeated
rows are judged one by one, and each counts if it is labelled. A score equal to its cutoff passes; equal steps go to the
loosest, equal ladders to the first stratum by name. Texts of any length are measured whole; windows of three words are
compared by 64-bit hash within one document. Without documents there are no rows, without labels only the base rules
hold. Extra columns are not carried, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.llm.shared import Workspace, size_checked

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: rule: (score over the measures, its cutoffs by step, from the loosest to the strictest; the last one stays)
RULES = {
    "symbols": ("n_symbols / n_words", (3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / n_lines", (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.48, 0.45, 0.4, 0.35, 0.3, 0.28, 0.25, 0.22, 0.2, 0.18, 0.15, 0.12, 0.1)),
    "long_words": ("word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.5, 10.0)),
}
RISK, DELTA = 0.025, 0.05


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Sorting keeps it near linear in the number of words."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(starts):
        steps = F.transform(starts, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - v, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, n: a + n)

    def repeated(ranked):
        again = F.filter(ranked, lambda x, j: F.coalesce(F.get(ranked, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ranked, j + 1)["h"] == x["h"], F.lit(False)))
        return _let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def count(h):
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(ranked, repeated))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(hashes, count))


def measures(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words> of a text, all long."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
    chars = lambda without: F.length(F.translate(body, without, "")).cast("long")
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("x"),
        chars(SPACES).alias("word_chars"),
        (F.length(body) - chars(SYMBOLS)).alias("n_symbols"),
    )


def measured(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The columns in keep beside the six measures and base_failed."""
    found = docs.select(*keep, measures(F.col(text)).alias("_m"))
    return found.select(
        *[c for c in found.columns if c != "_m"],
        F.col("_m.w.n").alias("n_words"),
        F.col("_m.word_chars").alias("word_chars"),
        F.col("_m.n_symbols").alias("n_symbols"),
        F.col("_m.x.n").alias("n_lines"),
        (F.col("_m.x.n") - F.col("_m.x.d")).alias("n_dup_lines"),
        F.col("_m.w.r").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lgamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1, by Stirling's series at x + 8."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shift = x
    for i in range(1, 8):
        shift = shift * (x + float(i))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(shift)


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), exact to rounding; 1 where k is not below n * risk, as no test passes there.

    Below the mean the terms fall towards 0, so the sum runs downwards from k; the terms beyond ten standard deviations
    are under 1e-20 of it, so that the work grows with the root of n.
    """
    k_, n_ = k.cast("double"), n.cast("double")
    top = F.exp(_lgamma(n_ + 1) - _lgamma(k_ + 1) - _lgamma(n_ - k_ + 1) + k_ * math.log(risk) + (n_ - k_) * math.log1p(-risk))
    steps = F.least(k.cast("long"), F.ceil(10 * F.sqrt(n_ * risk)).cast("long") + 200)
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (k_ - i) * (1 - risk) / ((n_ - k_ + i + 1) * risk)).alias("term")),
        lambda a: a["sum"],
    )
    return F.when(k_ >= n_ * risk, F.lit(1.0)).otherwise(top * total)


def _steps(rules: dict) -> int:
    return max(len(cs) for _, cs in rules.values())


def cutoffs(holdout: DataFrame, rules: dict = RULES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: stratum, step and a column per rule (no row where nothing is certified or worth it).

    holdout: stratum, good (boolean) and the measures, one row per labelled document. Documents are counted per stratum
    and first step that rejects them, combined before the shuffle; what follows is a few rows per stratum.
    """
    steps = _steps(rules)
    # cutoffs fall with the step: a score that exceeds e of a rule's l cutoffs is first rejected at step l - e
    first = [F.when(F.expr(score) > cs[-1], len(cs) - sum((F.expr(score) > c).cast("int") for c in cs)).otherwise(steps) for score, cs in rules.values()]
    counted = (
        holdout.filter("n_words > 0")
        .select("stratum", "good", (F.least(*first) if len(first) > 1 else first[0]).alias("first"))
        .groupBy("stratum", "first")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    totals = counted.groupBy("stratum").agg(F.sum("good").alias("n"), F.collect_list(F.struct("first", "good", "bad")).alias("cells"))  # at most one per step
    upto = lambda field: F.aggregate(F.filter("cells", lambda x: x["first"] <= F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x[field])
    tests = totals.select("stratum", "n", "cells", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    tests = tests.select("stratum", "step", "n", upto("good").alias("good"), upto("bad").alias("bad"))
    ladder = Window.partitionBy("stratum").orderBy("step")
    tests = tests.withColumn("p", F.max(binomial_tail(F.col("good"), F.col("n"), risk)).over(ladder))
    # one row per stratum from here: how many ladders pass whole, taken from the least p-value on
    by_p = Window.orderBy("whole", "stratum")
    families = tests.groupBy("stratum").agg(F.max("p").alias("whole")).select("stratum", "whole", F.row_number().over(by_p).alias("place"), F.count("*").over(Window.partitionBy()).alias("m"))
    families = families.withColumn("done", F.min(F.col("whole") * (F.col("m") - F.col("place") + 1) <= delta).over(by_p))
    families = families.select(F.col("stratum").alias("_of"), "done", (F.col("m") - F.count_if("done").over(Window.partitionBy())).alias("left"))
    certified = tests.join(families, F.col("stratum").eqNullSafe(F.col("_of"))).filter("done OR p * left <= %r" % delta).filter("bad > good")
    best = certified.groupBy("stratum").agg(F.max_by("step", F.struct(F.col("bad") - F.col("good"), -F.col("step"))).alias("step"))
    return best.select("stratum", "step", *[F.element_at(F.array(*[F.lit(c) for c in cs]), F.least(F.col("step") + 1, F.lit(len(cs)))).alias(r) for r, (_, cs) in rules.items()])


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", rules: dict = RULES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """key, stratum, the measures, base_failed, failed_rules (array) and kept, one row per document.

    Measures are computed once and written; labels meet them by key, and the few cutoffs come back by stratum.
    """
    work = Workspace(docs.sparkSession, "quality")
    found = work.keep(measured(docs, text, F.col(key).alias(key), F.col(stratum).cast("string").alias("stratum")), "measures")
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.min(label) > 0).alias("good"))
    holdout = found.filter("NOT base_failed").join(marks, key)
    chosen = work.keep(cutoffs(holdout, rules, risk, delta).select(F.col("stratum").alias("_of"), *[F.col(r).alias(f"_{r}") for r in rules]), "cutoffs")
    broken = [F.when(F.expr(score) > F.col(f"_{r}"), F.lit(r)) for r, (score, _) in rules.items()]
    failed = F.when(F.col("n_words") > 0, F.array_compact(F.array(*broken))).otherwise(F.array().cast("array<string>"))
    return (
        found.join(size_checked(chosen), F.col("stratum").eqNullSafe(F.col("_of")), "left")
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("_of", *[f"_{r}" for r in rules])
    )


def oracle(rules: dict = RULES, risk: float = RISK, delta: float = DELTA) -> str:
    """The same verdicts in SQL: every step's rejections counted as stated, the binomial tail as a plain sum."""
    as_double = lambda s: s.replace(" / ", "::DOUBLE / ")
    ladder = ", ".join(f"({i}, {', '.join(f'{cs[min(i, len(cs) - 1)]}::DOUBLE' for _, cs in rules.values())})" for i in range(_steps(rules)))
    over = " OR ".join(f"{as_double(s)} > _{r}" for r, (s, _) in rules.items())
    names = ", ".join(f"_{r}" for r in rules)
    ws = r"[^\x20\x09-\x0D]"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents
), split_up AS (
  SELECT *, regexp_extract_all(text, '{ws}+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{ws}')) AS lines FROM texts
), windows AS (
  SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM split_up WHERE len(words) >= 3)
), again AS (
  SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, w) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT row_id, count(DISTINCT place) AS n FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY row_id
), measures AS (
  SELECT s.doc_id, s.row_id, stratum, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split_up s LEFT JOIN repeats r ON r.row_id = s.row_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures
), marks AS (
  SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), holdout AS (
  SELECT j.*, good FROM judged j JOIN marks USING (doc_id) WHERE NOT base_failed AND n_words > 0
), ladder(step, {names}) AS (VALUES {ladder}), tests AS (
  SELECT stratum, step, count_if(good)::BIGINT AS n, count_if(good AND ({over}))::BIGINT AS k, count_if(NOT good AND ({over}))::BIGINT AS bad
  FROM holdout CROSS JOIN ladder GROUP BY ALL
), tails AS (
  SELECT *, CASE WHEN k >= n * {risk!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))) END AS tail FROM tests
), levels AS (
  SELECT *, max(tail) OVER (PARTITION BY stratum ORDER BY step) AS p FROM tails
), ladders AS (
  SELECT stratum, max(tail) AS whole FROM tails GROUP BY stratum
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY whole, stratum NULLS FIRST) AS place, count(*) OVER () AS m FROM ladders
), held AS (
  SELECT *, bool_and(whole * (m - place + 1) <= {delta!r}) OVER (ORDER BY place) AS done FROM ranked
), certified AS (
  SELECT l.* FROM levels l JOIN held h ON l.stratum IS NOT DISTINCT FROM h.stratum
  WHERE (h.done OR l.p * (h.m - (SELECT count_if(done) FROM held)) <= {delta!r}) AND l.bad > l.k
), best AS (
  SELECT stratum, min(step) AS step FROM certified c
  WHERE bad - k = (SELECT max(bad - k) FROM certified d WHERE d.stratum IS NOT DISTINCT FROM c.stratum) GROUP BY stratum
), chosen AS (
  SELECT b.stratum AS of_stratum, l.* FROM best b JOIN ladder l USING (step)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words > 0 AND ({over}), false) AS kept
FROM judged LEFT JOIN chosen ON stratum IS NOT DISTINCT FROM of_stratum
"""
