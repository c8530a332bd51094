"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose value is above a cutoff. Cutoffs come from fixed grids, which make one fixed sequence of
ever stricter rule sets (STEPS): from the cutoffs that reject least, each step tightens one rule, the rules in turn. In each
stratum (language) the sets are tested in that order: a set is certified if, of the labelled good documents, so few break
any of its rules that an exact binomial test rejects a false rejection rate of alpha or more, at level delta / strata; the
first set that isn't ends the sequence, and the last certified one is taken. As a set is tested only after all before it
were certified, the level needs no division by the number of sets: with probability 1 - delta the rules together reject at
most alpha of the good documents in every stratum. A stratum with fewer than least_labels() labels has no rule.

Null text has no words and fails the base rule. Null language is a stratum of its own. A document labelled more than once
counts as good only if every label says so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.llm import kernels
from talkscale.llm.common import add_columns, materialise

COUNTS = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]
ALPHA, DELTA = 0.02, 0.05

#: The rules: a value, and cutoffs from the one that rejects most.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0, 3.0)),
    "capitals": ("n_upper / word_chars", (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    "repeated_lines": ("n_dup_lines / n_lines", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8)),
    "repeated_words": ("n_repeat_words / n_words", (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18, 0.2)),
    "long_words": ("word_chars / n_words", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0, 100.0)),
    "short_words": ("- word_chars / n_words", (-4.0, -3.75, -3.5, -3.25, -3.0, -2.75, -2.5, -2.0, -1.5, -1.25)),
}


#: The sequence of rule sets: each step adds a rule or tightens it.
STEPS = [(rule, RULES[rule][1][-1 - i]) for i in range(max(len(grid) for _, grid in RULES.values())) for rule in RULES if i < len(RULES[rule][1])]


def value(rule: str) -> Column:
    above, below = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.expr(above).cast("double"), F.col(below)), F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed from k down until terms no longer count."""
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and (term > 0 or i == k):
        total += term
        if term < total * 1e-17:
            break
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(total, 1.0)


def certified(above: int, n: int, rate: float, level: float) -> bool:
    """Whether the exact upper bound (Clopper-Pearson, confidence 1 - level) on the rate behind above of n is at most rate."""
    return n > 0 and above < n * rate and binomial_cdf(above, n, rate) <= level


def least_labels(rate: float, level: float) -> int:
    """Fewer labels than this certify nothing."""
    return math.ceil(math.log(level) / math.log1p(-rate))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each document."""
    return add_columns(docs, ["doc_id", "lang"], "text", ", ".join(f"{c} bigint" for c in COUNTS), _ordered)


def _ordered(t) -> list:
    found = kernels.quality_counts(t)
    return [found[c] for c in COUNTS]


def learn_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """For each stratum the certified cutoff of each rule. Only strata with enough labels come to the driver, one row each."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    holdout = measured.where(~base_failed()).join(good, "doc_id", "left_semi")
    step = F.least(*[F.when(value(r) > c, i) for i, (r, c) in enumerate(STEPS)])  # the first that rejects the document
    sizes = holdout.select("lang", step.alias("step")).groupBy("lang").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("step") <= i, 1)).alias(f"above_{i}") for i in range(len(STEPS))])
    sizes = materialise(sizes, "holdout")
    level = delta / max(sizes.count(), 1)
    out = {}
    for row in sizes.where(F.col("n") >= least_labels(alpha, level)).collect():
        out[row["lang"]] = last_certified([row[f"above_{i}"] for i in range(len(STEPS))], row["n"], alpha, level)
    return out


def last_certified(above: list[int], n: int, rate: float, level: float) -> dict[str, float]:
    """The cutoffs of the last set before the first that isn't certified; above: how many of n each set rejects."""
    out = {}
    for (rule, cutoff), k in zip(STEPS, above, strict=True):
        if not certified(k, n, rate, level):
            break
        out[rule] = cutoff
    return out


def rejected(cutoffs: dict[str | None, dict[str, float]]) -> Column:
    """The rules that a measured document breaks, joined by commas."""
    out = []
    for rule in RULES:
        limit = F.lit(None).cast("double")
        for stratum, own in cutoffs.items():
            if rule in own:
                limit = F.when(F.col("lang").eqNullSafe(F.lit(stratum)), F.lit(own[rule])).otherwise(limit)
        out.append(F.when(value(rule) > limit, F.lit(rule)))
    return F.concat_ws(",", *out)


def judge_quality(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, broken (names of broken rules)."""
    measured = materialise(measure(docs), "quality")
    broken = rejected(learn_cutoffs(measured, labels, alpha, delta))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & (broken == "")).alias("kept"), broken.alias("broken"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that judge_quality keeps, with docs' own columns. Texts are never shuffled."""
    cutoffs = learn_cutoffs(measure(docs), labels, alpha, delta)
    rows = docs.select(F.struct("*").alias("row"), "lang", F.col("text").alias("_t"))
    counted = add_columns(rows, ["row", "lang"], "_t", ", ".join(f"{c} bigint" for c in COUNTS), _ordered)
    return counted.where(~base_failed() & (rejected(cutoffs) == "")).select("row.*")
