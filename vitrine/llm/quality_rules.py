"""Quality rules combined by weak supervision (DataFrame functions only).

Each rule looks at per-document statistics and votes ``good``, ``bad`` or
abstains. The votes are modelled as independent given a hidden class; expectation
maximisation over the counts of vote patterns estimates the class prior and, per
rule and class, how often it casts each vote. A document's verdict is its
posterior probability of the good class, not the conjunction of all rules.

Vote patterns are aggregated by Spark; what reaches the driver is at most
3 ** len(RULES) counts, whatever the size of the table.

Words are runs of characters other than ASCII white space.

Defined results: a null text counts as empty (no words, no lines); texts without
a word fail the base rules; ids may be null or repeated, every row is judged on
its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.materialize import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_POSTERIOR = 0.5
GOOD, ABSTAIN, BAD = 1, 0, -1

# name -> (votes bad when, votes good when); otherwise it abstains
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 50", "n_words >= 100"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    "symbols": ("100 * n_symbols > 20 * n_words", "100 * n_symbols <= 5 * n_words"),
    "duplicate_lines": ("100 * n_dup_lines > 30 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words",
                    "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    "letters": ("100 * n_other_chars > 12 * word_chars", "100 * n_other_chars <= 8 * word_chars"),
    "capitals": ("100 * n_capitals > 40 * word_chars", "100 * n_capitals <= 10 * word_chars"),
}


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_other_chars, n_capitals``
    (longs; other characters are those in words that are no letters). No shuffle: arrays within the row."""
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2]),
    )).otherwise(F.array().cast("array<bigint>"))
    # repeated windows only: sort (hash, position) and look at both neighbours
    ordered = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    repeated = F.filter(F.transform("ordered", lambda x, k: F.when(
        (x["h"] == F.get("ordered", k - 1)["h"]) | (x["h"] == F.get("ordered", k + 1)["h"]),
        x["i"])), lambda p: p.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "repeated", lambda p: F.array(p, p + 1, p + 2)))))
    has_word = r"[^\x20\x09-\x0D]"
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        .select("doc_id", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"),
                F.filter(F.split("t", "\n", -1), lambda x: x.rlike(has_word)).alias("lines"))
        .select("doc_id", "t", "words", "lines", windows.alias("windows"))
        .select("doc_id", "t", "words", "lines", ordered.alias("ordered"))
        .select("doc_id", "t", "words", "lines", repeated.alias("repeated"))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("repeated").isNull(), 0).otherwise(covered).cast("long")
            .alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            F.length(F.regexp_replace(F.array_join("words", ""), r"\p{L}+", "")).cast("long")
            .alias("n_other_chars"),
            F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        )
    )


def rule_votes(stats: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """Add one int column ``vote_<rule>`` per rule; documents without words abstain."""
    return stats.select("*", *[
        F.when(F.col("n_words") == 0, ABSTAIN).when(F.expr(bad), BAD).when(F.expr(good), GOOD)
        .otherwise(ABSTAIN).alias(f"vote_{name}") for name, (bad, good) in rules.items()])


def estimate_accuracies(patterns: list[tuple[tuple[int, ...], int]], n_rules: int,
                        rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, list]:
    """EM over ``(votes, count)`` patterns.

    Returns the prior of the good class and, per rule, ``{vote: (p_good, p_bad)}``.
    The start states the rules' polarity: a vote is right more often than wrong.
    """
    prior = 0.8
    table = [{GOOD: (0.6, 0.2), ABSTAIN: (0.35, 0.3), BAD: (0.05, 0.5)} for _ in range(n_rules)]
    total = sum(count for _, count in patterns)
    for _ in range(rounds if total else 0):
        mass = [{v: [1.0, 1.0] for v in (GOOD, ABSTAIN, BAD)} for _ in range(n_rules)]
        good = 1.0
        for votes, count in patterns:
            p = _posterior(votes, prior, table)
            good += p * count
            for rule, vote in enumerate(votes):
                mass[rule][vote][0] += p * count
                mass[rule][vote][1] += (1 - p) * count
        new_prior = good / (total + 2.0)
        table = []
        for m in mass:
            sums = [sum(m[v][k] for v in m) for k in (0, 1)]
            table.append({v: (m[v][0] / sums[0], m[v][1] / sums[1]) for v in m})
        moved, prior = abs(new_prior - prior), new_prior
        if moved < tolerance:
            break
    return prior, table


def _posterior(votes: tuple[int, ...], prior: float, table: list) -> float:
    odds = math.log(prior / (1 - prior))
    for rule, vote in enumerate(votes):
        good, bad = table[rule][vote]
        odds += math.log(good / bad)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def posterior_column(prior: float, table: list, rules: dict = RULES) -> Column:
    """Posterior of the good class as an expression over the vote columns."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, votes in zip(rules, table):
        weight = {v: math.log(good / bad) for v, (good, bad) in votes.items()}
        vote = F.col(f"vote_{name}")
        odds = odds + F.when(vote == GOOD, weight[GOOD]).when(vote == BAD, weight[BAD]).otherwise(
            weight[ABSTAIN])
    return 1.0 / (1.0 + F.exp(-odds))


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  rules: dict = RULES, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Statistics, ``base_failed``, ``kept`` and ``p_good`` per row.

    The statistics are written once to the checkpoint folder (a few counts per
    row); the votes are counted and judged from there.
    """
    stats = materialize(text_statistics(docs, doc_id, text), "quality-statistics")
    voted = rule_votes(stats, rules)
    names = [f"vote_{name}" for name in rules]
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # rows that fail the base rules need no verdict, so the model describes the others
    patterns = [(tuple(row[n] for n in names), row["count"])
                for row in voted.where(~failed).groupBy(*names).count().collect()]
    prior, table = estimate_accuracies(patterns, len(names))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (posterior_column(prior, table, rules) >= min_posterior)).alias("kept"),
        posterior_column(prior, table, rules).alias("p_good"))
