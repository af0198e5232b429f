"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, posterior probability.

Each rule votes good or bad, or abstains. Votes are counted by pattern (at most 3**rules of them, whatever the
corpus); expectation-maximisation on those counts estimates how each rule votes on good and on bad texts, and a
document's posterior probability of being good is a sum of literals. Everything on the rows is built-in functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import SEPARATORS, SPLIT, fresh, without

WINDOW = 8


def measures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with a struct ``out`` of the measures of the whole text; NULL text has no words.

    n_words, word_chars, n_symbols, n_dup_lines (lines with a word that equal an earlier one), n_repeat_words (words
    in 8-word windows found twice or more in the text), n_lines, n_distinct, n_upper, n_marks. Windows are compared by
    a 64-bit hash of their words.
    """
    df = without(df, out)
    t, words, codes, wins, order, lines = (fresh(df, f"_{out}_{x}") for x in ("t", "w", "c", "v", "o", "l"))
    c = F.col
    d = df.withColumn(t, F.coalesce(c(text), F.lit("")))
    d = d.withColumn(words, F.array_remove(F.split(t, SPLIT), ""))
    d = d.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0))
    d = d.withColumn(codes, F.transform(words, lambda w: F.xxhash64(w)))
    d = d.withColumn(wins, F.when(F.size(codes) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(codes) - WINDOW), lambda i: F.xxhash64(*(F.get(c(codes), i + k) for k in range(WINDOW)))
    )).otherwise(F.array().cast("array<bigint>")))
    pair = "array<struct<h:bigint,i:int>>"
    d = d.withColumn(order, F.when(
        F.size(F.array_distinct(wins)) < F.size(wins),
        F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast(pair)))
    same = lambda x, j: F.coalesce(F.get(c(order), j)["h"] == x["h"], F.lit(False))
    twice = F.sort_array(F.transform(
        F.filter(order, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        twice, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])
    long = lambda x: x.cast("long")
    # a generator, so that a filter on the measures isn't pushed below and evaluated from scratch for each of them
    return d.withColumn(out, F.explode(F.array(F.struct(
        long(F.size(words)).alias("n_words"),
        long(F.length(F.translate(t, SEPARATORS, ""))).alias("word_chars"),
        long(F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        long(F.size(lines)).alias("n_lines"),
        long(F.size(F.array_distinct(codes))).alias("n_distinct"),
        long(F.length(F.regexp_replace(t, "[^\\p{Lu}]+", ""))).alias("n_upper"),
        long(F.length(t) - F.length(F.translate(t, "!", ""))).alias("n_marks"),
    )))).select(*df.columns, out)


def base_failed(q: str) -> Column:
    m = F.col(q)
    return (m["n_words"] < 20) | (m["n_repeat_words"] * 100 > m["n_words"] * 30)


def votes(q: str) -> dict[str, Column]:
    """Each rule's vote by the measures ``q``: -1 bad, 1 good, 0 abstains. No words: all abstain."""
    m = F.col(q)
    n, chars = m["n_words"], m["word_chars"]

    def rule(bad: Column, good: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    variety = F.log(m["n_distinct"].cast("double")) / F.log(F.greatest(n, F.lit(2)).cast("double"))
    never = F.lit(False)
    return {
        "symbols": rule(m["n_symbols"] * 10 > n, never),
        "case": rule(m["n_upper"] * 10 > chars * 4, never),
        "repetition": rule(m["n_repeat_words"] * 5 > n, never),
        "lines": rule(m["n_dup_lines"] * 10 > m["n_lines"] * 3, never),
        "marks": rule(m["n_marks"] * 4 > n, never),
        "variety": rule((n >= 20) & (variety < 0.8), (n >= 20) & (variety >= 0.87)),
        "length": rule((chars < n * 3) | (chars > n * 10), (chars >= n * 4) & (chars <= n * 7)),
    }


@dataclass(frozen=True)
class RuleModel:
    """Share of good texts, the log-odds for good of a rule's bad vote, abstention and good vote, and its accuracy."""

    names: tuple[str, ...]
    prior: float
    weights: tuple[tuple[float, float, float], ...]
    accuracies: tuple[float, ...]

    def probability(self, cast: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (bad, none, good) in zip(self.names, self.weights):
            odds = odds + F.when(cast[name] < 0, bad).when(cast[name] > 0, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def estimate(
    patterns: Sequence[tuple[tuple[int, ...], int]], names: Sequence[str], false_votes: float = 0.002, rounds: int = 500,
) -> RuleModel:
    """Expectation-maximisation over counted vote patterns.

    Good and bad texts each have their own chances of a rule's three answers. ``false_votes`` bounds the chance of a
    bad vote on a good text: a rule that hits more texts than that isn't believed to say something else, so rules that
    fire alone keep their meaning. The start takes a text with a bad vote as bad with probability 0.9, others as good
    with 0.98. A rule's accuracy is the estimated share of its votes that are right.
    """
    total = sum(n for _, n in patterns)
    good = [0.1 if min(p, default=0) < 0 else 0.98 for p, _ in patterns]
    prior, chance, right = 0.5, {}, [0.5] * len(names)
    for _ in range(rounds):
        mass = {1: sum(n * g for (_, n), g in zip(patterns, good))}
        mass[0] = total - mass[1]
        prior = (mass[1] + 1) / (total + 2)
        for j in range(len(names)):
            hits = {(y, v): sum(n * (g if y else 1 - g) for (p, n), g in zip(patterns, good) if p[j] == v)
                    for y in (0, 1) for v in (-1, 0, 1)}
            right[j] = (hits[1, 1] + hits[0, -1] + 1) / (hits[1, 1] + hits[0, -1] + hits[1, -1] + hits[0, 1] + 2)
            for y in (0, 1):
                c = {v: (hits[y, v] + false_votes) / (mass[y] + 3 * false_votes) for v in (-1, 0, 1)}
                if y:
                    c = {-1: min(false_votes, max(c[-1], false_votes / 10)), 0: max(c[0], 0.01), 1: c[1]}
                chance |= {(j, y, v): c[v] for v in c}
        new = []
        for p, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j, 1, v] / chance[j, 0, v]) for j, v in enumerate(p))
            new.append(1 / (1 + math.exp(-max(-700, min(700, odds)))))
        moved = max((abs(a - b) for a, b in zip(new, good)), default=0)
        good = new
        if moved < 1e-9:
            break
    weights = tuple(tuple(math.log(chance[j, 1, v] / chance[j, 0, v]) for v in (-1, 0, 1)) for j in range(len(names))) \
        if chance else ((0.0, 0.0, 0.0),) * len(names)
    return RuleModel(tuple(names), prior, weights, tuple(right))


def fit(measured: DataFrame, q: str) -> RuleModel:
    """Rule model of all rows with measures ``q``; only the counted patterns reach the driver."""
    cast = votes(q)
    rows = measured.select(*(v.alias(k) for k, v in cast.items())).groupBy(*cast).count().collect()
    return estimate(sorted((tuple(r[:-1]), r[-1]) for r in rows), list(cast))


def judge(measured: DataFrame, q: str, model: RuleModel, probability: str, kept: str, least: float = 0.5) -> DataFrame:
    """``measured`` with the posterior probability of a good text and ``kept``: base rules passed and probability >= least."""
    p = model.probability(votes(q))
    return measured.withColumn(probability, p).withColumn(kept, ~base_failed(q) & (F.col(probability) >= least))
