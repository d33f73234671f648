"""Quality rules as weak supervision: rules vote or abstain, EM learns how far to trust each, a posterior decides.

Everything a row needs is a DataFrame expression: no Python runs on the executors. Rules see five counts of the whole
text. Each rule votes 1 (good), -1 (bad) or 0 (abstains). Votes of all documents are counted by pattern (at most
3 ** number of rules of them, whatever the corpus), and expectation-maximisation over those counts estimates the
share of good documents and each rule's accuracy on good and on bad ones. The posterior is again an expression.

Defined cases: a null or empty text has zero words and fails the base rule; ties don't arise (a posterior of exactly
0.5 keeps); repeated rows are judged alike; an empty table gives no rows and the prior model; columns other than the
text are passed through or ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty, word_array, written

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
WINDOW = 8


def _paired(hashes: Column, step: int) -> Column:
    """The hash of each element with the one step further; the last ones pair with null."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Of the words, how many lie in a window whose hash occurs twice or more."""

    def from_sorted(s: Column) -> Column:
        twice = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return let(
            F.array_sort(F.filter(twice, lambda x: x.isNotNull())),
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, from_sorted))


def repeated_words(words: Column) -> Column:
    """Words in 8-word windows that occur twice or more in the text, first occurrences included."""

    def counted(h: Column) -> Column:
        eight = let(_paired(h, 1), lambda h2: let(_paired(h2, 2), lambda h4: F.slice(_paired(h4, 4), 1, F.size(h) - (WINDOW - 1))))
        return F.when(F.size(h) <= WINDOW, F.lit(0)).otherwise(let(eight, _covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), counted)


def base_counts(text: Column) -> Column:
    """A struct of the counts that the rules see."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return let(
        word_array(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
            F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        ),
    )


def _vote(good: Column | None, bad: Column) -> Column:
    """-1 where bad, else 1 where good, else 0; a measure that a text lacks (null) leads to 0."""
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def rule_votes() -> dict[str, Column]:
    """The rules over the columns of base_counts()."""
    words, length = F.col("n_words"), _share("word_chars", "n_words")
    return {
        "length": _vote(words >= 50, words < MIN_WORDS),
        "word_length": _vote((length >= 3) & (length <= 10), (length < 2) | (length > 15)),
        "symbols": _vote(None, _share("n_symbols", "n_words") > 0.3),
        "symbol_chars": _vote(None, _share("n_symbols", "word_chars") > 0.05),
        "dup_lines": _vote(None, (F.col("n_dup_lines") >= 2) & (_share("n_dup_lines", "n_lines") > 0.3)),
        "repeats": _vote(None, _share("n_repeat_words", "n_words") > 0.2),
        "upper": _vote(None, _share("n_upper", "word_chars") > 0.4),
    }


@dataclass
class VoteModel:
    """Share of good documents, and for each rule how often it votes -1, 0 and 1 on good and on bad ones."""

    good: float = 0.85
    on_good: dict[str, list[float]] = field(default_factory=dict)
    on_bad: dict[str, list[float]] = field(default_factory=dict)

    def weights(self) -> tuple[float, dict[str, dict[int, float]]]:
        """The prior's log-odds, and what each vote of each rule adds. A rule is at least as right as chance: a vote
        of 1 never speaks against a document and one of -1 never for it; abstaining says nothing."""
        ratio = lambda r, k: math.log(self.on_good[r][k] / self.on_bad[r][k])
        return math.log(self.good / (1 - self.good)), {r: {-1: min(0.0, ratio(r, 0)), 0: 0.0, 1: max(0.0, ratio(r, 2))} for r in self.on_good}

    def posterior(self) -> Column:
        """Probability that a document is good, from the vote columns."""
        odds, weights = self.weights()
        total = F.lit(odds)
        for rule, says in weights.items():
            total = total + F.when(F.col(rule) == 1, says[1]).when(F.col(rule) == -1, says[-1]).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_votes(patterns: list[tuple[dict[str, int], int]], rules: list[str], good: float = 0.85, rounds: int = 100) -> VoteModel:
    """EM over (votes, number of documents) pairs; each count is smoothed by one document.

    The share of good documents is given, not learned: rules that mostly abstain can't tell it from their accuracies.
    """
    model = VoteModel(good, {r: [0.004, 0.296, 0.7] for r in rules}, {r: [0.4, 0.2, 0.4] for r in rules})
    for _ in range(rounds if patterns else 0):
        odds, weights = model.weights()
        on_good, on_bad = {r: [1.0] * 3 for r in rules}, {r: [1.0] * 3 for r in rules}
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-(odds + sum(weights[r][votes[r]] for r in rules))))
            for r in rules:
                on_good[r][votes[r] + 1] += n * p
                on_bad[r][votes[r] + 1] += n * (1 - p)
        share = lambda x: [y / sum(x) for y in x]
        model = VoteModel(good, {r: share(x) for r, x in on_good.items()}, {r: share(x) for r, x in on_bad.items()})
    return model


def with_votes(docs: DataFrame, keep: list[Column], text_column: str = "text") -> DataFrame:
    """keep, the base counts and a column for each rule's vote. keep must not use names of counts or rules."""
    counted = docs.select(*keep, base_counts(text_or_empty(text_column)).alias("_counts")).select("*", "_counts.*").drop("_counts")
    return counted.withColumns(rule_votes())


def learn(voted: DataFrame) -> VoteModel:
    """Fit the model to the votes of all rows; the driver sees vote patterns only, 3 ** rules at most."""
    rules = list(rule_votes())
    rows = voted.groupBy(*rules).agg(F.count("*").alias("_n")).collect()
    return fit_votes([({r: x[r] for r in rules}, x["_n"]) for x in sorted(rows)], rules)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row for each document: id, counts, base_failed, probability of being good, kept."""
    voted = written(with_votes(docs, [F.col(id_column).alias("doc_id")], text_column), "quality-votes")
    posterior = learn(voted).posterior()
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (posterior >= threshold)).alias("kept"),
        posterior.alias("p_good"),
    )


def filtered(docs: DataFrame, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with their columns. The counts are computed twice; no text is shuffled."""
    posterior = learn(with_votes(docs, [], text_column)).posterior()
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    voted = whole.select("_row", F.col(f"_row.`{text_column}`").alias("_text"))
    kept = with_votes(voted, [F.col("_row")], "_text").where(~base_failed() & (posterior >= threshold))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])
