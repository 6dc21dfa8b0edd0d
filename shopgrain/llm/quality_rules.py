"""Quality rules as weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document.  Nobody
tells which rules are right: expectation-maximisation estimates, for each
rule, how often its vote is right on good and on bad documents, and a document
stays if the posterior probability that it is good reaches one half.  A strict
base test comes first.

Votes are counted by pattern, of which there are at most 3 to the power of the
number of rules, so the estimation reads a table of bounded size, however many
documents there are; only the sums of one step reach the driver.  A null text
has no words and fails the base test; so do empty texts.  Repeated rows count
and are judged one by one.  Without documents the rules keep their first
guess.  Words and lines are kept in arrays for one document at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.columns import WORD, let, named, own, whole
from shopgrain.sources.shared import materialize

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 20
MOST_REPEATED_PERCENT = 30

# Frequent short words of the languages in use.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "with", "on", "as", "are", "this", "be", "by",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "est", "pour", "dans", "sur",
    "der", "die", "das", "und", "von", "zu", "mit", "ist", "den", "ein", "eine", "im", "nicht", "auf", "für", "sich",
    "el", "los", "las", "y", "se", "del", "por", "con", "una", "su", "para", "al", "lo", "no",
)


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that the array holds twice or more, the first included.

    A window's key is a 64-bit hash, folded from pairs to fours to eights.
    Equal windows have equal keys; that two different ones of a text collide
    has a probability of about the square of its words over 2**65.
    """
    def fold(keys: Column, step: int) -> Column:
        left = F.size(keys) - step
        return F.zip_with(F.slice(keys, 1, left), F.slice(keys, step + 1, left), lambda x, y: F.xxhash64(x, y))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def count(s: Column) -> Column:
            again = F.filter(s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]))
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            # Each window adds what reaches beyond the one before it.
            return F.aggregate(
                starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, i: F.struct(
                    (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end"),
                ),
            )["n"]

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(let(placed, count))

    ones = F.transform(words, lambda w: F.xxhash64(w))
    keys = let(let(let(ones, lambda k: fold(k, 1)), lambda k: fold(k, 2)), lambda k: fold(k, 4))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(keys, covered)).cast("long")


#: Signals that are reported, and those that only the rules use.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = (
    "symbols", "word_length", "line_copies", "window_copies", "capitals", "line_ends", "stop_words", "variety",
)
EXTRA = ("n_lines", "n_ended_lines", "n_capitals", "n_stop_words", "n_distinct_words")


def signals(docs: DataFrame, text_column: str, prefix: str = "") -> DataFrame:
    """``docs`` with the signals of every whole text, their names after ``prefix``."""
    words, lines, text = own(docs, f"{prefix}words", f"{prefix}lines", f"{prefix}whole")
    w, ls, t = named(words), named(lines), named(text)
    rows = docs.withColumn(text, whole(named(text_column)))
    rows = rows.withColumn(words, F.regexp_extract_all(t, F.lit(WORD), 0))
    rows = rows.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)))
    values = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
        "n_repeat_words": repeated_words(w),
        "n_lines": F.size(ls),
        "n_ended_lines": F.size(F.filter(ls, lambda x: x.rlike(r'[.!?:;"”»…][\x20\x09-\x0D]*$'))),
        "n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))),
        "n_distinct_words": F.size(F.array_distinct(w)),
    }
    made = [v.cast("long").alias(f"{prefix}{k}") for k, v in values.items()]
    return rows.select(*[named(c) for c in docs.columns], *made)


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MOST_REPEATED_PERCENT * n)


def votes(prefix: str = "") -> dict[str, Column]:
    """Each rule's vote from the signals, in the order of RULES."""
    c = {k: F.col(f"{prefix}{k}").cast("double") for k in (*BASE, *EXTRA)}

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")

    def share(part: str, of: str) -> Column:
        return F.when(c[of] > 0, c[part] / F.when(c[of] > 0, c[of]))

    symbols, length = share("n_symbols", "n_words"), share("word_chars", "n_words")
    lines, ended = share("n_dup_lines", "n_lines"), share("n_ended_lines", "n_lines")
    ended = F.when(c["n_lines"] > 1, ended)  # one line alone may be a cut sentence
    again, capitals = share("n_repeat_words", "n_words"), share("n_capitals", "word_chars")
    stops = share("n_stop_words", "n_words")
    # Distinct words grow about as the root of all words.
    variety = F.when(c["n_words"] > 0, c["n_distinct_words"] / F.sqrt(c["n_words"]))
    return {
        "symbols": vote(symbols, symbols < 0.02, symbols > 0.1),
        "word_length": vote(length, (length >= 4) & (length <= 7), (length < 3) | (length > 9)),
        "line_copies": vote(lines, lines < 0.1, lines > 0.4),
        "window_copies": vote(again, again < 0.05, again > 0.3),
        "capitals": vote(capitals, capitals < 0.15, capitals > 0.3),
        "line_ends": vote(ended, ended >= 0.8, ended < 0.3),
        "stop_words": vote(stops, stops >= 0.06, stops < 0.02),
        "variety": vote(variety, variety >= 3, variety < 2),
    }


@dataclass(frozen=True)
class RuleModel:
    """What is believed of the corpus and of each rule."""

    #: Share of good documents.
    good: float = 0.85
    #: How often a rule that votes is right on good documents, and on bad ones.
    right_good: dict[str, float] = field(default_factory=lambda: dict.fromkeys(RULES, 0.95))
    right_bad: dict[str, float] = field(default_factory=lambda: dict.fromkeys(RULES, 0.4))

    def posterior(self, voted: dict[str, Column]) -> Column:
        """Probability that a document with these votes is good."""
        odds = F.lit(math.log(self.good) - math.log1p(-self.good))
        for k, v in voted.items():
            g, b = self.right_good[k], self.right_bad[k]
            odds = odds + F.when(v == 1, math.log(g / (1 - b))).when(v == -1, math.log((1 - g) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


#: The smallest and largest belief, and how many documents' worth the first guess counts.
LEAST, MOST, FIRST_GUESS = 0.02, 0.9995, 10.0
STEPS = 15


def fit(voted: DataFrame, steps: int = STEPS) -> RuleModel:
    """Estimate the rules' accuracies from a frame of votes, all documents counted.

    A rule is held to be right on good documents more often than not, which
    keeps good and bad from changing places.
    """
    rules = list(RULES)
    patterns = materialize(voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")))
    first = model = RuleModel()
    for _ in range(steps):
        post = model.posterior({k: F.col(k) for k in rules})
        rows = patterns.select(*rules, "n", (F.col("n") * post).alias("good"))
        rows = rows.withColumn("bad", F.col("n") - F.col("good"))

        def total(of: str, when: Column) -> Column:
            return F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0.0))

        sums = rows.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"),
            *[total("good", F.col(k) == 1).alias(f"gr_{k}") for k in rules],
            *[total("good", F.col(k) != 0).alias(f"gv_{k}") for k in rules],
            *[total("bad", F.col(k) == -1).alias(f"br_{k}") for k in rules],
            *[total("bad", F.col(k) != 0).alias(f"bv_{k}") for k in rules],
        ).first()

        def belief(right: float, of: float, guess: float, least: float) -> float:
            return min(MOST, max(least, (right + FIRST_GUESS * guess) / (of + FIRST_GUESS)))

        model = RuleModel(
            belief(sums["good"], sums["n"], first.good, LEAST),
            {k: belief(sums[f"gr_{k}"], sums[f"gv_{k}"], first.right_good[k], 0.5) for k in rules},
            {k: belief(sums[f"br_{k}"], sums[f"bv_{k}"], first.right_bad[k], LEAST) for k in rules},
        )
    return model


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the signals, base_failed, posterior and kept of every document."""
    pair = docs.select(named(id_column).alias("doc_id"), named(text_column).alias("text"))
    rows = materialize(signals(pair, "text").drop("text"))
    model = fit(rows.select(*[v.alias(k) for k, v in votes().items()]))
    return rows.withColumn("base_failed", base_failed()).withColumn("posterior", model.posterior(votes())).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)
    )


def good_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that stay, columns as they were.

    The text is read once for the votes and once for the result; nothing but
    vote patterns is shuffled.
    """
    prefix = "_rule_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    seen = docs.select(named(text_column).alias("text"))
    model = fit(signals(seen, "text").select(*[v.alias(k) for k, v in votes().items()]))
    # Spark would move the filter below the signals and compute each once more for every use.  A filter that
    # reads a running id stays above.
    seen_once = f"{prefix}seen"
    rows = signals(docs, text_column, prefix).withColumn(seen_once, F.monotonically_increasing_id())
    good = ~base_failed(prefix) & (model.posterior(votes(prefix)) >= 0.5)
    kept = rows.filter((F.col(seen_once) >= 0) & good)
    return kept.select(*[named(c) for c in docs.columns])
