"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a failure predicate over the text. Its cost and selectivity are measured on a bounded random sample, the rules
are ordered by rejections per second, each among the rows that those before it let pass, and one CASE expression evaluates
them in that order, so a row that an early rule rejects never reaches the later ones. The order changes cost alone: a row is
kept exactly if no rule fails.

Defined cases: a null or empty text has no words and fails; a very long one is judged whole; words are maximal runs without ASCII white space; repeated rows
are judged each for itself; an empty table gives an empty result; other columns are passed through untouched, and the
working columns carry a prefix of their own so that equal names in the input do no harm.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoloom.session import stash

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample on which cost and selectivity are measured; how often a measured pass goes over it, and is repeated.
SAMPLE_ROWS, REPEATS, RUNS = 512, 2, 1
P = "__q_"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, "")).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def n_upper(text: Column) -> Column:
    """ASCII capitals."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words inside a window of three that occurs at least twice in the text.

    Windows become 64-bit hashes. A text whose hashes are all distinct is done; else (hash, place) pairs are sorted, equal
    neighbours are the repeated windows, and one fold over their sorted places adds the words that each newly covers.
    """
    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            hit = F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            let(pairs, places),
            start,
            lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")),
            lambda a: a["n"],
        )

    # bound, so that no rewrite of the plan puts the split inside the function over its words
    return let(let(words, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


@dataclass(frozen=True)
class Rule:
    """``fails`` builds the failure predicate from a source of features."""

    name: str
    fails: object


class Lazy:
    """Features as expressions over the text column: a rule pays for what it reads."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = text, words

    @property
    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    @property
    def word_chars(self) -> Column:
        return word_chars(self.text)

    @property
    def n_symbols(self) -> Column:
        return n_symbols(self.text)

    @property
    def n_upper(self) -> Column:
        return n_upper(self.text)

    @property
    def n_dup_lines(self) -> Column:
        return n_dup_lines(self.text)

    @property
    def n_repeat_words(self) -> Column:
        return n_repeat_words(self.words)


class Ready:
    """Features that stand in columns already, and the capitals, which no column holds."""

    def __init__(self, text: Column):
        self.text = text

    @property
    def n_upper(self) -> Column:
        return n_upper(self.text)

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


BASE = (
    Rule("too_few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
#: Beside the base rules: symbols crowding the words, capitals in place of small letters, words
#: too long or short on average, lines repeated over and over.
EXTRA = (
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("shouting", lambda f: 10 * f.n_upper > 3 * f.word_chars),
    Rule("word_length", lambda f: let(f.word_chars, lambda n: (n < 2 * f.n_words) | (n > 15 * f.n_words))),
    Rule("repeated_lines", lambda f: let(f.n_dup_lines, lambda n: (n >= 10) & (20 * n > f.n_words))),
)
RULES = BASE + EXTRA


def any_fails(rules, features) -> Column:
    """True if one of ``rules`` fails; later ones are not evaluated once one has failed."""
    chain = F
    for rule in rules:
        chain = chain.when(rule.fails(features), F.lit(True))
    return chain.otherwise(F.lit(False)) if rules else F.lit(False)


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(f"{P}words", words_of(F.col(text)))


def order_by_worth(rejects: list[list[bool]], costs: list[float]) -> list[int]:
    """Places of rules, each next one that which rejects most per cost of what its predecessors let pass; ties by place.

    ``rejects`` holds the verdicts of all rules for each sampled row. Costs count by powers of two, so that the noise of a
    measurement seldom changes the order.
    """
    left, todo, out = list(rejects), list(range(len(costs))), []
    level = [2.0 ** round(math.log2(c)) for c in costs]
    while todo:
        rate = {i: sum(row[i] for row in left) / max(1, len(left)) for i in todo}
        # rules that reject no more rows go cheapest first
        best = min(todo, key=lambda i: (-rate[i] / level[i], level[i], i))
        out.append(best)
        todo.remove(best)
        left = [row for row in left if not row[best]]
    return out


def plan_cascade(df: DataFrame, text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules with their measured (rejection rate, seconds a sampled row), in the order of the cascade.

    The sample is drawn at random from the whole table, about ``sample_rows`` rows of it at any size, and stays in the shared
    folder; the driver sees verdicts and times. A rule's cost is the least time of ``RUNS`` warm passes over ``REPEATS``
    copies of the sample, less that of a pass that reads the words alone. The sample decides the order alone, never a
    verdict. A table without rows keeps the given order.
    """
    n = df.count()
    share = min(1.0, 1.5 * sample_rows / max(n, 1))
    sample = stash(df.select(F.col(text).cast("string").alias("text")).sample(share, seed=1).limit(sample_rows), "quality-sample")
    sample = sample.withColumn("words", words_of(F.col("text"))).repartition(1).persist()
    features = Lazy(F.col("text"), F.col("words"))
    verdicts = [[bool(x) for x in r] for r in sample.select(*[F.coalesce(rule.fails(features), F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules)]).collect()]
    if not verdicts:
        sample.unpersist()
        return [(rule, 0.0, 0.0) for rule in rules]
    many = sample.select("text", "words", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("again"))

    def seconds(verdict: Column) -> float:
        job, best = many.agg(F.count(F.when(verdict, 1))), math.inf
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            job.first()
            best = min(best, time.perf_counter() - began)
        return best

    base = seconds(F.size("words") + F.col("again") < 0)
    costs = [max(seconds(rule.fails(features)) - base, 1e-4) / (REPEATS * len(verdicts)) for rule in rules]
    sample.unpersist()
    rates = [sum(row[i] for row in verdicts) / len(verdicts) for i in range(len(rules))]
    return [(rules[i], rates[i], costs[i]) for i in order_by_worth(verdicts, costs)]


def filter_quality(df: DataFrame, text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``df``."""
    ordered = [rule for rule, _, _ in plan_cascade(df, text, rules, sample_rows)]
    # words are bound inside the one expression of the filter, which the optimizer can't take apart
    failed = let(words_of(F.col(text)), lambda words: any_fails(ordered, Lazy(F.col(text), words)))
    return df.where(~failed)


def score_quality(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Columns of these names in ``df`` are replaced.
    """
    order = [rule for rule, _, _ in plan_cascade(df, text, RULES, sample_rows)]
    body, words = F.col(text), F.col(f"{P}words")
    made = {
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars(body),
        "n_symbols": n_symbols(body),
        "n_dup_lines": n_dup_lines(body),
        "n_repeat_words": n_repeat_words(words),
    }
    keep = [F.col(f"`{c}`") for c in df.columns if c not in {*made, "base_failed", "kept"}]
    scored = with_words(df, text).select(*keep, body.alias(f"{P}text"), *[made[c].alias(c) for c in made])
    ready = Ready(F.col(f"{P}text"))
    verdicts = {"base_failed": any_fails(BASE, ready), "kept": ~any_fails(order, ready)}
    return scored.select("*", *[v.alias(c) for c, v in verdicts.items()]).drop(f"{P}text")
