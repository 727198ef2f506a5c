"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a column over a document's `Facts` that is true for a document to reject. `plan_cascade` times every rule and
counts what it rejects on a bounded random sample, then orders the rules by rejections per second.
`cascade` is a chain of WHENs in that order: the first rule that rejects ends the work on that
document. Counts that are made already are handed to the rules as columns; the others are expressions that run
only where the cascade gets to them. The order changes the cost and the named rule, never the verdict.

Defined results. Null and blank texts have no words: every count is 0, `few_words` rejects them.
Repeated rows are judged row by row. An empty table gives an empty table. Columns of the input
are kept; `text_col` names the text, and a clashing output name replaces nothing: see `judge`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, let, without, words

SYMBOLS = "#*$%&|<>"


def n_repeat_words(tokens: Column) -> Column:
    """Words inside 3-word windows that the text holds at least twice, the first of them included."""

    def covered(grams: Column) -> Column:
        keyed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                before, after = F.get(s, i - 1)["g"], F.get(s, i + 1)["g"]
                return F.coalesce(before == x["g"], F.lit(False)) | F.coalesce(after == x["g"], F.lit(False))

            places = F.transform(F.filter(s, twin), lambda x: x["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(keyed, starts))

    def of(w: Column) -> Column:
        grams = F.transform(
            F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        )
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(grams, covered))

    return let(tokens, of).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_lines(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.octet_length(whole) - F.octet_length(without(whole, "\n")) + 1).cast("long")


def n_symbols(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.octet_length(whole) - F.octet_length(without(whole, SYMBOLS))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(without(F.coalesce(text, F.lit("")), SPACES)).cast("long")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


@dataclass(frozen=True)
class Facts:
    """What rules read of a document: its text and the counts, each a column made already or an expression."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @classmethod
    def of(cls, text: Column, **made: Column) -> Facts:
        return cls(**{
            "text": text, "n_words": n_words(text), "word_chars": word_chars(text), "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(words(text)),
        } | made)


@dataclass(frozen=True)
class Rule:
    """A named test; `reject` is true for a document to reject and never null."""

    name: str
    reject: Callable[[Facts], Column]


def _shouting(facts: Facts) -> Column:
    """Over half of all characters outside white space are capitals."""
    capitals = F.length(F.regexp_replace(F.coalesce(facts.text, F.lit("")), r"[^\p{Lu}]+", ""))
    return 2 * capitals > facts.word_chars


BASE_RULES = [
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeats", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
]
EXTRA_RULES = [
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.n_words),
    Rule("shouting", _shouting),
    Rule("dup_lines", lambda d: 2 * d.n_dup_lines > n_lines(d.text)),
    Rule("word_length", lambda d: ~d.word_chars.between(2 * d.n_words, 20 * d.n_words)),
]
RULES = BASE_RULES + EXTRA_RULES
#: Rows of the sample that sets the cascade's order.
SAMPLE_ROWS, SEED = 400, 11


def plan_cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), best first, from a random sample of at most `sample_rows` rows of all, which stays with the executors.

    The sample sets the order only. Rules that reject nothing in it follow, cheapest first.
    """
    n = docs.count()
    drawn = docs if n <= 2 * sample_rows else docs.sample(False, 2 * sample_rows / n, SEED)
    rows = drawn.select(F.col(text_col).cast("string").alias("t")).orderBy(F.rand(SEED)).limit(sample_rows)
    local = rows.withColumn("n", n_words(F.col("t"))).cache()
    total = max(1, local.count())
    facts = Facts.of(F.col("t"), n_words=F.col("n"))
    found = []
    for rule in rules:
        probe = local.agg(F.count_if(rule.reject(facts)).alias("n"))
        took = []
        for _ in range(2):
            began = time.perf_counter()
            hits = probe.head()["n"]
            took.append(time.perf_counter() - began)
        found.append((rule, min(took), hits / total))
    local.unpersist()
    return sorted(found, key=lambda x: (-x[2] / max(x[1], 1e-6), x[1], x[0].name))


def cascade(facts: Facts, order: list[Rule]) -> Column:
    """Name of the first rule in `order` that rejects; null if none does. Later rules are not run."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(rule.reject(facts), F.lit(rule.name)).otherwise(verdict)
    return verdict


def accepted(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of `docs` that no rule rejects, columns as they were. Words are counted once, since most rules read their number."""
    order = [x[0] for x in plan_cascade(docs, rules, text_col)]
    n = free_name(docs, "n_words")
    counted = docs.withColumn(n, n_words(F.col(text_col).cast("string")))
    return counted.filter(cascade(Facts.of(F.col(text_col).cast("string"), n_words=F.col(n)), order).isNull()).drop(n)


def judge(docs: DataFrame, text_col: str = "text", rules: list[Rule] = EXTRA_RULES) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean) and
    rejected_by (string: `base`, a rule's name, or null).

    The base verdict comes from the counts, which every row needs anyway; rows that pass it go through the cascade of `rules`, which
    reads the same counts. Input columns of these names are replaced. `rejected_by` names the first rule in the cascade's order, which
    follows times measured on the sample: of several rules that reject a document, runs may name different ones. `kept` never differs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = [x[0] for x in plan_cascade(docs, rules, text_col)]
    held = free_name(docs, "tokens")
    counts = {"word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text)}
    counted = docs.withColumns(
        counts | {held: let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).alias("r")))}
    ).withColumns({"n_words": F.col(held)["n"], "n_repeat_words": F.col(held)["r"]})
    facts = Facts.of(text, **{c: F.col(c) for c in ("n_words", "n_repeat_words", *counts)})
    base = [x.reject(facts) for x in BASE_RULES]
    return (
        counted.withColumn("base_failed", base[0] | base[1])
        .withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(facts, order)))
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop(held)
    )
