"""Operator 6, quality rules: a short-circuit cascade, in native columns only.

Every rule is a boolean column over a document's counts.  ``order_rules``
evaluates each rule alone on a small sample, takes its wall time as its cost and
its share of true rows as its selectivity, and sorts by rejection per cost.  The
cascade is one ``CASE WHEN`` in that order, so a document stops at the first
rule that rejects it.  Whatever the order, the same documents are rejected; only
``first_rule`` names another rule.

Defined cases: null text has no words and is rejected by ``few_words``; an empty
table gives an empty result; further columns of the input are kept by
``keep_good`` and ignored by ``score`` (which returns ``id_col`` and its own).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescast.llm.text import WHITE, words

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a bound variable."""
    return F.transform(F.array(value), fn)[0]


def _repeats(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``w``."""
    def spread(at: Column) -> Column:
        # at: sorted starts of repeated windows; each covers 3 words, overlaps count once
        gaps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))),
                          lambda b, a: F.least(b - a, F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g) + F.when(F.size(at) > 0, 3).otherwise(0)

    def windows(a: Column) -> Column:
        n = F.size(a) - 2
        return F.zip_with(F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), lambda x, y: F.concat_ws(" ", x, y)),
                          F.slice(a, 3, n), lambda x, y: F.concat_ws(" ", x, y))

    def repeated(win: Column) -> Column:
        rows = F.array_sort(F.transform(win, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        twins = _let(rows, lambda s: F.flatten(F.filter(
            F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)),
                       lambda p, q: F.when(p["v"] == q["v"], F.array(p["i"], q["i"]))),
            lambda x: x.isNotNull())))
        return _let(F.array_sort(F.array_distinct(twins)), spread)

    # most texts repeat no window: a hash set settles those without the sort
    some = _let(windows(w), lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0))
                .otherwise(repeated(win)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(some)


def counts(text: Column) -> dict[str, Column]:
    """The count columns as independent expressions over a text column."""
    t = F.coalesce(text, F.lit(""))
    lines = _let(F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != ""),
                 lambda a: F.size(a) - F.size(F.array_distinct(a)))
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")).cast("long"),
        "n_dup_lines": lines.cast("long"),
        "n_repeat_words": _let(words(text), _repeats).cast("long"),
    }


Rule = Callable[[Mapping[str, Column]], Column]

#: Each rule is true for documents to reject; thresholds are the operator's parameters.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda c: c["n_words"] < 50,
    "repeated_words": lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"],
}
MORE_RULES: dict[str, Rule] = {
    "symbols": lambda c: 10 * c["n_symbols"] > 2 * c["n_words"],
    "duplicate_lines": lambda c: 2 * c["n_dup_lines"] > c["n_lines"],
    "short_words": lambda c: c["word_chars"] < 2 * c["n_words"],
    "long_words": lambda c: c["word_chars"] > 14 * c["n_words"],
}
RULES: dict[str, Rule] = BASE_RULES | MORE_RULES


def order_rules(docs: DataFrame, text_col: str = "text", rules: Mapping[str, Rule] = RULES,
                sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejection per cost, measured on ``sample_rows`` documents.

    The sample (read from the first partitions that have enough rows, texts of at
    most ``SAMPLE_CHARS``, so of bounded size) only fixes the order of evaluation,
    never which documents go."""
    rows = docs.select(F.col(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS).take(sample_rows)
    sample = docs.sparkSession.createDataFrame(rows, "text string").persist()
    try:
        n = max(1, sample.count())
        gain = {}
        for name, rule in rules.items():
            began = time.perf_counter()
            hit = sample.select(F.sum(rule(counts(F.col("text"))).cast("long"))).first()[0] or 0
            gain[name] = (hit / n) / (time.perf_counter() - began)
        return sorted(rules, key=lambda r: -gain[r])
    finally:
        sample.unpersist()


def cascade(made: Mapping[str, Column], order: Sequence[str], rules: Mapping[str, Rule] = RULES) -> Column:
    """Name of the first rule in ``order`` that rejects the document, or null."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(F.coalesce(rules[name](made), F.lit(False)), F.lit(name)).otherwise(out)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """One row per document with every count, ``first_rule``, ``base_failed`` and ``kept``."""
    order = order_rules(docs, text_col, rules)
    made = counts(F.col(text_col))
    counted = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in made.items()])
    cols = {n: F.col(n) for n in made}
    base = cols["n_words"] < 50
    base = base | (100 * cols["n_repeat_words"] > 50 * cols["n_words"])
    return (counted.withColumn("first_rule", cascade(cols, order, rules))
            .withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & F.col("first_rule").isNull()))


def keep_good(docs: DataFrame, text_col: str = "text", rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, all columns unchanged; the counts of a
    rule are computed only for documents that the rules before it let pass."""
    order = order_rules(docs, text_col, rules)
    return docs.where(cascade(counts(F.col(text_col)), order, rules).isNull())
