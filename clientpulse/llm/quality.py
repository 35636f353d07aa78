"""Quality rules: a decision list learned by sequential covering.

``statistics`` works out counts of each whole text with built-in functions only.
``learn`` takes a bounded sample of labelled documents (``LABELLED_ROWS``, the only
rows that reach the driver, as a few numbers each) and covers the low-quality ones
rule by rule: grow a conjunction of thresholds on two thirds of the sample by
information gain, drop conditions that do not help on the last third, keep the
rule if it is precise there, remove what it covers, go on. ``verdict`` turns the
list into one ordered Spark CASE expression: the first rule that holds rejects a
document, and none keeps it.

A document fails the base test with under ``LEAST_WORDS`` words, or with over 30 %
of its words in 8-word windows that occur twice or more in it.

Defined cases: null and empty texts have no words and fail the base test. Labels
other than 0 and 1, null ids and ids without a document are left out; an id with
several labels takes the best. With too few labelled documents of either class the
list is empty, so every document that passes the base test is kept. Equal rows get
equal verdicts; extra columns come along, whatever their names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.common import SPACE_RUN, fresh, quoted, text_of

WINDOW = 8
LEAST_WORDS = 20
LABELLED_ROWS = 20_000
CUTS = 32
MOST_CONDITIONS = 3
MOST_RULES = 12
LEAST_COVERED = 8
LEAST_PRECISION = 0.97
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_marks", "n_distinct")
FEATURES = (
    "n_words",
    "mean_word",
    "symbols_per_word",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "marks_per_word",
    "distinct_share",
)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, features: np.ndarray) -> np.ndarray:
        values = features[:, FEATURES.index(self.feature)]
        return values > self.cut if self.above else values <= self.cut


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, features: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(features) for c in self.conditions])


# --- statistics of texts ----------------------------------------------------------


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts; the second value gives each count's column name."""
    own = docs.columns
    t, words, lines, hashes, windows, ordered, starts, *names = fresh(
        own, "t", "words", "lines", "hashes", "windows", "ordered", "starts", *COUNTS, *MORE
    )
    name = dict(zip((*COUNTS, *MORE), names))
    keep = [quoted(c) for c in own]
    c = {k: F.col(k) for k in (t, words, lines, hashes, windows, ordered, starts, *names)}

    split = docs.select(*keep, text_of(text_col).alias(t)).select(
        "*",
        F.array_remove(F.split(F.col(t), SPACE_RUN), "").alias(words),
        F.filter(F.split(F.col(t), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    counted = split.select(
        *keep,
        F.transform(c[words], lambda w: F.xxhash64(w)).alias(hashes),
        F.size(words).cast("long").alias(name["n_words"]),
        F.length(F.array_join(words, "")).cast("long").alias(name["word_chars"]),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias(name["n_symbols"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(name["n_dup_lines"]),
        F.size(lines).cast("long").alias(name["n_lines"]),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias(name["n_upper"]),
        F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long").alias(name["n_marks"]),
    )
    n = c[name["n_words"]].cast("int")
    windowed = counted.select(
        "*",
        F.size(F.array_distinct(hashes)).cast("long").alias(name["n_distinct"]),
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(c[hashes], i, WINDOW))),
        ).alias(windows),
    )
    # texts without a repeated window need no sorting
    sorted_windows = windowed.withColumn(
        ordered,
        F.when(
            F.size(windows) > F.size(F.array_distinct(windows)),
            F.sort_array(F.transform(c[windows], lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    s = c[ordered]

    def twice(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
            F.get(s, i + 1)["h"] == x["h"], F.lit(False)
        )

    repeated = sorted_windows.withColumn(starts, F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"])))
    covered = F.aggregate(
        c[starts],
        F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"), i.alias("last")),
        lambda acc: acc["total"],
    )
    counts = [quoted(x) for x in names if x != name["n_repeat_words"]]
    counts.append(F.coalesce(covered, F.lit(0)).cast("long").alias(name["n_repeat_words"]))
    # a generator, so that filters on the counts are not written out in terms of the text and pushed below
    return repeated.select(*keep, F.inline(F.array(F.struct(*counts)))), name


def base_failed(name: dict[str, str]) -> Column:
    n, repeat = F.col(name["n_words"]), F.col(name["n_repeat_words"])
    return (n < LEAST_WORDS) | (100 * repeat > 30 * n)


def feature(which: str, name: dict[str, str]) -> Column:
    """A statistic that the rules read, from the counts."""
    col = {k: F.col(v).cast("double") for k, v in name.items()}
    words = F.greatest(col["n_words"], F.lit(1.0))
    return {
        "n_words": col["n_words"],
        "mean_word": col["word_chars"] / words,
        "symbols_per_word": col["n_symbols"] / words,
        "dup_line_share": col["n_dup_lines"] / F.greatest(col["n_lines"], F.lit(1.0)),
        "repeat_share": col["n_repeat_words"] / words,
        "upper_share": col["n_upper"] / F.greatest(col["word_chars"], F.lit(1.0)),
        "marks_per_word": col["n_marks"] / words,
        "distinct_share": col["n_distinct"] / words,
    }[which]


# --- learning ------------------------------------------------------------------------


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED_ROWS
) -> tuple[np.ndarray, np.ndarray]:
    """Features and low-quality flags of at most ``most`` labelled documents, chosen
    by a hash of the id. At most ``most`` ids are broadcast."""
    marked = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max("quality").alias("label"))
    )
    order = F.xxhash64("labelled_id"), F.col("labelled_id")
    some = marked.orderBy(*order).limit(most)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("body"))
    joined = rows.join(F.broadcast(some), F.col("id") == F.col("labelled_id"))
    found, name = statistics(joined.select("labelled_id", "label", "body"), "body")
    values = found.where(~base_failed(name)).select(
        "labelled_id", "label", *(feature(f, name).alias(f"f{i}") for i, f in enumerate(FEATURES))
    )
    ordered = values.orderBy(*order, *(f"f{i}" for i in range(len(FEATURES)))).limit(most).collect()
    data = np.array([[float(x) for x in r[2:]] for r in ordered]).reshape(len(ordered), len(FEATURES))
    return data, np.array([r.label == 0 for r in ordered], dtype=bool)


def learn(features: np.ndarray, low: np.ndarray) -> list[Rule]:
    """Sequential covering of the ``low`` rows."""
    turn = np.arange(len(low)) % 3 == 2
    grow_x, grow_y, prune_x, prune_y = features[~turn], low[~turn], features[turn], low[turn]
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and grow_y.sum() >= LEAST_COVERED and (~grow_y).any():
        rule = grow(grow_x, grow_y)
        if rule is None:
            break
        rule = prune(rule, prune_x, prune_y)
        hit, check = rule.holds(grow_x), rule.holds(prune_x)
        if precision(grow_y[hit], prune_y[check]) < LEAST_PRECISION or grow_y[hit].sum() < LEAST_COVERED:
            break
        rules.append(rule)
        grow_x, grow_y, prune_x, prune_y = grow_x[~hit], grow_y[~hit], prune_x[~check], prune_y[~check]
    return rules


def precision(*parts: np.ndarray) -> float:
    """Share of low rows among those that a rule covers."""
    n = sum(len(p) for p in parts)
    return sum(int(p.sum()) for p in parts) / n if n else 0.0


def gain(before: np.ndarray, after: np.ndarray) -> float:
    """Information gained per covered low row, times their number."""
    p, q = after.sum(), before.sum()
    return float(p * (np.log2(p / len(after)) - np.log2(q / len(before)))) if p else 0.0


def grow(x: np.ndarray, y: np.ndarray) -> Rule | None:
    chosen: list[Condition] = []
    inside = np.ones(len(y), dtype=bool)
    while len(chosen) < MOST_CONDITIONS and not y[inside].all():
        part, best, best_gain = x[inside], None, 1e-9
        for f, column in zip(FEATURES, part.T):
            levels = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1)))
            for cut in (levels[:-1] + levels[1:]) / 2:
                for above in (True, False):
                    condition = Condition(f, above, float(np.round(cut, 6)))
                    hit = condition.holds(part)
                    if y[inside][hit].sum() >= LEAST_COVERED and (value := gain(y[inside], y[inside][hit])) > best_gain:
                        best, best_gain = condition, value
        if best is None:
            break
        chosen.append(best)
        inside &= best.holds(x)
    return Rule(tuple(chosen)) if chosen else None


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Drop last conditions while (low - good) / covered on held-out rows does not fall."""

    def worth(r: Rule) -> float:
        hit = y[r.holds(x)]
        return (2 * hit.sum() - len(hit)) / len(hit) if len(hit) else -1.0

    while len(rule.conditions) > 1:
        shorter = Rule(rule.conditions[:-1])
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    return rule


# --- verdicts --------------------------------------------------------------------------


def verdict(rules: Sequence[Rule], name: dict[str, str]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule.conditions:
            value = feature(c.feature, name)
            test = test & ((value > c.cut) if c.above else (value <= c.cut))
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """``docs`` with counts, ``base_failed``, ``rule`` and ``kept``; and their names."""
    rules = learn(*labelled_sample(docs, labels, id_col, text_col))
    found, name = statistics(docs, text_col)
    failed, rule, kept = fresh(found.columns, "base_failed", "rule", "kept")
    out = found.select("*", base_failed(name).alias(failed), verdict(rules, name).cast("long").alias(rule))
    out = out.withColumn(kept, ~F.col(failed) & (F.col(rule) == 0))
    return out, {**name, "base_failed": failed, "rule": rule, "kept": kept}


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: counts, base_failed, rule and kept."""
    out, name = judged(docs.select("doc_id", "text"), labels)
    shown = (*COUNTS, "base_failed", "kept", "rule")
    return out.select("doc_id", *(quoted(name[c]).alias(c) for c in shown))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows."""
    out, name = judged(docs, labels, id_col, text_col)
    return out.where(F.col(name["kept"])).select(*(quoted(c) for c in docs.columns))
