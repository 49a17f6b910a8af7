"""Quality rules: a decision list learned by sequential covering.

Rules are grown and pruned from the statistics of labelled documents: a rule
is a conjunction of thresholds, grown one condition at a time by information
gain, pruned on rows held back from growing, and kept if it is precise enough
there; the rows it covers leave, and the next rule starts. The list is emitted
as one ordered Spark conditional expression. The statistics are native
expressions on whole texts, computed where the text is read: no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvox.llm.common import SPACES, filled, unused, words

#: Labelled rows that the list is learned from, at most: the documented bound of the fit.
MAX_LABELLED = 20_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Thresholds tried per statistic: quantiles of the labelled rows.
CUTS = 32

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "chars_per_word", "symbols_per_word", "dup_lines_per_line", "repeat_share",
            "distinct_share", "upper_share", "digit_share", "letter_share")


def window_hashes(hashes: Column) -> Column:
    """A hash for each window of WINDOW neighbouring words."""
    return F.when(F.size(hashes) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW),
                    lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)])))


def repeated_words(windows: Column) -> Column:
    """Words inside windows that the text holds twice or more, in n log n: the
    starts of equal windows are neighbours once (hash, start) is sorted; a
    start then covers the words up to the next one, WINDOW at most."""
    spots = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x)

    def held(value: Column, use) -> Column:  # evaluates value once and passes it on
        return F.get(F.transform(F.array(value), use), 0)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        held(spots, lambda s: held(starts(s), covered)))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the base counts and the features of the rules (see BASE
    and FEATURES), null texts as empty ones. Names that ``docs`` has already
    are taken by the statistics."""
    text, w, h, g, ln = unused(docs.select(*[c for c in docs.columns if c not in BASE + FEATURES]),
                               "_text", "_words", "_hashes", "_windows", "_lines")
    kept = [c for c in docs.columns if c.lower() not in BASE + FEATURES]
    d = docs.select(*kept, filled(F.col(text_col)).alias(text))
    d = d.select("*", words(F.col(text)).alias(w))
    d = d.select("*", F.transform(w, lambda x: F.xxhash64(x)).alias(h),
                 F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias(ln))
    d = d.select("*", window_hashes(F.col(h)).alias(g))

    def chars(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))

    t = F.col(text)
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_repeat_words": repeated_words(F.col(g)),
    }
    d = d.select(*kept, w, h, ln, text, *[c.cast("long").alias(k) for k, c in counts.items()])
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    wide = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    shares = {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_line": F.col("n_dup_lines") / F.greatest(F.size(ln), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "distinct_share": F.size(F.array_distinct(h)) / n,
        "upper_share": chars(r"\p{Lu}") / wide,
        "digit_share": chars(r"\p{Nd}") / wide,
        "letter_share": chars(r"\p{L}") / wide,
    }
    return d.select(*kept, *BASE, *[c.alias(k) for k, c in shares.items()])


@dataclass(frozen=True)
class Condition:
    """A statistic at or above (``least``) or below a threshold."""

    feature: str
    least: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.threshold) == self.least

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.least else c < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def counts_of(rule: Rule, rows: list[dict]) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if covers(rule, r)]
    return sum(hit), len(hit) - sum(hit)


def grown(rows: list[dict], cuts: dict[str, list[float]], max_conditions: int = 4) -> Rule:
    """Adds the condition of the best information gain until no good row is covered."""
    rule: Rule = ()
    while len(rule) < max_conditions:
        p0, n0 = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
        if not p0 or not n0:
            break
        before, best, pick = math.log2(p0 / (p0 + n0)), 0.0, None
        for f, points in cuts.items():
            ordered = sorted((r[f], r["bad"]) for r in rows)
            i = below_p = below_n = 0
            for t in points:
                while i < len(ordered) and ordered[i][0] < t:
                    below_p += ordered[i][1]
                    below_n += not ordered[i][1]
                    i += 1
                for least, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                    gain = p * (math.log2(p / (p + n)) - before) if p else 0.0
                    if gain > best + 1e-9:
                        best, pick = gain, Condition(f, least, t)
        if pick is None:
            break
        rule += (pick,)
        rows = [r for r in rows if pick.holds(r)]
    return rule


def pruned(rule: Rule, rows: list[dict]) -> Rule:
    """Drops final conditions while that raises (p - n) / (p + n) on held-back rows."""
    def worth(r: Rule) -> float:
        p, n = counts_of(r, rows)
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) > worth(best):
            best = rule[:k]
    return best


def learned_list(rows: list[dict], *, min_precision: float = 0.95, min_held: float = 0.9,
                 min_support: int = 5, max_rules: int = 12) -> list[Rule]:
    """Rules for bad rows, in the order they were found, each with the given
    precision on all rows and on those held back. Rows: the FEATURES, ``bad``
    and ``held`` (true for rows used to prune only)."""
    if not any(r["bad"] for r in rows) or all(r["bad"] for r in rows):
        return []
    cuts = {}
    for f in FEATURES:
        values = sorted(r[f] for r in rows)
        bad = sorted(r[f] for r in rows if r["bad"])
        cuts[f] = sorted({v[len(v) * i // CUTS] for v in (values, bad) for i in range(1, CUTS)})
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = [r for r in rows if not r["held"]], [r for r in rows if r["held"]]
        rule = grown(grow, cuts)
        if not rule:
            break
        rule = pruned(rule, prune)
        p, n = counts_of(rule, rows)
        hp, hn = counts_of(rule, prune)
        if p < min_support or p / (p + n) < min_precision or (hp + hn and hp / (hp + hn) < min_held):
            break
        rules.append(rule)
        rows = [r for r in rows if not covers(rule, r)]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", max_labelled: int = MAX_LABELLED, **how) -> list[Rule]:
    """Learns from at most ``max_labelled`` labelled rows, those of the least
    hash of their id. Only these rows' statistics reach the driver. Rows with a
    null id or label are no examples; an id with several labels is bad if its
    least label is 0."""
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("_i")).agg(F.min(label_col).alias("_label"))
              .withColumn("_o", F.xxhash64("_i")).orderBy("_o", "_i").limit(max_labelled))
    # max_labelled rows at most, so they may be broadcast and no text moves.
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_i")
    rows = text_statistics(texts, "_t").select(
        *FEATURES, (F.col("_label") == 0).alias("bad"), (F.pmod(F.col("_o"), F.lit(3)) == 0).alias("held")).collect()
    return learned_list([r.asDict() for r in sorted(rows)], **how)


def verdict(rules: list[Rule], rejected: Column, kept: Column) -> Column:
    """The list as an ordered conditional: the first rule that holds rejects."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, rejected) if out is None else out.when(test, rejected)
    return kept if out is None else out.otherwise(kept)


def which_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(verdict([rules[k - 1]], F.lit(True), F.lit(False)), F.lit(k)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """``docs`` plus the statistics, ``base_failed``, ``rule`` (the first that
    holds, null if none) and ``kept``.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated
    windows. Null and empty texts have no words and fail. Columns of these
    names in ``docs`` give way; an empty table stays empty."""
    made = ("base_failed", "rule", "kept")
    d = text_statistics(docs.select(*[c for c in docs.columns if c.lower() not in made]), text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (d.withColumn("base_failed", failed).withColumn("rule", which_rule(rules))
            .withColumn("kept", ~F.col("base_failed") & verdict(rules, F.lit(False), F.lit(True))))
