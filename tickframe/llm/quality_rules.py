"""Quality rules: a decision list learned by sequential covering, applied as one CASE expression.

All work is DataFrame expressions. Per text, base statistics are computed inside the row (array
functions, no explode, no shuffle). Labelled statistics are binned on fixed, readable thresholds and
counted into cells, so that learning aggregates a table whose size depends on the bins, not on the data.
Each step of the covering is one grouped sum over the cells; only these sums reach the driver.

Edge cases: a null or empty text has zero statistics and fails the base rule. Missing, null or
single-class labels give an empty list, which keeps every document that passes the base rule. Several
label rows of one document count as its lowest quality. Repeated rows are judged alike. Extra columns
of the documents never take part; ``kept_documents`` carries them through.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import staged, trimmed, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"

#: What a rule may test: an integer expression over the statistics, and the thresholds to choose from.
FEATURES = {
    "n_words": ("n_words", (20, 50, 100, 200, 500, 1000, 2000, 5000)),
    "word_chars_x100": (
        "100 * word_chars div greatest(n_words, 1)", (200, 250, 300, 350, 400, 450, 500, 550, 600, 700, 800, 1000)),
    "symbols_pct": ("100 * n_symbols div greatest(n_words, 1)", (0, 1, 2, 5, 10, 20, 30, 50, 100, 200)),
    "dup_lines_pct": ("100 * n_dup_lines div greatest(n_lines, 1)", (0, 5, 10, 20, 30, 50, 75)),
    "repeat_pct": ("100 * n_repeat_words div greatest(n_words, 1)", (0, 1, 2, 5, 10, 15)),
}


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` if ``above``, else ``feature <= threshold``."""

    feature: str
    above: bool
    step: int

    def on_bins(self) -> Column:
        bin_ = F.col(f"b_{self.feature}")
        return bin_ > self.step if self.above else bin_ <= self.step

    def on_statistics(self) -> Column:
        expression, thresholds = FEATURES[self.feature]
        value = F.expr(expression)
        return value > thresholds[self.step] if self.above else value <= thresholds[self.step]

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {FEATURES[self.feature][1][self.step]}"


Rule = tuple[Condition, ...]


def _repeat_words() -> Column:
    """Words inside windows that occur twice or more in ``w``.

    Word hashes (a) are hashed by fives (h). Fives that are all distinct end it early. Otherwise sorted
    (hash, place) pairs bring equal windows side by side, and the sorted places of repeated windows say
    how many words they cover. The one-element ``transform`` calls bind a value to a name, so that it is computed once per row.
    """
    return F.expr("""
      if(size(w) < 5, 0L,
        transform(array(transform(w, x -> xxhash64(x))), a ->
        transform(array(transform(sequence(0, greatest(size(a) - 5, 0)), i ->
            xxhash64(get(a, i), get(a, i + 1), get(a, i + 2), get(a, i + 3), get(a, i + 4)))), h ->
          if(size(array_distinct(h)) = size(h), 0L,
            transform(array(sort_array(transform(h, (x, i) -> struct(x, i)))), s ->
              transform(array(sort_array(transform(
                  filter(s, (e, j) -> coalesce(get(s, j - 1).x = e.x, false) or coalesce(get(s, j + 1).x = e.x, false)),
                  e -> e.i))), p ->
                aggregate(transform(p, (a, k) -> least(5, coalesce(get(p, k + 1) - a, 5))),
                          0L, (n, v) -> n + v))[0])[0]))[0])[0])""")


def statistics(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, the base statistics and n_lines (lines with a word) of every whole text, and ``carried``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: trimmed(line) != "")
    return docs.select(
        F.col("doc_id"), words(F.col("text")).alias("w"), lines.alias("lines"),
        F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.translate(text, SYMBOLS, "")))
        .otherwise(0).cast("long").alias("n_symbols"), *carried,
    ).select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
        *(["row"] if carried else []))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _cells(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of bad and all labelled documents per combination of bins, for growing and for pruning."""
    truth = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(F.col("quality").isNotNull())
    bins = [
        sum((F.expr(expression) > t).cast("int") for t in thresholds).alias(f"b_{name}")
        for name, (expression, thresholds) in FEATURES.items()]
    rows = stats.filter(~base_failed()).join(truth, "doc_id").select(
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), (F.col("quality") == 0).cast("long").alias("bad"), *bins)
    return rows.groupBy("grow", *[f"b_{f}" for f in FEATURES]).agg(
        F.sum("bad").alias("bad"), F.count("*").alias("total"))


def _counts(cells: DataFrame) -> tuple[list[tuple[Condition, int, int]], int, int]:
    """Per possible condition the bad and good it leaves, then bad and good altogether."""
    per_bin = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"b_{f}").alias("bin")) for f in FEATURES])).alias("f")
    rows = cells.select("bad", "total", per_bin).groupBy("f.feature", "f.bin").agg(
        F.sum("bad").alias("bad"), F.sum("total").alias("total")).collect()
    found, all_bad, all_good = [], 0, 0
    for feature, (_, thresholds) in FEATURES.items():
        own = {r["bin"]: (r["bad"], r["total"] - r["bad"]) for r in rows if r["feature"] == feature}
        all_bad, all_good = (sum(v[k] for v in own.values()) for k in (0, 1))
        for step in range(len(thresholds)):
            bad, good = (sum(v[k] for b, v in own.items() if b > step) for k in (0, 1))
            found.append((Condition(feature, True, step), bad, good))
            found.append((Condition(feature, False, step), all_bad - bad, all_good - good))
    return found, all_bad, all_good


def _all_of(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.on_bins()
    return out


def _grow(cells: DataFrame, max_conditions: int) -> Rule:
    """Add the condition with the largest information gain until only bad documents are left."""
    rule: Rule = ()
    while len(rule) < max_conditions:
        found, bad, good = _counts(cells.filter(F.col("grow") & _all_of(rule)))
        if not bad or not good:
            break
        before = log2(bad / (bad + good))
        gain, best = max(
            ((p * (log2(p / (p + n)) - before), condition) for condition, p, n in found if p),
            key=lambda x: (x[0], -list(FEATURES).index(x[1].feature), x[1].above, -x[1].step), default=(0, None))
        if gain <= 1e-9:
            break
        rule += (best,)
    return rule


def _prune(cells: DataFrame, rule: Rule) -> tuple[Rule, float, int]:
    """The shortest beginning of the rule that is best on held-out rows; its precision and bad documents there."""
    sums = [F.sum(F.when(_all_of(rule[:k]), F.col(c))).alias(f"{c}_{k}")
            for k in range(1, len(rule) + 1) for c in ("bad", "total")]
    row = cells.filter(~F.col("grow")).agg(*sums).first()
    scored = [((row[f"bad_{k}"] or 0) / max(row[f"total_{k}"] or 0, 1), -k) for k in range(1, len(rule) + 1)]
    precision, k = max(scored)
    return rule[:-k], precision, row[f"bad_{-k}"] or 0


def learn(stats: DataFrame, labels: DataFrame, max_rules: int = 8, max_conditions: int = 3,
          min_precision: float = 0.9, min_bad: int = 3) -> list[Rule]:
    """An ordered list of rules whose match means low quality.

    Rules are grown on two thirds of the labelled documents and pruned on the rest. A rule that is not
    ``min_precision`` right there, or finds fewer than ``min_bad`` bad documents, ends the list.
    """
    left, rules = staged(_cells(stats, labels), "quality-cells"), []
    while len(rules) < max_rules:
        rule = _grow(left, max_conditions)
        if not rule:
            break
        rule, precision, bad = _prune(left, rule)
        if precision < min_precision or bad < min_bad:
            break
        rules.append(rule)
        left = left.filter(~_all_of(rule))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that matches, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        match = F.lit(True)
        for condition in rule:
            match = match & condition.on_statistics()
        out = F.when(match, F.lit(number)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: base statistics, base_failed, kept, and the rule that rejected it (0: the base rule)."""
    stats = staged(statistics(docs), "quality-stats")
    rules = learn(stats, labels)
    hit = F.when(base_failed(), F.lit(0)).otherwise(verdict(rules))
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), hit.isNull().alias("kept"), hit.alias("rule"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns, learned from their own statistics and labels.

    Statistics are staged beside the documents, so that no text is shuffled and equal ids do no harm.
    """
    stats = staged(statistics(docs, F.struct(*docs.columns).alias("row")), "quality-rows")
    rules = learn(stats.drop("row"), labels)
    return stats.filter(~base_failed() & verdict(rules).isNull()).select("row.*")
