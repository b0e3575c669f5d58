"""Quality rules learned as a decision list: sequential covering over labelled text statistics.

Everything runs in DataFrame expressions: the statistics, the counts behind every threshold and
the finished list, which is one conditional expression. The driver only sees counts per feature
and threshold, whose number does not depend on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tallytree.llm.rawtext import SPACE_CLASS, SPACES
from tallytree.session import pin

MIN_WORDS = 50
#: Thresholds of a feature are these quantiles of the labelled documents, and of the rejected ones among them.
QUANTILES = [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99]
MAX_RULES, MAX_CONDITIONS = 8, 3
#: A rule must reach this share of rejected labels among the pruning documents it covers, and cover so many.
MIN_PRECISION, MIN_COVER = 0.9, 3


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def _repeated(hashes: Column) -> Column:
    """Words inside three-word windows that occur twice or more, from the hash of the window at every place."""
    def covered(places: Column) -> Column:
        return _total(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1), p + 3) - p)))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"]))

    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(tagged, lambda s: _let(F.sort_array(F.transform(twice(s), lambda x: x["i"])), covered))


def statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and n_lines, n_upper, n_marks.

    Words are runs without white space (space, tab to carriage return); a null text has none.
    Duplicate lines are lines with a word that equal an earlier line of the text.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    trimmed = F.trim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    own = docs.columns
    step = docs.withColumns({
        "_words": words, "_lines": lines,
        "n_symbols": (F.length(text) - left("[#*$%&|<>]+")).cast("long"),
        "n_upper": (F.length(text) - left("\\p{Lu}+")).cast("long"),
        "n_marks": (F.length(text) - left("[!?]+")).cast("long"),
    })
    n = F.size("_words")
    at = lambda i: F.get(F.col("_words"), i)
    windows = F.transform(F.slice("_words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, at(i + 1), at(i + 2)))
    step = step.select(
        *own, "n_symbols", "n_upper", "n_marks", n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"), windows.alias("_windows"),
    )
    step = step.withColumn("_sorted", F.sort_array("_windows"))
    twins = F.exists(
        F.transform("_sorted", lambda x, k: x == F.get(F.col("_sorted"), k + 1)), lambda same: F.coalesce(same, F.lit(False)))
    # Most texts repeat no window; only the others pay for the places.
    repeat = F.when(twins, _repeated(F.col("_windows"))).otherwise(F.lit(0)).cast("long")
    return step.withColumn("n_repeat_words", repeat).drop("_windows", "_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def _per(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def features() -> dict[str, Column]:
    """The measures that conditions compare with thresholds."""
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": _per("word_chars", "n_words"),
        "symbols_per_word": _per("n_symbols", "n_words"),
        "marks_per_word": _per("n_marks", "n_words"),
        "upper_share": _per("n_upper", "word_chars"),
        "dup_line_share": _per("n_dup_lines", "n_lines"),
        "repeat_share": _per("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, measures: dict[str, Column]) -> Column:
        value = measures[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects the document."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule_number(self) -> Column:
        """The number (from 1) of the first rule that holds, 0 if none does."""
        measures, out = features(), None
        for number, rule in enumerate(self.rules, 1):
            test = F.lit(True)
            for condition in rule:
                test = test & condition.column(measures)
            out = F.when(test, number) if out is None else out.when(test, number)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(" AND ".join(map(str, rule)) for rule in self.rules) or "(keep all)"


def learn(labelled: DataFrame) -> DecisionList:
    """A list from rows with the statistics, ``bad`` (boolean) and ``fold``: 'grow' or 'prune'.

    A rule grows by the condition with the best FOIL gain over the grow rows that no earlier
    rule covers, loses the trailing conditions that do not help on the prune rows, and joins the list
    while it is precise there. No row is sampled: each step reads a table of counts per combination of
    threshold bins, and returns one count per feature and threshold.
    """
    names, measures = list(features()), features()
    quantiles = lambda value: F.coalesce(
        F.percentile_approx(value, QUANTILES, 10000), F.array().cast("array<double>"))
    cuts = labelled.agg(*[
        F.concat(quantiles(measures[n]), quantiles(F.when(F.col("bad"), measures[n]))).alias(n) for n in names]).first()
    cuts = {n: sorted(set(cuts[n])) for n in names}
    if not any(cuts.values()):
        return DecisionList()
    bin_of = lambda n: sum(((measures[n] >= c).cast("int") for c in cuts[n]), F.lit(0))
    cells = pin(
        labelled.select(*[bin_of(n).alias(n) for n in names], "bad", "fold")
        .groupBy(*names, "bad", "fold").agg(F.count(F.lit(1)).alias("n")), "rule-cells")

    def test(rule: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for n, at_least, b in rule:
            out = out & (F.col(n) >= b if at_least else F.col(n) < b)
        return out

    def counts(rows: DataFrame) -> dict[str, list[list[int]]]:
        """[bad, good] by feature and bin."""
        spread = rows.select("bad", "n", F.explode(F.array(*[
            F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names])).alias("x"))
        out = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
        for f, b, bad, total in spread.groupBy("x.f", "x.b", "bad").agg(F.sum("n")).collect():
            out[f][b][0 if bad else 1] += total
        return out

    def total(rows: DataFrame) -> tuple[int, int]:
        row = rows.agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n")))).first()
        return row[0] or 0, row[1] or 0

    done: list[list[tuple[str, bool, int]]] = []
    for _ in range(MAX_RULES):
        free = cells.filter(~test_any(done, test))
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < MAX_CONDITIONS:
            table = counts(free.filter((F.col("fold") == "grow") & test(rule)))
            bad, good = (sum(c[k] for c in table[names[0]]) for k in (0, 1))
            if not bad or not good:
                break
            before, best = math.log2(bad / (bad + good)), (1e-9, None)
            for n in names:
                below = [0, 0]
                for b in range(1, len(cuts[n]) + 1):
                    below = [below[k] + table[n][b - 1][k] for k in (0, 1)]
                    for at_least, (p, q) in ((False, below), (True, [bad - below[0], good - below[1]])):
                        if p >= MIN_COVER:
                            gain = p * (math.log2(p / (p + q)) - before)
                            best = max(best, (gain, (n, at_least, b)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
        # Pruning: the shortest beginning of the rule that is worth most on rows it has not seen.
        held, worth = free.filter(F.col("fold") == "prune"), []
        for k in range(1, len(rule) + 1):
            p, q = total(held.filter(test(rule[:k])))
            worth.append(((p - q) / (p + q) if p + q else -1.0, -k, p, q))
        if not worth:
            break
        _, k, p, q = max(worth)
        if p + q < MIN_COVER or p < MIN_PRECISION * (p + q):
            break
        done.append(rule[:-k])
    return DecisionList([[Condition(n, at_least, float(cuts[n][b - 1])) for n, at_least, b in rule] for rule in done])


def test_any(rules: list, test) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | test(rule)
    return out


test_any.__test__ = False


def judged(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", quality_column: str = "quality",
) -> DataFrame:
    """(id, text_key, statistics, base_failed, rule, kept) of every row of ``docs``, kept as a table in the shared folder.

    A document is kept unless the base test fails or a learned rule holds. The list learns from
    the labelled documents (quality 0 is rejected) whose crc32(id) mod 5 is 1 to 4: 1 prunes, the
    others grow. Null ids and documents without a label are judged and not learned from; without any
    label only the base test decides. Empty and null texts fail the base test.
    """
    own = docs.select(F.col(id_column).alias("row_id"), F.col(text_column).alias("text"))
    counted = statistics(own).withColumn("text_key", F.md5("text")).drop("text")
    counted = pin(counted, "rule-statistics")
    marks = labels.select(F.col(id_column).alias("row_id"), (F.col(quality_column) == 0).alias("bad")).filter("bad IS NOT NULL")
    part = F.crc32(F.col("row_id").cast("string")) % 5
    learned = learn(
        counted.join(marks, "row_id").filter(part != 0)
        .withColumn("fold", F.when(part == 1, "prune").otherwise("grow")))
    rule = learned.rule_number()
    return counted.select(
        F.col("row_id").alias(id_column), "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), rule.cast("int").alias("rule"), (~base_failed() & (rule == 0)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    passed = judged(docs, labels).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.withColumn("_text_key", F.md5("text"))
    same = keyed["doc_id"].eqNullSafe(passed["_id"]) & (keyed["_text_key"] == passed["_key"])
    return keyed.join(passed, same, "left_semi").select(*docs.columns)
