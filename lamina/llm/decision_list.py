"""Quality rules: learned decision lists.

Sequential covering over labelled statistics.  Each rule, a conjunction of thresholds that rejects, is grown on two thirds of the rows by
information gain, pruned on the last third, and kept only if it is precise there; the rows that it covers leave, and the next rule is
grown.  The list becomes one ordered Spark conditional expression over the statistics, so scoring stays in generated code.

Without labels, or with labels of one class, the list is empty and rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import labelled
from lamina.llm.text_stats import COUNTS, fresh, with_statistics


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v >= self.threshold if self.at_least else v <= self.threshold

    def column(self, stats: Column) -> Column:
        v, t = stats[self.feature], F.lit(float(self.threshold))
        return v >= t if self.at_least else v <= t

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects, otherwise the text stays."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self, x: np.ndarray, names: tuple[str, ...] = labelled.FEATURES) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= _covered(rule, x, names)
        return out

    def rule_number(self, stats: Column) -> Column:
        """The number of the first rule that fires, from 1; 0 if none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            test = rule[0].column(stats)
            for c in rule[1:]:
                test = test & c.column(stats)
            out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(map(str, r))}: reject" for r in self.rules) + "\nelse: keep"


def _covered(rule: list[Condition], x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...], cuts: int) -> tuple[float, Condition | None]:
    """The threshold with the largest information gain for the class to reject among the rows still covered."""
    p0, n0 = bad.sum(), (~bad).sum()
    best, found = 1e-9, None
    base = np.log2(p0 / (p0 + n0))
    for j, name in enumerate(names):
        v = x[:, j]
        order = np.argsort(v, kind="stable")
        sv, sb = v[order], bad[order]
        edges = np.flatnonzero(sv[1:] > sv[:-1]) + 1
        if not len(edges):
            continue
        if len(edges) > cuts:
            edges = edges[np.linspace(0, len(edges) - 1, cuts).astype(int)]
        below = np.concatenate([[0], np.cumsum(sb)])[edges]
        for at_least, p, total in ((False, below, edges), (True, p0 - below, len(v) - edges)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(total, 1)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(name, at_least, float((sv[edges[k] - 1] + sv[edges[k]]) / 2))
    return best, found


def learn(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = labelled.FEATURES, max_rules: int = 24, max_conditions: int = 4, precision: float = 0.95, cuts: int = 256) -> DecisionList:
    """x: statistics, y: 1 for texts to keep, 0 for texts to reject.  precision: what a rule must reach on the rows that prune it."""
    bad = y == 0
    out = DecisionList()
    if not len(x) or bad.all() or not bad.any():
        return out
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    for _ in range(max_rules):
        grow = left & ~prune
        if not (bad & grow).any():
            break
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            inside = grow & _covered(rule, x, names)
            if not (~bad & inside).any():
                break
            _, c = _best_condition(x[inside], bad[inside], names, cuts)
            if c is None:
                break
            rule.append(c)
        if not rule:
            break
        check = left & prune if (left & prune & bad).any() else grow

        def worth(r: list[Condition], check=check) -> float:
            hit = check & _covered(r, x, names)
            p, n = int((bad & hit).sum()), int((~bad & hit).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = left & _covered(rule, x, names)
        on_check = check & _covered(rule, x, names)
        p, n = int((bad & on_check).sum()), int((~bad & on_check).sum())
        if p < precision * (p + n) or p == 0 or (bad & hit).sum() < 2:
            break
        out.rules.append(rule)
        left &= ~hit
    return out


def verdicts(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """docs with its columns, a struct of statistics, base_failed, rule (the rule that fired, 0: none) and kept.

    Null and empty texts fail the base (fewer than 10 words).  The added columns' names are given in the attribute-free order
    stats, base_failed, rule, kept, with underscores before them where docs has such a name."""
    stats = fresh(docs, "_stats")
    s = F.col(stats)
    base, rule, kept = (fresh(docs, c) for c in ("base_failed", "rule", "kept"))
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    out = with_statistics(docs, text_col, stats).withColumn(base, failed).withColumn(rule, rules.rule_number(s))
    return out.withColumn(kept, ~F.col(base) & (F.col(rule) == 0))


def fitted(documents: DataFrame, labels: DataFrame) -> DecisionList:
    return learn(*labelled.sample(documents, labels))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, the base's counts, base_failed, kept, rule.  Repeated and null ids keep their rows."""
    out = verdicts(documents.select("doc_id", "text"), fitted(documents, labels))
    return out.select("doc_id", *(F.col("_stats")[c].alias(c) for c in COUNTS), "base_failed", "kept", "rule")


def filtered(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the rules keep, with their own columns."""
    out = verdicts(documents, fitted(documents, labels))
    return out.where(F.col(out.columns[-1])).select(*documents.columns)
