"""Rules: prioritised patterns with actions, in modes, compiled to conditional expressions.

The winner for an item is the matching rule of highest import precedence, then highest priority, then latest declaration.  A mode says what
becomes of items that no rule matches.  An action makes columns from the item's row; ``next_match`` inside it stands for what the item's
next best rule would make.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default priorities by kind of pattern: any item, any name of a kind, a name, a pattern with a predicate or several steps.
DEFAULT_PRIORITY = {"any": -0.5, "kind": -0.25, "name": 0.0, "specific": 0.5}
NO_MATCH = ("deep-copy", "shallow-copy", "deep-skip", "shallow-skip", "text-only-copy", "fail")

Action = Callable[["Next"], Column]


@dataclass(frozen=True)
class Rule:
    """match: a boolean column; action: makes a column, given the next match; pattern: the kind that sets the default priority."""

    name: str
    match: Column
    action: Action
    priority: float | None = None
    precedence: int = 0
    pattern: str = "specific"
    mode: str = "default"

    @property
    def rank(self) -> float:
        return DEFAULT_PRIORITY[self.pattern] if self.priority is None else self.priority


class Next:
    """What ``next_match`` and ``apply_imports`` give inside an action."""

    def __init__(self, rules: list[Rule], at: int, last: Column):
        self.rules, self.at, self.last = rules, at, last

    def next_match(self) -> Column:
        return _chain(self.rules, self.at + 1, self.last)

    def apply_imports(self) -> Column:
        """The best rule of lower import precedence."""
        own = self.rules[self.at].precedence
        lower = [r for r in self.rules[self.at + 1 :] if r.precedence < own]
        return _chain(lower, 0, self.last)


def _chain(rules: list[Rule], start: int, last: Column) -> Column:
    out = None
    for i in range(start, len(rules)):
        value = rules[i].action(Next(rules, i, last))
        test = F.coalesce(rules[i].match, F.lit(False))
        out = F.when(test, value) if out is None else out.when(test, value)
    return last if out is None else out.otherwise(last)


@dataclass
class Mode:
    """on_no_match: the built-in rule; on_multiple: 'use-last', or 'fail' if two rules of one rank match."""

    on_no_match: str = "text-only-copy"
    on_multiple: str = "use-last"


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    modes: dict[str, Mode] = field(default_factory=dict)

    def rule(self, name: str, match: Column, action: Action | Column, **kind) -> RuleSet:
        act = action if callable(action) and not isinstance(action, Column) else (lambda _, c=action: c)
        self.rules.append(Rule(name, match, act, **kind))
        return self

    def imported(self, other: RuleSet) -> RuleSet:
        """This set over another, whose rules have lower precedence."""
        lowest = min((r.precedence for r in self.rules), default=0)
        top = max((r.precedence for r in other.rules), default=0)
        theirs = [replace(r, precedence=r.precedence - top + lowest - 1) for r in other.rules]
        return RuleSet([*theirs, *self.rules], {**other.modes, **self.modes})

    def ordered(self, mode: str) -> list[Rule]:
        """The mode's rules, best first."""
        found = [(i, r) for i, r in enumerate(self.rules) if r.mode in (mode, "#all")]
        return [r for i, r in sorted(found, key=lambda x: (x[1].precedence, x[1].rank, x[0]), reverse=True)]

    def apply(self, df: DataFrame, text: Column, copy: Column | None = None, mode: str = "default", result: str = "result", winner: str | None = None) -> DataFrame:
        """df with the result of each item's rule, and the rule's name if a column for it is named.

        text: the item's string value; copy: what copying it gives, the text if absent.  Skipped items get no result (NULL) and stay as rows
        for shallow skip; deep skip drops them."""
        kind = self.modes.get(mode, Mode())
        rules = self.ordered(mode)
        copy = text if copy is None else copy
        none = F.lit(None).cast("string")
        last = {"deep-copy": copy, "shallow-copy": copy, "text-only-copy": text, "deep-skip": none, "shallow-skip": none}.get(kind.on_no_match)
        if last is None:
            last = F.raise_error(F.lit(f"no rule of mode {mode} matches an item")).cast("string")
        name = _chain([replace(r, action=lambda _, n=r.name: F.lit(n)) for r in rules], 0, none)
        out = df.withColumn(result, self._checked(rules, kind, mode, _chain(rules, 0, last)))
        if winner or kind.on_no_match == "deep-skip":
            out = out.withColumn(winner or "_winner", name)
        if kind.on_no_match == "deep-skip":
            out = out.where(F.col(winner or "_winner").isNotNull())
        return out if winner else out.drop("_winner")

    @staticmethod
    def _checked(rules: list[Rule], kind: Mode, mode: str, value: Column) -> Column:
        if kind.on_multiple != "fail":
            return value
        ranks = sorted({(r.precedence, r.rank) for r in rules}, reverse=True)
        test = None
        for rank in ranks:
            n = sum((F.coalesce(r.match, F.lit(False)).cast("int") for r in rules if (r.precedence, r.rank) == rank), F.lit(0))
            test = F.when(n > 0, n) if test is None else test.when(n > 0, n)
        clash = F.raise_error(F.lit(f"several rules of mode {mode} match an item")).cast("string")
        return value if test is None else F.when(test > 1, clash).otherwise(value)
