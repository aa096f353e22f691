"""Event drop rules, compiled to one column on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masks import wildcard

#: Tried in this order over the whole rule, so `a>=5` reads as `a > "=5"`.
OPERATORS = ("!=", ">", "<", "=")


@dataclass(frozen=True)
class Rule:
    field: str
    op: str
    value: str

    @property
    def number(self) -> float | None:
        try:
            n = float(self.value)
        except ValueError:
            return None
        return None if "_" in self.value or math.isnan(n) else n


def parse_rule(text: str) -> Rule:
    for op in OPERATORS:
        field, found, value = text.partition(op)
        if found:
            field, value = field.strip(), value.strip()
            if not field or not value:
                raise ValueError(f"a drop rule needs a field and a value: {text!r}")
            return Rule(field, op, value)
    raise ValueError(f"a drop rule needs one of {OPERATORS}: {text!r}")


def _text_match(rule: Rule, actual: Column) -> Column:
    """Equality, or the mask where the value has a star."""
    return wildcard(actual, rule.value) if "*" in rule.value else actual == rule.value


def _signed(rule: Rule, matched: Column) -> Column:
    if rule.op == "=":
        return matched
    return ~matched if rule.op == "!=" else F.lit(False)


def rule_condition(rule: Rule, metric: str = "metric", key: str = "key", data: str = "data") -> Column:
    """Whether the rule drops an event with columns metric, key and data."""
    if rule.field == "metric":
        return _signed(rule, _text_match(rule, F.col(metric)))
    if rule.field == "key":
        return _signed(rule, _text_match(rule, F.col(key)))
    if rule.field == "var":
        return _signed(rule, F.exists(F.map_keys(data), lambda v: _text_match(rule, v)))
    last = F.col(data)[rule.field]["last"]
    number = rule.number
    if number is None:
        compared = _signed(rule, _text_match(rule, last.cast("string")))
    else:
        against = F.lit(number)
        value = last.cast("double")
        compared = {"=": value == against, "!=": value != against, ">": value > against, "<": value < against}[rule.op]
    return F.coalesce(compared, F.lit(False))  # a missing variable never matches


def dropped_by(rules: Iterable[str]) -> Column | None:
    """Whether some rule holds for an event; None without rules."""
    dropped = None
    for text in rules:
        condition = rule_condition(parse_rule(text))
        dropped = condition if dropped is None else dropped | condition
    return None if dropped is None else F.coalesce(dropped, F.lit(False))


def drop_events(events: DataFrame, rules: Iterable[str]) -> DataFrame:
    """Events for which no rule holds."""
    dropped = dropped_by(rules)
    return events if dropped is None else events.filter(~dropped)
