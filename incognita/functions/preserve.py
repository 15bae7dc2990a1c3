"""Allow-list of values which are never replaced."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from incognita.functions.arrays import literal_array
from incognita.rules import DEFAULT_PRESERVE_WORDS

_SEPARATOR = "\u0000"
# Longer lists are tested by one regular expression over their prefix tree instead of one expression
# per rule, which gives the same answers; for lists too long for that, operators.preserve.mark_preserved joins.
_SHORT = 200
_DEPTH = 40  # branches within branches; what is left below is listed


def _flatten(node: object) -> Iterable[str]:
    if isinstance(node, dict):
        node = list(node.values())
    if isinstance(node, list):
        for child in node:
            yield from _flatten(child)
    elif isinstance(node, str) and node:
        yield node


def parse_rules(text: str | None) -> list[str]:
    """Rules from JSON (any nesting) or from a comma/newline separated list."""
    if not text or not text.strip():
        return []
    trimmed = text.strip()
    if trimmed[0] in "[{":
        try:
            return list(_flatten(json.loads(trimmed)))
        except json.JSONDecodeError:
            pass  # a plain list that happens to start with a bracket
    parts = (part.strip() for part in re.split("[,\n]", trimmed))
    return [part for part in parts if part]


@dataclass(frozen=True)
class PreserveRules:
    """An immutable rule list.

    mode "compat" (default): a value is kept if it equals a rule, contains a
    rule or is contained in a rule. mode "strict" drops the last condition.
    ``glob=True`` gives ``*`` in a rule the meaning "anything", matched against
    the whole value.
    """

    rules: tuple[str, ...] = ()
    case_sensitive: bool = False
    mode: str = "compat"
    glob: bool = False

    @staticmethod
    def parse(text: str | None, case_sensitive: bool = False, **options) -> PreserveRules:
        return PreserveRules(tuple(parse_rules(text)), case_sensitive, **options)

    @staticmethod
    def defaults(**options) -> PreserveRules:
        return PreserveRules(tuple(DEFAULT_PRESERVE_WORDS), **options)

    def get(self) -> list[str]:
        return list(self.rules)

    def add(self, rule: str) -> PreserveRules:
        cleaned = rule.strip()
        if not cleaned or cleaned in self.rules:
            return self
        return replace(self, rules=(*self.rules, cleaned))

    def remove(self, rule: str) -> PreserveRules:
        return replace(self, rules=tuple(r for r in self.rules if r != rule))

    def normalised(self) -> list[str]:
        folded = self.rules if self.case_sensitive else [r.lower() for r in self.rules]
        return list(dict.fromkeys(folded))

    def matches(self, value: Column) -> Column:
        """Boolean expression, false for NULL."""
        rules = self.normalised()
        if not rules:
            return F.lit(False)
        folded = value if self.case_sensitive else F.lower(value)
        hit = F.lit(False)
        plain = rules
        if self.glob:
            globs = [r for r in rules if "*" in r]
            plain = [r for r in rules if "*" not in r]
            if globs:
                bodies = (".*".join(re.escape(p) for p in g.split("*")) for g in globs)
                hit = hit | folded.rlike("(?s)^(?:" + "|".join(bodies) + ")$")
        if len(plain) > _SHORT:
            hit = hit | folded.rlike(prefix_tree(plain))
            if self.mode == "compat" and any(_SEPARATOR in r for r in plain):
                hit = hit | F.exists(literal_array(plain), lambda r: F.contains(r, folded))
            elif self.mode == "compat":
                joined = F.lit(_SEPARATOR.join(plain))
                hit = hit | (F.contains(joined, folded) & ~F.contains(folded, F.lit(_SEPARATOR)))
        elif plain:
            # A rule that contains another rule adds nothing to "value contains rule".
            shortest = [r for r in plain if not any(o != r and o in r for o in plain)]
            for rule in shortest:
                hit = hit | F.contains(folded, F.lit(rule))
            if self.mode == "compat":
                hit = hit | _inside_a_rule(folded, plain)
        return F.coalesce(hit, F.lit(False))


def prefix_tree(rules: list[str]) -> str:
    """A regular expression that occurs where one of the rules does. Rules with a common beginning
    share it, so that a place in a value is tested against few characters, not against every rule."""
    shortest: list[str] = []
    for rule in sorted(rules):
        if not (shortest and rule.startswith(shortest[-1])):
            shortest.append(rule)

    def literal(text: str) -> str:
        return "".join(c if c.isascii() and c.isalnum() else "\\" + c for c in text)

    def tree(some: list[str], depth: int) -> str:
        start = os.path.commonprefix(some)
        rest = [r[len(start) :] for r in some]
        if len(some) == 1:
            return literal(start)
        if depth == _DEPTH:
            return literal(start) + "(?:" + "|".join(map(literal, rest)) + ")"
        branches = [tree(list(group), depth + 1) for _, group in groupby(rest, lambda r: r[0])]
        return literal(start) + "(?:" + "|".join(branches) + ")"

    return tree(shortest, 0)


def _inside_a_rule(value: Column, rules: list[str]) -> Column:
    """True where some rule contains the value: one search in the joined rules."""
    if any(_SEPARATOR in r for r in rules):
        tests = [F.contains(F.lit(r), value) for r in rules]
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return out
    longest = [r for r in rules if not any(o != r and r in o for o in rules)]
    joined = _SEPARATOR.join(longest)
    return F.contains(F.lit(joined), value) & ~F.contains(value, F.lit(_SEPARATOR))


def should_preserve(value: Column, rules: PreserveRules | None) -> Column:
    return F.lit(False) if rules is None else rules.matches(value)
