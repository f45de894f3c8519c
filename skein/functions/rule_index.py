"""Signature rules as data, found by the rarest text that each of them needs.

A pattern can only match where one of its required literals stands. One scan of a value finds which of these literals it
holds; only the rules behind them are tried. The rules may be any number: the value is read once, not once a rule.
"""

from __future__ import annotations

import math
import re
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decode import let
from .patterns import RULES, has, java

#: Rules of one table at most: they become constants of the plan.
MOST_RULES = 10_000
Rule = tuple[str, str, str, str]


def required(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case literals: of each set, at least one stands in every text that the pattern matches."""
    return _required(parser.parse(pattern, re.IGNORECASE))


def _required(parsed) -> list[frozenset[str]]:
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in parsed:
        if op is ops.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if op is ops.AT:  # takes no room: what stands about it is still adjacent
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is ops.SUBPATTERN:
            found += _required(arg[-1])
        elif op is ops.ATOMIC_GROUP:
            found += _required(arg)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and arg[0] > 0:
            found += _required(arg[2])
        elif op is ops.BRANCH:
            each = [_best(_required(branch)) for branch in arg[1]]
            if all(each):
                found.append(frozenset().union(*each))
        elif op is ops.IN and len(arg) <= 4 and all(kind is ops.LITERAL and value < 128 for kind, value in arg):
            found.append(frozenset(chr(value).lower() for _, value in arg))
    if run:
        found.append(frozenset([run]))
    return found


def _expected(literal: str) -> float:
    """How often a literal is to be expected: letters at one place in twenty, other characters at one in two hundred."""
    return math.prod(0.05 if c.isalpha() else 0.005 for c in literal)


def _best(sets: list[frozenset[str]], seen: dict[str, int] | None = None) -> frozenset[str]:
    """The set whose literals are rarest: by their counts where given, then by what is to be expected."""
    if not sets:
        return frozenset()
    return min(sets, key=lambda s: (sum((seen or {}).get(x, 0) for x in s), sum(map(_expected, s)), sorted(s)))


def _alternation(literals: set[str]) -> str:
    """A pattern that finds, at every position, the longest literal that begins there: the literals as a tree by their characters."""
    tree: dict = {}
    for x in literals:
        node = tree
        for c in x:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [re.escape(c) + written(below) for c, below in sorted(node.items()) if c]
        body = "(?:" + "|".join(branches) + ")" if branches else ""
        return body + "?" if branches and "" in node else body

    first = "".join(sorted(re.escape(c) for c in tree))
    return f"(?=[{first}])(?=({written(tree)}))"


def literals_in(value: Column, literals: set[str]) -> Column:
    """The distinct longest literals that stand in a value, wherever they begin."""
    return F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(_alternation(literals)), F.lit(1)))


class RuleIndex:
    """Rules (id, family, severity, pattern) by required literal."""

    def __init__(self, rules: list[Rule], seen: dict[str, int] | None = None):
        self.rules = rules
        self.key_of = [_best(required(p), seen) for *_, p in rules]
        self.literals: set[str] = set().union(*self.key_of)
        self.always = [k for k, key in enumerate(self.key_of) if not key]

    def _places(self) -> dict[str, list[int]]:
        """For each literal the rules that it may mean: its own, and those of literals that it begins with."""
        own: dict[str, list[int]] = {}
        for k, key in enumerate(self.key_of):
            for x in key:
                own.setdefault(x, []).append(k)
        return {x: sorted({k for y, ks in own.items() if x.startswith(y) for k in ks}) for x in self.literals}

    def hits(self, value: Column) -> Column:
        """Ids of the rules that match, in the order of the rules; the pattern of a rule is only tried where its literal stands."""
        if not self.rules:
            return F.array().cast("array<string>")
        patterns = F.array(*(F.lit(java(p)) for *_, p in self.rules))
        ids = F.array(*(F.lit(r[0]) for r in self.rules))
        always = F.array(*map(F.lit, self.always)).cast("array<int>")

        def tried(candidates: Column) -> Column:
            matching = F.filter(candidates, lambda k: F.rlike(value, F.get(patterns, k)))
            return F.transform(matching, lambda k: F.get(ids, k))

        if not self.literals:
            return F.when(value.isNotNull(), tried(always))
        places = F.create_map(*(x for lit, ks in sorted(self._places().items()) for x in (F.lit(lit), F.array(*map(F.lit, ks)))))
        candidates = let(places, lambda m: F.flatten(F.transform(literals_in(value, self.literals), lambda x: F.element_at(m, x))))
        return F.when(value.isNotNull(), tried(F.array_sort(F.array_distinct(F.concat(candidates, always)))))

    def fixed_hits(self, value: Column) -> Column:
        """The same for rules that are known with the program: each is an expression of its own, and compiles once a task."""
        means = lambda key: F.array(*(F.lit(x) for x in sorted(self.literals) if any(x.startswith(y) for y in key)))
        test = lambda found, key, p: F.arrays_overlap(found, means(key)) & has(value, p) if key else has(value, p)
        made = lambda found: F.array_compact(F.array(*(F.when(test(found, key, p), F.lit(i)) for key, (i, _, _, p) in zip(self.key_of, self.rules))))
        none = F.array().cast("array<string>")
        return let(literals_in(value, self.literals), lambda found: made(found) if self.always else F.when(F.size(found) > 0, made(found)).otherwise(none))

    def high(self) -> list[str]:
        return [r[0] for r in self.rules if r[2] == "high"]


def rule_hits(value: Column, rules: list[Rule] = RULES) -> Column:
    """Ids of the built-in rules that match, in their order."""
    return RuleIndex(rules).fixed_hits(value)


def read_rules(rules: DataFrame) -> list[Rule]:
    """The rows of a rules table (id, family, severity, pattern), in order of id. Its size is checked: ``MOST_RULES`` at most."""
    rows = rules.select("id", "family", "severity", "pattern").orderBy("id").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [tuple(r) for r in rows]


def measured_index(rules: list[Rule], values: DataFrame, value_col: str) -> RuleIndex:
    """An index whose literals are the rarest of each pattern in ``values``: one pass counts the values that hold each literal."""
    literals = {x for *_, p in rules for s in required(p) for x in s}
    if not literals:
        return RuleIndex(rules)
    counts = values.select(F.explode(literals_in(F.col(value_col), literals)).alias("x")).groupBy("x").count().collect()
    seen = {r["x"]: r["count"] for r in counts}
    return RuleIndex(rules, {x: sum(n for y, n in seen.items() if y.startswith(x)) for x in literals})
