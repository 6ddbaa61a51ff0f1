"""Property filters, drug-likeness rule sets and element filters, all as Column predicates that reach the scan where the
source has the columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Published drug-likeness ranges, (low, high), inclusive; None is open. Sets by year, properties as their papers
#: name them: Lipinski and others 1997, Ghose and others 1999, Egan and others 2000, Muegge and others 2001, Veber and others 2002.
RULE_SETS: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "lipinski": {"NumHDonors": (None, 5), "NumHAcceptors": (None, 10), "MolWt": (None, 500), "MolLogP": (None, 5)},
    "ghose": {"MolLogP": (-0.4, 5.6), "MolMR": (40, 130), "MolWt": (160, 480), "NumAtoms": (20, 70)},
    "egan": {"TPSA": (None, 131.6), "MolLogP": (None, 5.88)},
    "muegge": {"MolWt": (200, 600), "MolLogP": (-2, 5), "TPSA": (None, 150), "RingCount": (None, 7), "NumRotatableBonds": (None, 15), "NumHAcceptors": (None, 10), "NumHDonors": (None, 5)},
    "veber": {"NumRotatableBonds": (None, 10), "TPSA": (None, 140)},
}
RULE = re.compile(r"\s*([A-Za-z_]\w*)\s*(<=|>=|==|!=|<|>)\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s*$")


def in_range(value: Column, low: float | None, high: float | None) -> Column:
    """Inclusive; a null value is outside."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.coalesce(ok, F.lit(False)) if low is not None or high is not None else ok


def parse_rule(rule: str) -> Column:
    """A predicate from text such as "MolWt <= 500". < and > are strict."""
    m = RULE.match(rule)
    if not m:
        raise ValueError(f"not a property rule: {rule!r}")
    c, value = F.col(m[1]), F.lit(float(m[3]))
    return {"<=": c <= value, ">=": c >= value, "<": c < value, ">": c > value, "==": c == value, "!=": c != value}[m[2]]


def by_rules(df: DataFrame, *rules: str) -> DataFrame:
    """Rows for which all rules hold; several rules on one property all count."""
    return df.where(reduce(Column.__and__, map(parse_rule, rules), F.lit(True)))


def violations(rules: str | dict[str, tuple[float | None, float | None]], columns: dict[str, Column | str] | None = None) -> Column:
    """Number of a rule set's ranges that a row is outside of. columns: where a property's value is, by default the column of
    its name."""
    checks = _checks(rules, columns)
    return reduce(Column.__add__, ((~ok).cast("int") for _, ok in checks), F.lit(0))


def failed_rules(rules: str | dict[str, tuple[float | None, float | None]], columns: dict[str, Column | str] | None = None) -> Column:
    """"Failed: a, b", or null if none."""
    names = F.concat_ws(", ", *(F.when(~ok, F.lit(name)) for name, ok in _checks(rules, columns)))
    return F.when(names != "", F.concat(F.lit("Failed: "), names))


def druglike(df: DataFrame, rules: str | dict = "lipinski", max_violations: int = 0, columns: dict[str, Column | str] | None = None) -> DataFrame:
    return df.where(violations(rules, columns) <= max_violations)


def _checks(rules, columns) -> list[tuple[str, Column]]:
    if isinstance(rules, str):
        if rules not in RULE_SETS:
            raise ValueError(f"unknown rule set {rules!r}; known: {', '.join(RULE_SETS)}")
        rules = RULE_SETS[rules]
    place = columns or {}
    value = lambda n: (lambda c: F.col(c) if isinstance(c, str) else c)(place.get(n, n))
    return [(name, in_range(value(name), low, high)) for name, (low, high) in rules.items()]


def by_elements(elements: Column, allowed: list[str] | None = None, required: list[str] | None = None, forbidden: list[str] | None = None) -> Column:
    """For an array of element symbols: none outside allowed, all of required, none of forbidden."""
    lits = lambda xs: F.array(*map(F.lit, xs))
    ok = F.lit(True)
    if allowed:
        ok = ok & (F.size(F.array_except(elements, lits(allowed))) == 0)
    if required:
        ok = ok & (F.size(F.array_except(lits(required), elements)) == 0)
    if forbidden:
        ok = ok & ~F.arrays_overlap(elements, lits(forbidden))
    return ok


def by_complexity(df: DataFrame, atoms: tuple[int, int] = (1, 100), rings: tuple[int, int] = (0, 10), rotatable: tuple[int, int] = (0, 20)) -> DataFrame:
    """On HeavyAtomCount, RingCount and NumRotatableBonds, inclusive."""
    return df.where(in_range(F.col("HeavyAtomCount"), *atoms) & in_range(F.col("RingCount"), *rings) & in_range(F.col("NumRotatableBonds"), *rotatable))
