"""Similarity of bit fingerprints as Columns.

A fingerprint is an array of 64-bit words. Metrics are formulas over a and b (bits set in each), c (bits set in both) and n
(bits in all), so Catalyst sees plain arithmetic. Where a formula divides by zero, as for two empty fingerprints, the
value is 1.0 if both are equal and 0.0 else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SQL of each metric over a, b, c, n in doubles; Spark and DuckDB read it alike.
FORMULAS = {
    "tanimoto": ("c", "a + b - c"),
    "dice": ("2 * c", "a + b"),
    "cosine": ("c", "sqrt(a * b)"),
    "sokal": ("c", "2 * a + 2 * b - 3 * c"),
    "russel": ("c", "n"),
    "allbit": ("n - (a + b - 2 * c)", "n"),
    "asymmetric": ("c", "least(a, b)"),
    "braunblanquet": ("c", "greatest(a, b)"),
    "kulczynski": ("c * (a + b)", "2 * a * b"),
    "mcconnaughey": ("c * (a + b) - a * b", "a * b"),
    "onbit": ("c", "a + b - c"),
    "rogotgoldberg": None,
    "tversky": None,
}


def sql(metric: str, alpha: float = 0.5, beta: float = 0.5) -> str:
    """The metric over columns a, b, c, n."""
    if metric == "tversky":
        top, under = "c", f"CAST({alpha} AS DOUBLE) * (a - c) + CAST({beta} AS DOUBLE) * (b - c) + c"
    elif metric == "rogotgoldberg":
        same = "CASE WHEN a = b AND a = c THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
        return f"CASE WHEN a + b = 0 OR 2 * n - a - b = 0 THEN {same} ELSE c / (a + b) + (n - a - b + c) / (2 * n - a - b) END"
    elif metric in FORMULAS:
        top, under = FORMULAS[metric]
    else:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(FORMULAS)}")
    return f"CASE WHEN {under} = 0 THEN CASE WHEN a = b AND a = c THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END ELSE ({top}) / ({under}) END"


def popcount(words: Column) -> Column:
    return F.aggregate(F.transform(words, F.bit_count), F.lit(0), lambda s, x: s + x)


def common(a: Column, b: Column) -> Column:
    """Bits set in both arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def similarity(metric: str, a: Column, b: Column, n_bits: int, alpha: float = 0.5, beta: float = 0.5) -> Column:
    """Of two arrays of words, with a formula's parts computed once."""
    parts = F.struct(popcount(a).cast("double").alias("a"), popcount(b).cast("double").alias("b"), common(a, b).cast("double").alias("c"), F.lit(float(n_bits)).alias("n"))
    return F.transform(F.array(parts), lambda p: of_parts(metric, p["a"], p["b"], p["c"], p["n"], alpha, beta))[0]


def of_parts(metric: str, a: Column, b: Column, c: Column, n: Column, alpha: float = 0.5, beta: float = 0.5) -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    same = F.when((a == b) & (a == c), one).otherwise(zero)
    if metric == "rogotgoldberg":
        return F.when((a + b == 0) | (2 * n - a - b == 0), same).otherwise(c / (a + b) + (n - a - b + c) / (2 * n - a - b))
    ratios = {
        "tanimoto": (c, a + b - c),
        "onbit": (c, a + b - c),
        "dice": (2 * c, a + b),
        "cosine": (c, F.sqrt(a * b)),
        "sokal": (c, 2 * a + 2 * b - 3 * c),
        "russel": (c, n),
        "allbit": (n - (a + b - 2 * c), n),
        "asymmetric": (c, F.least(a, b)),
        "braunblanquet": (c, F.greatest(a, b)),
        "kulczynski": (c * (a + b), 2 * a * b),
        "mcconnaughey": (c * (a + b) - a * b, a * b),
        "tversky": (c, alpha * (a - c) + beta * (b - c) + c),
    }
    if metric not in ratios:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(FORMULAS)}")
    top, under = ratios[metric]
    return F.when(under == 0, same).otherwise(top / under)
