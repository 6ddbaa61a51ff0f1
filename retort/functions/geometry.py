"""Coordinates as Columns: RMSD, inertia and shape. Points are arrays of [x, y, z].

Superposing two conformers needs the largest eigenvalue of a 4 x 4 matrix (Horn's quaternions); it is found by Newton steps
from above on the characteristic polynomial (Theobald 2005), and principal moments come from the closed form for symmetric
3 x 3 matrices, so nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from retort.functions.expr import let


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def raw_rmsd(p: Column, q: Column) -> Column:
    """Without moving either."""
    squares = F.zip_with(p, q, lambda a, b: (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))
    return F.sqrt(_sum(squares) / F.size(p))


def centered(p: Column) -> Column:
    mean = F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda k: _sum(F.transform(p, lambda a: F.get(a, k))) / F.size(p))
    return F.transform(p, lambda a: F.zip_with(a, mean, lambda x, y: x - y))


def aligned_rmsd(p: Column, q: Column, steps: int = 60) -> Column:
    """After the best rotation and translation of equally many points."""

    def of(pair: Column) -> Column:
        a, b = pair["p"], pair["q"]
        dot = lambda i, j: _sum(F.zip_with(a, b, lambda x, y: x[i] * y[j]))
        own = lambda c: _sum(F.transform(c, lambda x: x[0] * x[0] + x[1] * x[1] + x[2] * x[2]))
        m = F.struct(*(dot(i, j).alias(f"s{i}{j}") for i in range(3) for j in range(3)), ((own(a) + own(b)) / 2).alias("e"))
        return let(m, lambda s: F.sqrt(F.greatest(F.lit(0.0), 2 * (s["e"] - _largest(s, steps)) / F.size(a))))

    return let(F.struct(centered(p).alias("p"), centered(q).alias("q")), of)


def _largest(s: Column, steps: int) -> Column:
    xx, xy, xz, yx, yy, yz, zx, zy, zz = (s[f"s{i}{j}"] for i in range(3) for j in range(3))
    k = [
        [xx + yy + zz, yz - zy, zx - xz, xy - yx],
        [yz - zy, xx - yy - zz, xy + yx, zx + xz],
        [zx - xz, xy + yx, yy - xx - zz, yz + zy],
        [xy - yx, zx + xz, yz + zy, zz - xx - yy],
    ]
    # characteristic polynomial x^4 + c2 x^2 + c1 x + c0
    flat = F.array(*(x for row in k for x in row))

    def poly(v: Column) -> Column:
        g = lambda i, j: F.get(v, F.lit(4 * i + j))
        minor = lambda r, c: g(r[0], c[0]) * g(r[1], c[1]) - g(r[0], c[1]) * g(r[1], c[0])
        det3 = lambda r, c: g(r[0], c[0]) * minor(r[1:], c[1:]) - g(r[0], c[1]) * minor(r[1:], (c[0], c[2])) + g(r[0], c[2]) * minor(r[1:], c[:2])
        pairs = [(i, j) for i in range(4) for j in range(i)]
        c2 = sum((minor(p, p) for p in pairs[1:]), minor(pairs[0], pairs[0]))
        triples = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
        c1 = -sum((det3(t, t) for t in triples[1:]), det3(triples[0], triples[0]))
        rest = lambda j: tuple(c for c in range(4) if c != j)
        c0 = g(0, 0) * det3((1, 2, 3), rest(0)) - g(0, 1) * det3((1, 2, 3), rest(1)) + g(0, 2) * det3((1, 2, 3), rest(2)) - g(0, 3) * det3((1, 2, 3), rest(3))
        return F.struct(c2.alias("c2"), c1.alias("c1"), c0.alias("c0"))

    def newton(c: Column) -> Column:
        def step(x: Column, _: Column) -> Column:
            f = ((x * x + c["c2"]) * x + c["c1"]) * x + c["c0"]
            d = (4 * x * x + 2 * c["c2"]) * x + c["c1"]
            return F.when(F.abs(d) < 1e-300, x).otherwise(x - f / d)

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), s["e"], step)

    return let(let(flat, poly), newton)


def moments(p: Column, mass: Column) -> Column:
    """The three principal moments of inertia, smallest first, as an array."""

    def of(t: Column) -> Column:
        pts, w = t["p"], t["w"]
        total = _sum(w)
        center = F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda k: _sum(F.zip_with(pts, w, lambda a, m: F.get(a, k) * m)) / total)
        moved = F.transform(pts, lambda a: F.zip_with(a, center, lambda x, y: x - y))
        cov = lambda i, j: _sum(F.zip_with(moved, w, lambda a, m: m * a[i] * a[j]))
        s = F.struct(*(cov(i, j).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)))
        return let(s, _inertia)

    return let(F.struct(p.alias("p"), mass.alias("w")), of)


def _inertia(s: Column) -> Column:
    a, b, c = s["c11"] + s["c22"], s["c00"] + s["c22"], s["c00"] + s["c11"]
    d, e, f = -s["c01"], -s["c02"], -s["c12"]
    off = d * d + e * e + f * f
    q = (a + b + c) / 3
    spread = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * off) / 6)
    det = (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
    r = F.when(spread > 0, det / (spread * spread * spread) / 2).otherwise(0.0)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3
    top, low = q + 2 * spread * F.cos(phi), q + 2 * spread * F.cos(phi + 2 * math.pi / 3)
    return F.array_sort(F.array(low, 3 * q - top - low, top))


def shape(pmi: Column) -> dict[str, Column]:
    """Descriptors of shape from principal moments (smallest first)."""
    a, b, c = (F.get(pmi, F.lit(k)) for k in range(3))
    safe = lambda x, y: F.when(y != 0, x / y).otherwise(0.0)
    # half the trace less each moment: the principal second moments
    half = (a + b + c) / 2
    x, y, z = half - c, half - b, half - a
    return {
        "PMI1": a, "PMI2": b, "PMI3": c, "NPR1": safe(a, c), "NPR2": safe(b, c),
        "Asphericity": safe(((z - y) * (z - y) + (z - x) * (z - x) + (y - x) * (y - x)) / 2, (x + y + z) * (x + y + z)),
        "Eccentricity": safe(F.sqrt(F.greatest(c * c - a * a, F.lit(0.0))), c),
        "InertialShapeFactor": safe(b, a * c),
        "SpherocityIndex": safe(3 * x, x + y + z),
    }
