"""Descriptors of a molecule's graph: connectivity, shape, distance and complexity indices, electrotopological states, partial
charges, surface areas in bins of a property, and counts of ring kinds.

What several of them need (distances, paths, areas, states, charges: STEPS) is a column that is made once a row; descriptors
are short expressions on these. All are array expressions inside the row.

Conventions: paths and rings are of the graph without hydrogens, and a path visits an atom once; an aromatic bond counts 1.5; a
quotient by nothing is 0. As the field's usual toolkit has it, areas take one hydrogen's overlap off every heavy atom, and the
total has one hydrogen more; bins hold heavy atoms' areas; the third shape index has A - 2 before the square for even numbers. Elements outside the tables count as carbon in radius
and as 0 in valence electrons.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from retort.functions import graphs
from retort.functions import molecule as M
from retort.functions.crippen import VALUES
from retort.functions.expr import let
from retort.functions.molecule import degree, m, total, z_at

# Fixed values. Outer electrons by atomic number.
OUTER = {
    1: 1, 3: 1, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7, 11: 1, 12: 2, 13: 3, 14: 4, 15: 5, 16: 6, 17: 7, 19: 1, 20: 2, 33: 5, 34: 6, 35: 7, 50: 4, 52: 6, 53: 7,
}
#: Shell of the outer electrons.
SHELL = {1: 1, 3: 2, 5: 2, 6: 2, 7: 2, 8: 2, 9: 2, 11: 3, 12: 3, 13: 3, 14: 3, 15: 3, 16: 3, 17: 3, 19: 4, 20: 4, 33: 4, 34: 4, 35: 4, 50: 5, 52: 5, 53: 5}
#: Size against sp3 carbon less one, by element and hybridization (Hall and Kier 1991).
ALPHA = {
    "C1": -0.22, "C2": -0.13, "C3": 0.0, "N1": -0.29, "N2": -0.20, "N3": -0.04, "O2": -0.20, "O3": -0.04, "F3": -0.07,
    "P2": 0.30, "P3": 0.43, "S2": 0.22, "S3": 0.35, "Cl3": 0.29, "Br3": 0.48, "I3": 0.73,
}
#: Covalent radii, and what a bond of order 1, 2, 3 or 4 (aromatic) takes off the sum of two (Labute 2000).
RADII = {1: 0.33, 5: 0.82, 6: 0.77, 7: 0.70, 8: 0.66, 9: 0.611, 14: 0.937, 15: 0.89, 16: 1.04, 17: 0.997, 35: 1.14, 53: 1.33}
SHORTER = (0.0, 0.2, 0.3, 0.1)
#: Upper edges of the bins of logP, refractivity, charge, electrotopological state, and area; a last bin is open.
BINS = {
    "SlogP_VSA": (-0.4, -0.2, 0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6),
    "SMR_VSA": (1.29, 1.82, 2.24, 2.45, 2.75, 3.05, 3.63, 3.8, 4.0),
    "PEOE_VSA": (-0.30, -0.25, -0.20, -0.15, -0.10, -0.05, 0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30),
    "EState_VSA": (-0.390, 0.290, 0.717, 1.165, 1.540, 1.807, 2.05, 4.69, 9.17, 15.0),
    "VSA_EState": (4.78, 5.00, 5.410, 5.740, 6.00, 6.07, 6.45, 7.00, 11.0),
}


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def _atoms() -> Column:
    return F.sequence(F.lit(0), F.size(m("z")) - 1)


def _sum(xs: Column) -> Column:
    return total(xs, 0.0)


def _root(x: Column) -> Column:
    """1 / sqrt(x), 0 for what is not positive."""
    return F.when(x > 0, 1 / F.sqrt(x)).otherwise(F.lit(0.0))


def electrons() -> Column:
    """Outer electrons less hydrogens of each atom."""
    outer = _map(OUTER)
    return F.transform(_atoms(), lambda i: (F.coalesce(F.try_element_at(outer, z_at(i)), F.lit(0)) - F.get(m("h"), i)).cast("double"))


def valences() -> Column:
    """The same, divided by the inner electrons less one beyond the second row."""
    outer = _map(OUTER)
    inner = lambda i: z_at(i) - F.coalesce(F.try_element_at(outer, z_at(i)), F.lit(0)) - 1
    return F.transform(electrons(), lambda e, i: F.when(z_at(i) > 10, e / inner(i)).otherwise(e))


def paths() -> Column:
    """For 1 to 4 bonds: n paths, each way, and sums of the products of 1 / sqrt of electrons (e) and of valences (v) on them."""
    kind = "array<array<int>>"
    product = lambda p, by: F.aggregate(p, F.lit(1.0), lambda s, i: s * F.get(by, i))

    def grown(e: Column, v: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            told = lambda p: F.struct(F.size(p).cast("long").alias("n"), _sum(F.transform(p, lambda x: product(x, e))).alias("e"), _sum(F.transform(p, lambda x: product(x, v))).alias("v"))
            return let(graphs._grown(s["p"]).cast(kind), lambda p: F.struct(p.alias("p"), F.concat(s["out"], F.array(told(p))).alias("out")))

        none = F.array().cast("array<struct<n:bigint,e:double,v:double>>")
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.struct(F.transform(_atoms(), lambda i: F.array(i)).cast(kind).alias("p"), none.alias("out")), step, lambda s: s["out"])

    return let(F.transform(electrons(), _root), lambda e: let(F.transform(valences(), _root), lambda v: grown(e, v)))


def far() -> Column:
    """Of each atom, the others that it is connected to and the bonds between."""
    first = F.transform(_atoms(), lambda i: F.struct(F.array(i).alias("ball"), F.array(i).alias("edge"), F.array().cast("array<struct<v:int,d:int>>").alias("far")))

    def step(state: Column, d: Column) -> Column:
        def one(s: Column) -> Column:
            edge = F.array_except(F.array_distinct(F.flatten(F.transform(s["edge"], lambda i: F.get(m("near"), i)))), s["ball"])
            grown = lambda e: F.struct(F.concat(s["ball"], e).alias("ball"), e.alias("edge"), F.concat(s["far"], F.transform(e, lambda v: F.struct(v.alias("v"), d.alias("d")))).alias("far"))
            return F.when(F.size(s["edge"]) == 0, s).otherwise(let(edge, grown))

        return F.transform(state, one)

    return F.transform(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(m("z")), F.lit(1))), first, step), lambda s: s["far"])


def length_sums() -> Column:
    """Of each atom, the sum of shortest distances to all others, a bond of order o being 1 / o long. Each step lets paths lead
    through one more atom; what is not connected is not counted."""
    order = lambda o: F.when(o == 4, F.lit(1.5)).otherwise(o.cast("double"))
    pairs = lambda i: F.map_from_arrays(F.get(m("near"), i), F.transform(F.get(m("order"), i), lambda o: 1 / order(o)))
    row = lambda i: let(pairs(i), lambda near: F.transform(_atoms(), lambda j: F.when(i == j, F.lit(0.0)).otherwise(F.coalesce(F.try_element_at(near, j), F.lit(math.inf)))))
    through = lambda dist, k: let(F.get(dist, k), lambda mid: F.transform(dist, lambda own: let(F.get(own, k), lambda to: F.when(to == math.inf, own).otherwise(F.zip_with(own, mid, lambda d, x: F.least(d, to + x))))))
    done = F.aggregate(_atoms(), F.transform(_atoms(), row), through)
    return F.transform(done, lambda own: _sum(F.filter(own, lambda d: d < math.inf)))


def areas() -> Column:
    """Surface of each atom that its bonds and one hydrogen leave (Labute 2000)."""
    radii = _map(RADII)
    radius = lambda i: F.coalesce(F.try_element_at(radii, z_at(i)), F.lit(RADII[6]))
    shorter = F.array(*map(F.lit, SHORTER))

    def taken(r: Column, q: Column, off: Column) -> Column:
        apart = F.least(F.greatest(F.abs(r - q), r + q - off), r + q)
        return let(apart, lambda d: q * q - (r - d) * (r - d) / d)

    def one(i: Column) -> Column:
        bonds = F.arrays_zip(F.get(m("near"), i).alias("v"), F.get(m("order"), i).alias("o"))
        heavy = lambda r: _sum(F.transform(bonds, lambda x: taken(r, radius(x["v"]), F.get(shorter, x["o"] - 1))))
        return let(radius(i), lambda r: 4 * math.pi * r * r - math.pi * r * (heavy(r) + taken(r, F.lit(RADII[1]), F.lit(0.0))))

    return F.transform(_atoms(), one)


def hydrogen_area() -> Column:
    """Surface of a hydrogen that a bond to every heavy atom leaves."""
    radii, q = _map(RADII), RADII[1]
    radius = lambda i: F.coalesce(F.try_element_at(radii, z_at(i)), F.lit(RADII[6]))
    taken = lambda r: r * r - r * r / (r + q)
    return 4 * math.pi * q * q - math.pi * q * _sum(F.transform(_atoms(), lambda i: let(radius(i), taken)))


def states() -> Column:
    """Electrotopological state of each atom (Kier and Hall 1990): its own state, and its difference to all others' over the
    square of atoms on the way."""
    shell = _map(SHELL)
    n = lambda i: F.coalesce(F.try_element_at(shell, z_at(i)), F.lit(2)).cast("double")
    own = F.transform(electrons(), lambda e, i: F.when(degree(i) > 0, (4 / (n(i) * n(i)) * e + 1) / degree(i)).otherwise(F.lit(0.0)))
    felt = lambda s, i: _sum(F.transform(F.get(F.col("_far"), i), lambda x: (F.get(s, i) - F.get(s, x["v"])) / ((x["d"] + 1) * (x["d"] + 1))))
    return let(own, lambda s: F.transform(s, lambda x, i: x + felt(s, i)))


def partial() -> Column:
    from retort.operators.rewrite import charge_states

    return let(charge_states(12), lambda s: F.when(F.forall(s, lambda a: a["q"].isNotNull()), F.transform(s, lambda a: a["q"])))


def heavy_share(field: str) -> Column:
    """The contributions to logp or mr of heavy atoms alone, without what their hydrogens bring."""
    which = ("logp", "mr").index(field)
    h1, alcohol, amine, acid, other = (F.lit(VALUES[k][which]) for k in ("H1", "H2", "H3", "H4", "HS"))
    bonds = lambda v: F.arrays_zip(F.get(m("near"), v).alias("v"), F.get(m("order"), v).alias("o"))
    acyl = lambda v: (z_at(v) == 6) & ~F.get(m("arom"), v) & F.exists(bonds(v), lambda x: (x["o"] == 2) & z_at(x["v"]).isin(6, 7, 8, 16))
    one = lambda i: F.when(z_at(i).isin(1, 6), h1).when(z_at(i) == 7, amine).when(z_at(i) == 8, F.when(F.exists(F.get(m("near"), i), acyl), acid).otherwise(alcohol)).otherwise(other)
    return F.transform(m(field), lambda x, i: x - F.get(m("h"), i) * one(i))


def binned(by: Column, amount: Column, edges: tuple[float, ...]) -> Column:
    """Sums of amount by the bins of by; an edge itself is in the higher bin."""
    bin_of = lambda x: F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x))
    rows = F.zip_with(by, amount, lambda x, y: F.struct(bin_of(x).alias("k"), y.alias("y")))
    return let(rows, lambda r: F.transform(F.sequence(F.lit(0), F.lit(len(edges))), lambda k: _sum(F.transform(F.filter(r, lambda x: x["k"] == k), lambda x: x["y"]))))


#: Columns that descriptors share, in the order in which they are made.
STEPS: dict[str, Callable[[], Column]] = {
    "_paths": paths,
    "_far": far,
    "_sums": length_sums,
    "_area": areas,
    "_state": states,
    "_charge": partial,
    "SlogP_VSA": lambda: binned(heavy_share("logp"), F.col("_area"), BINS["SlogP_VSA"]),
    "SMR_VSA": lambda: binned(heavy_share("mr"), F.col("_area"), BINS["SMR_VSA"]),
    "PEOE_VSA": lambda: binned(F.col("_charge"), F.col("_area"), BINS["PEOE_VSA"]),
    "EState_VSA": lambda: binned(F.col("_state"), F.col("_area"), BINS["EState_VSA"]),
    "VSA_EState": lambda: binned(F.col("_area"), F.col("_state"), BINS["VSA_EState"]),
}
NEEDS = {"_state": ("_far",), "SlogP_VSA": ("_area",), "SMR_VSA": ("_area",), "PEOE_VSA": ("_charge", "_area"), "EState_VSA": ("_far", "_state", "_area"), "VSA_EState": ("_far", "_state", "_area")}


def _hybrid(i: Column) -> Column:
    """1, 2 or 3 for sp, sp2 and sp3. Nitrogen and oxygen beside a multiple bond are sp2."""
    multiple = lambda j: F.exists(F.get(m("order"), j), lambda o: o > 1)
    doubles = F.size(F.filter(F.get(m("order"), i), lambda o: o == 2))
    beside = z_at(i).isin(7, 8) & (degree(i) + F.get(m("h"), i) < 4) & F.exists(F.get(m("near"), i), multiple)
    return F.when(F.exists(F.get(m("order"), i), lambda o: o == 3) | (doubles > 1) & (z_at(i) == 6), 1).when(multiple(i) & ~z_at(i).isin(15, 16) | beside | z_at(i).isin(15, 16) & (multiple(i) & (degree(i) < 3)), 2).otherwise(3)


def hall_kier() -> Column:
    table, names = _map(ALPHA), _map({z: s for z, s in M.SYMBOL.items() if z})
    kind = lambda i: F.concat(F.coalesce(F.try_element_at(names, z_at(i)), F.lit("")), _hybrid(i).cast("string"))
    return _sum(F.transform(_atoms(), lambda i: F.coalesce(F.try_element_at(table, kind(i)), F.lit(0.0))))


def _path(k: int, field: str) -> Column:
    return F.get(F.col("_paths"), F.lit(k - 1))[field] / 2.0


def _over(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def kappa(k: int) -> Column:
    """Kier's shape index of paths of k bonds, with the size of atoms."""

    def of(x: Column) -> Column:
        n, alpha, p = x["n"], x["alpha"], x["p"]
        a = n + alpha
        if k == 1:
            top = a * (a - 1) * (a - 1)
        elif k == 2:
            top = (a - 1) * (a - 2) * (a - 2)
        else:
            top = F.when(n % 2 == 1, a - 1).otherwise(a - 2) * (a - 3) * (a - 3)
        return F.when(p == 0, F.lit(0.0)).otherwise(_over(top, (p + alpha) * (p + alpha)))

    return let(F.struct(F.size(m("z")).alias("n"), hall_kier().alias("alpha"), _path(k, "n").alias("p")), of)


def balaban() -> Column:
    """Balaban's J (1982) over distances that multiple bonds shorten."""
    s = F.col("_sums")
    over = _sum(F.transform(F.arrays_zip(m("a").alias("a"), m("b").alias("b")), lambda x: _root(F.get(s, x["a"]) * F.get(s, x["b"]))))
    q, n = F.size(m("a")), F.size(m("z"))
    return _over(q * over, (q - n + 2).cast("double"))


def _spread(counts: Column) -> Column:
    """n log2 n less the sum of n_k log2 n_k."""
    log = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    return log(_sum(counts)) - _sum(F.transform(counts, log))


def bertz() -> Column:
    """Bertz's complexity (1981): of connections, pairs of bonds that meet and the parts of a multiple bond, by number and kind,
    and of elements. A pair of bonds of orders o and p is o p connections, a bond has o (o - 1) / 2 of its own; atoms are of one kind if
    the whole molecule around them is."""
    order = lambda o: F.when(o == 4, F.lit(1.5)).otherwise(o.cast("double"))

    def connections(h: Column) -> Column:
        def around(i: Column) -> Column:
            ends = F.arrays_zip(F.get(m("near"), i).alias("v"), F.get(m("order"), i).alias("o"))
            one = lambda x: F.xxhash64(F.get(h, x["v"]), x["o"])
            pair = lambda x, y: F.struct(F.xxhash64(F.get(h, i), F.least(one(x), one(y)), F.greatest(one(x), one(y))).alias("k"), (order(x["o"]) * order(y["o"])).alias("n"))
            return F.flatten(F.transform(ends, lambda x, k: F.transform(F.slice(ends, k + 2, F.size(ends)), lambda y: pair(x, y))))

        own = lambda x: F.struct(F.xxhash64(F.least(F.get(h, x["a"]), F.get(h, x["b"])), F.greatest(F.get(h, x["a"]), F.get(h, x["b"])), x["o"]).alias("k"), (order(x["o"]) * (order(x["o"]) - 1) / 2).alias("n"))
        return F.concat(F.flatten(F.transform(_atoms(), around)), F.transform(F.filter(M.bonds(), lambda x: x["o"] > 1), own))

    sums = lambda c: F.transform(F.array_distinct(F.transform(c, lambda x: x["k"])), lambda k: _sum(F.transform(F.filter(c, lambda x: x["k"] == k), lambda x: x["n"])))
    kinds = F.transform(F.array_distinct(m("z")), lambda z: M.count(m("z"), lambda y: y == z).cast("double"))
    size = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))
    return let(let(let(graphs.refined(), connections), sums), lambda n: _spread(n) + let(_sum(n), size)) + _spread(kinds)


def rings_where(test) -> Column:
    return M.count(m("rings"), test)


def _aromatic(r: Column) -> Column:
    return F.forall(r, lambda i: F.get(m("arom"), i))


def _carbon(r: Column) -> Column:
    return F.forall(r, lambda i: z_at(i) == 6)


def _saturated(r: Column) -> Column:
    bonds = lambda i: F.arrays_zip(F.get(m("near"), i).alias("v"), F.get(m("order"), i).alias("o"))
    return F.forall(r, lambda i: F.forall(bonds(i), lambda x: (x["o"] == 1) | ~F.array_contains(r, x["v"])))


def _amides() -> Column:
    acyl = lambda c, n: (z_at(c) == 6) & (z_at(n) == 7) & ~F.get(m("arom"), n) & F.exists(F.arrays_zip(F.get(m("near"), c).alias("v"), F.get(m("order"), c).alias("o")), lambda x: (x["o"] == 2) & (z_at(x["v"]) == 8))
    return M.count(M.bonds(), lambda x: (x["o"] == 1) & (acyl(x["a"], x["b"]) | acyl(x["b"], x["a"])))


def _centers(undefined: bool) -> Column:
    from retort.operators.molecules import possible_centers, undefined_centers

    return F.size(undefined_centers()) if undefined else F.size(F.array_union(possible_centers(), M.atoms_where(lambda i: F.get(m("chiral"), i) > 0)))


def _density(radius: int) -> Column:
    return F.size(F.array_distinct(graphs._all_hashes(radius))) / F.nullif(F.size(m("z")).cast("double"), F.lit(0.0))


def _numbers(made: list[Column]) -> list[Column]:
    """The molecular quantum numbers in order, built once for a list that is empty at first."""
    from retort.operators.analysis import quantum_numbers

    if not made:
        made.extend(quantum_numbers().values())
    return made


def _degrees(order: int) -> Column:
    if order == 0:
        return _sum(F.transform(_atoms(), lambda i: _root(degree(i))))
    return _sum(F.transform(M.bonds(), lambda x: _root(degree(x["a"]) * degree(x["b"]))))


def _qed() -> Column:
    from retort.functions.scores import qed

    return qed()


def described() -> dict[str, tuple[str, Callable[[], Column], tuple[str, ...]]]:
    """name: (category, expression, shared columns that it reads)."""
    topo, elec, cons = "topological", "electronic", "constitutional"
    out: dict[str, tuple[str, Callable[[], Column], tuple[str, ...]]] = {
        "Chi0": (topo, lambda: _degrees(0), ()),
        "Chi1": (topo, lambda: _degrees(1), ()),
        "Chi0n": (topo, lambda: _sum(F.transform(electrons(), _root)), ()),
        "Chi0v": (topo, lambda: _sum(F.transform(valences(), _root)), ()),
        "HallKierAlpha": (topo, hall_kier, ()),
        "Phi": (topo, lambda: kappa(1) * kappa(2) / F.size(m("z")), ("_paths",)),
        "BalabanJ": (topo, balaban, ("_sums",)),
        "BertzCT": (topo, bertz, ()),
        "LabuteASA": (elec, lambda: _sum(F.col("_area")) + hydrogen_area(), ("_area",)),
        "MaxEStateIndex": (elec, lambda: F.array_max("_state"), ("_far", "_state")),
        "MinEStateIndex": (elec, lambda: F.array_min("_state"), ("_far", "_state")),
        "MaxAbsEStateIndex": (elec, lambda: F.array_max(F.transform("_state", F.abs)), ("_far", "_state")),
        "MinAbsEStateIndex": (elec, lambda: F.array_min(F.transform("_state", F.abs)), ("_far", "_state")),
        "MaxPartialCharge": (elec, lambda: F.array_max("_charge"), ("_charge",)),
        "MinPartialCharge": (elec, lambda: F.array_min("_charge"), ("_charge",)),
        "MaxAbsPartialCharge": (elec, lambda: F.array_max(F.transform("_charge", F.abs)), ("_charge",)),
        "MinAbsPartialCharge": (elec, lambda: F.least(F.abs(F.array_max("_charge")), F.abs(F.array_min("_charge"))), ("_charge",)),
        "HeavyAtomMolWt": ("molecular", lambda: M.weight() - M.h_count() * M.MASSES["H"][1], ()),
        "NumValenceElectrons": (cons, lambda: _sum(electrons()) + 2 * M.h_count() - total(m("charge")), ()),
        "NHOHCount": (cons, lambda: total(F.transform(M.atoms_where(lambda i: z_at(i).isin(7, 8)), lambda i: F.get(m("h"), i))), ()),
        "NOCount": (cons, lambda: F.size(M.atoms_where(lambda i: z_at(i).isin(7, 8))), ()),
        "NumAmideBonds": (cons, _amides, ()),
        "NumHeterocycles": (cons, lambda: rings_where(lambda r: ~_carbon(r)), ()),
        "NumAromaticCarbocycles": (cons, lambda: rings_where(lambda r: _aromatic(r) & _carbon(r)), ()),
        "NumAromaticHeterocycles": (cons, lambda: rings_where(lambda r: _aromatic(r) & ~_carbon(r)), ()),
        "NumAliphaticCarbocycles": (cons, lambda: rings_where(lambda r: ~_aromatic(r) & _carbon(r)), ()),
        "NumAliphaticHeterocycles": (cons, lambda: rings_where(lambda r: ~_aromatic(r) & ~_carbon(r)), ()),
        "NumSaturatedRings": (cons, lambda: rings_where(_saturated), ()),
        "NumSaturatedCarbocycles": (cons, lambda: rings_where(lambda r: _saturated(r) & _carbon(r)), ()),
        "NumSaturatedHeterocycles": (cons, lambda: rings_where(lambda r: _saturated(r) & ~_carbon(r)), ()),
        "NumAtomStereoCenters": (cons, lambda: _centers(False), ()),
        "NumUnspecifiedAtomStereoCenters": (cons, lambda: _centers(True), ()),
        "QED": ("molecular", _qed, ()),
    }
    for k in range(1, 5):
        out[f"Chi{k}n"] = (topo, lambda k=k: _path(k, "e"), ("_paths",))
        out[f"Chi{k}v"] = (topo, lambda k=k: _path(k, "v"), ("_paths",))
    for k in range(1, 4):
        out[f"Kappa{k}"] = (topo, lambda k=k: kappa(k), ("_paths",))
        out[f"FpDensityMorgan{k}"] = ("molecular", lambda k=k: _density(k), ())
    for family, edges in BINS.items():
        for k in range(len(edges) + 1):
            out[f"{family}{k + 1}"] = (elec, lambda f=family, k=k: F.get(F.col(f), F.lit(k)), (*NEEDS[family], family))
    made: list[Column] = []
    for k in range(1, 43):
        out[f"MQN{k}"] = ("mqn", lambda k=k: _numbers(made)[k - 1], ())
    return out
