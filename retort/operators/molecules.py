"""Operators on molecule tables: validation, substructures, functional groups, rings, pairs and reductions.

Substructure search grows partial fits inside each row, one pattern bond a step, so that it is a plain filter without a
shuffle. Fragments and matched pairs are exploded rows that meet on their core; atoms() and bonds() give molecules as tables
for what has to be joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions import graphs
from retort.functions import molecule as M
from retort.functions import smiles as S
from retort.functions.elements import NUMBER
from retort.functions.expr import let
from retort.functions.molecule import m
from retort.functions.stereo import SMALLEST_RING


class NotAvailable(NotImplementedError):
    """What needs data or force fields that are not published in a form this library could use."""


def unavailable(what: str, why: str):
    def call(*args, **kwargs):
        raise NotAvailable(f"{what} is not offered: {why}")

    return call


#: Operators of the same field that need conformer generation, force fields, or catalogs and tables that are not at hand.
MISSING = {
    name: unavailable(name, why)
    for why, names in {
        "it needs generated 3D coordinates": ("conformers_generate", "conformers_constrained", "similarity_shape"),
        "it needs a force field": ("conformers_optimize", "conformers_torsion", "energy_compute", "energy_minimize", "align_o3a"),
        "its table or catalog is not public data at hand": ("np_likeness", "inchi", "inchikey", "alerts_catalog", "avalon", "gobbi_pharmacophore"),
        "it needs a drawing library": ("depict",),
    }.items()
    for name in names
}


def validate(df: DataFrame, smiles: str = "smiles", max_atoms: int | None = None, max_rings: int | None = None, allowed: list[str] | None = None, stereo: bool = False) -> DataFrame:
    """df with is_valid, errors and warnings (arrays of text)."""
    if "mol" not in df.columns:
        df = M.with_molecules(df, smiles)
    none = F.lit(None).cast("string")
    when = lambda cond, text: F.when(cond, F.lit(text)).otherwise(none)
    ok = F.col("mol").isNotNull()
    errors = [when(~ok, "Failed to parse SMILES")]
    if max_atoms is not None:
        errors.append(when(ok & (F.size(m("z")) > max_atoms), f"Too many atoms (max {max_atoms})"))
    if max_rings is not None:
        errors.append(when(ok & (F.size(m("rings")) > max_rings), f"Too many rings (max {max_rings})"))
    if allowed is not None:
        outside = F.array_except(M.elements(), F.array(*map(F.lit, allowed)))
        errors.append(F.when(ok & (F.size(outside) > 0), F.concat(F.lit("Disallowed elements: "), F.array_join(outside, ","))))
    charge = M.total(m("charge"))
    warnings = [F.when(ok & (F.abs(charge) > 2), F.concat(F.lit("High charge: "), charge.cast("string")))]
    if stereo:
        n = F.size(undefined_centers())
        warnings.append(F.when(ok & (n > 0), F.concat(n.cast("string"), F.lit(" undefined stereocenters"))))
        n_bonds = F.size(undefined_double_bonds())
        warnings.append(F.when(ok & (n_bonds > 0), F.concat(n_bonds.cast("string"), F.lit(" undefined double bonds"))))
    out = df.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("warnings", F.array_compact(F.array(*warnings)))
    return out.withColumn("is_valid", F.size("errors") == 0)


def possible_centers() -> Column:
    """sp3 carbons with four neighbours, one hydrogen at most, whose heavy neighbours differ anywhere in the molecule."""

    def center(hashes: Column, i: Column) -> Column:
        near = F.get(m("near"), i)
        kind = F.transform(near, lambda j: F.get(hashes, j))
        return (M.z_at(i) == 6) & ~F.get(m("arom"), i) & (F.size(near) + F.get(m("h"), i) == 4) & (F.get(m("h"), i) <= 1) & (F.size(F.array_distinct(kind)) == F.size(near))

    return let(graphs.refined(), lambda h: M.atoms_where(lambda i: center(h, i)))


def undefined_centers() -> Column:
    return F.filter(possible_centers(), lambda i: F.get(m("chiral"), i) == 0)


def possible_double_bonds() -> Column:
    """Numbers of double bonds, not in small rings, with two different neighbours at each end, a hydrogen or lone pair being one."""

    def end(hashes: Column, i: Column, other: Column) -> Column:
        vs = F.filter(F.get(m("near"), i), lambda v: v != other)
        hidden = F.when(M.z_at(i) == 7, 1).otherwise(F.get(m("h"), i))
        return (F.size(vs) == 1) & (hidden == 1) | (F.size(vs) == 2) & (F.get(hashes, F.get(vs, F.lit(0))) != F.get(hashes, F.get(vs, F.lit(1))))

    def bond(hashes: Column, k: Column) -> Column:
        a, b = F.get(m("a"), k), F.get(m("b"), k)
        small = F.exists(m("rings"), lambda r: (F.size(r) < SMALLEST_RING) & F.array_contains(r, a) & F.array_contains(r, b))
        return (F.get(m("o"), k) == 2) & ~small & end(hashes, a, b) & end(hashes, b, a)

    numbers = F.transform(m("o"), lambda _, k: k)
    return let(graphs.refined(), lambda hashes: F.filter(numbers, lambda k: bond(hashes, k)))


def undefined_double_bonds() -> Column:
    return F.filter(possible_double_bonds(), lambda k: F.get(m("ez"), k) == 0)


def stereo_counts(df: DataFrame) -> DataFrame:
    """df with n_potential, n_specified and n_unspecified stereocenters."""
    specified = M.atoms_where(lambda i: F.get(m("chiral"), i) > 0)
    every = F.size(F.array_union(possible_centers(), specified))
    return df.withColumn("n_potential", every).withColumn("n_specified", F.size(specified)).withColumn("n_unspecified", every - F.size(specified))


def atoms(df: DataFrame, id_: str) -> DataFrame:
    """(id, i, z, arom, charge, h, degree, ring): a row an atom."""
    zipped = F.arrays_zip(*(m(f).alias(f) for f in ("z", "arom", "charge", "h", "near", "ring")))
    rows = df.where("mol is not null").select(F.col(id_).alias("id"), F.posexplode(zipped).alias("i", "x"))
    return rows.select("id", "i", "x.z", "x.arom", "x.charge", "x.h", F.size("x.near").alias("degree"), "x.ring")


def bonds(df: DataFrame, id_: str) -> DataFrame:
    """(id, a, b, o, inring): two rows a bond, one each way."""
    rows = df.where("mol is not null").select(F.col(id_).alias("id"), F.explode(M.bonds()).alias("x")).select("id", "x.*")
    return rows.unionByName(rows.select("id", F.col("b").alias("a"), F.col("a").alias("b"), "o", "inring"))


def places(pattern: S.Mol) -> Column:
    """All ways in which a pattern fits, each an array with the atom on which each pattern atom falls. Partial fits grow by one
    pattern bond a step, inside the row: to a neighbour that fits and is free, or, for a ring bond, by a test."""
    fits = lambda k, i: _fits(pattern, k, i)
    state = F.transform(M.atoms_where(lambda i: fits(0, i)), lambda i: F.array(i))
    at = {0: 0}
    for a, b, order, _ in _walk(pattern):
        state = _grown(state, at[a], at.get(b), order, lambda i, b=b: fits(b, i))
        at.setdefault(b, len(at))
    back = [at[k] for k in range(len(pattern.z))]
    if back == sorted(back):
        return state
    return F.transform(state, lambda p: F.array(*(F.get(p, F.lit(k)) for k in back)))


def _grown(state: Column, a: int, b: int | None, order: int, fits) -> Column:
    def bound(p: Column) -> Column:
        i = F.get(p, F.lit(a))
        near = F.arrays_zip(F.get(m("near"), i).alias("v"), F.get(m("order"), i).alias("o"))
        return F.filter(near, lambda x: x["o"] == order)

    if b is not None:
        return F.filter(state, lambda p: F.exists(bound(p), lambda x: x["v"] == F.get(p, F.lit(b))))
    free = lambda p: F.filter(bound(p), lambda x: ~F.array_contains(p, x["v"]) & fits(x["v"]))
    return F.flatten(F.transform(state, lambda p: F.transform(free(p), lambda x: F.concat(p, F.array(x["v"])))))


def matches(df: DataFrame, pattern: str, id_: str = "row_idx") -> DataFrame:
    """(id, atoms): one row for each set of atoms that matches the pattern, written as SMILES; * is any atom, a bracket's charge
    must be met, and the hydrogens of an atom with a map number at least."""
    found = F.array_distinct(F.transform(places(pattern_of(pattern)), lambda p: F.array_sort(p)))
    return df.where("mol is not null").select(F.col(id_).alias("id"), F.explode(found).alias("atoms"))


def pattern_of(text: str) -> S.Mol:
    try:
        return S.parse(text)
    except S.Invalid as e:
        raise ValueError(f"not a pattern: {text!r} ({e})") from None


def _fits(p: S.Mol, k: int, i: Column) -> Column:
    ok = F.lit(True) if p.z[k] == 0 else (M.z_at(i) == p.z[k]) & (F.get(m("arom"), i) == p.arom[k])
    if p.charge[k]:
        ok = ok & (F.get(m("charge"), i) == p.charge[k])
    if p.label[k] and p.z[k]:
        ok = ok & (F.get(m("h"), i) >= p.h[k])
    return ok


def _walk(p: S.Mol) -> list[tuple[int, int, int, int]]:
    """Pattern bonds in an order in which each starts at an atom that is placed already."""
    out, placed, left = [], {0}, list(range(len(p.bonds)))
    while left:
        k = next((k for k in left if p.bonds[k][0] in placed or p.bonds[k][1] in placed), None)
        if k is None:
            raise ValueError("a pattern is one connected piece")
        left.remove(k)
        a, b, order, _ = p.bonds[k]
        if a not in placed:
            a, b = b, a
        out.append((a, b, order, k))
        placed.add(b)
    if len(placed) < len(p.z):
        raise ValueError("a pattern is one connected piece")
    return out


def has_substructure(pattern: str) -> Column:
    """A condition on molecules. What a pattern needs in atoms is tested first."""
    p = pattern_of(pattern)
    could = reduce(Column.__and__, (F.size(F.filter(m("z"), _equals(z))) >= p.z.count(z) for z in sorted({z for z in p.z if z})), F.lit(True))
    return F.when(could, F.size(places(p)) > 0).otherwise(False)


def substructure(df: DataFrame, pattern: str, exclude: bool = False) -> DataFrame:
    """Rows of df that hold the pattern, or that don't; rows that are no molecules hold nothing and are dropped. A filter
    within each row: nothing is shuffled."""
    held = has_substructure(pattern)
    return df.where("mol is not null").where(~held if exclude else held)


def _equals(z: int):
    return lambda x: x == z


def functional_groups() -> dict[str, Column]:
    """Counts of functional groups, as conditions on an atom and its bonds. A group counts wherever it stands, also within a
    larger one: the OH of an acid is an alcohol, and an ester's oxygen is an ether."""
    z, h, arom, q = M.z_at, lambda i: F.get(m("h"), i), lambda i: F.get(m("arom"), i), lambda i: F.get(m("charge"), i)
    near = lambda i: F.arrays_zip(F.get(m("near"), i).alias("v"), F.get(m("order"), i).alias("o"))
    bound = lambda i, test: F.exists(near(i), lambda x: test(x["v"], x["o"]))
    times = lambda i, test: F.size(F.filter(near(i), lambda x: test(x["v"], x["o"])))
    around = lambda i: M.degree(i) + h(i)
    carbon = lambda v, o: z(v) == 6
    carbonyl = lambda i: (z(i) == 6) & ~arom(i) & (around(i) == 3) & bound(i, lambda v, o: (o == 2) & (z(v) == 8))
    amine = lambda i, k: (z(i) == 7) & ~arom(i) & (around(i) == 3) & (h(i) == 2 - k) & (times(i, carbon) >= k + 1)
    single = lambda v, o, k: (o == 1) & (z(v) == k)
    atom = lambda test: F.size(M.atoms_where(test))
    pairs = lambda a, b: F.aggregate(M.atoms_where(a), F.lit(0), lambda s, i: s + times(i, lambda v, o: (o == 1) & b(v)))
    hydroxyl = lambda k: lambda i: (z(i) == k) & ~arom(i) & (h(i) == 1) & (around(i) == 2)
    return {
        "n_alcohol": atom(hydroxyl(8)),
        "n_aldehyde": atom(lambda i: carbonyl(i) & (h(i) == 1) & bound(i, carbon)),
        "n_ketone": atom(lambda i: carbonyl(i) & (times(i, carbon) == 2)),
        "n_carboxylic_acid": pairs(carbonyl, hydroxyl(8)),
        "n_ester": pairs(lambda i: carbonyl(i) & bound(i, carbon), lambda v: (z(v) == 8) & ~arom(v) & (M.degree(v) == 2) & (times(v, carbon) == 2)),
        "n_ether": atom(lambda i: (z(i) == 8) & ~arom(i) & (times(i, carbon) == 2)),
        "n_amine_primary": atom(lambda i: amine(i, 0)),
        "n_amine_secondary": atom(lambda i: amine(i, 1)),
        "n_amine_tertiary": atom(lambda i: amine(i, 2)),
        "n_amide": pairs(lambda i: carbonyl(i) & bound(i, carbon), lambda v: (z(v) == 7) & ~arom(v) & (around(v) == 3)),
        "n_nitro": atom(lambda i: (z(i) == 7) & (times(i, lambda v, o: (o == 2) & (z(v) == 8)) >= 1) & ((times(i, lambda v, o: (o == 2) & (z(v) == 8)) == 2) | (q(i) == 1) & bound(i, lambda v, o: single(v, o, 8) & (q(v) == -1)))),
        "n_nitrile": atom(lambda i: (z(i) == 7) & (around(i) == 1) & bound(i, lambda v, o: (o == 3) & (z(v) == 6))),
        "n_halogen": atom(lambda i: z(i).isin(9, 17, 35, 53)),
        "n_thiol": atom(hydroxyl(16)),
        "n_sulfide": atom(lambda i: (z(i) == 16) & (around(i) == 2) & (times(i, carbon) == 2)),
        "n_aromatic_ring": M.count(m("rings"), lambda r: (F.size(r) == 6) & F.forall(r, arom)),
    }


def ring_info(df: DataFrame) -> DataFrame:
    """df with counts of rings by kind, and their sizes."""
    sizes = F.array_sort(F.transform(m("rings"), F.size))
    hetero = lambda r: F.exists(r, lambda i: M.z_at(i) != 6)
    arom = lambda r: F.forall(r, lambda i: F.get(m("arom"), i))
    return df.withColumns({
        "num_rings": F.size(m("rings")),
        "num_aromatic_rings": M.aromatic_rings(),
        "num_aliphatic_rings": F.size(m("rings")) - M.aromatic_rings(),
        "num_heterocycles": M.count(m("rings"), hetero),
        "num_aromatic_heterocycles": M.count(m("rings"), lambda r: hetero(r) & arom(r)),
        "num_spiro_atoms": F.size(M.spiro()),
        "num_bridgehead_atoms": F.size(M.bridgeheads()),
        "ring_sizes": F.array_join(F.transform(sizes, lambda s: s.cast("string")), ","),
        "largest_ring": F.coalesce(F.array_max(sizes), F.lit(0)),
        "smallest_ring": F.coalesce(F.array_min(sizes), F.lit(0)),
    })


def info(df: DataFrame) -> DataFrame:
    """df with formula, counts and Lipinski violations of each molecule."""
    d = {n: M.DESCRIPTORS[n][1]() for n in ("MolWt", "ExactMolWt", "HeavyAtomCount", "NumAtoms", "RingCount", "NumAromaticRings", "NumRotatableBonds", "NumHDonors", "NumHAcceptors", "TPSA", "MolLogP", "FormalCharge")}
    rounded = {n: F.round(c.cast("double"), 2) if n in ("MolWt", "ExactMolWt", "TPSA", "MolLogP") else c for n, c in d.items()}
    out = df.withColumns(rounded | {"formula": M.formula(), "elements": M.element_counts(), "num_bonds": F.size(m("a"))})
    broken = lambda c, top: (F.col(c) > top).cast("int")
    return out.withColumn("lipinski_violations", broken("MolWt", 500) + broken("MolLogP", 5) + broken("NumHDonors", 5) + broken("NumHAcceptors", 10))


FRAGMENT = pa.struct([("core", pa.string()), ("rgroup", pa.string()), ("core_heavy", pa.int32())])


def cuts(df: DataFrame, id_: str = "row_idx", smiles: str = "smiles") -> DataFrame:
    """(id, core, rgroup, core_heavy): two rows for each single bond outside rings between heavy atoms, one for either side as
    the core (Hussain and Rea 2010), equal ones once. * marks the cut. Repeated rows give repeated cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in M.sliced(batches):
            made = [_cut_rows(M.parsed(s)) for s in batch.column(smiles).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.list_(FRAGMENT))], ["id", "cuts"])

    source = df.select(F.col(id_).alias("id"), smiles)
    made = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, cuts array<struct<core:string,rgroup:string,core_heavy:int>>")
    return made.select("id", F.explode("cuts").alias("c")).select("id", "c.*")


def _cut_rows(mol: S.Mol | None) -> list[dict]:
    if mol is None:
        return []
    in_ring = {frozenset(p) for r in mol.rings for p in zip(r, r[1:] + r[:1], strict=True)}
    out = {}
    for a, b, order, _ in mol.bonds:
        if order == 1 and frozenset((a, b)) not in in_ring:
            side, todo = {a}, [a]
            while todo:
                u = todo.pop()
                for v, _k in mol.near[u]:
                    if v not in side and {u, v} != {a, b}:
                        side.add(v)
                        todo.append(v)
            if b in side:
                continue
            rest = [i for i in range(len(mol.z)) if i not in side]
            x, y = S.write(mol, sorted(side), {a: "(*)"}), S.write(mol, rest, {b: "(*)"})
            out |= {(x, y): len(side), (y, x): len(rest)}
    return [{"core": x, "rgroup": y, "core_heavy": n} for (x, y), n in out.items()]


def matched_pairs(fragments: DataFrame, min_core: int = 1) -> DataFrame:
    """(core, id_1, id_2, rgroup_1, rgroup_2, transformation) for molecules that share a core and differ in the rest: an
    equi-join on the core. Cores of one molecule only are dropped first, by partial sums."""
    rows = fragments.where(F.col("core_heavy") >= min_core)
    shared = rows.groupBy("core").agg((F.min("id") < F.max("id")).alias("s")).where("s").select("core")
    rows = rows.join(shared, "core", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.core") == F.col("b.core")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.rgroup") != F.col("b.rgroup")))
    return met.select(F.col("a.core").alias("core"), F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"), F.col("a.rgroup").alias("rgroup_1"), F.col("b.rgroup").alias("rgroup_2"), F.concat("a.rgroup", F.lit(">>"), "b.rgroup").alias("transformation"))


def transformation_counts(fragments: DataFrame, min_core: int = 1) -> DataFrame:
    """(transformation, count, percentage) over all matched pairs, most frequent first, without making the pairs: rows of one
    core and group are counted first, two groups of a core then meet once, and make as many pairs as the product of their
    numbers. Which of two molecules comes first has no say here: a transformation is named from the smaller text to the larger."""
    groups = fragments.where(F.col("core_heavy") >= min_core).groupBy("core", "rgroup").agg(F.count("*").alias("n"))
    shared = groups.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core")
    groups = groups.join(shared, "core", "left_semi")
    a, b = groups.alias("a"), groups.alias("b")
    met = a.join(b, (F.col("a.core") == F.col("b.core")) & (F.col("a.rgroup") < F.col("b.rgroup")))
    counts = met.groupBy(F.concat("a.rgroup", F.lit(">>"), "b.rgroup").alias("transformation")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("percentage", F.round(F.col("count") / F.col("_total") * 100, 2))
    return out.orderBy(F.desc("count"), "transformation").drop("_total")


def enumerate_products(reactants: list[DataFrame], product: Column, limit: int | None = 1000) -> DataFrame:
    """Distinct products over all combinations of reactant rows, the first `limit` in their order. The combinations are the
    feature; each table's rows are dealt to blocks and meet by equality, and the limit is a top-k by product."""
    from retort.operators.similarity import _blocks

    out = reactants[0]
    for right in reactants[1:]:
        out = _blocks(out, right, out.columns[0], right.columns[0])
    out = out.select(product.alias("product")).distinct()
    return out.orderBy("product").limit(limit) if limit else out


def neutral_state(kept: str | None = None) -> Column:
    """(charge, h) of all atoms, two arrays, once cations with hydrogens have lost them and anions of N, O, S or C have taken
    one for each charge. Charges beside an opposite one stay, as in a nitro group, and so do as many other anions, the first
    written, as there are cations without a hydrogen to lose. kept: a column of flags; only these atoms count."""
    q, h = lambda i: F.get(m("charge"), i), lambda i: F.get(m("h"), i)
    n = F.sequence(F.lit(0), F.size(m("z")) - 1)
    inside = F.filter(n, lambda i: F.get(kept, i)) if kept else n
    paired = lambda i: F.exists(F.get(m("near"), i), lambda j: q(j) * q(i) < 0)
    anions = F.filter(inside, lambda i: (q(i) < 0) & ~paired(i) & M.z_at(i).isin(6, 7, 8, 16))
    fixed = F.aggregate(F.filter(inside, lambda i: (q(i) > 0) & ~paired(i)), F.lit(0), lambda s, i: s + F.greatest(q(i) - h(i), F.lit(0)))
    free = let(F.struct(anions.alias("a"), fixed.alias("f")), lambda x: F.slice(x["a"], x["f"] + 1, F.size(x["a"])))

    def moved(takes: Column) -> Column:
        change = lambda i: F.when(F.array_contains(takes, i), -q(i)).when((q(i) > 0) & ~paired(i), -F.least(q(i), h(i))).otherwise(0)
        return F.struct(F.transform(n, lambda i: q(i) + change(i)).alias("charge"), F.transform(n, lambda i: h(i) + change(i)).alias("h"))

    return let(free, moved)


ELEMENTS_DEFAULT = [s for s in ("C", "H", "N", "O", "S", "F", "Cl", "Br", "I", "P") if s in NUMBER]
