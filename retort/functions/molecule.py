"""Molecule columns: a SMILES column becomes a struct column of flat arrays, and everything else is Column expressions.

with_molecules adds `mol`, null where the text is no molecule: per atom z, charge, h (hydrogens), iso, label, chiral, arom,
ring (in any), and by neighbours near and order (4: aromatic); per bond a, b, o, ez and inring (chiral, ez: see stereo.py); rings, as lists of atoms; and
logp and mr, per-atom contributions. It is the one step in Python; it runs in Arrow batches, once a row, and Catalyst prunes
and pushes around it as around any scan. Descriptors, filters, fingerprints and graph reductions read the arrays with
built-in higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions import smiles as S
from retort.functions.crippen import contributions
from retort.functions.elements import MASSES, SYMBOL

INTS, INTS2 = "array<int>", "array<array<int>>"
FIELDS = {
    "z": INTS, "charge": INTS, "h": INTS, "iso": INTS, "label": INTS, "chiral": INTS, "arom": "array<boolean>", "ring": "array<boolean>",
    "near": INTS2, "order": INTS2, "a": INTS, "b": INTS, "o": INTS, "ez": INTS, "inring": "array<boolean>", "rings": INTS2, "logp": "array<double>", "mr": "array<double>",
}
MOL_TYPE = f"struct<{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>"
_i, _ii, _b, _d = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.bool_()), pa.list_(pa.float64())
_ARROW = pa.struct([(k, {INTS: _i, INTS2: _ii, "array<boolean>": _b, "array<double>": _d}[v]) for k, v in FIELDS.items()])


def parsed(text: str | None) -> S.Mol | None:
    try:
        return S.parse(text) if text else None
    except (S.Invalid, RecursionError):
        return None


def as_row(m: S.Mol) -> dict:
    ring_bonds = {frozenset(p) for r in m.rings for p in zip(r, r[1:] + r[:1], strict=True)}
    in_ring = set().union(*map(set, m.rings)) if m.rings else set()
    logp, mr = contributions(m)
    return {
        "z": m.z, "charge": m.charge, "h": m.h, "iso": m.iso, "label": m.label, "chiral": m.chiral, "arom": m.arom, "ring": [i in in_ring for i in range(len(m.z))],
        "near": [[v for v, _ in x] for x in m.near], "order": [[m.bonds[b][2] for _, b in x] for x in m.near],
        "a": [b[0] for b in m.bonds], "b": [b[1] for b in m.bonds], "o": [b[2] for b in m.bonds], "ez": m.ez, "inring": [frozenset(b[:2]) in ring_bonds for b in m.bonds],
        "rings": m.rings, "logp": logp, "mr": mr,
    }


#: Rows that a Python step takes from an Arrow batch at a time; molecules as Python objects are large.
SLICE = 256


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, a few at a time, so that a step's memory does not grow with a partition's rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def each_text(df: DataFrame, made: Callable[[DataFrame], DataFrame], smiles: str = "smiles") -> DataFrame:
    """df joined with what made gives for its distinct texts: a table with smiles and other columns, for steps on which rows of one
    text agree. Texts are dealt to all cores, as there may be few bytes of them; rows without a text meet as others do. A text
    without rows in made has none in the result, one with several has each."""
    texts = df.select(smiles).distinct().repartition(df.sparkSession.sparkContext.defaultParallelism)
    found = made(texts)
    new = [c for c in found.columns if c != smiles]
    met = df.drop(*new).join(found.withColumnRenamed(smiles, "_text"), F.col(smiles).eqNullSafe(F.col("_text")))
    return met.select(*[c for c in df.columns if c not in new], *new)


def with_molecules(df: DataFrame, smiles: str = "smiles", canonical: str | None = None) -> DataFrame:
    """df with mol; canonical: also a column of that name with a SMILES that does not depend on how the row's was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            mols = [parsed(s) for s in batch.column(smiles).to_pylist()]
            columns = [*batch.columns, pa.array([as_row(m) if m else None for m in mols], _ARROW)]
            if canonical:
                columns.append(pa.array([S.write(m) if m else None for m in mols], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    df = df.drop("mol", *([canonical] if canonical else []))
    names = [*df.columns, "mol", *([canonical] if canonical else [])]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"mol {MOL_TYPE}", *([f"`{canonical}` string"] if canonical else [])])
    return df.mapInArrow(run, schema)


def m(field: str) -> Column:
    return F.col(f"mol.{field}")


def atoms_where(test) -> Column:
    """Numbers of the atoms for which test(i) holds."""
    return F.filter(F.sequence(F.lit(0), F.size(m("z")) - 1), test)


def count(xs: Column, test) -> Column:
    return F.size(F.filter(xs, test))


def total(xs: Column, zero: float | int = 0) -> Column:
    return F.aggregate(xs, F.lit(zero), lambda s, x: s + x)


def _table(value) -> Column:
    """A map literal from atomic number."""
    return F.create_map(*(F.lit(x) for z, s in SYMBOL.items() if z for x in (z, value(s))))


def z_at(i: Column) -> Column:
    return F.get(m("z"), i)


def h_count() -> Column:
    return total(m("h"))


def weight(exact: bool = False) -> Column:
    k = 2 if exact else 1
    masses = _table(lambda s: float(MASSES[s][k]))
    heavy = F.aggregate(F.zip_with(m("z"), m("iso"), lambda z, i: F.when(i > 0, i.cast("double")).otherwise(F.coalesce(F.element_at(masses, z), F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)
    return heavy + h_count() * MASSES["H"][k]


def formula() -> Column:
    """Carbon and hydrogen first, then by symbol; by symbol alone without carbon."""
    names = _table(str)
    symbols = F.transform(F.filter(m("z"), lambda z: z > 1), lambda z: F.element_at(names, z))
    hydrogens = h_count() + count(m("z"), lambda z: z == 1)
    has_c = F.exists(m("z"), lambda z: z == 6)
    counts = F.transform(F.array_distinct(symbols), lambda s: F.struct(F.when(has_c & (s == "C"), "").otherwise(s).alias("k"), s.alias("s"), count(symbols, lambda t: t == s).alias("n")))
    h = F.when(hydrogens > 0, F.array(F.struct(F.when(has_c, " ").otherwise("H").alias("k"), F.lit("H").alias("s"), hydrogens.alias("n")))).otherwise(F.array().cast("array<struct<k:string,s:string,n:int>>"))
    text = F.array_join(F.transform(F.array_sort(F.concat(counts, h)), lambda x: F.concat(x["s"], F.when(x["n"] > 1, x["n"].cast("string")).otherwise(""))), "")
    q = total(m("charge"))
    size = F.when(F.abs(q) > 1, F.abs(q).cast("string")).otherwise("")
    return F.concat(text, F.when(q > 0, F.concat(F.lit("+"), size)).when(q < 0, F.concat(F.lit("-"), size)).otherwise(""))


def element_counts() -> Column:
    """symbol -> atoms, hydrogens included."""
    names = _table(str)
    symbols = F.transform(F.filter(m("z"), lambda z: z > 1), lambda z: F.element_at(names, z))
    pairs = F.transform(F.array_sort(F.array_distinct(symbols)), lambda s: F.struct(s.alias("k"), count(symbols, lambda t: t == s).alias("v")))
    h = F.when(h_count() > 0, F.array(F.struct(F.lit("H").alias("k"), h_count().alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:int>>"))
    return F.map_from_entries(F.concat(pairs, h))


def elements() -> Column:
    """Distinct symbols of heavy atoms."""
    names = _table(str)
    return F.array_sort(F.array_distinct(F.transform(F.filter(m("z"), lambda z: z > 1), lambda z: F.element_at(names, z))))


def bonds() -> Column:
    """Bonds as structs (a, b, o, inring)."""
    return F.arrays_zip(m("a").alias("a"), m("b").alias("b"), m("o").alias("o"), m("inring").alias("inring"))


def degree(i: Column) -> Column:
    return F.size(F.get(m("near"), i))


def has_order(i: Column, o: int) -> Column:
    return F.exists(F.get(m("order"), i), lambda x: x == o)


#: Ertl's polar contributions (2000), by element, hydrogens, charge, and numbers of single, double, triple and
#: aromatic bonds; r marks an atom of a three-membered ring.
POLAR = {
    "N 0 0 3000": 3.24, "N 0 0 1100": 12.36, "N 0 0 0010": 23.79, "N 0 0 1200": 11.68, "N 0 0 0110": 13.60, "N 0 0 3000r": 3.01,
    "N 1 0 2000": 12.03, "N 1 0 2000r": 21.94, "N 1 0 0100": 23.85, "N 2 0 1000": 26.02, "N 0 1 4000": 0.0, "N 0 1 2100": 3.01,
    "N 0 1 1010": 4.36, "N 1 1 3000": 4.44, "N 1 1 1100": 13.97, "N 2 1 2000": 16.61, "N 2 1 0100": 25.59, "N 3 1 1000": 27.64,
    "N 0 0 0002": 12.89, "N 0 0 0003": 4.41, "N 0 0 1002": 4.93, "N 0 0 0102": 8.39, "N 1 0 0002": 15.79, "N 0 1 0003": 4.10,
    "N 0 1 1002": 3.88, "N 1 1 0002": 14.14,
    "O 0 0 2000": 9.23, "O 0 0 2000r": 12.53, "O 0 0 0100": 17.07, "O 1 0 1000": 20.23, "O 0 -1 1000": 23.06, "O 0 0 0002": 13.14,
}


def tpsa() -> Column:
    table = F.create_map(*(F.lit(x) for kv in POLAR.items() for x in kv))
    n = lambda i, o: count(F.get(m("order"), i), lambda x: x == o).cast("string")
    small = lambda i: F.when(F.exists(m("rings"), lambda r: (F.size(r) == 3) & F.array_contains(r, i)), "r").otherwise("")

    def key(i: Column) -> Column:
        base = F.concat(F.when(z_at(i) == 7, "N ").otherwise("O "), F.get(m("h"), i).cast("string"), F.lit(" "), F.get(m("charge"), i).cast("string"), F.lit(" "), n(i, 1), n(i, 2), n(i, 3), n(i, 4))
        return F.concat(base, small(i))

    # what the table lacks falls back to Ertl's general formula, at least 0
    general = lambda i: F.greatest(F.lit(0.0), F.when(z_at(i) == 7, 30.5 - 8.2 * degree(i) + 1.5 * F.get(m("h"), i)).otherwise(28.5 - 8.6 * degree(i) + 1.5 * F.get(m("h"), i)))
    polar = atoms_where(lambda i: z_at(i).isin(7, 8))
    return F.aggregate(F.transform(polar, lambda i: F.coalesce(F.element_at(table, key(i)), general(i))), F.lit(0.0), lambda s, x: s + x)


def hbond_donors() -> Column:
    """N with hydrogens, O and S with one."""
    h = lambda i: F.get(m("h"), i)
    return F.size(atoms_where(lambda i: (z_at(i) == 7) & (h(i) > 0) | z_at(i).isin(8, 16) & (h(i) == 1) & (F.get(m("charge"), i) == 0)))


def valence(i: Column) -> Column:
    """Sum of bond orders and hydrogens of an atom without aromatic bonds."""
    return F.aggregate(F.get(m("order"), i), F.get(m("h"), i), lambda s, o: s + o)


def double_to_hetero(j: Column, outside_rings: bool = False) -> Column:
    """Atom j has a double bond to O, N, P or S."""

    def ends(x: Column) -> Column:
        ok = (x["o"] == 2) & ((x["a"] == j) & z_at(x["b"]).isin(7, 8, 15, 16) | (x["b"] == j) & z_at(x["a"]).isin(7, 8, 15, 16))
        return ok & ~x["inring"] if outside_rings else ok

    return F.exists(bonds(), ends)


def hbond_acceptors() -> Column:
    """O and S of two bonds, but no OH or SH beside a double bond to a hetero atom; anions; neutral N of three bonds, but no
    amide-like one; aromatic n without hydrogen, o and s."""

    def accepts(i: Column) -> Column:
        z, h, q, arom = z_at(i), F.get(m("h"), i), F.get(m("charge"), i), F.get(m("arom"), i)
        near = F.get(m("near"), i)
        chalcogen = z.isin(8, 16) & ~arom & ((q < 0) | (valence(i) == 2) & ((h == 0) | (h == 1) & ~F.exists(near, lambda j: double_to_hetero(j))))
        nitrogen = (z == 7) & ~arom & (q == 0) & (valence(i) == 3) & ~F.exists(near, lambda j: double_to_hetero(j, True))
        aromatic = arom & (q == 0) & (z.isin(8, 16) | (z == 7) & (h == 0))
        return chalcogen | nitrogen | aromatic

    return F.size(atoms_where(accepts))


def rotatable() -> Column:
    """Single bonds outside rings between atoms with other heavy neighbours, but those beside a triple bond, those of acyl
    groups to N, O or S, and those to a carbon with three equal ends (CF3, CCl3, CBr3, C(CH3)3)."""
    acyl = lambda c, x: (z_at(c) == 6) & (degree(c) == 3) & z_at(x).isin(7, 8, 16) & double_to_hetero(c)

    def capped(c: Column) -> Column:
        ends = F.transform(F.filter(F.get(m("near"), c), lambda v: degree(v) == 1), z_at)
        return (z_at(c) == 6) & F.exists(F.array(*map(F.lit, (6, 9, 17, 35))), lambda z: F.size(F.filter(ends, lambda e: e == z)) == 3)

    def free(x: Column) -> Column:
        a, b = x["a"], x["b"]
        return (x["o"] == 1) & ~x["inring"] & (degree(a) > 1) & (degree(b) > 1) & ~has_order(a, 3) & ~has_order(b, 3) & ~acyl(a, b) & ~acyl(b, a) & ~capped(a) & ~capped(b)

    return count(bonds(), free)


def aromatic_rings() -> Column:
    return count(m("rings"), lambda r: F.forall(r, lambda i: F.get(m("arom"), i)))


DESCRIPTORS: dict[str, tuple[str, object]] = {
    "MolWt": ("molecular", weight),
    "ExactMolWt": ("molecular", lambda: weight(True)),
    "HeavyAtomCount": ("constitutional", lambda: count(m("z"), lambda z: z > 1)),
    "NumAtoms": ("constitutional", lambda: F.size(m("z"))),
    "NumHAcceptors": ("constitutional", hbond_acceptors),
    "NumHDonors": ("constitutional", hbond_donors),
    "NumRotatableBonds": ("constitutional", rotatable),
    "NumHeteroatoms": ("constitutional", lambda: count(m("z"), lambda z: ~z.isin(1, 6))),
    "NumAromaticRings": ("constitutional", aromatic_rings),
    "NumAliphaticRings": ("constitutional", lambda: F.size(m("rings")) - aromatic_rings()),
    "RingCount": ("constitutional", lambda: F.size(m("rings"))),
    "FormalCharge": ("electronic", lambda: total(m("charge"))),
    "TPSA": ("topological", tpsa),
    "MolLogP": ("electronic", lambda: total(m("logp"), 0.0)),
    "MolMR": ("electronic", lambda: total(m("mr"), 0.0)),
    "FractionCSP3": ("constitutional", lambda: F.coalesce(F.size(atoms_where(lambda i: (z_at(i) == 6) & (degree(i) + F.get(m("h"), i) == 4))) / F.nullif(count(m("z"), lambda z: z == 6), F.lit(0)), F.lit(0.0))),
    "NumHeavyAtoms": ("constitutional", lambda: count(m("z"), lambda z: z > 1)),
    "NumRings": ("constitutional", lambda: F.size(m("rings"))),
    "LogP": ("electronic", lambda: total(m("logp"), 0.0)),
    "NumFragments": ("constitutional", lambda: F.size(m("z")) - F.size(m("a")) + F.size(m("rings"))),
    "NumBridgeheadAtoms": ("topological", lambda: F.size(bridgeheads())),
    "NumSpiroAtoms": ("topological", lambda: F.size(spiro())),
}
COMMON = ("MolWt", "ExactMolWt", "HeavyAtomCount", "NumHAcceptors", "NumHDonors", "NumRotatableBonds", "NumHeteroatoms", "NumAromaticRings", "RingCount", "TPSA", "MolLogP", "MolMR", "FractionCSP3")
LIPINSKI = ("MolWt", "MolLogP", "NumHDonors", "NumHAcceptors")
DRUGLIKE = ("MolWt", "MolLogP", "NumHDonors", "NumHAcceptors", "TPSA", "NumRotatableBonds", "RingCount", "FractionCSP3")


def spiro() -> Column:
    """Atoms that are all that two rings share."""
    pairs = F.flatten(F.transform(m("rings"), lambda r, i: F.transform(F.slice(m("rings"), i + 2, F.size(m("rings"))), lambda q: F.array_intersect(r, q))))
    return F.array_distinct(F.flatten(F.filter(pairs, lambda x: F.size(x) == 1)))


def bridgeheads() -> Column:
    """Ends of what two rings share, if that is three atoms or more."""
    pairs = F.flatten(F.transform(m("rings"), lambda r, i: F.transform(F.slice(m("rings"), i + 2, F.size(m("rings"))), lambda q: F.array_intersect(r, q))))
    wide = F.filter(pairs, lambda x: F.size(x) > 2)
    ends = F.transform(wide, lambda x: F.filter(x, lambda i: F.size(F.array_intersect(F.get(m("near"), i), x)) == 1))
    return F.array_distinct(F.flatten(ends))


def described() -> dict[str, tuple[str, Callable[[], Column], tuple[str, ...]]]:
    """name: (category, expression, shared columns that it reads) of all descriptors."""
    from retort.functions import topology

    return {n: (c, f, ()) for n, (c, f) in DESCRIPTORS.items()} | topology.described()


def chosen(names: tuple[str, ...] | None = None, category: str | None = None, exclude: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Names of descriptors: those given, or all of a category, or all, less exclude. Unknown names are an error."""
    known = described()
    unknown = [n for n in (*(names or ()), *exclude) if n not in known]
    if unknown:
        raise ValueError(f"unknown descriptors: {', '.join(unknown)}")
    kinds = {c for c, _, _ in known.values()}
    if category is not None and category not in kinds:
        raise ValueError(f"unknown category: {category}; known: {', '.join(sorted(kinds))}")
    return tuple(n for n in names or known if n not in exclude and category in (None, known[n][0]))


def descriptors(df: DataFrame, names: tuple[str, ...] | None = COMMON, precision: int | None = 4, category: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """df (with mol) and one column a descriptor; null where mol is. names None: all, or all of category."""
    from retort.functions import topology

    known, wanted = described(), chosen(names, category, exclude)
    shared = [c for c in topology.STEPS if any(c in known[n][2] for n in wanted)]
    for c in shared:
        df = df.withColumn(c, F.when(F.col("mol").isNotNull(), topology.STEPS[c]()))
    made = {}
    for n in wanted:
        c = F.when(F.col("mol").isNotNull(), known[n][1]()).cast("double")
        made[n] = c if precision is None else F.round(c, precision)
    return df.withColumns(made).drop(*shared)


def registry(spark, category: str | None = None) -> DataFrame:
    rows = sorted((n, c) for n, (c, _, _) in described().items() if category in (None, c))
    return spark.createDataFrame(rows, "name string, category string")
