"""Operators whose result is new molecules: conversion, standardization, scaffolds, ring systems, fragments, transformations
and reactions.

What to keep or cut is found with Column expressions, as lists of atom numbers; one small Arrow step writes the text of
given atom lists. Joining pieces is text: a cut end (*) becomes a ring bond number that both pieces share, which any SMILES
reader closes to a bond, so products are made by joins and concatenation and then read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions import graphs
from retort.functions import molecule as M
from retort.functions import smiles as S
from retort.functions.expr import let
from retort.functions.molecule import m
from retort.operators import molecules

END = "(*)"
JOINT = "%99"


def written(df: DataFrame, parts: str, out: str, smiles: str = "smiles", ends: str | None = None, state: str | None = None, generic: bool = False, marks: bool = True) -> DataFrame:
    """df with out: the SMILES of each atom list in the column parts (array of arrays), read from smiles. ends: a column with,
    for each list, the atoms that get a cut end. state: a column (charge, h) of all atoms, where these are not as read,
    or (chiral, ez) of all atoms and bonds.
    generic: with all atoms as carbon and all bonds single. marks: with stereo marks. Arrays of molecules are not sent to Python, so mol is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in M.sliced(batches):
            texts = []
            given = [batch.column(c).to_pylist() if c else [None] * batch.num_rows for c in (ends, state)]
            for s, lists, marked, changed in zip(batch.column(smiles).to_pylist(), batch.column(parts).to_pylist(), *given, strict=True):
                mol = M.parsed(s) if lists else None
                if mol and changed:
                    for field, values in changed.items():
                        setattr(mol, field, values)
                mol = S.generic(mol) if mol and generic else mol
                marked = marked or [[]] * len(lists or [])
                texts.append([S.write(mol, x, dict.fromkeys(y, END), marks) if x else "" for x, y in zip(lists, marked, strict=True)] if mol else [] if lists is not None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.list_(pa.string()))], names)

    df = df.drop(out, "mol")
    names = [*df.columns, out]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{out}` array<string>"])
    return df.mapInArrow(run, schema)


def flagged(flags: Column) -> Column:
    """Numbers of the atoms with a true flag."""
    return F.transform(F.filter(F.transform(flags, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: x["k"]), lambda x: x["i"])


def convert(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Valid rows with their canonical SMILES in place of what was read."""
    read = lambda texts: M.with_molecules(texts, smiles, "canonical").where("mol is not null").drop("mol")
    return M.each_text(df.drop("mol", "canonical"), read, smiles).withColumn(smiles, F.col("canonical")).drop("canonical")


def scaffolds(df: DataFrame, smiles: str = "smiles", generic: bool = False) -> DataFrame:
    """df (with mol, which is dropped) with scaffold, its SMILES, "" if acyclic; generic: also with generic_scaffold, in which
    all atoms are carbon and all bonds single."""
    flags = graphs.framework(df, "_fw").withColumn("_parts", F.array(flagged(F.col("_fw"))))
    out = written(flags, "_parts", "_text", smiles).withColumn("scaffold", F.get("_text", F.lit(0)))
    if generic:
        out = written(out, "_parts", "_text", smiles, generic=True).withColumn("generic_scaffold", F.get("_text", F.lit(0)))
    return out.drop("_fw", "_parts", "_text")


def side_chains(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """df (with mol) with side_chains: the text of each piece that the framework leaves, with its cut end."""
    n = F.sequence(F.lit(0), F.size(m("z")) - 1)
    steps = F.sequence(F.lit(1), F.greatest(F.size(m("z")), F.lit(1)))
    rows = graphs.framework(df, "_fw")

    def pieces(fw: Column) -> Column:
        out = lambda i: ~F.get(fw, i)
        spread = F.aggregate(steps, n, lambda c, _: F.transform(c, lambda own, i: F.when(out(i), F.least(own, F.coalesce(F.array_min(F.transform(F.filter(F.get(m("near"), i), out), lambda j: F.get(c, j))), own))).otherwise(own)))
        return let(spread, lambda c: F.transform(F.array_sort(F.array_distinct(F.filter(c, lambda x, i: out(i)))), lambda k: F.filter(n, lambda i: out(i) & (F.get(c, i) == k))))

    rows = rows.withColumn("_parts", F.when(F.exists("_fw", lambda k: k), let(F.col("_fw"), pieces)).otherwise(F.array().cast("array<array<int>>")))
    ends = F.transform("_parts", lambda p: F.filter(p, lambda i: F.exists(F.get(m("near"), i), lambda j: F.get(F.col("_fw"), j))))
    return written(rows.withColumn("_ends", ends), "_parts", "side_chains", smiles, "_ends").drop("_fw", "_parts", "_ends")


def neutralize(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """df (with mol, which is dropped) with neutralized: the molecule without the charges that taking or giving a hydrogen removes (see
    molecules.neutral_state), canonical; null where smiles is no molecule."""
    every = F.array(F.sequence(F.lit(0), F.size(m("z")) - 1))
    rows = df.withColumn("_parts", F.when(F.col("mol").isNotNull(), every)).withColumn("_state", F.when(F.col("mol").isNotNull(), molecules.neutral_state()))
    return written(rows, "_parts", "_text", smiles, state="_state").withColumn("neutralized", F.get("_text", F.lit(0))).drop("_parts", "_state", "_text")


def standardize(df: DataFrame, smiles: str = "smiles", neutralize: bool = True, stereo: bool = False) -> DataFrame:
    """df with standardized: the largest fragment, without the charges that taking or giving a hydrogen removes, canonical and
    without stereo marks, or with them. Null where smiles is no molecule."""
    df = M.with_molecules(df, smiles) if "mol" not in df.columns else df
    ok = F.col("mol").isNotNull()
    rows = graphs.largest_fragment(df, "_big").withColumn("_parts", F.when(ok, F.array(flagged(F.col("_big")))))
    if not neutralize:
        return written(rows, "_parts", "_text", smiles, marks=stereo).withColumn("standardized", F.get("_text", F.lit(0))).drop("_big", "_parts", "_text")
    # only the kept fragment's charges count
    rows = rows.withColumn("_state", F.when(ok, molecules.neutral_state("_big")))
    return written(rows, "_parts", "_text", smiles, state="_state", marks=stereo).withColumn("standardized", F.get("_text", F.lit(0))).drop("_big", "_parts", "_text", "_state")


def ring_systems(df: DataFrame, id_: str = "row_idx", smiles: str = "smiles") -> DataFrame:
    """(id, ring_system, ring_type, ring_size, num_rings, is_aromatic): a row for each group of rings that share atoms. Groups
    grow by lists of rings that meet; the type is simple, fused (a bond shared), spiro (one atom) or bridged (more)."""

    def merge(groups: Column, ring: Column) -> Column:
        touches = lambda g: F.arrays_overlap(g, ring)
        joined = F.array_distinct(F.concat(ring, F.flatten(F.filter(groups, touches))))
        return F.concat(F.filter(groups, lambda g: ~touches(g)), F.array(joined))

    groups = F.aggregate(m("rings"), F.array().cast("array<array<int>>"), merge)

    def described(atoms: Column) -> Column:
        inside = F.filter(m("rings"), lambda r: F.arrays_overlap(r, atoms))
        shared = F.flatten(F.transform(inside, lambda r, i: F.transform(F.slice(inside, i + 2, F.size(inside)), lambda q: F.size(F.array_intersect(r, q)))))
        kind = F.when(F.size(inside) == 1, "simple").when(F.exists(shared, lambda n: n > 2), "bridged").when(F.exists(shared, lambda n: n == 2), "fused").otherwise("spiro")
        aromatic = F.forall(atoms, lambda i: F.get(m("arom"), i))
        return F.struct(kind.alias("kind"), F.size(atoms).alias("size"), F.size(inside).alias("rings"), aromatic.alias("aromatic"))

    rows = df.where("mol is not null").withColumn("_parts", groups).withColumn("_kinds", F.transform("_parts", described))
    rows = written(rows.select(F.col(id_).alias("id"), smiles, "_parts", "_kinds"), "_parts", "_text", smiles)
    rows = rows.select("id", F.explode(F.arrays_zip(F.col("_kinds").alias("k"), F.col("_text").alias("text"))).alias("g"))
    return rows.select("id", F.col("g.text").alias("ring_system"), F.col("g.k.kind").alias("ring_type"), F.col("g.k.size").alias("ring_size"), F.col("g.k.rings").alias("num_rings"), F.col("g.k.aromatic").alias("is_aromatic"))


def retrosynthetic_bonds() -> Column:
    """Bonds that combinatorial chemistry makes (Lewell and others 1998): amide, ester, urea, amine, ether, olefin, sulfonamide,
    aromatic nitrogen to carbon, and between two aromatic rings; none in a ring or to an end of one atom but oxygen's."""
    z, arom, deg = M.z_at, lambda i: F.get(m("arom"), i), M.degree
    acyl = lambda i: (z(i) == 6) & ~arom(i) & M.double_to_hetero(i)

    def one_way(a: Column, b: Column) -> Column:
        amide_ester = acyl(a) & z(b).isin(7, 8) & ~arom(b) & (deg(b) > 1)
        amine = (z(a) == 6) & ~acyl(a) & (z(b) == 7) & ~arom(b) & (deg(b) > 1) & ~F.exists(F.get(m("near"), b), acyl) & (deg(a) > 1)
        ether = (z(a) == 6) & ~acyl(a) & (z(b) == 8) & ~arom(b) & (deg(b) == 2) & ~F.exists(F.get(m("near"), b), acyl) & (deg(a) > 1)
        sulfonamide = (z(a) == 16) & (deg(a) == 4) & (z(b) == 7)
        aromatic_n = arom(a) & (z(a) == 7) & (z(b) == 6) & ~arom(b) & (deg(b) > 1)
        return amide_ester | amine | ether | sulfonamide | aromatic_n

    def cut(x: Column) -> Column:
        a, b = x["a"], x["b"]
        biaryl = arom(a) & arom(b)
        olefin = (x["o"] == 2) & (z(a) == 6) & (z(b) == 6) & (deg(a) > 1) & (deg(b) > 1)
        return ~x["inring"] & ((x["o"] == 1) & (one_way(a, b) | one_way(b, a) | biaryl) | olefin)

    return F.transform(F.filter(M.bonds(), cut), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))


def fragments(df: DataFrame, id_: str = "row_idx", smiles: str = "smiles", min_size: int = 1) -> DataFrame:
    """(id, fragment_smiles, fragment_idx, heavy_atom_count): the pieces once all retrosynthetic bonds are cut."""
    rows = df.where("mol is not null").withColumn("_cuts", retrosynthetic_bonds())
    n = F.sequence(F.lit(0), F.size(m("z")) - 1)
    steps = F.sequence(F.lit(1), F.greatest(F.size(m("z")), F.lit(1)))

    def pieces(cuts: Column) -> Column:
        apart = lambda i, j: F.exists(cuts, lambda c: (c["a"] == i) & (c["b"] == j) | (c["a"] == j) & (c["b"] == i))
        kept = F.transform(n, lambda i: F.filter(F.get(m("near"), i), lambda j: ~apart(i, j)))
        spread = lambda near: F.aggregate(steps, n, lambda c, _: F.transform(c, lambda own, i: F.least(own, F.coalesce(F.array_min(F.transform(F.get(near, i), lambda j: F.get(c, j))), own))))
        lists = lambda part: F.transform(F.array_sort(F.array_distinct(part)), lambda p: F.filter(n, lambda i: F.get(part, i) == p))
        return let(let(kept, spread), lists)

    rows = rows.withColumn("_parts", let(F.col("_cuts"), pieces))
    ends = F.transform("_parts", lambda p: F.array_distinct(F.flatten(F.transform("_cuts", lambda c: F.filter(F.array(c["a"], c["b"]), lambda i: F.array_contains(p, i))))))
    rows = written(rows.withColumn("_ends", ends), "_parts", "_text", smiles, "_ends")
    out = rows.select(F.col(id_).alias("id"), F.posexplode(F.arrays_zip(F.col("_text").alias("t"), F.transform("_parts", F.size).alias("n"))).alias("fragment_idx", "x"))
    return out.select("id", F.col("x.t").alias("fragment_smiles"), "fragment_idx", F.col("x.n").alias("heavy_atom_count")).where(F.col("heavy_atom_count") >= min_size)


def joined(a: Column, b: Column) -> Column:
    """The SMILES text of two pieces with a cut end each, bonded."""
    return F.concat(F.replace(a, F.lit(END), F.lit(JOINT)), F.lit("."), F.replace(b, F.lit(END), F.lit(JOINT)))


def transformed(cut_rows: DataFrame, transformation: str) -> DataFrame:
    """(id, product): molecules of cut_rows (see molecules.cuts) in which the one group is replaced by the other, for a text
    such as "C(*)>>O(*)". Groups are compared by their canonical text."""
    old, new = transformation.split(">>")
    made = cut_rows.where(F.col("rgroup") == old).select("id", joined(F.col("core"), F.lit(new)).alias("smiles"))
    read = lambda texts: M.with_molecules(texts, "smiles", "product").where("product is not null").drop("mol")
    return M.each_text(made, read).select("id", "product").distinct()


def recombined(pieces: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Distinct molecules of two pieces with one cut end each, the first `limit` by text. The combinations are the feature;
    pieces meet in blocks."""
    from retort.operators.similarity import _blocks

    ends = pieces.where(F.col("fragment_smiles").contains(END)).where((F.length("fragment_smiles") - F.length(F.replace("fragment_smiles", F.lit(END), F.lit("")))) == len(END)).select(F.col("fragment_smiles").alias("x")).distinct()
    both = _blocks(ends, ends.select(F.col("x").alias("y")), "x", "y").where("x <= y")
    made = M.with_molecules(both.select(joined(F.col("x"), F.col("y")).alias("smiles")), "smiles", "product").where("product is not null").select("product").distinct()
    return made.orderBy("product").limit(limit) if limit else made


def atom_map(df: DataFrame, reaction: str = "reaction", id_: str = "row_idx") -> DataFrame:
    """(id, map_num, reactant_idx, product_idx, symbol) of reactions written as reactants>>products, by map numbers: a join of
    the two sides' atoms."""
    sides = F.split(reaction, ">>")

    def side(k: int, idx: str) -> DataFrame:
        rows = M.with_molecules(df.select(F.col(id_).alias("id"), F.get(sides, F.lit(k)).alias("smiles"))).where("mol is not null")
        each = rows.select("id", F.posexplode(F.arrays_zip(m("label").alias("n"), m("z").alias("z"))).alias(idx, "x")).where("x.n > 0")
        return each.select("id", F.col("x.n").alias("map_num"), idx, F.col("x.z").alias("z"))

    names = F.create_map(*(F.lit(v) for z, s in M.SYMBOL.items() for v in (z, s)))
    out = side(0, "reactant_idx").join(side(1, "product_idx").drop("z"), ["id", "map_num"])
    return out.select("id", "map_num", "reactant_idx", "product_idx", F.element_at(names, F.col("z")).alias("symbol"))


def reaction_fingerprints(df: DataFrame, reaction: str = "reaction", id_: str = "row_idx", radius: int = 1, n_bits: int = 2048) -> DataFrame:
    """(id, difference): circular counts of the products less those of the reactants, without zeros."""
    sides = F.split(reaction, ">>")
    one = lambda k, name: graphs.circular(M.with_molecules(df.select(F.col(id_).alias("id"), F.get(sides, F.lit(k)).alias("smiles"))), radius, n_bits, name, True).where("mol is not null").select("id", name)
    both = one(0, "r").join(one(1, "p"), "id")
    change = F.map_zip_with("p", "r", lambda _, p, r: F.coalesce(p, F.lit(0)) - F.coalesce(r, F.lit(0)))
    return both.select("id", F.map_filter(change, lambda _, v: v != 0).alias("difference"))


def crippen_atoms(df: DataFrame) -> DataFrame:
    """df with per-atom logP and MR (4 decimals) and their totals, sums of the rounded values."""
    out = df.withColumn("logp_atoms", F.transform(m("logp"), lambda x: F.round(x, 4))).withColumn("mr_atoms", F.transform(m("mr"), lambda x: F.round(x, 4)))
    return out.withColumn("logp_total", F.round(M.total(F.col("logp_atoms"), 0.0), 4)).withColumn("mr_total", F.round(M.total(F.col("mr_atoms"), 0.0), 4))


#: Electronegativity a + b q + c q^2 by element and hybridization (Gasteiger and Marsili 1980).
PEOE = {
    "H": (7.17, 6.24, -0.56), "C3": (7.98, 9.18, 1.88), "C2": (8.79, 9.32, 1.51), "C1": (10.39, 9.45, 0.73), "N3": (11.54, 10.82, 1.36),
    "N2": (12.87, 11.15, 0.85), "N1": (15.68, 11.70, -0.27), "O3": (14.18, 12.92, 1.39), "O2": (17.07, 13.79, 0.47), "F": (14.66, 13.85, 2.31),
    "Cl": (11.00, 9.69, 1.35), "Br": (10.08, 8.47, 1.16), "I": (9.90, 7.96, 0.96), "S": (10.14, 9.13, 1.38),
}


def charge_states(rounds: int) -> Column:
    """Of each heavy atom its charge q, null without parameters, and that of each of its hydrogens, h. Charge flows along bonds to
    the more electronegative end, damped by half each round. Aromatic atoms count as doubly bonded."""
    z, table = M.z_at, F.create_map(*(F.lit(v) for k, x in PEOE.items() for v in (k, list(x))))
    kinds = {6: "C", 7: "N", 8: "O", 9: "F", 17: "Cl", 35: "Br", 53: "I", 16: "S"}
    names = F.create_map(*(F.lit(v) for kv in kinds.items() for v in kv))

    def kind(i: Column) -> Column:
        most = F.coalesce(F.array_max(F.transform(F.get(m("order"), i), lambda o: F.when(o == 4, 2).otherwise(o))), F.lit(1))
        hyb = F.when(z(i) == 8, F.when(most >= 2, "2").otherwise("3")).when(z(i).isin(6, 7), (4 - most).cast("string")).otherwise("")
        return F.concat(F.element_at(names, z(i)), hyb)

    n = F.sequence(F.lit(0), F.size(m("z")) - 1)
    state = F.transform(n, lambda i: F.struct(F.try_element_at(table, kind(i)).alias("p"), F.get(m("charge"), i).cast("double").alias("q"), F.lit(0.0).alias("h")))
    p_h = F.array(*map(F.lit, PEOE["H"]))
    chi = lambda p, q: F.get(p, F.lit(0)) + F.get(p, F.lit(1)) * q + F.get(p, F.lit(2)) * q * q
    full = lambda p: F.get(p, F.lit(0)) + F.get(p, F.lit(1)) + F.get(p, F.lit(2))

    def flow(s: Column, k: Column) -> Column:
        damp = F.pow(F.lit(0.5), k)

        def between(a: Column, b: Column) -> Column:
            """What a gets from b."""
            x, y = chi(a["p"], a["q"]), chi(b["p"], b["q"])
            return (y - x) / F.when(y > x, full(a["p"])).otherwise(full(b["p"]))

        def one(a: Column, i: Column) -> Column:
            heavy = F.aggregate(F.transform(F.get(m("near"), i), lambda j: between(a, F.get(s, j))), F.lit(0.0), lambda t, v: t + v)
            from_h = let(F.struct(chi(a["p"], a["q"]).alias("x"), chi(p_h, a["h"]).alias("y")), lambda e: (e["y"] - e["x"]) / F.when(e["y"] > e["x"], full(a["p"])).otherwise(F.lit(20.02)))
            count = F.get(m("h"), i)
            return F.struct(a["p"].alias("p"), (a["q"] + damp * (heavy + count * from_h)).alias("q"), (a["h"] - F.when(count > 0, damp * from_h).otherwise(0.0)).alias("h"))

        return F.transform(s, one)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, flow)


def partial_charges(df: DataFrame, rounds: int = 6) -> DataFrame:
    """df with charges of the heavy atoms (6 decimals; hydrogens take part as atoms of their own), min_charge and
    max_charge; null where an element has no parameters."""
    done = charge_states(rounds)
    out = df.withColumn("_q", F.when(F.col("mol").isNotNull(), done)).withColumn("charges", F.when(F.forall("_q", lambda a: a["q"].isNotNull()), F.transform("_q", lambda a: F.round(a["q"], 6))))
    return out.drop("_q").withColumn("min_charge", F.array_min("charges")).withColumn("max_charge", F.array_max("charges"))
