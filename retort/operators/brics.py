"""Fragments by sixteen kinds of bond ends, and molecules built of fragments whose ends go together (Degen and others 2008).

Which ends an atom offers and which bonds are cut are array expressions inside the row; an Arrow step writes the pieces, with
an atom like [4*] for each cut end. Pieces meet again by an equi-join on the kinds that their ends accept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions import molecule as M
from retort.functions import smiles as S
from retort.functions.expr import let
from retort.functions.molecule import degree, m, z_at

# Kinds of ends that go together, in the published order; 7 with 7 by a double bond.
PAIRS = [
    (1, 3), (1, 5), (1, 10),
    (3, 4), (3, 13), (3, 14), (3, 15), (3, 16),
    (4, 5), (4, 11),
    (5, 12), (5, 14), (5, 16), (5, 13), (5, 15),
    (6, 13), (6, 14), (6, 15), (6, 16),
    (7, 7),
    (8, 9), (8, 10), (8, 13), (8, 14), (8, 15), (8, 16),
    (9, 13), (9, 14), (9, 15), (9, 16),
    (10, 13), (10, 14), (10, 15), (10, 16),
    (11, 13), (11, 14), (11, 15), (11, 16),
    (13, 14), (13, 15), (13, 16),
    (14, 14), (14, 15), (14, 16),
    (15, 16),
    (16, 16),
]


def neighbours() -> Column:
    """Of each atom its neighbours v, with the bond's order o and whether it is in a ring."""
    bond = lambda i, v: F.exists(M.bonds(), lambda x: x["inring"] & ((x["a"] == i) & (x["b"] == v) | (x["a"] == v) & (x["b"] == i)))
    one = lambda i: F.zip_with(F.get(m("near"), i), F.get(m("order"), i), lambda v, o: F.struct(v.alias("v"), o.alias("o"), bond(i, v).alias("r")))
    return F.transform(F.sequence(F.lit(0), F.size(m("z")) - 1), one)


def kinds(near: Column) -> Column:
    """Of each atom the kinds of ends that it offers. near: neighbours()."""
    aliphatic = lambda i, *z: z_at(i).isin(*z) & ~F.get(m("arom"), i)
    aromatic = lambda i, *z: z_at(i).isin(*z) & F.get(m("arom"), i)
    some = lambda i, test: F.exists(F.get(near, i), test)
    many = lambda i, test: F.size(F.filter(F.get(near, i), test))
    ring = lambda i: F.get(m("ring"), i)
    oxo = lambda i: some(i, lambda x: (x["o"] == 2) & (z_at(x["v"]) == 8))
    single = lambda x, *z: (x["o"] == 1) & z_at(x["v"]).isin(*z)
    outside = lambda x, *z: single(x, *z) & ~x["r"]
    round_ = lambda x, *z: (x["o"] == 1) & x["r"] & aliphatic(x["v"], *z)
    flat = lambda x, *z: (x["o"] == 4) & aromatic(x["v"], *z)
    multiple = lambda i: some(i, lambda x: x["o"] != 1)
    double = lambda i: some(i, lambda x: x["o"] == 2)

    def of(i: Column) -> Column:
        carbon, nitrogen, d = aliphatic(i, 6), aliphatic(i, 7), degree(i)
        lactam = ring(i) & some(i, lambda x: x["r"] & aliphatic(x["v"], 6) & oxo(x["v"]))
        tests = {
            1: carbon & (d == 3) & oxo(i) & some(i, lambda x: single(x, 0, 6, 7, 8)),
            3: aliphatic(i, 8) & (d == 2) & some(i, lambda x: outside(x, 0, 1, 6)),
            4: carbon & (d != 1) & ~double(i) & some(i, lambda x: outside(x, 6)),
            5: nitrogen & (d != 1) & ~double(i) & ~some(i, lambda x: (x["o"] == 1) & ~z_at(x["v"]).isin(0, 1, 6, 16)) & ~lactam,
            6: carbon & (d == 3) & ~ring(i) & oxo(i) & some(i, lambda x: outside(x, 0, 6, 7, 8)),
            7: carbon & d.isin(2, 3) & some(i, lambda x: single(x, 6)),
            8: carbon & ~ring(i) & (d != 1) & ~multiple(i),
            9: aromatic(i, 7) & (F.get(m("charge"), i) == 0) & (many(i, lambda x: flat(x, 6, 7, 8, 16)) > 1),
            10: nitrogen & lactam & (many(i, lambda x: x["r"] & aliphatic(x["v"], 6, 7, 8, 16)) > 1),
            11: aliphatic(i, 16) & (d == 2) & some(i, lambda x: outside(x, 0, 6)),
            12: aliphatic(i, 16) & (d == 4) & some(i, lambda x: single(x, 0, 6)) & (many(i, lambda x: (x["o"] == 2) & (z_at(x["v"]) == 8)) == 2),
            13: carbon & some(i, lambda x: round_(x, 7, 8, 16)) & (many(i, lambda x: round_(x, 6, 7, 8, 16)) > 1),
            14: aromatic(i, 6) & some(i, lambda x: flat(x, 7, 8, 16)) & (many(i, lambda x: flat(x, 6, 7, 8, 16)) > 1),
            15: carbon & (many(i, lambda x: round_(x, 6)) > 1),
            16: aromatic(i, 6) & (many(i, lambda x: flat(x, 6)) > 1),
        }
        return F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))

    return F.transform(F.sequence(F.lit(0), F.size(m("z")) - 1), of)


def cuts() -> Column:
    """Bonds that are cut: a, b, the kinds x and y of their ends, and the order o. The first pair of kinds that fits names them."""
    pairs = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(2 if x == y == 7 else 1).alias("o")) for x, y in PAIRS))
    open_ = F.filter(M.bonds(), lambda b: ~b["inring"] & b["o"].isin(1, 2))

    def named(offers: Column) -> Column:
        def one(b: Column) -> Column:
            has = lambda atom, kind: F.array_contains(F.get(offers, atom), kind)
            fits = lambda p: (p["o"] == b["o"]) & (has(b["a"], p["x"]) & has(b["b"], p["y"]) | has(b["a"], p["y"]) & has(b["b"], p["x"]))
            first = F.get(F.filter(pairs, fits), F.lit(0))

            def told(p: Column) -> Column:
                straight = has(b["a"], p["x"]) & has(b["b"], p["y"])
                return F.when(p.isNotNull(), F.struct(b["a"].alias("a"), b["b"].alias("b"), F.when(straight, p["x"]).otherwise(p["y"]).alias("x"), F.when(straight, p["y"]).otherwise(p["x"]).alias("y"), p["o"].alias("o")))

            return let(first, told)

        return F.array_compact(F.transform(open_, one))

    return let(let(neighbours(), kinds), named)


def _pieces(mol: S.Mol, found: list[dict]) -> list[tuple[str, int]]:
    """(text, heavy atoms) of each distinct piece."""
    apart = {frozenset((c["a"], c["b"])) for c in found}
    out = S.Mol()
    for i in range(len(mol.z)):
        out.add(mol.z[i], mol.arom[i], mol.charge[i], mol.h[i], mol.iso[i])
    for a, b, order, _ in mol.bonds:
        if frozenset((a, b)) not in apart:
            out.bond(a, b, order)
    for c in found:
        for atom, kind in ((c["a"], c["x"]), (c["b"], c["y"])):
            out.bond(atom, out.add(0, h=0, iso=kind), c["o"])
    seen, texts = set(), {}
    for i in range(len(out.z)):
        if i not in seen:
            part, new = {i}, [i]
            while new:
                new = [v for u in new for v, _ in out.near[u] if v not in part]
                part.update(new)
            seen |= part
            texts[S.write(out, sorted(part))] = sum(out.z[k] > 1 for k in part)
    return sorted(texts.items())


def fragments(df: DataFrame, id_: str = "row_idx", smiles: str = "smiles", min_size: int = 1) -> DataFrame:
    """(id, fragment_smiles, fragment_idx, heavy_atom_count): the distinct pieces of each molecule of df (with mol) once all such
    bonds are cut; the molecule itself where there is none."""
    rows = df.where("mol is not null").select(F.col(id_).alias("id"), F.col(smiles).alias("smiles"), cuts().alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("t", pa.string()), ("n", pa.int32())]))
        for batch in M.sliced(batches):
            made = [[{"t": t, "n": n} for t, n in _pieces(M.parsed(s), c)] for s, c in zip(batch.column("smiles").to_pylist(), batch.column("cuts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, kind)], ["id", "pieces"])

    rows = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pieces array<struct<t:string,n:int>>")
    out = rows.select("id", F.posexplode("pieces").alias("fragment_idx", "x")).where(F.col("x.n") >= min_size)
    return out.select("id", F.col("x.t").alias("fragment_smiles"), "fragment_idx", F.col("x.n").alias("heavy_atom_count"))


def built(pieces: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Distinct molecules of two pieces (fragment_smiles) with one cut end each, of kinds that go together; the first `limit` by
    text. The combinations are the feature; pieces meet by kind, those of a kind dealt to parts."""
    end = r"\[([0-9]+)\*\]"
    ends = pieces.where(F.size(F.regexp_extract_all("fragment_smiles", F.lit(end), 1)) == 1)
    ends = ends.select(F.col("fragment_smiles").alias("x"), F.regexp_extract("fragment_smiles", end, 1).cast("int").alias("kind")).distinct()
    accepted = sorted({(x, y) for p in PAIRS for x, y in (p, p[::-1])})
    table = F.create_map(*(F.lit(v) for k in sorted({x for x, _ in accepted}) for v in (k, [y for x, y in accepted if x == k])))
    deal = 16
    left = ends.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(deal))).select("x", F.explode(F.element_at(table, F.col("kind"))).alias("kind"), "part")
    right = ends.select(F.col("x").alias("y"), "kind", F.explode(F.sequence(F.lit(0), F.lit(deal - 1)).cast("array<bigint>")).alias("part"))
    both = left.join(right, ["kind", "part"]).where("x <= y").select("x", "y", F.when(F.col("kind") == 7, 2).otherwise(1).alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in M.sliced(batches):
            made = [_bonded(x, y, o) for x, y, o in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "o")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["product"])

    made = both.mapInArrow(run, "product string").where("product is not null").distinct()
    return made.orderBy("product").limit(limit) if limit else made


def _bonded(x: str, y: str, order: int) -> str | None:
    """The molecule of two pieces, their cut ends bonded; null if it is none."""
    out, ends = S.Mol(), []
    try:
        for text in (x, y):
            mol = S.parse(text)
            at, dummy = len(out.z), mol.z.index(0)
            place = {i: at + k for k, i in enumerate(i for i in range(len(mol.z)) if i != dummy)}
            for i in place:
                out.add(mol.z[i], mol.arom[i], mol.charge[i], mol.h[i], mol.iso[i])
            for a, b, o, _ in mol.bonds:
                if dummy not in (a, b):
                    out.bond(place[a], place[b], o)
            ends.append(place[mol.near[dummy][0][0]])
        out.bond(*ends, order)
        return S.write(S.parse(S.write(out)))
    except (S.Invalid, RecursionError):
        return None
