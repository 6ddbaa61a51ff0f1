"""Reactions written as reactant>>product with map numbers, applied to molecules.

The reactant's places are found inside the row, with array expressions (molecules.places); rows without one never reach Python.
What a template changes (bonds, charges, hydrogens, atoms) is read from it once, on the driver; one small Arrow step applies
these changes to each place of a row's molecule and writes the distinct products.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.functions import molecule as M
from retort.functions import smiles as S
from retort.functions.elements import VALENCES
from retort.operators import molecules

#: What an aromatic bond takes of a valence.
ORDERS = {4: 1.5}


class Template(NamedTuple):
    """Atoms of the reactant keep their number, new ones follow. bonds: the order of each bond that differs, 0 if it goes; charge
    and h: what differs; new: (z, aromatic, charge, h); gone: atoms of the reactant without a partner; pieces: the atoms of
    each product. A new atom without brackets has the hydrogens that its valence leaves."""

    pattern: S.Mol
    bonds: dict[tuple[int, int], int]
    charge: dict[int, int]
    h: dict[int, int]
    new: list[tuple[int, bool, int, int]]
    gone: set[int]
    pieces: list[list[int]]


def template(text: str) -> Template:
    """One reactant, connected; every map number once a side, and on the left if on the right."""
    left, arrow, right = text.partition(">>")
    if not arrow or not left or not right:
        raise ValueError(f"not a reaction: {text!r}")
    try:
        before, after = S.parse(left, part=True), S.parse(right, part=True)
    except S.Invalid as e:
        raise ValueError(f"not a reaction: {text!r} ({e})") from None
    molecules._walk(before)
    at = {n: i for i, n in enumerate(before.label) if n}
    labels = [n for n in after.label if n]
    if len(at) != sum(map(bool, before.label)) or len(set(labels)) != len(labels) or set(labels) - set(at):
        raise ValueError(f"map numbers don't pair up: {text!r}")
    count, number, new = len(before.z), {}, []
    for i, n in enumerate(after.label):
        number[i] = at[n] if n else count + len(new)
        if not n:
            used = sum(ORDERS.get(o, o) for o in (after.bonds[b][2] for _, b in after.near[i]))
            plain = not (after.charge[i] or after.h[i] or after.iso[i] or after.arom[i])
            free = next((v - used for v in VALENCES.get(after.z[i], ()) if v >= used), 0) if plain else after.h[i]
            new.append((after.z[i], after.arom[i], after.charge[i], int(free)))
    kept = {at[n] for n in labels}
    old = {tuple(sorted(b[:2])): b[2] for b in before.bonds if kept.issuperset(b[:2])}
    now = {tuple(sorted((number[a], number[b]))): o for a, b, o, _ in after.bonds}
    bonds = {p: now.get(p, 0) for p in old.keys() | now.keys() if old.get(p) != now.get(p)}
    charge = {number[i]: after.charge[i] for i, n in enumerate(after.label) if n and after.charge[i] != before.charge[at[n]]}
    h = {number[i]: after.h[i] for i, n in enumerate(after.label) if n and after.h[i] and after.h[i] != before.h[at[n]]}
    part = _parts(range(len(after.z)), {p[:2]: 1 for p in map(tuple, after.bonds)})
    return Template(before, bonds, charge, h, new, set(range(count)) - kept, [[number[i] for i in x] for x in part])


def _parts(atoms, bonds: dict[tuple[int, int], int]) -> list[list[int]]:
    """Groups of atoms that bonds connect."""
    own = {i: {i} for i in atoms}
    for a, b in bonds:
        if own[a] is not own[b]:
            own[a] |= own[b]
            for i in own[b]:
                own[i] = own[a]
    return [sorted(x) for x in {id(x): x for x in own.values()}.values()]


def products_of(mol: S.Mol, place: list[int], t: Template) -> list[str]:
    """Canonical text of each product at one place; none that is no molecule. An atom whose bonds or charge change gives or takes
    hydrogens so that its valence stays, unless the template names them. What hangs on atoms that go, goes."""
    n, size = len(mol.z), len(t.pattern.z)
    place = [*place, *range(n, n + len(t.new))]
    gone = {place[i] for i in t.gone}
    old = {tuple(sorted(b[:2])): b[2] for b in mol.bonds}
    bonds = {p: o for p, o in old.items() if not gone.intersection(p)}
    for (a, b), order in t.bonds.items():
        pair = tuple(sorted((place[a], place[b])))
        bonds.pop(pair, None)
        if order:
            bonds[pair] = order
    change = [0.0] * n
    for side, sign in ((old, 1), (bonds, -1)):
        for p, o in side.items():
            for i in p:
                if i < n:
                    change[i] += sign * ORDERS.get(o, o)
    out = S.Mol()
    for i in range(n):
        out.add(mol.z[i], mol.arom[i], mol.charge[i], mol.h[i], mol.iso[i])
    for z, arom, charge, h in t.new:
        out.add(z, arom, charge, h)
    for k, charge in t.charge.items():
        i = place[k]
        step = charge - t.pattern.charge[k]
        out.charge[i] += step
        change[i] += step if out.z[i] not in (5, 6, 14) else -abs(step)
    for k in range(size):
        i = place[k]
        out.h[i] = t.h[k] if k in t.h else out.h[i] + round(change[i])
        if out.h[i] < 0:
            return []
    found, parts = [], _parts([i for i in range(len(out.z)) if i not in gone], bonds)
    for (a, b), order in bonds.items():
        out.bond(a, b, order)
    for piece in t.pieces:
        keep = next(x for x in parts if place[piece[0]] in x)
        try:
            found.append(S.write(S.parse(S.write(out, keep))))
        except (S.Invalid, RecursionError):
            continue
    return found


def transformed(df: DataFrame, reaction: str, id_: str = "row_idx", smiles: str = "smiles") -> DataFrame:
    """(id, reactant, product, num_products): a row for each distinct product of each molecule of df (with mol) that the
    reactant fits, products being counted over all places."""
    t = template(reaction)
    rows = df.where("mol is not null").withColumn("_places", molecules.places(t.pattern)).where(F.size("_places") > 0)
    rows = rows.select(F.col(id_).alias("id"), F.col(smiles).alias("reactant"), "_places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in M.sliced(batches):
            made = []
            for text, places in zip(batch.column("reactant").to_pylist(), batch.column("_places").to_pylist(), strict=True):
                mol = M.parsed(text)
                made.append(sorted({p for place in places for p in products_of(mol, place, t)}))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("reactant"), pa.array(made, pa.list_(pa.string()))], ["id", "reactant", "products"])

    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"id {kind}, reactant string, products array<string>")
    return rows.select("id", "reactant", F.explode("products").alias("product"), F.size("products").alias("num_products"))
