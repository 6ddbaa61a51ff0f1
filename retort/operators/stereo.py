"""Stereo marks of molecule tables: what could be marked, labels, marks that mean something, and isomers as molecules.

What could be marked is found with Column expressions on the arrays of mol; labels and texts come from one Arrow step a row.
Rings with two alike ways around (1,4-dimethylcyclohexane) keep their marks in texts, but are not among what could be marked;
isomers that a bridge forbids are made all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions import cip
from retort.functions import molecule as M
from retort.functions.molecule import m
from retort.operators import molecules, rewrite

LABELS = "struct<atoms:array<struct<atom:int,label:string>>,bonds:array<struct<a:int,b:int,label:string>>>"
_ARROW = pa.struct([
    ("atoms", pa.list_(pa.struct([("atom", pa.int32()), ("label", pa.string())]))),
    ("bonds", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("label", pa.string())]))),
])


def assign(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """df with cip: R or S of atoms and E or Z of double bonds, numbered as in the text; null where it is no molecule. A column mol
    is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in M.sliced(batches):
            rows = []
            for text in batch.column(smiles).to_pylist():
                mol = M.parsed(text)
                atoms, bonds = cip.labels(mol) if mol else ([], [])
                rows.append({"atoms": [{"atom": i, "label": x} for i, x in atoms], "bonds": [{"a": a, "b": b, "label": x} for a, b, x in bonds]} if mol else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names)

    df = df.drop("cip", "mol")
    names = [*df.columns, "cip"]
    return df.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"cip {LABELS}"]))


def undefined(df: DataFrame) -> DataFrame:
    """df (with mol) with open_centers and open_double_bonds: atoms and bonds that could have a mark and have none."""
    return df.withColumn("open_centers", molecules.undefined_centers()).withColumn("open_double_bonds", molecules.undefined_double_bonds())


def cleaned(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Valid rows with cleaned, the canonical SMILES with the marks that mean something, and n_marks and n_kept, the atoms and double
    bonds with marks before and after."""
    marks = M.count(m("chiral"), lambda c: c > 0) + M.count(m("ez"), lambda c: c > 0)
    first = M.with_molecules(df, smiles, "cleaned").where("mol is not null").withColumn("n_marks", marks)
    return M.with_molecules(first, "cleaned").withColumn("n_kept", marks).drop("mol")


def isomers(df: DataFrame, id_: str = "row_idx", smiles: str = "smiles", most: int = 32, only_unassigned: bool = True) -> DataFrame:
    """(id, isomer): a row for each different molecule that the marks of open centers and double bonds can make, from at most so many
    ways to set them (the lowest numbers in binary); only_unassigned: without turning over the marks that are there. df has mol."""
    chosen = undefined(df.where("mol is not null"))
    if not only_unassigned:
        chosen = chosen.withColumn("open_centers", molecules.possible_centers()).withColumn("open_double_bonds", molecules.possible_double_bonds())
    free = F.size("open_centers") + F.size("open_double_bonds")
    ways = F.least(F.pow(F.lit(2.0), free), F.lit(float(most))).cast("int")
    rows = chosen.withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1)))

    def marked(field: str, places: str, skip: Column) -> Column:
        bit = lambda i: F.call_function("shiftright", F.col("way"), skip + F.array_position(places, i).cast("int") - 1).bitwiseAND(F.lit(1))
        return F.transform(m(field), lambda x, i: F.when(F.array_contains(places, i), bit(i) + 1).otherwise(x)).alias(field)

    state = F.struct(marked("chiral", "open_centers", F.lit(0)), marked("ez", "open_double_bonds", F.size("open_centers")))
    every = F.array(F.sequence(F.lit(0), F.size(m("z")) - 1))
    rows = rows.select(F.col(id_).alias("id"), F.col(smiles).alias("smiles"), every.alias("parts"), state.alias("state"))
    out = rewrite.written(rows, "parts", "texts", "smiles", state="state")
    return out.select("id", F.get("texts", F.lit(0)).alias("isomer")).distinct()
