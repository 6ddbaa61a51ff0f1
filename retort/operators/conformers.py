"""Operators on given conformers: tables (id, conf, xyz), xyz an array of points in one atom order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.functions import geometry
from retort.operators.similarity import _blocks


def compare(df: DataFrame, reference: list[list[float]], aligned: bool = True, threshold: float | None = None) -> DataFrame:
    """df with rmsd to one conformer; rows of another number of atoms have null and, with a threshold, go."""
    ref = F.array(*(F.array(*map(F.lit, map(float, p))) for p in reference))
    f = geometry.aligned_rmsd if aligned else geometry.raw_rmsd
    out = df.withColumn("rmsd", F.when(F.size("xyz") == len(reference), f(F.col("xyz"), ref)))
    return out if threshold is None else out.where(F.col("rmsd") <= threshold)


def pairs(df: DataFrame, aligned: bool = True) -> DataFrame:
    """(i, j, rmsd), i < j, over all rows (id, xyz)."""
    a = df.select(F.col("id").alias("i"), F.col("xyz").alias("p"))
    b = df.select(F.col("id").alias("j"), F.col("xyz").alias("q"))
    met = _blocks(a, b, "i", "j").where((F.col("i") < F.col("j")) & (F.size("p") == F.size("q")))
    f = geometry.aligned_rmsd if aligned else geometry.raw_rmsd
    return met.select("i", "j", f(F.col("p"), F.col("q")).alias("rmsd"))


def spread(df: DataFrame, by: str = "id", aligned: bool = True) -> DataFrame:
    """(by, n, min_rmsd, max_rmsd, mean_rmsd) over the pairs of conformers of each molecule."""
    a = df.select(by, F.col("conf").alias("c1"), F.col("xyz").alias("p"))
    b = df.select(by, F.col("conf").alias("c2"), F.col("xyz").alias("q"))
    met = a.join(b, by).where("c1 < c2")
    f = geometry.aligned_rmsd if aligned else geometry.raw_rmsd
    value = met.withColumn("rmsd", f(F.col("p"), F.col("q")))
    return value.groupBy(by).agg(F.count("*").alias("n_pairs"), F.min("rmsd").alias("min_rmsd"), F.max("rmsd").alias("max_rmsd"), F.avg("rmsd").alias("mean_rmsd"))


def best(df: DataFrame, by: str = "id", energy: str = "energy") -> DataFrame:
    """The conformer of least energy of each molecule, the first among equals."""
    return df.groupBy(by).agg(F.min_by(F.struct("conf", energy), F.struct(energy, "conf")).alias("b")).select(by, "b.*")


def torsion_profile(df: DataFrame, by: str = "id") -> DataFrame:
    """From (by, angle, energy): the profile in order of angle, its least energy and angle, and the barrier."""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("angle", "energy"))).alias("profile"), F.min("energy").alias("min_energy"), F.min_by("angle", F.struct("energy", "angle")).alias("min_angle"), (F.max("energy") - F.min("energy")).alias("barrier"))


def shapes(df: DataFrame, mass: str | None = None) -> DataFrame:
    """df with principal moments and what follows from them."""
    w = F.col(mass) if mass else F.transform("xyz", lambda _: F.lit(1.0))
    out = df.withColumn("_pmi", geometry.moments(F.col("xyz"), w))
    return out.withColumns(geometry.shape(F.col("_pmi"))).drop("_pmi")
