"""Drug-likeness and synthetic accessibility scores as Columns over molecules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions import bits, graphs
from retort.functions import molecule as M
from retort.functions.expr import let
from retort.functions.molecule import m

# Desirability parameters a, b, c, d, e, f and maximum, and mean weights (Bickerton and others 2012).
QED = {
    "MolWt": ((2.817065973, 392.5754953, 290.7489764, 2.419764353, 49.22325677, 65.37051707, 104.9805561), 0.66),
    "MolLogP": ((3.172690585, 137.8624751, 2.534937431, 4.581497897, 0.822739154, 0.576295591, 131.3186604), 0.46),
    "NumHAcceptors": ((2.948620388, 160.4605972, 3.615294657, 4.435986202, 0.290141953, 1.300669958, 148.7763046), 0.05),
    "NumHDonors": ((1.618662227, 1010.051101, 0.985094388, 0.000000001, 0.713820843, 0.920922555, 258.1632616), 0.61),
    "TPSA": ((1.876861559, 125.2232657, 62.90773554, 87.83366614, 12.01999824, 28.51324732, 104.5686167), 0.06),
    "NumRotatableBonds": ((0.01, 272.4121427, 2.558379970, 1.565547684, 1.271567166, 2.758063707, 105.4420403), 0.65),
    "NumAromaticRings": ((3.217788970, 957.7374108, 2.274627939, 0.000000001, 1.317690384, 0.375760881, 312.3372610), 0.48),
    "alerts": ((0.01, 1199.094025, -0.09002883, 0.000000001, 0.185904477, 0.875193782, 417.7253140), 0.95),
}


def qed(alerts: Column | int = 0) -> Column:
    """Weighted geometric mean of eight desirabilities, 4 decimals. The number of structural alerts is the caller's, as their
    catalogue is; 0 takes a molecule as free of them."""
    values = {n: M.DESCRIPTORS[n][1]().cast("double") for n in QED if n != "alerts"} | {"alerts": (alerts if isinstance(alerts, Column) else F.lit(alerts)).cast("double")}

    def desirability(name: str) -> Column:
        a, b, c, d, e, f, top = QED[name][0]
        x = values[name]
        return (a + b / (1 + F.exp(-(x - c + d / 2) / e)) * (1 - 1 / (1 + F.exp(-(x - c - d / 2) / f)))) / top

    weights = sum(w for _, w in QED.values())
    logs = reduce(Column.__add__, (QED[n][1] * F.log(F.greatest(desirability(n), F.lit(1e-300))) for n in QED))
    return F.when(F.col("mol").isNotNull(), F.round(F.exp(logs / weights), 4))


def accessibility(df: DataFrame, fragments: dict[int, float] | None = None, unknown: float = -4.0) -> DataFrame:
    """df with sa_score (1 to 10, 4 decimals). fragments: a contribution for each circular neighbourhood (its hash, radius up to
    2). A known one counts as often as it occurs, an unknown kind once; by default all are unknown. The mean over all
    occurrences is taken off, and size, stereo, spiro, bridgehead and macrocycle terms are added, to what goes into
    11 - (sum + 5) / 1.5."""
    from retort.operators.molecules import possible_centers

    table = F.create_map(*(F.lit(x) for k, v in (fragments or {}).items() for x in (k, float(v)))) if fragments else None

    def mean(hashes: Column) -> Column:
        kinds = F.array_distinct(hashes)
        times = lambda k: F.size(F.filter(hashes, lambda h: h == k))
        value = (lambda k: F.coalesce(F.try_element_at(table, k) * times(k), F.lit(unknown))) if fragments else (lambda k: F.lit(unknown))
        return F.aggregate(F.transform(kinds, value), F.lit(0.0), lambda s, x: s + x) / F.size(hashes)

    n = F.size(m("z")).cast("double")
    log1 = lambda c: F.log10(c.cast("double") + 1)
    specified = M.atoms_where(lambda i: F.get(m("chiral"), i) > 0)
    macro = M.count(m("rings"), lambda r: F.size(r) > 8)
    penalties = F.pow(n, F.lit(1.005)) - n + log1(F.size(F.array_union(possible_centers(), specified))) + log1(F.size(M.spiro())) + log1(F.size(M.bridgeheads())) + log1(macro)
    score = 11 - (penalties - let(graphs._all_hashes(2), mean) + 5) / 1.5
    return df.withColumn("sa_score", F.when(F.col("mol").isNotNull(), F.round(F.least(F.greatest(score, F.lit(1.0)), F.lit(10.0)), 4)))


def minhash_circular(df: DataFrame, radius: int = 3, functions: int = 128, n_bits: int = 2048, out: str = "words") -> DataFrame:
    """df with out: the circular neighbourhoods' minima under so many hash functions, folded to bits."""
    least = lambda h: F.transform(F.sequence(F.lit(1), F.lit(functions)), lambda k: F.pmod(F.array_min(F.transform(h, lambda x: F.xxhash64(k, x))), F.lit(n_bits)).cast("int"))
    made = let(F.array_distinct(graphs._all_hashes(radius)), least)
    return df.withColumn(out, F.when(F.col("mol").isNotNull(), bits.words_from_bits(made, n_bits)))
