"""Fingerprints, keys and reductions of molecule columns, as built-in array functions on the atoms of a row.

Neighbourhood hashes grow by one bond a round: an atom's next hash is of its own and its neighbours' sorted (bond order,
hash) pairs. Rounds are steps of one aggregate() over an array, so the expression does not grow with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions import bits
from retort.functions.expr import let
from retort.functions.molecule import m, z_at


def _start(kept: Column | None = None, generic: bool = False) -> Column:
    """First hash of each atom; of kept atoms, if given, as if they were the whole molecule."""
    n = F.sequence(F.lit(0), F.size(m("z")) - 1)

    def one(i: Column) -> Column:
        near = F.get(m("near"), i)
        degree = F.size(near) if kept is None else F.size(F.filter(near, lambda j: F.get(kept, j)))
        if generic:
            return F.xxhash64(degree)
        return F.xxhash64(z_at(i), degree, F.when(F.lit(kept is None), F.get(m("h"), i)).otherwise(0), F.get(m("charge"), i), F.get(m("ring"), i), F.get(m("arom"), i), F.get(m("iso"), i))

    return F.transform(n, one)


def _next(hashes: Column, kept: Column | None = None, generic: bool = False) -> Column:
    def one(h: Column, i: Column) -> Column:
        pairs = F.arrays_zip(F.get(m("near"), i).alias("v"), F.get(m("order"), i).alias("o"))
        if kept is not None:
            pairs = F.filter(pairs, lambda p: F.get(kept, p["v"]))
        around = F.array_sort(F.transform(pairs, lambda p: F.xxhash64(F.lit(1) if generic else p["o"], F.get(hashes, p["v"]))))
        return F.xxhash64(h, around)

    return F.transform(hashes, one)


LONGS = "array<bigint>"


def refined(rounds: int | None = None, kept: Column | None = None, generic: bool = False) -> Column:
    """Hashes of all atoms after so many rounds; by default as many as there are (kept) atoms, so that all see each other."""
    n = F.size(m("z") if kept is None else F.filter(kept, lambda k: k))
    last = F.greatest(n, F.lit(1)) if rounds is None else F.lit(rounds)
    return F.aggregate(F.sequence(F.lit(1), last), _start(kept, generic).cast(LONGS), lambda h, _: _next(h, kept, generic).cast(LONGS))


def _all_hashes(rounds: int) -> Column:
    """Hashes of all atoms of the start and of each round, one after the other."""
    first = let(_start().cast(LONGS), lambda h: F.struct(h.alias("h"), h.alias("all")))
    grow = lambda s, _: let(_next(s["h"]).cast(LONGS), lambda h: F.struct(h.alias("h"), F.concat(s["all"], h).alias("all")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, grow, lambda s: s["all"])


def circular(df: DataFrame, radius: int = 2, n_bits: int = 2048, out: str = "words", counts: bool = False) -> DataFrame:
    """df with out: the circular (Morgan-like) fingerprint as words, or as a map from bit to count. Hash and folding are
    this library's own, so bits agree with each other but not with another toolkit's."""
    folded = F.transform(_all_hashes(radius) if radius else _start(), lambda h: F.pmod(h, F.lit(n_bits)).cast("int"))
    if counts:
        made = let(folded, lambda xs: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(xs)), lambda b: F.struct(b, F.size(F.filter(xs, lambda x: x == b))))))
    else:
        made = bits.words_from_bits(folded, n_bits)
    return df.withColumn(out, F.when(F.col("mol").isNotNull(), made))


def _types() -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m("z")) - 1), lambda i: F.xxhash64(z_at(i), F.size(F.get(m("near"), i)), F.get(m("arom"), i)))


def _grown(paths: Column) -> Column:
    """Paths of atoms, each one bond longer, without coming back to an atom of their own."""
    longer = lambda p: F.transform(F.filter(F.get(m("near"), F.element_at(p, -1)), lambda v: ~F.array_contains(p, v)), lambda v: F.concat(p, F.array(v)))
    return F.flatten(F.transform(paths, longer))


def paths(df: DataFrame, longest: int = 5, n_bits: int = 2048, out: str = "words", only_longest: bool = False) -> DataFrame:
    """df with out: hashed linear paths of up to so many bonds, read in the direction that hashes lower. With only_longest
    and 3 bonds these are topological torsions."""
    kind = "array<array<int>>"
    single = F.transform(F.sequence(F.lit(0), F.size(m("z")) - 1), lambda i: F.array(i)).cast(kind)
    none = F.array().cast(kind)
    grow = lambda s, _: let(_grown(s["p"]).cast(kind), lambda p: F.struct(p.alias("p"), (F.concat(s["all"], p) if not only_longest else p).alias("all")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(longest)), F.struct(single.alias("p"), none.alias("all")), grow, lambda s: s["all"])

    def hashed(types: Column) -> Column:
        one = lambda p: let(F.transform(p, lambda i: F.get(types, i)), lambda t: F.least(F.xxhash64(t), F.xxhash64(F.reverse(t))))
        return F.transform(found, lambda p: F.pmod(one(p), F.lit(n_bits)).cast("int"))

    return df.withColumn(out, F.when(F.col("mol").isNotNull(), bits.words_from_bits(let(_types(), hashed), n_bits)))


def torsions(df: DataFrame, n_bits: int = 2048, out: str = "words") -> DataFrame:
    return paths(df, 3, n_bits, out, only_longest=True)


def atom_pairs(df: DataFrame, n_bits: int = 2048, out: str = "words", farthest: int = 30) -> DataFrame:
    """df with out: hashed (type, bonds between, type) of all pairs of atoms (Carhart 1985)."""
    n = F.size(m("z"))
    every = F.sequence(F.lit(0), n - 1)
    # balls around each atom grow by one bond a step, for as long as the molecule has atoms
    first = F.transform(every, lambda i: F.struct(F.array(i).alias("ball"), F.array(i).alias("edge"), F.array().cast("array<struct<v:int,d:int>>").alias("far")))

    def step(state: Column, d: Column) -> Column:
        def one(s: Column) -> Column:
            edge = F.array_except(F.array_distinct(F.flatten(F.transform(s["edge"], lambda i: F.get(m("near"), i)))), s["ball"])
            far = F.concat(s["far"], F.transform(edge, lambda v: F.struct(v.alias("v"), d.alias("d"))))
            return F.struct(F.concat(s["ball"], edge).alias("ball"), edge.alias("edge"), far.alias("far"))

        return F.transform(state, one)

    steps = F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(farthest)))

    def folded(types: Column) -> Column:
        pair = lambda i, x: let(F.struct(F.get(types, i).alias("a"), F.get(types, x["v"]).alias("b")), lambda t: F.pmod(F.xxhash64(F.least(t["a"], t["b"]), x["d"], F.greatest(t["a"], t["b"])), F.lit(n_bits)).cast("int"))
        return F.flatten(F.transform(F.aggregate(steps, first, step), lambda s, i: F.transform(F.filter(s["far"], lambda x: x["v"] > i), lambda x: pair(i, x))))

    return df.withColumn(out, F.when(F.col("mol").isNotNull(), bits.words_from_bits(let(_types(), folded), n_bits)))


def key(df: DataFrame, out: str = "mol_key", rounds: int | None = None, kept: str | None = None, generic: bool = False) -> DataFrame:
    """df with out: a hex key that does not depend on how a molecule was written, by which equal molecules meet in joins and
    groups. kept: a column of flags by atom; the key is then of these atoms alone, empty if there are none."""

    def text(last: Column, flags: Column | None = None) -> Column:
        chosen = last if flags is None else F.transform(F.filter(F.arrays_zip(last.alias("h"), flags.alias("k")), lambda x: x["k"]), lambda x: x["h"])
        return let(chosen, lambda c: F.when(F.size(c) == 0, F.lit("")).otherwise(F.sha2(F.to_json(F.array_sort(c)), 256)))

    made = text(refined(rounds)) if kept is None else let(F.col(kept), lambda k: text(refined(rounds, k, generic), k))
    return df.withColumn(out, F.when(F.col("mol").isNotNull(), made))


def framework(df: DataFrame, out: str = "framework") -> DataFrame:
    """df with out: a flag for each atom, true in rings and in what links them (Bemis and Murcko 1996), and for atoms doubly
    bonded to these. Ends that are in no ring are taken off until none is left."""
    start = m("ring")

    def peel(keep: Column, _: Column) -> Column:
        held = lambda i: F.size(F.filter(F.get(m("near"), i), lambda j: F.get(keep, j)))
        return F.transform(keep, lambda k, i: k & (F.get(m("ring"), i) | (held(i) > 1)))

    n = F.size(m("z"))
    all_ = F.array_repeat(F.lit(True), n)
    steps = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    core = F.when(F.exists(start, lambda x: x), F.aggregate(steps, all_, peel)).otherwise(start)
    bound = lambda c, i: F.exists(F.arrays_zip(F.get(m("near"), i).alias("v"), F.get(m("order"), i).alias("o")), lambda x: (x["o"] == 2) & F.get(c, x["v"]))
    return df.withColumn(out, let(core, lambda c: F.transform(c, lambda k, i: k | bound(c, i))))


def scaffold_keys(df: DataFrame) -> DataFrame:
    """df with scaffold_key and generic_key ("" if acyclic) and scaffold_atoms; generic: all atoms and bonds alike, without
    what is doubly bonded to the framework."""
    df = framework(df, "_fw").withColumn("scaffold_atoms", F.size(F.filter(F.col("_fw"), lambda x: x)))
    df = key(df, "scaffold_key", kept="_fw")
    linked = lambda f: F.transform(f, lambda k, i: k & (F.get(m("ring"), i) | (F.size(F.filter(F.get(m("near"), i), lambda j: F.get(f, j))) > 1)))
    df = df.withColumn("_gw", let(F.col("_fw"), linked))
    return key(df, "generic_key", kept="_gw", generic=True).drop("_fw", "_gw")


def largest_fragment(df: DataFrame, out: str = "fragment") -> DataFrame:
    """df with out: a flag by atom of the fragment with most heavy atoms, the first written among equals. Fragments are found
    by spreading the lowest atom number along bonds."""
    n = F.sequence(F.lit(0), F.size(m("z")) - 1)
    steps = F.sequence(F.lit(1), F.greatest(F.size(m("z")), F.lit(1)))
    spread = lambda c, _: F.transform(c, lambda own, i: F.least(own, F.coalesce(F.array_min(F.transform(F.get(m("near"), i), lambda j: F.get(c, j))), own)))
    whole = F.size(m("a")) == F.size(m("z")) - 1 + F.size(m("rings"))
    part = F.when(whole, F.transform(n, lambda i: F.lit(0))).otherwise(F.aggregate(steps, n, spread))

    def flags(p: Column) -> Column:
        heavy = lambda x: F.size(F.filter(F.arrays_zip(p.alias("p"), m("z").alias("z")), lambda y: (y["p"] == x) & (y["z"] > 1)))
        sizes = F.transform(F.array_distinct(p), lambda x: F.struct(heavy(x).alias("n"), (-x).alias("p")))
        return let(-F.array_max(sizes)["p"], lambda big: F.transform(p, lambda x: x == big))

    return df.withColumn(out, let(part, flags))
