"""Sites, features, counts and decompositions of molecules: protonation, pharmacophore features, molecular quantum numbers,
alerts, R-groups, stereoisomers and scaffold networks. Column expressions and joins, as in molecules.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions import graphs
from retort.functions import molecule as M
from retort.functions.molecule import degree, m, z_at
from retort.operators import molecules, rewrite

#: Usual pKa of groups; acids lose a proton above it, bases take one below it.
PKA = {
    "carboxylic_acid": (4.5, -1), "phosphate": (2.0, -1), "sulfonate": (-1.0, -1), "primary_amine": (10.5, 1), "secondary_amine": (10.5, 1),
    "tertiary_amine": (10.5, 1), "imidazole": (6.5, 1), "phenol": (10.0, -1), "thiol": (8.5, -1),
}


def _h(i: Column) -> Column:
    return F.get(m("h"), i)


def _arom(i: Column) -> Column:
    return F.get(m("arom"), i)


def _q(i: Column) -> Column:
    return F.get(m("charge"), i)


def _near(i: Column) -> Column:
    return F.arrays_zip(F.get(m("near"), i).alias("v"), F.get(m("order"), i).alias("o"))


def _beside(i: Column, test) -> Column:
    return F.exists(_near(i), lambda x: test(x["v"], x["o"]))


def _acyl(i: Column) -> Column:
    return (z_at(i) == 6) & ~_arom(i) & _beside(i, lambda v, o: (o == 2) & (z_at(v) == 8))


def site_kind(i: Column) -> Column:
    """The group of an atom that takes or loses a proton, or null."""
    hydroxyl = (z_at(i) == 8) & (_h(i) == 1) & (_q(i) == 0)
    to = lambda z: _beside(i, lambda v, o: (o == 1) & (z_at(v) == z) & _beside(v, lambda w, p: (p == 2) & (z_at(w) == 8)))
    amine = (z_at(i) == 7) & ~_arom(i) & (_q(i) == 0) & (M.valence(i) == 3) & ~_beside(i, lambda v, o: (o > 1) | _acyl(v) | (z_at(v) == 16))
    carbons = F.size(F.filter(_near(i), lambda x: (x["o"] == 1) & (z_at(x["v"]) == 6)))
    five = F.exists(m("rings"), lambda r: F.array_contains(r, i) & (F.size(r) == 5) & (F.size(F.filter(r, lambda j: z_at(j) == 7)) == 2))
    return (
        F.when(hydroxyl & _beside(i, lambda v, o: _acyl(v)), "carboxylic_acid")
        .when(hydroxyl & to(15), "phosphate")
        .when(hydroxyl & to(16), "sulfonate")
        .when(hydroxyl & _beside(i, lambda v, o: _arom(v)), "phenol")
        .when((z_at(i) == 16) & (_h(i) == 1), "thiol")
        .when(amine & (_h(i) == 2) & (carbons == 1), "primary_amine")
        .when(amine & (_h(i) == 1) & (carbons == 2), "secondary_amine")
        .when(amine & (_h(i) == 0) & (carbons == 3), "tertiary_amine")
        .when((z_at(i) == 7) & _arom(i) & (_h(i) == 0) & (_q(i) == 0) & (degree(i) == 2) & five, "imidazole")
    )


def protonation_sites(df: DataFrame, id_: str = "row_idx") -> DataFrame:
    """(id, atom, site, pka, change): a row for each atom that takes (1) or loses (-1) a proton around its pKa."""
    pka = F.create_map(*(F.lit(x) for k, v in PKA.items() for x in (k, v[0])))
    change = F.create_map(*(F.lit(x) for k, v in PKA.items() for x in (k, v[1])))
    kinds = F.transform(F.sequence(F.lit(0), F.size(m("z")) - 1), lambda i: F.struct(i.alias("atom"), site_kind(i).alias("site")))
    rows = df.where("mol is not null").select(F.col(id_).alias("id"), F.explode(F.filter(kinds, lambda x: x["site"].isNotNull())).alias("x"))
    return rows.select("id", "x.atom", "x.site", F.element_at(pka, F.col("x.site")).alias("pka"), F.element_at(change, F.col("x.site")).alias("change"))


def charge_at(df: DataFrame, ph: float = 7.4) -> DataFrame:
    """df with n_sites, and charge_at_ph, the charge of the dominant state: acids have lost their proton where pH is over the
    pKa, bases have taken one where it is under."""
    moved = F.lit(0)
    kinds = F.transform(F.sequence(F.lit(0), F.size(m("z")) - 1), site_kind)
    for kind, (pka, change) in PKA.items():
        if (change < 0) == (ph > pka):
            moved = moved + change * _times(kind)
    out = df.withColumn("_sites", F.filter(kinds, lambda x: x.isNotNull()))
    return out.withColumn("n_sites", F.size("_sites")).withColumn("charge_at_ph", M.total(m("charge")) + moved).drop("_sites")


def protonated(df: DataFrame, ph: float = 7.4, smiles: str = "smiles") -> DataFrame:
    """df with protonated: the dominant state at a pH as canonical SMILES: each group of PKA that is not charged yet has lost or
    taken its proton."""
    change = F.create_map(*(F.lit(x) for k, (pka, c) in PKA.items() for x in (k, c if (c < 0) == (ph > pka) else 0)))
    n = F.sequence(F.lit(0), F.size(m("z")) - 1)
    ok = F.col("mol").isNotNull()
    rows = df.withColumn("_d", F.when(ok, F.transform(n, lambda i: F.coalesce(F.try_element_at(change, site_kind(i)), F.lit(0)))))
    add = lambda field: F.zip_with(m(field), F.col("_d"), lambda x, d: x + d)
    rows = rows.withColumn("_state", F.when(ok, F.struct(add("charge").alias("charge"), add("h").alias("h")))).withColumn("_parts", F.when(ok, F.array(n)))
    return rewrite.written(rows, "_parts", "_text", smiles, state="_state").withColumn("protonated", F.get("_text", F.lit(0))).drop("_d", "_state", "_parts", "_text")


def _times(kind: str) -> Column:
    return F.size(F.filter("_sites", lambda x: x == kind))


def pharmacophore(df: DataFrame) -> DataFrame:
    """df with counts of features by family, and their total: donors HD, acceptors HA, aromatic rings AR, acids AG, bases BG,
    hydrophobic ends LH, rings that are not aromatic RR, halogens X. The families' definitions are this library's own."""
    sites = lambda kinds: F.size(M.atoms_where(lambda i: site_kind(i).isin(*kinds) | ((_q(i) > 0) if "primary_amine" in kinds else (_q(i) < 0))))
    ends = M.atoms_where(lambda i: (z_at(i) == 6) & ~_arom(i) & (degree(i) == 1) & _beside(i, lambda v, o: (z_at(v) == 6) & ~_beside(v, lambda w, p: ~z_at(w).isin(6))))
    made = {
        "HD": M.hbond_donors(), "HA": M.hbond_acceptors(), "AR": M.aromatic_rings(), "AG": sites(("carboxylic_acid", "phosphate", "sulfonate")),
        "BG": sites(("primary_amine", "secondary_amine", "tertiary_amine")), "LH": F.size(ends), "RR": F.size(m("rings")) - M.aromatic_rings(),
        "X": M.count(m("z"), lambda z: z.isin(9, 17, 35, 53)),
    }
    return df.withColumns(made).withColumn("num_features", reduce(Column.__add__, (F.col(k) for k in made)))


def quantum_numbers() -> dict[str, Column]:
    """The 42 molecular quantum numbers (Nguyen and others 2009). Of the bonds of aromatic rings, half of the atoms that bring
    one electron count as a double bond."""
    atoms = lambda test: F.size(M.atoms_where(test))
    ring = lambda i: F.get(m("ring"), i)
    bonds = lambda test: M.count(M.bonds(), test)
    pairs = F.floor(atoms(lambda i: _arom(i) & ((z_at(i) == 6) & ~_beside(i, lambda v, o: o == 2) | (z_at(i) == 7) & (degree(i) == 2) & (_h(i) == 0))) / 2).cast("int")
    aromatic = bonds(lambda x: x["o"] == 4)
    donor_sites = F.aggregate(M.atoms_where(lambda i: z_at(i).isin(7, 8, 16)), F.lit(0), lambda s, i: s + _h(i))
    lone = lambda i: F.when(z_at(i) == 8, 2).when(z_at(i) == 7, F.when(_q(i) <= 0, 1).otherwise(0)).otherwise(0)
    acceptor_sites = F.aggregate(M.atoms_where(lambda i: z_at(i).isin(7, 8)), F.lit(0), lambda s, i: s + lone(i))
    size = lambda k: M.count(m("rings"), lambda r: F.size(r) == k)
    shared_a = atoms(lambda i: M.count(m("rings"), lambda r: F.array_contains(r, i)) > 1)
    shared_b = bonds(lambda x: M.count(m("rings"), lambda r: F.array_contains(r, x["a"]) & F.array_contains(r, x["b"])) > 1)
    of = lambda z: (lambda i: z_at(i) == z)
    valence = lambda k, cyclic: atoms(lambda i: (degree(i) == k) & (ring(i) if cyclic else ~ring(i)))
    made = [
        ("c", atoms(of(6))), ("f", atoms(of(9))), ("cl", atoms(of(17))), ("br", atoms(of(35))), ("i", atoms(of(53))), ("s", atoms(of(16))), ("p", atoms(of(15))),
        ("an", atoms(lambda i: (z_at(i) == 7) & ~ring(i))), ("cn", atoms(lambda i: (z_at(i) == 7) & ring(i))), ("ao", atoms(lambda i: (z_at(i) == 8) & ~ring(i))), ("co", atoms(lambda i: (z_at(i) == 8) & ring(i))),
        ("hac", atoms(lambda i: z_at(i) > 1)),
        ("asb", bonds(lambda x: (x["o"] == 1) & ~x["inring"])), ("adb", bonds(lambda x: (x["o"] == 2) & ~x["inring"])), ("atb", bonds(lambda x: (x["o"] == 3) & ~x["inring"])),
        ("csb", bonds(lambda x: (x["o"] == 1) & x["inring"]) + aromatic - pairs), ("cdb", bonds(lambda x: (x["o"] == 2) & x["inring"]) + pairs), ("ctb", bonds(lambda x: (x["o"] == 3) & x["inring"])),
        ("rbc", M.rotatable()), ("hbam", acceptor_sites), ("hba", M.hbond_acceptors()), ("hbdm", donor_sites), ("hbd", M.hbond_donors()),
        ("neg", atoms(lambda i: _q(i) < 0)), ("pos", atoms(lambda i: _q(i) > 0)),
        ("asv", valence(1, False)), ("adv", valence(2, False)), ("atv", valence(3, False)), ("aqv", valence(4, False)), ("cdv", valence(2, True)), ("ctv", valence(3, True)), ("cqv", valence(4, True)),
        *((f"r{k}", size(k)) for k in range(3, 10)), ("rg10", M.count(m("rings"), lambda r: F.size(r) > 9)), ("afr", shared_a), ("bfr", shared_b),
    ]
    return {f"MQN{k + 1}_{name}": c for k, (name, c) in enumerate(made)}


def alerts(df: DataFrame, patterns: dict[str, str], keep_hits: bool = False) -> DataFrame:
    """df with alerts, the names of the given patterns that a molecule holds: only rows without any, or only those with. The
    catalogue is the caller's."""
    names = F.array_compact(F.array(*(F.when(molecules.has_substructure(p), F.lit(name)) for name, p in sorted(patterns.items()))))
    out = df.where("mol is not null").withColumn("alerts", names)
    return out.where(F.size("alerts") > 0 if keep_hits else F.size("alerts") == 0)


def stereoisomers(df: DataFrame, id_: str = "row_idx", most: int = 32, only_unassigned: bool = True) -> DataFrame:
    """(id, isomer, centers, assignment): a row for each way to set the open centers, at most so many; assignment has a 0 or 1
    for each of centers."""
    centers = molecules.undefined_centers() if only_unassigned else molecules.possible_centers()
    rows = df.where("mol is not null").select(F.col(id_).alias("id"), centers.alias("centers"))
    n = F.least(F.pow(F.lit(2.0), F.size("centers")), F.lit(float(most))).cast("int")
    rows = rows.withColumn("isomer", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("id", "isomer", "centers", F.transform("centers", lambda c, k: F.call_function("shiftright", F.col("isomer"), k).bitwiseAND(F.lit(1))).alias("assignment"))


def rgroups(df: DataFrame, core: str, id_: str = "row_idx", smiles: str = "smiles") -> DataFrame:
    """(id, matched, R1, R2, ...): what stands at the labelled atoms of a core such as c1ccc([*:1])cc1, H for nothing. Of several
    places where the core fits, the one with lowest atom numbers is taken."""
    p = molecules.pattern_of(core)
    labels = {p.label[k]: p.near[k][0][0] for k in range(len(p.z)) if p.z[k] == 0 and p.label[k]}
    if not labels:
        raise ValueError("a core has labelled attachment points such as [*:1]")
    bare = [k for k in range(len(p.z)) if p.z[k]]
    place = {k: n for n, k in enumerate(bare)}
    q = type(p)()
    for k in bare:
        q.add(p.z[k], p.arom[k], p.charge[k], p.h[k])
    for a, b, o, mark in p.bonds:
        if a in place and b in place:
            q.bond(place[a], place[b], o, mark)
    rows = df.where("mol is not null").withColumn("places", F.array_min(molecules.places(q)))
    steps = F.sequence(F.lit(1), F.greatest(F.size(m("z")), F.lit(1)))

    def side(k: int) -> tuple[Column, Column]:
        at = F.get(F.col("places"), F.lit(place[k]))
        roots = F.array_except(F.get(m("near"), at), F.col("places"))
        grow = lambda s, _: F.array_union(s, F.array_except(F.array_distinct(F.flatten(F.transform(s, lambda i: F.get(m("near"), i)))), F.col("places")))
        return F.aggregate(steps, roots, grow), roots

    sides = [side(labels[n]) for n in sorted(labels)]
    rows = rows.withColumn("_parts", F.when(F.col("places").isNotNull(), F.array(*(a for a, _ in sides)))).withColumn("_ends", F.when(F.col("places").isNotNull(), F.array(*(b for _, b in sides))))
    rows = rewrite.written(rows, "_parts", "_text", smiles, "_ends")
    texts = [F.when(F.get("_text", F.lit(k)) == "", "[H]").otherwise(F.get("_text", F.lit(k))).alias(f"R{n}") for k, n in enumerate(sorted(labels))]
    return rows.select(F.col(id_).alias("id"), F.col("places").isNotNull().alias("matched"), *texts)


def scaffold_levels(df: DataFrame) -> DataFrame:
    """df (with mol, which is dropped) with the keys of the levels: mol_key, scaffold_key, generic_key; valid rows alone."""
    return graphs.key(graphs.scaffold_keys(df.where("mol is not null"))).drop("mol", "scaffold_atoms")


def scaffold_network(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, level, count, fraction) and edges (src, dst, count): molecule keys under their scaffolds, and scaffolds under
    their generic frameworks. Counts are molecules; acyclic ones have no nodes above them.
    df has mol, or the keys of scaffold_levels."""
    keys = (scaffold_levels(df) if "mol" in df.columns else df).select("mol_key", "scaffold_key", "generic_key")
    levels = [keys.select(F.col(c).alias("id"), F.lit(k).alias("level")) for k, c in enumerate(("mol_key", "scaffold_key", "generic_key"))]
    counts = reduce(DataFrame.unionByName, levels).where("id <> ''").groupBy("id", "level").agg(F.count("*").alias("count"))
    total = keys.agg(F.count("*").alias("n"))
    nodes = counts.join(F.broadcast(total)).withColumn("fraction", F.round(F.col("count") / F.col("n"), 4)).drop("n")
    up = keys.select(F.explode(F.array(F.struct(F.col("mol_key").alias("src"), F.col("scaffold_key").alias("dst")), F.struct(F.col("scaffold_key").alias("src"), F.col("generic_key").alias("dst")))).alias("e"))
    return nodes, up.select("e.src", "e.dst").where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("count"))


#: name: (bits, what it is); those of 0 bits need tables that are not at hand.
FINGERPRINTS = {
    "circular": (2048, "atom neighbourhoods up to a radius"), "path": (2048, "linear paths"), "atompair": (2048, "pairs of atoms and the bonds between them"),
    "torsion": (2048, "paths of four atoms"), "maccs": (0, "166 public keys"), "avalon": (0, "not published"), "pharmacophore": (0, "feature tables"),
}


def fingerprint_registry(spark) -> DataFrame:
    return spark.createDataFrame([(k, b, w, b > 0) for k, (b, w) in FINGERPRINTS.items()], "name string, default_bits int, description string, available boolean")
