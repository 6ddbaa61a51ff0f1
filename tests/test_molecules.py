import random

import known as library
import pytest
from pyspark.sql import functions as F

from retort.functions import bits, graphs, smiles
from retort.functions import molecule as M
from retort.operators import analysis, molecules

#: Values of a widely used toolkit, from the literature: MolLogP, TPSA, acceptors, donors, rotatable bonds.
KNOWN = {
    "aspirin": (1.3101, 63.60, 3, 1, 2),
    "caffeine": (-1.0293, 61.82, 6, 0, 0),
    "benzene": (1.6866, 0.0, 0, 0, 0),
    "ethanol": (-0.0014, 20.23, 1, 1, 0),
    "acetone": (0.5953, 17.07, 1, 0, 0),
    "ibuprofen": (3.0732, 37.30, 1, 1, 4),
    "paracetamol": (1.3506, 49.33, 2, 2, 1),
    "toluene": (1.9950, 0.0, 0, 0, 0),
    "phenol": (1.3922, 20.23, 1, 1, 0),
    "pyridine": (1.0816, 12.89, 1, 0, 0),
}


@pytest.fixture(scope="module")
def mols(spark):
    return M.with_molecules(library.frame(spark).withColumnRenamed("mol_id", "row_idx"), canonical="canonical").cache()


def test_known_descriptors(mols):
    got = M.descriptors(mols, ("MolLogP", "TPSA", "NumHAcceptors", "NumHDonors", "NumRotatableBonds", "FractionCSP3"))
    by = {r.name: r for r in got.collect()}
    for name, (logp, tpsa, acceptors, donors, rotatable) in KNOWN.items():
        r = by[name]
        assert abs(r.MolLogP - logp) < 2e-4 and abs(r.TPSA - tpsa) < 0.011, (name, r.MolLogP, r.TPSA)
        assert (r.NumHAcceptors, r.NumHDonors, r.NumRotatableBonds) == (acceptors, donors, rotatable), name
    assert by["benzene"].FractionCSP3 == 0 and by["ethanol"].FractionCSP3 == 1


def test_formulas_are_those_of_the_literature(mols):
    assert all(r.f == r.formula_lit for r in mols.select(M.formula().alias("f"), "formula_lit").collect())


def test_invalid_strings():
    for text in [*library.INVALID, "F(C)C", "[Xx]", "cc", "C=1CC#1", "C)", "1CC1", "C..C(", "[C", "C%1"]:
        assert M.parsed(text) is None, text
    for text in ["[NH4+]", "[13CH4]", "C[C@H](N)C(=O)O", "C/C=C/C", "[Na+].[Cl-]", "C%12CC%12", "[cH]1ccccc1", "O=c1cc[nH]cc1", "c1ccc2cccc2cc1", "[O-][n+]1ccccc1", "*C", "c1cc[n-]c1", "[te]1cccc1", "[Na+].c1nc[n-]n1"]:
        assert M.parsed(text) is not None, text


def shuffled(m: smiles.Mol, r: random.Random) -> smiles.Mol:
    order = list(range(len(m.z)))
    r.shuffle(order)
    place, out = {o: k for k, o in enumerate(order)}, smiles.Mol()
    for o in order:
        out.add(m.z[o], m.arom[o], m.charge[o], m.h[o], m.iso[o], m.label[o], m.chiral[o])
    bonds = list(m.bonds)
    r.shuffle(bonds)
    for a, b, o, mark in bonds:
        out.bond(place[a], place[b], o, mark)
    out.rings = smiles.smallest_rings(out)
    return out


def test_canonical_text_does_not_depend_on_writing():
    r = random.Random(4)
    for text, name, _ in library.MOLECULES:
        m = smiles.parse(text)
        want = smiles.write(m)
        assert {smiles.write(shuffled(m, r)) for _ in range(8)} == {want}, name
        again = smiles.parse(want)
        assert smiles.write(again) == want and sorted(again.h) == sorted(m.h), name


def test_keys_and_fingerprints_do_not_depend_on_writing(spark, mols):
    pairs = [(k, s, smiles.write(smiles.parse(s))) for k, (s, *_) in enumerate(library.MOLECULES)]
    both = spark.createDataFrame([(k, s) for k, a, b in pairs for s in (a, b)], "k int, smiles string")
    df = M.with_molecules(both)
    for made in (graphs.key(df, "x"), graphs.circular(df, out="x"), graphs.paths(df, 3, out="x"), graphs.torsions(df, out="x"), graphs.atom_pairs(df, out="x"), graphs.scaffold_keys(df).withColumn("x", F.array("scaffold_key", "generic_key"))):
        assert made.groupBy("k").agg(F.countDistinct("x").alias("n")).where("n <> 1").count() == 0
    assert graphs.key(mols).select("mol_key").distinct().count() == len(library.MOLECULES)


def test_circular_counts(spark):
    df = M.with_molecules(spark.createDataFrame([("CCCCCC",)], "smiles string"))
    (row,) = graphs.circular(df, 1, 4096, "n", counts=True).select("n").collect()
    # ends, middles; their neighbourhoods: end, next to end, middle
    assert sorted(row.n.values()) == [2, 2, 2, 2, 4]


def test_substructures(mols):
    names = lambda p, **k: {r.name for r in molecules.substructure(mols, p, **k).collect()}
    assert names("C#N") == {"acetonitrile"}
    assert names("[O-]") == {"nitrobenzene", "sodium acetate"}
    assert names("c1ccncc1") == {"pyridine", "nicotine"}
    assert "ethanol" in names("c1ccccc1", exclude=True) and "toluene" not in names("c1ccccc1", exclude=True)
    counts = {r.id: r["count"] for r in molecules.matches(mols, "c1ccccc1").groupBy("id").count().collect()}
    of = lambda name: counts[next(k for k, m in enumerate(library.MOLECULES) if m[1] == name)]
    assert of("naphthalene") == 2 and of("aspirin") == 1
    with pytest.raises(ValueError, match="connected"):
        molecules.substructure(mols, "C.C")
    with pytest.raises(ValueError, match="not a pattern"):
        molecules.substructure(mols, "C(")


def test_functional_groups(mols):
    by = {r.name: r for r in mols.select("name", *(c.alias(k) for k, c in molecules.functional_groups().items())).collect()}
    want = {
        "aspirin": {"n_ester": 1, "n_carboxylic_acid": 1, "n_alcohol": 1, "n_ether": 1, "n_aromatic_ring": 1},
        "paracetamol": {"n_amide": 1, "n_amine_secondary": 1, "n_alcohol": 1, "n_aromatic_ring": 1},
        "acetone": {"n_ketone": 1},
        "glucose": {"n_alcohol": 5, "n_ether": 1},
        "nitrobenzene": {"n_nitro": 1, "n_aromatic_ring": 1},
        "chloroform": {"n_halogen": 3},
        "sulfamethoxazole": {"n_amine_primary": 1, "n_aromatic_ring": 1},
        "lidocaine": {"n_amide": 1, "n_amine_secondary": 1, "n_amine_tertiary": 1, "n_aromatic_ring": 1},
        "acetonitrile": {"n_nitrile": 1},
        "urea": {"n_amine_primary": 2},
    }
    for name, groups in want.items():
        assert {k: v for k, v in by[name].asDict().items() if k != "name" and v} == groups, name


def test_scaffolds(mols):
    got = {r.name: r for r in graphs.scaffold_keys(mols).collect()}
    phenyl = {"aspirin", "benzene", "ibuprofen", "paracetamol", "toluene", "phenol", "lidocaine", "nitrobenzene", "bromobenzene", "dopamine"}
    assert {n for n, r in got.items() if r.scaffold_key == got["benzene"].scaffold_key} == phenyl
    assert got["pyridine"].generic_key == got["benzene"].generic_key != got["furan"].generic_key
    assert got["ethanol"].scaffold_key == "" and got["ethanol"].scaffold_atoms == 0
    assert got["caffeine"].scaffold_atoms == 11  # the carbonyl oxygens stay


def test_matched_pairs(spark):
    df = spark.createDataFrame([(1, "Cc1ccccc1"), (2, "Oc1ccccc1"), (3, "c1ccccc1N"), (4, "CCO"), (5, "bad")], "row_idx long, smiles string")
    pairs = molecules.matched_pairs(molecules.cuts(df), 3).collect()
    assert {(p.id_1, p.id_2) for p in pairs} == {(1, 2), (1, 3), (2, 3)}
    assert {p.transformation for p in pairs if (p.id_1, p.id_2) == (1, 2)} == {"C(*)>>O(*)"}


def test_validation(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "xx"), (3, "c1ccccc1"), (4, "[Fe+3]"), (5, "CC(N)O"), (6, None)], "row_idx int, smiles string")
    got = {r.row_idx: r for r in molecules.validate(df, max_atoms=5, allowed=["C", "O", "N"], stereo=True).collect()}
    assert got[1].is_valid and not got[2].is_valid and not got[6].is_valid
    assert got[3].errors == ["Too many atoms (max 5)"]
    assert got[4].errors == ["Disallowed elements: Fe"] and got[4].warnings == ["High charge: 3"]
    assert got[5].warnings == ["1 undefined stereocenters"]


def test_what_differs_far_away(spark):
    chains = [(1, "CC(CCC=C(C)C)CCO", 1), (2, "CCCC(C)CCCCC", 1), (3, "CCCCC(C)CCCCC", 1), (4, "CCCCCC(C)CCCCC", 0), (5, "CC1CCCCC1", 0), (6, "CC1CCCC(C)(C)C1", 1), (7, "C" * 20 + "C(C)" + "C" * 21, 1), (8, "C" * 20 + "C(C)" + "C" * 20, 0)]
    df = M.with_molecules(spark.createDataFrame([c[:2] for c in chains], "row_idx int, smiles string"))
    assert {r.row_idx: r.n_potential for r in molecules.stereo_counts(df).collect()} == {i: n for i, _, n in chains}
    isomers = analysis.stereoisomers(df).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in isomers} == {i: 2**n for i, _, n in chains}
    warned = molecules.validate(df, stereo=True).where("size(warnings) > 0").collect()
    assert {r.row_idx for r in warned} == {i for i, _, n in chains if n}
    long = lambda a, b, c: "N" + "C" * a + "O" + "C" * b + "S" + "C" * c + "F"
    rows = [(1, long(30, 40, 50)), (2, long(40, 30, 50)), (3, long(30, 40, 50).replace("N", "", 1)[::-1] + "N")]
    keys = {r.row_idx: r.mol_key for r in graphs.key(M.with_molecules(spark.createDataFrame(rows, "row_idx int, smiles string"))).collect()}
    assert keys[1] == keys[3] != keys[2]


def test_rings_and_fragments(mols):
    got = {r.name: r for r in molecules.ring_info(mols).collect()}
    assert (got["morphine"].num_rings, got["indole"].ring_sizes, got["ethanol"].largest_ring) == (5, "5,6", 0)
    assert got["caffeine"].num_aromatic_heterocycles == 2 and got["naphthalene"].num_heterocycles == 0
    kept = {r.name: r.n for r in graphs.largest_fragment(mols).select("name", F.size(F.filter("fragment", lambda k: k)).alias("n")).collect()}
    assert kept["sodium acetate"] == 4 and kept["benzene"] == 6


def test_bits_round_trip(spark):
    r = random.Random(7)
    rows = [(k, sorted(r.sample(range(200), r.randint(0, 60)))) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, on array<int>").withColumn("words", bits.words_from_bits(F.col("on"), 200))
    for x in df.select("*", bits.on_bits(F.col("words")).alias("again"), bits.to_bitstring(F.col("words")).alias("s"), bits.to_hex(F.col("words")).alias("hex"), *bits.to_columns(F.col("words"), 3)).collect():
        assert x.on == x.again == [i for i, c in enumerate(x.s) if c == "1"] and len(x.s) == 256 and len(x.hex) == 64
        assert [x.bit_0, x.bit_1, x.bit_2] == [int(k in x.on) for k in range(3)]


def test_what_is_not_offered():
    with pytest.raises(molecules.NotAvailable, match="force field"):
        molecules.MISSING["energy_compute"]()


def test_each_text_is_read_once(spark, monkeypatch):
    """Rows with repeated, null and wrong texts, and a step with none, one or several rows a text."""
    from pyspark.sql import functions as F

    from retort.functions import molecule as M
    from retort.plans import catalog

    texts = ["CCO", None, "CCO", "c1ccccc1", "no molecule", None, "CCO", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, smiles string")
    seen = []

    def sizes(t):
        seen.append(t.count())
        return M.with_molecules(t).select("smiles", F.size(M.m("z")).alias("n"))

    got = M.each_text(df, sizes)
    assert got.columns == ["k", "smiles", "n"] and seen == [5]
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(k, s, {"CCO": 3, "c1ccccc1": 6}.get(s)) for k, s in enumerate(texts)]
    atoms = M.each_text(df, lambda t: M.with_molecules(t).where("mol is not null").select("smiles", F.explode(M.m("z")).alias("z")))
    assert atoms.groupBy("k").count().where("count > 1").count() == 4 and atoms.count() == 15
    # the queries of the bridge read a molecule a text, not one a part
    read, plain = [], M.with_molecules
    monkeypatch.setattr(M, "with_molecules", lambda rows, *a, **k: (read.append(rows.count()), plain(rows, *a, **k))[1])
    for name in ("descriptors_surface", "fingerprint_spellings", "rings_analyze", "convert", "mmp_transform"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert read and max(read) <= 78


def test_python_steps_take_few_rows():
    import pyarrow as pa

    from retort.functions import molecule as M

    batch = pa.record_batch({"smiles": [f"C{'C' * (k % 5)}" for k in range(1000)]})
    parts = list(M.sliced([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= 256 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
