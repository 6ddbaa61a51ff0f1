import known as library
import pytest

from retort.functions import molecule as M
from retort.functions import scores, smiles
from retort.operators import analysis, rewrite


@pytest.fixture(scope="module")
def mols(spark):
    return M.with_molecules(library.frame(spark).withColumnRenamed("mol_id", "row_idx")).cache()


def name(k):
    return library.MOLECULES[k][1]


def test_sites_and_charges(mols):
    found = {}
    for r in analysis.protonation_sites(mols).collect():
        found.setdefault(name(r.id), []).append(r.site)
    assert found["aspirin"] == ["carboxylic_acid"] and found["phenol"] == ["phenol"] and found["nicotine"] == ["tertiary_amine"]
    assert sorted(found["glycine"]) == ["carboxylic_acid", "primary_amine"]
    assert "urea" not in found and "ethanol" not in found
    at = lambda ph: {r.name: r.charge_at_ph for r in analysis.charge_at(mols, ph).collect()}
    assert at(7.4)["aspirin"] == -1 and at(7.4)["glycine"] == 0 and at(1.0)["glycine"] == 1 and at(12.0)["phenol"] == -1


def test_quantum_numbers(mols):
    made = analysis.quantum_numbers()
    assert len(made) == 42
    by = {r.name: [v for k, v in r.asDict().items() if k != "name"] for r in mols.select("name", *(c.alias(k) for k, c in made.items())).collect()}
    keys = [k.split("_")[1] for k in made]
    benzene, aspirin = (dict(zip(keys, by[n], strict=True)) for n in ("benzene", "aspirin"))
    assert (benzene["c"], benzene["csb"], benzene["cdb"], benzene["r6"], benzene["cdv"]) == (6, 3, 3, 1, 6)
    assert (aspirin["ao"], aspirin["adb"], aspirin["hac"], aspirin["rbc"], aspirin["hbd"]) == (4, 2, 13, 2, 1)
    for row in by.values():  # bonds of all kinds are all bonds
        x = dict(zip(keys, row, strict=True))
        assert x["asv"] + x["adv"] + x["atv"] + x["aqv"] + x["cdv"] + x["ctv"] + x["cqv"] <= x["hac"]


def test_features_alerts_isomers(mols):
    f = {r.name: r for r in analysis.pharmacophore(mols).collect()}
    assert (f["aspirin"].AG, f["aspirin"].AR, f["chloroform"].X, f["dopamine"].BG) == (1, 1, 3, 1)
    hit = {r.name: r.alerts for r in analysis.alerts(mols, {"nitrile": "C#N", "nitro": "[N+](=O)[O-]"}, keep_hits=True).collect()}
    assert hit == {"acetonitrile": ["nitrile"], "nitrobenzene": ["nitro"]}
    assert analysis.alerts(mols, {"nitrile": "C#N"}).count() == len(library.MOLECULES) - 1
    isomers = {}
    for r in analysis.stereoisomers(mols, most=4).collect():
        isomers.setdefault(name(r.id), []).append(tuple(r.assignment))
    assert sorted(isomers["alanine"]) == [(0,), (1,)] and isomers["ethanol"] == [()] and len(isomers["glucose"]) == 4


def test_rgroups(spark):
    df = M.with_molecules(spark.createDataFrame([(1, "Cc1ccccc1"), (2, "CCc1ccccc1"), (3, "CCO"), (4, "Oc1ccc(C)cc1")], "row_idx int, smiles string"))
    got = {r.id: r for r in analysis.rgroups(df, "c1ccc([*:1])cc1").collect()}
    assert not got[3].matched and got[3].R1 is None
    assert got[1].matched and {r.R1 for r in (got[1], got[2])} <= {"[H]", "C(*)", "C(*)C"}
    two = {r.id: r for r in analysis.rgroups(df, "c1cc([*:2])ccc1([*:1])").collect()}
    assert {two[4].R1, two[4].R2} in ({"C(*)", "O(*)"}, {"[H]"})
    with pytest.raises(ValueError, match="attachment"):
        analysis.rgroups(df, "c1ccccc1")


def test_network_and_registry(spark, mols):
    nodes, edges = analysis.scaffold_network(mols)
    top = {(r.level, r["count"]) for r in nodes.where("level = 2").orderBy("count", ascending=False).limit(1).collect()}
    assert top == {(2, 12)}  # six-membered rings: ten phenyls, pyridine and glucose
    assert edges.where("src = dst").count() == 0
    assert analysis.fingerprint_registry(spark).where("available").count() == 4
    assert smiles.parse("CC").z == [6, 6]


def test_scores(mols):
    got = {r.name: r for r in scores.accessibility(mols).withColumn("qed", scores.qed()).collect()}
    assert all(1 <= r.sa_score <= 10 and 0 < r.qed < 1 for r in got.values())
    assert 0.75 < got["ibuprofen"].qed < 0.88 and got["ibuprofen"].qed > got["glucose"].qed
    # all 6 neighbourhoods up to radius 1 of ethanol's 3 atoms are unknown and different, and 3 of radius 2
    want = 11 - (4 + 3**1.005 - 3 + 5) / 1.5
    assert got["ethanol"].sa_score == round(want, 4)
    # benzene: 3 kinds of neighbourhood, each 6 times
    assert got["benzene"].sa_score == round(11 - (12 / 18 + 6**1.005 - 6 + 5) / 1.5, 4)
    assert len({r.sa_score for r in got.values()}) > 20


def test_side_chains(mols):
    got = {r.name: sorted(r.side_chains) for r in rewrite.side_chains(mols).collect()}
    assert got["toluene"] == ["C(*)"] and got["benzene"] == [] and got["ethanol"] == []
    assert len(got["aspirin"]) == 2 and len(got["caffeine"]) == 3
