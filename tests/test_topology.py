"""Graph descriptors against published and hand-counted values, and against plain loops on common molecules."""

import itertools
import math

import known as library
import pytest

from retort.functions import molecule as M
from retort.functions import smiles, topology

#: Literature values (benzene's are those that the field's usual toolkit is known to give) and values counted by hand.
BY_HAND = {
    "C": {"Chi0": 0, "Chi1": 0, "Kappa1": 0, "BalabanJ": 0, "BertzCT": 0, "NumValenceElectrons": 8, "HeavyAtomMolWt": 12.011},
    "CCCC": {"Chi0": 3.4142, "Chi1": 1.9142, "Chi2n": 1.0, "Chi3n": 0.5, "Chi4n": 0, "Kappa1": 4, "Kappa2": 3, "Kappa3": 2, "BalabanJ": 1.9747, "BertzCT": 2, "HallKierAlpha": 0},
    "CC(C)C": {"Chi0": 3.5774, "Chi1": 1.7321, "Chi2n": 1.7321, "Chi3n": 0, "Kappa2": 1.3333, "BalabanJ": 2.3238, "BertzCT": 4.7549, "MaxEStateIndex": 2.1667, "MinEStateIndex": 0.8333},
    "c1ccccc1": {"Chi0": 4.2426, "Chi1": 3, "Chi1v": 2, "Chi3v": 0.6667, "HallKierAlpha": -0.78, "Kappa1": 3.4116, "Kappa2": 1.6058, "Kappa3": 0.5824, "BalabanJ": 3, "BertzCT": 71.961, "LabuteASA": 37.4314, "SlogP_VSA6": 36.3982, "SMR_VSA7": 36.3982, "MaxEStateIndex": 2, "NumAromaticCarbocycles": 1, "NumSaturatedRings": 0, "MinPartialCharge": -0.0623},
    "CCO": {"Chi0v": 2.1543, "Chi1v": 1.0233, "Chi2v": 0.3162, "HallKierAlpha": -0.04, "Kappa1": 2.96, "BertzCT": 2.7549, "PEOE_VSA1": 5.1065, "MaxEStateIndex": 7.5694, "MinEStateIndex": 0.25, "NHOHCount": 1, "NOCount": 1, "MaxPartialCharge": 0.0402, "NumValenceElectrons": 20},
    "CCCl": {"Chi0v": 2.8410, "Chi1v": 1.5089, "Chi0n": 2.0849, "HallKierAlpha": 0.29, "Kappa1": 3.29},
    "C1CC1": {"Chi1": 1.5, "Kappa1": 1.3333, "NumSaturatedCarbocycles": 1, "NumAliphaticCarbocycles": 1, "BalabanJ": 2.25},
    "CC(=O)N": {"NumAmideBonds": 1, "NHOHCount": 2, "HallKierAlpha": -0.53, "SlogP_VSA1": 5.7337},
    "C1CCNCC1": {"NumSaturatedHeterocycles": 1, "NumHeterocycles": 1, "NumAliphaticHeterocycles": 1, "NumAromaticHeterocycles": 0},
    "c1ccncc1": {"NumAromaticHeterocycles": 1, "NumAromaticCarbocycles": 0, "HallKierAlpha": -0.85, "BalabanJ": 3},
    "CC(N)C(=O)O": {"NumAtomStereoCenters": 1, "NumUnspecifiedAtomStereoCenters": 1, "MQN12": 6, "NOCount": 3, "NHOHCount": 3},
    "C[C@H](N)C(=O)O": {"NumAtomStereoCenters": 1, "NumUnspecifiedAtomStereoCenters": 0},
    "[NH4+].[Cl-]": {"NumValenceElectrons": 16, "BalabanJ": 0},
}


@pytest.fixture(scope="module")
def rows(spark):
    texts = [*BY_HAND, *(s for s, _, _ in library.MOLECULES), "no molecule"]
    df = M.with_molecules(spark.createDataFrame([(s,) for s in dict.fromkeys(texts)], "smiles string"))
    return {r.smiles: r.asDict() for r in M.descriptors(df, None, 4).drop("mol").collect()}


def test_values_counted_by_hand(rows):
    for s, wanted in BY_HAND.items():
        assert {n: rows[s][n] for n in wanted} == pytest.approx(wanted, abs=2e-4), s


def test_registry(rows):
    known = M.described()
    assert len(known) >= 160 and set(rows["C"]) == {"smiles", *known}
    assert all(rows["no molecule"][n] is None for n in known)
    assert len(M.chosen(category="topological")) >= 20 and len(M.chosen(category="mqn")) == 42
    with pytest.raises(ValueError):
        M.chosen(("Chi9",))


def plain(s):
    """The same by loops over all pairs of atoms and all orders of atoms."""
    mol = smiles.parse(s)
    n, h = len(mol.z), mol.h
    bond = {frozenset(b[:2]): b[2] for b in mol.bonds}
    near = [[v for v in range(n) if frozenset((i, v)) in bond] for i in range(n)]
    e = [topology.OUTER[mol.z[i]] - h[i] for i in range(n)]
    v = [x / (z - topology.OUTER[z] - 1) if z > 10 else x for x, z in zip(e, mol.z, strict=True)]
    r = lambda x: 1 / math.sqrt(x) if x > 0 else 0.0
    out = {"Chi0": sum(r(len(x)) for x in near), "Chi0v": sum(map(r, v)), "Chi0n": sum(map(r, e))}
    chains = [[i] for i in range(n)]
    for k in range(1, 5):
        chains = [[*c, w] for c in chains for w in near[c[-1]] if w not in c]
        out[f"Chi{k}v"] = sum(math.prod(r(v[i]) for i in c) for c in chains) / 2
        out[f"Chi{k}n"] = sum(math.prod(r(e[i]) for i in c) for c in chains) / 2
    inf = math.inf
    d = [[0 if i == j else 1 if frozenset((i, j)) in bond else inf for j in range(n)] for i in range(n)]
    w = [[0 if i == j else 1 / {4: 1.5}.get(bond[frozenset((i, j))], bond[frozenset((i, j))]) if frozenset((i, j)) in bond else inf for j in range(n)] for i in range(n)]
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i][j], w[i][j] = min(d[i][j], d[i][k] + d[k][j]), min(w[i][j], w[i][k] + w[k][j])
    total = [sum(x for x in row if x < inf) for row in w]
    cycles = len(mol.bonds) - n + 1
    out["BalabanJ"] = len(mol.bonds) / (cycles + 1) * sum(r(total[b[0]] * total[b[1]]) for b in mol.bonds) if cycles + 1 else 0
    own = [(4 / topology.SHELL[mol.z[i]] ** 2 * e[i] + 1) / len(near[i]) if near[i] else 0 for i in range(n)]
    state = [own[i] + sum((own[i] - own[j]) / (d[i][j] + 1) ** 2 for j in range(n) if 0 < d[i][j] < inf) for i in range(n)]
    out |= {"MaxEStateIndex": max(state), "MinEStateIndex": min(state)}
    return out


def test_plain_loops_agree(rows):
    for s, _, _ in library.MOLECULES:
        wanted = plain(s)
        assert {n: rows[s][n] for n in wanted} == pytest.approx(wanted, abs=2e-4), s


def test_bins_hold_all_area(rows):
    for r in rows.values():
        if r["Chi0"] is None:
            continue
        areas = [sum(r[f"{f}{k + 1}"] for k in range(len(topology.BINS[f]) + 1)) for f in ("SlogP_VSA", "SMR_VSA", "EState_VSA")]
        assert areas == pytest.approx([areas[0]] * 3, abs=0.01) and areas[0] > 0


def test_spellings_agree(spark):
    texts = ["CC(=O)Nc1ccc(O)cc1", "Oc1ccc(cc1)NC(C)=O", "C1=CC(O)=CC=C1NC(=O)C"]
    df = M.with_molecules(spark.createDataFrame([(s,) for s in texts], "smiles string"))
    one, *rest = ({k: v for k, v in r.asDict().items() if k != "smiles"} for r in M.descriptors(df, None, 4).drop("mol").collect())
    assert all(r == pytest.approx(one, abs=2e-4) for r in rest)
