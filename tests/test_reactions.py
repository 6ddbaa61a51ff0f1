"""Products of mapped templates, worked out by hand."""

import pytest

from retort.functions import molecule as M
from retort.functions import smiles
from retort.operators import reactions

CASES = [
    ("[C:1](=[O:2])[N:3]>>[C:1](=[O:2])O.[N:3]", "CC(=O)Nc1ccccc1", ["CC(=O)O", "Nc1ccccc1"]),  # an amide gives acid and amine
    ("[C:1](=[O:2])[N:3]>>[C:1](=[O:2])O.[N:3]", "O=C1CCCCN1", ["OC(=O)CCCCN"]),  # a lactam opens, in one piece
    ("[C:1]=[O:2]>>[C:1][O:2]", "O=C1CCC(=O)CC1", ["OC1CCC(=O)CC1"]),  # two places, one product
    ("[C:1]=[O:2]>>[C:1][O:2]", "CC(=O)CC=O", ["CC(O)CC=O", "CC(=O)CCO"]),
    ("[CH3:1]Br>>[CH3:1]O", "CBr", ["CO"]),
    ("[CH3:1]Br>>[CH3:1]O", "CCBr", []),  # no methyl
    ("[N+:1](=[O:2])[O-:3]>>[NH2:1]", "[O-][N+](=O)c1ccccc1", ["Nc1ccccc1"]),  # atoms without partner go, the charge too
    ("[NH2:1][c:2]>>CC(=O)[NH:1][c:2]", "Nc1ccc(N)cc1", ["CC(=O)Nc1ccc(N)cc1"]),
    ("[c:1]Cl>>[c:1]O", "Clc1ccccc1", ["Oc1ccccc1"]),
    ("[c:1]Cl>>[c:1]B(O)O", "Clc1ccncc1", ["OB(O)c1ccncc1"]),
    ("[NH2:1][c:2]>>O=C1CCC(=O)[N:1]1[c:2]", "Nc1ccccc1", ["O=C1CCC(=O)N1c1ccccc1"]),
    ("[N:1]>>[N+:1]", "CN(C)C", ["C[NH+](C)C"]),
    ("[O:1]>>[O-:1]", "CCO", ["CC[O-]"]),
    ("[C:1]Cl>>[C:1]C#N", "ClCCCl", ["N#CCCCl"]),
    ("[C:1]=[C:2]>>[C:1]1[C:2]C1", "CC=C", ["CC1CC1"]),  # a new ring
    ("[C:1]=[C:2].[C:3]>>[C:1]", "CC=C", None),
    ("[c:1]1[c:2][c:3][c:4][c:5][c:6]1>>[C:1]1[C:2][C:3][C:4][C:5][C:6]1", "c1ccccc1", []),  # what would be no molecule, or is one
    ("[C:1](=[O:2])[O:3][C:4]>>[C:1](=[O:2])O.[O:3][C:4]", "CCOC(=O)c1ccccc1", ["OC(=O)c1ccccc1", "CCO"]),
    ("[N:1]([C:2])[C:3]>>[N:1][C:2]", "CCN(C)C", ["CNCC", "CNC"]),  # what hangs on an atom that goes, goes
]


@pytest.mark.parametrize("reaction, reactant, wanted", CASES)
def test_products(spark, reaction, reactant, wanted):
    df = M.with_molecules(spark.createDataFrame([(1, reactant), (2, "no molecule"), (3, None)], "row_idx int, smiles string"))
    if wanted is None:
        with pytest.raises(ValueError):
            reactions.transformed(df, reaction)
        return
    got = reactions.transformed(df, reaction).collect()
    if "[c:1]1" in reaction:
        assert {r.product for r in got} <= {"C1CCCCC1"}
        return
    assert {r.product for r in got} == {smiles.write(smiles.parse(x)) for x in wanted}
    assert {(r.id, r.reactant, r.num_products) for r in got} == ({(1, reactant, len(wanted))} if wanted else set())


@pytest.mark.parametrize("text", ["CC", "C>>", ">>C", "[C:1]>>[C:2]", "[C:1][C:1]>>[C:1]", "[C:1]>>[C:1][C:1]", "C(>>C"])
def test_wrong_templates(text):
    with pytest.raises(ValueError):
        reactions.template(text)
