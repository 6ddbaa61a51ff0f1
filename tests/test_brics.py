"""Cut bonds, pieces and molecules built of them, worked out by hand."""

import pytest

from retort.functions import molecule as M
from retort.functions import smiles
from retort.operators import brics
from retort.plans import library

#: Pieces of whole molecules; the first is the example that is usually given for the method.
PIECES = {
    "CCCOCCC(=O)c1ccccc1": ["[16*]c1ccccc1", "[3*]O[3*]", "[4*]CCC", "[4*]CCC([6*])=O"],
    "CC(=O)Nc1ccccc1": ["[1*]C(C)=O", "[5*]N[5*]", "[16*]c1ccccc1"],
    "COc1ccccc1": ["[3*]OC", "[16*]c1ccccc1"],
    "CCCN1CCCC1=O": ["[8*]CCC", "[10*]N1CCCC1=O"],
    "c1ccc(-c2ccccn2)cc1": ["[16*]c1ccccc1", "[14*]c1ccccn1"],
    "CC=CCC": ["[7*]=CC", "[7*]=CCC"],
    "CNS(=O)(=O)c1ccccc1": ["[5*]NC", "[12*]S(=O)(=O)c1ccccc1"],
    "CSc1ccccc1": ["[11*]SC", "[16*]c1ccccc1"],
    "CCn1cccc1": ["CCn1cccc1"],
    "CCCn1cccc1": ["[8*]CCC", "[9*]n1cccc1"],
    "OCCO": ["OCCO"],
    "C1CCCCC1C1CCCCN1": ["C1CCCCC1C1CCCCN1", None],
}


def plain(s):
    return smiles.write(smiles.parse(s))


@pytest.fixture(scope="module")
def pieces(spark):
    df = M.with_molecules(spark.createDataFrame([(k, s) for k, s in enumerate([*PIECES, "no molecule", ""])], "row_idx int, smiles string"))
    found = {}
    for r in brics.fragments(df).collect():
        found.setdefault(r.id, []).append(r)
    return found


def test_pieces(pieces):
    for k, (_, wanted) in enumerate(PIECES.items()):
        got = {r.fragment_smiles for r in pieces[k]}
        if wanted[-1] is None:  # a ring carbon beside nitrogen and one of a carbocycle: 13 with 15
            assert got == {plain("[15*]C1CCCCC1"), plain("[13*]C1CCCCN1")}
        elif k == 8:  # the end of ethyl's CH2 is of kind 8
            assert got == {plain("[8*]CC"), plain("[9*]n1cccc1")}
        else:
            assert got == {plain(x) for x in wanted}, k
    assert len(PIECES) == len(pieces)
    assert all(sorted(r.fragment_idx for r in rows) == list(range(len(rows))) for rows in pieces.values())


def test_sizes(pieces, spark):
    assert sum(r.heavy_atom_count for r in pieces[0]) == len(smiles.parse("CCCOCCC(=O)c1ccccc1").z)
    df = M.with_molecules(spark.createDataFrame([(1, "COc1ccccc1")], "row_idx int, smiles string"))
    assert [r.heavy_atom_count for r in brics.fragments(df, min_size=3).collect()] == [6]


def test_pieces_of_spellings_agree(spark):
    df = M.with_molecules(spark.createDataFrame([*library.SPELLINGS, *((k, library.MOLECULES[k][0]) for k, _ in library.SPELLINGS)], "row_idx int, smiles string"))
    rows = brics.fragments(df).groupBy("id", "fragment_smiles").count().collect()
    assert rows and all(r["count"] == 2 for r in rows)


def test_built_molecules(spark):
    texts = ["[3*]OC", "[16*]c1ccccc1", "[4*]CCC", "[7*]=CC", "[5*]N[5*]", "[12*]S(C)(=O)=O", "CCO"]
    got = {r.product for r in brics.built(spark.createDataFrame([(plain(t),) for t in texts], "fragment_smiles string"), None).collect()}
    assert got == {plain(x) for x in ("COc1ccccc1", "COCCC", "c1ccc(-c2ccccc2)cc1", "CC=CC")}
    assert brics.built(spark.createDataFrame([], "fragment_smiles string")).count() == 0


def test_whole_molecules_come_back(spark):
    """A molecule with one such bond is among those built of its pieces."""
    texts = ["COc1ccccc1", "NC(=O)c1ccccc1", "NCCc1c[nH]cn1", "CC(C)C1CCC(C)CC1O", "O=C(O)C=Cc1ccccc1", "Cc1ccc(C(C)C)c(O)c1"]
    df = M.with_molecules(spark.createDataFrame(list(enumerate(texts)), "row_idx int, smiles string"))
    got = {r.product for r in brics.built(brics.fragments(df), None).collect()}
    assert got >= {plain(t) for t in texts}
