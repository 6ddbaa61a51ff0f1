import random

import pytest

from retort.functions import cip, ranks
from retort.functions import molecule as M
from retort.functions import smiles as S
from retort.functions import stereo as marks
from retort.operators import molecules, rewrite, stereo
from retort.plans import library

#: Texts with hand-assigned labels, in the order of their atoms.
LABELLED = [
    (r"N[C@@H](C)C(=O)O", "S"), (r"N[C@H](C)C(=O)O", "R"), (r"N[C@@H](CS)C(=O)O", "R"), (r"N[C@@H](CO)C(=O)O", "S"),
    (r"CC[C@H](C)O", "S"), (r"CC[C@@H](C)O", "R"), (r"OC[C@@H](O)C=O", "R"), (r"C[C@@H](O)[C@H](N)C(=O)O", "RS"),
    (r"CC(C)[C@@H]1CC[C@@H](C)C[C@H]1O", "SRR"), (r"CC1=CC[C@@H](CC1)C(=C)C", "R"), (r"[2H][C@@H](C)O", "S"),
    (r"F[C@](Cl)(Br)I", "S"), (r"F[C@@](Cl)(Br)I", "R"), (r"C[S@](=O)CC", "S"), (r"Cc1ccc(cc1)[S@](=O)C", "R"), (r"OC(=O)[C@H](O)[C@@H](O)C(=O)O", "RR"),
    (r"C/C=C/C", "E"), (r"C/C=C\C", "Z"), (r"F/C(Cl)=C/Br", "Z"), (r"F/C(Cl)=C\Br", "E"), (r"C[C@H](C)O", ""), (r"C/C=C(/C)C", ""),
]


def shuffled(m: S.Mol, seed: int) -> str:
    """A text of m with atoms in random order."""
    every = list(range(len(m.z)))
    place = dict(zip(every, random.Random(seed).sample(every, len(every)), strict=True))
    return S._text(m, every, place, {}, marks.marks_within(m, set(every)))


@pytest.mark.parametrize(("text", "want"), LABELLED)
def test_labels(text, want):
    for t in (text, *(shuffled(S.parse(text), k) for k in range(10))):
        atoms, bonds = cip.labels(S.parse(t))
        assert sorted([x for _, x in atoms] + [x for *_, x in bonds]) == sorted(want), t


def test_one_text_for_all_spellings():
    texts = {}
    for name, *_, spellings in library.MARKED:
        written = {S.write(S.parse(s)) for s in spellings}
        written |= {S.write(S.parse(shuffled(S.parse(s), k))) for s in spellings for k in range(25)}
        assert len(written) == 1, (name, written)
        assert S.write(S.parse(*written)) in written
        texts.setdefault(written.pop(), []).append(name)
    assert all(len(names) == 1 for names in texts.values())


def test_rings_of_marks():
    # the inositols: nine molecules with six marks each, one pair of which are mirror images
    texts = set()
    for way in range(64):
        at = ["@" * (1 + (way >> k & 1)) for k in range(6)]
        texts.add(S.write(S.parse("O[C{}H]1[C{}H](O)[C{}H](O)[C{}H](O)[C{}H](O)[C{}H]1O".format(*at))))
    assert len(texts) == 9
    assert S.write(S.parse(r"C[C@H]1CCC(C)CC1")) == S.write(S.parse("CC1CCC(C)CC1"))


def test_marks_are_read_across_ring_bonds():
    assert S.write(S.parse(r"C1CCC/C=C/CC1")) == S.write(S.parse(r"C/1=C\CCCCCC1")) == S.write(S.parse(r"C1=C\CCCCCC\1"))
    assert S.parse(r"C/1=C\CCCCC1").ez == [0] * 7  # rings of seven have no marks


def test_places_without_marks_are_those_of_the_graph():
    m = S.parse("CC(C)O")
    near, first = ranks.started(m, [0, 1, 2, 3])
    place = ranks.broken(near, first)
    assert sorted(place.values()) == [0, 1, 2, 3]


def test_operators(spark):
    rows = [(1, r"C[C@H](C)O"), (2, r"CC=CC(C)O"), (3, "nonsense"), (4, None), (5, r"C/C=C/C"), (6, "CC=CC=CC"), (7, "OC(C(O)C(=O)O)C(=O)O"), (8, "")]
    df = spark.createDataFrame(rows, "row_idx int, smiles string")
    clean = {r.row_idx: (r.n_marks, r.n_kept, r.cleaned) for r in stereo.cleaned(df).collect()}
    assert set(clean) == {1, 2, 5, 6, 7} and clean[1] == (1, 0, "C(C)(C)O") and clean[5][:2] == (1, 1)
    made = stereo.isomers(M.with_molecules(df)).collect()
    count = {}
    for r in made:
        count[r.id] = count.get(r.id, 0) + 1
        assert S.write(S.parse(r.isomer)) == r.isomer
    assert count == {1: 1, 2: 4, 5: 1, 6: 3, 7: 3}
    assert {r.isomer for r in made if r.id == 5} == {clean[5][2]}
    turned = stereo.isomers(M.with_molecules(df), only_unassigned=False).where("id = 5").collect()
    assert len(turned) == 2
    assert stereo.isomers(M.with_molecules(df), most=2).where("id = 2").count() == 2
    labels = {r.row_idx: r.cip for r in stereo.assign(df).collect()}
    assert labels[3] is None and labels[4] is None and labels[8] is None and labels[1].atoms == [] and labels[5].bonds == [(1, 2, "E")]
    assert stereo.assign(df.limit(0)).count() == 0


def test_validation_warns_of_open_marks(spark):
    texts = ["CC=CC(C)O", r"C/C=C/C", "CC=CC=CC", "CC=C(C)C", "C1CCC=CCC1", "C1CCCC=CCC1", "CC(C)=O", "no molecule", None, "CC=NO", "C=CC"]
    got = {r.smiles: r.warnings for r in molecules.validate(spark.createDataFrame([(t,) for t in texts], "smiles string"), stereo=True).collect()}
    one = ["1 undefined double bonds"]
    want = {"CC=CC(C)O": ["1 undefined stereocenters", *one], "CC=CC=CC": ["2 undefined double bonds"], "C1CCCC=CCC1": one, "CC=NO": one}
    assert got == {t: want.get(t, []) for t in texts}


def test_pieces_leave_out_marks_of_cut_atoms(spark):
    df = spark.createDataFrame([(1, r"C[C@H](O)c1ccccc1"), (2, r"C[C@H](N)C(=O)[O-].[Na+]")], "row_idx int, smiles string")
    frames = rewrite.scaffolds(M.with_molecules(df)).collect()
    assert "@" not in frames[0].scaffold
    for kept, want in ((True, r"C[C@H](N)C(=O)O"), (False, "CC(N)C(=O)O")):
        out = {r.row_idx: r.standardized for r in rewrite.standardize(df, stereo=kept).collect()}
        assert out[2] == S.write(S.parse(want))
