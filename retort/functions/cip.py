"""R, S, E and Z of one molecule's marks, by the sequence rules on atomic numbers and then masses.

Branches are compared sphere by sphere. A branch is a list of classes of nodes, best first; each sphere's sets of atoms are read
in that order, and split the classes. A double bond or closed ring ends in a copy of the atom without substituents; in an aromatic
ring the copy's number is the mean of the atoms that a double bond may go to. Branches that differ in stereo marks alone tie.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cmp_to_key

from retort.functions import smiles as S
from retort.functions import stereo
from retort.functions.ranks import refined, started

Node = tuple[int, frozenset]  #: an atom and those on the way to it; atom -1: nothing follows


def _copies(m: S.Mol, u: int) -> list[Fraction]:
    """Numbers of the copies that double and triple bonds of u add to it."""
    found = [Fraction(m.z[v]) for v, b in m.near[u] for _ in range(m.bonds[b][2] - 1) if m.bonds[b][2] in (2, 3)]
    if m.arom[u] and S.needs_double(m, u):
        ends = [m.z[v] for v, b in m.near[u] if m.bonds[b][2] == S.AROMATIC and S.needs_double(m, v)]
        found += [Fraction(sum(ends), len(ends))] if ends else []
    return found


def _next(m: S.Mol, node: Node, before: int, by_mass: bool) -> list[tuple[Fraction, Node]]:
    """(value, node) of what follows a node, without the bond it was reached by."""
    u, path = node
    if u < 0:
        return []
    value = (lambda v: Fraction(m.iso[v])) if by_mass else (lambda v: Fraction(m.z[v]))
    out = [(value(v), (-1 if v in path else v, path | {v})) for v, _ in m.near[u] if v != before]
    ends = [Fraction(1)] * m.h[u] + _copies(m, u)
    return out + [(Fraction(0) if by_mass else x, (-1, path)) for x in ends]


def _compare(m: S.Mol, center: int, x: int, y: int, by_mass: bool = False) -> int:
    """Over 0 if x ranks above y, neighbours of center."""
    number = m.iso if by_mass else m.z
    if number[x] != number[y]:
        return number[x] - number[y]
    sides = [[[((v, frozenset((center, v))), center)]] for v in (x, y)]
    while any(sides):
        keys = []
        for n, classes in enumerate(sides):
            said, after = [], []
            for nodes in classes:
                follows = [(sorted((v for v, _ in got), reverse=True), node[0], got) for node, came in nodes for got in [_next(m, node, came, by_mass)]]
                follows.sort(key=lambda f: f[0], reverse=True)
                said += [f[0] for f in follows]
                for key in sorted({tuple(f[0]) for f in follows}, reverse=True):
                    alike = [(v, (node, u)) for k, u, got in follows if tuple(k) == key for v, node in got]
                    after += [[node for w, node in alike if w == v] for v in sorted({v for v, _ in alike}, reverse=True)]
            keys.append(said)
            sides[n] = after
        if keys[0] != keys[1]:
            return 1 if keys[0] > keys[1] else -1
    return 0


def _ranked(m: S.Mol, center: int, atoms: list[int], alike: dict[int, int]) -> list[int] | None:
    """Atoms by falling rank; None if two tie. Atoms that no difference in the molecule tells apart are not compared."""
    if len({alike[v] for v in atoms}) < len(atoms):
        return None
    tie = []

    def order(x: int, y: int) -> int:
        found = _compare(m, center, x, y) or _compare(m, center, x, y, by_mass=True)
        tie.extend([x] * (not found))
        return -found

    found = sorted(atoms, key=cmp_to_key(order))
    return None if tie else found


def labels(m: S.Mol) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
    """(atom, R or S) and (atom, atom, E or Z); marks without four, or two, different branches have none."""
    every = list(range(len(m.z)))
    alike = refined(*started(m, every))
    atoms, bonds = [], []
    for (kind, n), value in sorted(stereo.marks_within(m, set(every)).items()):
        groups = [_ranked(m, c, vs, alike) for c, vs in stereo.groups(m, (kind, n))]
        if None in groups:
            continue
        place = {v: k for vs in groups for k, v in enumerate(vs)}
        found = stereo.turned(m, (kind, n), value, lambda v: place.get(v, len(place)))
        if kind == "atom":
            atoms.append((n, "SR"[found - 1]))
        else:
            bonds.append((*m.bonds[n][:2], "ZE"[found - 1]))
    return atoms, bonds
