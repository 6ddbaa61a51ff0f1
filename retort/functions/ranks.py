"""Places of a molecule's atoms that do not depend on how it was written."""

from __future__ import annotations


def dense(key: dict) -> dict[int, int]:
    place = {k: n for n, k in enumerate(sorted(set(map(_frozen, key.values()))))}
    return {i: place[_frozen(k)] for i, k in key.items()}


def _frozen(k):
    return tuple(map(_frozen, k)) if isinstance(k, (list, tuple)) else k


def started(m, keep: list[int]) -> tuple[dict, dict[int, int]]:
    """Neighbours with bond orders, and first places, of the kept atoms."""
    inside = set(keep)
    near = {i: [(v, m.bonds[b][2]) for v, b in m.near[i] if v in inside] for i in keep}
    return near, dense({i: (m.z[i], m.arom[i], m.charge[i], m.h[i], m.iso[i], m.label[i], len(near[i]), sum(i in r for r in m.rings)) for i in keep})


def refined(near: dict, rank: dict[int, int]) -> dict[int, int]:
    """Places told apart by those of neighbours, as far as that goes."""
    while True:
        new = dense({i: (rank[i], sorted((rank[v], o) for v, o in near[i])) for i in rank})
        if new == rank:
            return rank
        rank = new


def before(rank: dict[int, int], x: int) -> dict[int, int]:
    """Places with x ahead of the atoms that share its place."""
    return dense({i: (r, i != x and r == rank[x]) for i, r in rank.items()})


def broken(near: dict, rank: dict[int, int]) -> dict[int, int]:
    """A place for each atom: ties are broken one at a time, for any of the atoms, as they are symmetric."""
    while True:
        rank = refined(near, rank)
        if len(set(rank.values())) == len(rank):
            return rank
        first: dict[int, int] = {}
        tied = min(r for i, r in rank.items() if first.setdefault(r, i) != i)
        rank = before(rank, first[tied])
