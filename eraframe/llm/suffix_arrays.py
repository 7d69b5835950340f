"""Suffix arrays, common prefixes and content anchors of one shard, in numpy."""

from __future__ import annotations

import numpy as np

BITS = 21
_LOW = np.uint64((1 << BITS) - 1)
_B = np.uint64(BITS)
_FIRST = 5  # bytes that the first sort looks at


def _group_starts(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def _shared(new: np.ndarray) -> np.ndarray:
    """Whether an entry's group has more than one member."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return ~alone


def repeated_starts(data: np.ndarray, allowed: np.ndarray, length: int) -> np.ndarray:
    """Which ``allowed`` positions start a string of ``length`` bytes that also starts
    at another allowed position.

    Larsson-Sadakane refinement: suffixes are sorted by their first bytes, then groups
    that are still equal by the rank of what follows, doubling the depth; sorted ones
    are left alone. Neighbours in the last groups get their common prefix as Kasai does,
    in text order: where the neighbour moves along with the position, the prefix
    shrinks by one, so only the ends of such runs are compared.
    """
    n = len(data)
    marked = np.zeros(n, dtype=bool)
    if n < 2 or not allowed.any():
        return marked
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    keys = np.zeros(n, dtype=np.uint64)
    for i in range(_FIRST):
        keys = keys << np.uint64(8) | padded[i : n + i]
    packed = keys << _B | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & _LOW).astype(np.int64)
    new = _group_starts(packed >> _B)
    slots = np.arange(n, dtype=np.int64)
    heads = np.maximum.accumulate(np.where(new, slots, 0))
    rank = np.zeros(n + 1, dtype=np.int64)  # from 1; 0 behind the end
    rank[order] = heads + 1
    slots = slots[_shared(new)]
    depth = _FIRST
    while len(slots) and depth * 2 < length:
        slots, _ = _refine(order, rank, slots, depth, n)
        depth *= 2
    if not len(slots):
        return marked
    # All groups are equal to ``depth`` bytes, which is at least half of ``length``.
    groups = rank[order[slots]]
    _, _ = _refine(order, rank, slots, depth, n)
    places = order[slots]
    usable = allowed[places]
    places, groups = places[usable], groups[usable]
    pair = groups[1:] == groups[:-1]
    before = np.full(n + 1, -2, dtype=np.int64)
    before[places[1:][pair]] = places[:-1][pair]
    at = np.flatnonzero(before[:n] >= 0)
    if not len(at):
        return marked
    last = np.ones(len(at), dtype=bool)
    last[:-1] = (at[1:] != at[:-1] + 1) | (before[at[1:]] != before[at[:-1]] + 1)
    ends = at[last]
    others = before[ends]
    common = np.full(len(ends), depth, dtype=np.int64)
    going = np.arange(len(ends))
    more = np.concatenate([data, np.zeros(1, dtype=np.uint8)])
    for step in range(depth, length):
        a, b = ends[going] + step, others[going] + step
        going = going[(np.maximum(a, b) < n) & (more[np.minimum(a, n)] == more[np.minimum(b, n)])]
        if not len(going):
            break
        common[going] = step + 1
    run = np.cumsum(last) - last
    prefix = ends[run] - at + common[run]
    hit = at[prefix >= length]
    marked[hit] = True
    marked[before[hit]] = True
    return marked


def _refine(
    order: np.ndarray, rank: np.ndarray, slots: np.ndarray, depth: int, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the groups at ``slots`` by the rank ``depth`` further on, in place.

    Returns the slots of groups that are still shared, and which were looked at."""
    places = order[slots]
    following = rank[np.minimum(places + depth, n)]
    packed = (
        (rank[places] - 1).astype(np.uint64) << np.uint64(2 * BITS)
        | following.astype(np.uint64) << _B
        | places.astype(np.uint64)
    )
    packed.sort()
    places = (packed & _LOW).astype(np.int64)
    order[slots] = places
    new = _group_starts(packed >> _B)
    rank[places] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
    shared = _shared(new)
    return slots[shared], shared


_RANDOM = np.random.default_rng(20)
_BYTES = [_RANDOM.integers(1, 2**63, 256, dtype=np.uint64) for _ in range(2)]
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(factor, done, 1 << 64))
        done += more
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's factor and of its inverse, at least ``n`` of them."""
    if which not in _TABLES or len(_TABLES[which][0]) < n:
        factor = int(_ODD[which])
        _TABLES[which] = (_powers(factor, n), _powers(pow(factor, -1, 1 << 64), n))
    return _TABLES[which]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any substring from sums over prefixes, modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        powers, self.inverse = _tables(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[which][data] * powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def all_of(self, length: int) -> np.ndarray:
        """Of every substring of a length, by start."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def anchors(hashes: Hashes, gram: int, length: int) -> np.ndarray:
    """The anchor of the string of ``length`` bytes at each start: the place of the
    smallest hash of its substrings of ``gram`` bytes, the first one of equal ones.

    It depends on the string alone, so equal strings have it at the same distance.
    """
    values = hashes.all_of(gram)
    least = values >> _B << _B | np.arange(len(values), dtype=np.uint64)
    window, done = length - gram + 1, 1
    while done * 2 <= window:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = window - done
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & _LOW).astype(np.int64)


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of consecutive numbers in a sorted array."""
    if not len(places):
        return places, places
    first = np.ones(len(places), dtype=bool)
    first[1:] = places[1:] != places[:-1] + 1
    at = np.flatnonzero(first)
    return places[at], np.diff(np.append(at, len(places)))
