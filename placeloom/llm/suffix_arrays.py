"""Suffix arrays of byte strings in numpy.

``suffix_order`` refines groups of suffixes that agree on a prefix, doubling its
length each round and sorting only the groups not yet single (Larsson and
Sadakane), until all are.
``common_prefixes`` is the method of Kasai et al.: in text order the common prefix
of a suffix with its predecessor shrinks by one at most, so each comparison goes on
where the last one ended. Many stretches of the text are walked side by side.
"""

from __future__ import annotations

import numpy as np

_LANE = 256


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in their order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # The first eight bytes make the first key. Past the end counts as the byte 0, so
    # suffixes shorter than that tie with longer ones and are parted in the next round.
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    # A suffix's rank is the place of the first of its group.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    reached = 8
    while True:
        last = np.concatenate([new[1:], [True]])
        unsorted = np.flatnonzero(~(new & last))  # places in groups of two or more
        if not len(unsorted):
            break
        members = order[unsorted]
        group = rank[members]
        ahead = members + reached
        next_rank = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        again = np.lexsort((next_rank, group))
        members, group, next_rank = members[again], group[again], next_rank[again]
        order[unsorted] = members
        changed = np.concatenate([[True], (group[1:] != group[:-1]) | (next_rank[1:] != next_rank[:-1])])
        new[unsorted] = changed
        place = np.where(changed, unsorted, 0)
        rank[members] = np.maximum.accumulate(place)
        reached *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Per place in ``order`` the common prefix with the place before, up to ``most`` bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    # Bytes past the end differ from all others: each side has its own.
    left = np.concatenate([data.astype(np.int16), np.full(most + 1, -1, np.int16)])
    right = np.concatenate([data.astype(np.int16), np.full(most + 1, -2, np.int16)])
    lanes = np.arange(0, n, _LANE)
    at = lanes.copy()
    ends = np.minimum(lanes + _LANE, n)
    length = np.zeros(len(lanes), np.int64)
    found = np.zeros(n, np.int64)
    while len(at):
        other = before[at]
        open_ = (other >= 0) & (length < most)
        open_[open_] = left[at[open_] + length[open_]] == right[other[open_] + length[open_]]
        length[open_] += 1
        done = ~open_
        found[at[done]] = np.where(other[done] >= 0, length[done], 0)
        length[done] = np.where(other[done] >= 0, np.maximum(length[done] - 1, 0), 0)
        at[done] += 1
        live = at < ends
        if not live.all():
            at, ends, length = at[live], ends[live], length[live]
    return found[order]
