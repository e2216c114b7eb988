"""Suffix arrays by linear grouping, many strings at a time.

Phase one keeps suffixes in groups, ordered by a common prefix, and processes groups from the greatest down. When its
turn comes, a group's prefix is the longest Lyndon prefix of its suffixes. Each of them has a previous smaller pointer:
the nearest suffix to its left in a lesser group. A suffix that k of them point to has that prefix k times behind its
own, so it moves behind the rest of its group, into a new group for each k, greater k last. Phase two emits the order:
from the least suffix on, the suffix in front of each one emitted, and then along the previous smaller pointers, takes
the next free place of its group, until one is reached that has its place. No names are assigned again and nothing
recurses; each suffix is moved once for each group that it points from.

Strings are handled in step: in every round each of them processes its own greatest group, and all are updated by the
same array operations.
"""

from __future__ import annotations

import numpy as np

from . import common


def suffix_arrays(strings: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For strings of integers >= 0 (one behind another in `strings`), the suffix array of each, in the same places.

    Suffix positions are counted from each string's own start. A shorter suffix is less than one that it begins.
    """
    count = len(lengths)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    # each string is laid out with a guard in front and a least symbol behind
    base = np.concatenate(([0], np.cumsum(lengths + 2)[:-1])) + 1  # first suffix of each
    n = lengths + 1
    size = int((lengths + 2).sum())
    owner = np.repeat(np.arange(count), lengths + 2)
    text = np.zeros(size, np.int64)
    where = common.ranges(base, lengths)
    text[where] = strings[common.ranges(starts, lengths)] + 1
    guard = base - 1
    # ranks are places in the same layout; a group is named by its first place
    suffix = common.ranges(base, n)
    order_in = suffix[np.lexsort((text[suffix], owner[suffix]))]
    order = np.full(size, -1, np.int64)
    order[suffix] = order_in
    rank = np.full(size, -1, np.int64)
    rank[order_in] = suffix
    first = np.ones(len(order_in), bool)
    first[1:] = (text[order_in[1:]] != text[order_in[:-1]]) | (owner[order_in[1:]] != owner[order_in[:-1]])
    heads = np.flatnonzero(first)
    group = np.full(size, -1, np.int64)  # by suffix; guards stay below all
    sizes = np.diff(np.append(heads, len(order_in)))
    group[order_in] = np.repeat(suffix[heads], sizes)
    group_size = np.zeros(size, np.int64)
    group_size[suffix[heads]] = sizes
    before = np.arange(size) - 1
    moved = np.zeros(size, bool)
    end = base + n  # places from here on are processed
    live = np.arange(count)
    while len(live):
        last = order[end[live] - 1]
        begin = group[last]
        sizes = end[live] - begin
        end[live] = begin
        members = order[common.ranges(begin, sizes)]
        turn = np.repeat(begin, sizes)
        live = live[begin > base[live]]
        # previous smaller pointers, by jumping along those that are known
        at, open_ = before[members], np.arange(len(members))
        while True:
            open_ = open_[group[at[open_]] >= turn[open_]]
            if not len(open_):
                break
            at[open_] = before[at[open_]]
            before[members[open_]] = at[open_]
        target = at[group[at] >= 0]
        if not len(target):
            continue
        target.sort()
        new = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        times = np.diff(np.append(new, len(target)))
        target = target[new]
        mine = group[target]
        by = np.lexsort((times, mine))
        target, times, mine = target[by], times[by], mine[by]
        block = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        moving = np.diff(np.append(block, len(mine)))
        own = mine[block]
        tail = own + group_size[own] - moving
        slots = common.ranges(tail, moving)
        # what stands in the tail and stays changes places with what moves from further in front
        moved[target] = True
        there = order[slots]
        there = there[~moved[there]]
        moved[target] = False
        here = rank[target]
        here = here[here < np.repeat(tail, moving)]
        order[here], rank[there] = there, here
        order[slots], rank[target] = target, slots
        fresh = np.flatnonzero(np.concatenate(([True], (mine[1:] != mine[:-1]) | (times[1:] != times[:-1]))))
        group_size[own] -= moving
        sizes = np.diff(np.append(fresh, len(mine)))
        group[target] = np.repeat(slots[fresh], sizes)
        group_size[slots[fresh]] = sizes
    # phase two: every string follows its own chain, one step in each round
    free = np.arange(size)
    placed = np.zeros(size, bool)
    placed[guard] = True
    out = np.full(size, -1, np.int64)
    sentinel = base + lengths
    out[base], placed[sentinel] = sentinel, True
    place, current, live = base.copy(), sentinel - 1, np.arange(count)
    while len(live):
        j = current[live]
        done = placed[j]
        go = ~done
        k, s = live[go], j[go]
        g = group[s]
        out[free[g]] = s
        free[g] += 1
        placed[s] = True
        current[k] = before[s]
        k = live[done]
        if len(k):
            place[k] += 1
            k = k[place[k] < base[k] + n[k]]
            current[k] = out[place[k]] - 1
            live = live[go | np.isin(live, k, assume_unique=True)] if len(k) < int(done.sum()) else live
    found = out[common.ranges(base + 1, lengths)]
    return found - np.repeat(base, lengths)


def suffix_array(values: np.ndarray) -> np.ndarray:
    """The suffix array of one string of integers."""
    values = np.asarray(values, np.int64)
    return suffix_arrays(values, np.zeros(1, np.int64), np.array([len(values)]))
