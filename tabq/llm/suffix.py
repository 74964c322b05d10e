"""Suffix arrays by linear grouping, of many small texts at once.

Suffixes are grouped by the longest Lyndon word that begins them. First, groups are taken from the largest down: each
member points to the nearest earlier suffix of a smaller group, and the suffixes pointed to move, by how many point to
them, into groups right behind their own, their prefix being longer by what they were pointed to from. Then the order
within every group follows, from the smallest up, from the ranks of the suffixes that come after the common prefix,
which lie in smaller groups; nothing is renamed and no smaller problem is solved.

The texts are independent, so one step takes one group of every text, with numpy over all of them.
"""

from __future__ import annotations

import numpy as np

from .hashing import ranges


def suffix_ranks(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The place of every suffix among those of its text, from the text's place in ``symbols`` on.

    ``bounds`` has the texts' first symbols and the end; every text ends in a 0 and has none elsewhere.
    """
    n = len(symbols)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    low = bounds[:-1][text]
    sa = np.lexsort((symbols, text))
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    key = text * np.int64(int(symbols.max(initial=0)) + 1) + symbols
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    starts = np.flatnonzero(new)
    size = np.zeros(n + 1, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(starts, size[starts])
    length = np.ones(n, np.int64)
    before = np.full(n, -1, np.int64)
    nearest = np.full(n, -1, np.int64)
    marked = np.zeros(n, bool)

    current = group[sa[bounds[1:] - 1]]
    while len(current):
        members = sa[ranges(current, size[current])]
        own, floor = group[members], low[members]
        p = members - 1
        todo = np.flatnonzero(p >= floor)
        todo = todo[group[p[todo]] > own[todo]]
        while len(todo):
            p[todo] = before[p[todo]]
            todo = todo[p[todo] >= 0]
            todo = todo[group[p[todo]] > own[todo]]
        p[p < floor] = -1
        nearest[members] = p
        todo = np.flatnonzero(p >= 0)
        todo = todo[group[p[todo]] == own[todo]]
        while len(todo):  # an earlier member of the same group: what it points to
            p[todo] = nearest[p[todo]]
            todo = todo[p[todo] >= 0]
            todo = todo[group[p[todo]] == own[todo]]
        before[members] = p
        hit = p >= 0
        if hit.any():
            who, first, count = np.unique(p[hit], return_index=True, return_counts=True)
            length[who] += count * length[members[hit][first]]
            old = group[who]
            order = np.lexsort((count, old))
            who, old, count = who[order], old[order], count[order]
            head = np.ones(len(who), bool)
            head[1:] = old[1:] != old[:-1]
            at = np.flatnonzero(head)
            moved = np.diff(np.append(at, len(who)))
            tail = old[at] + size[old[at]] - moved
            slots = np.arange(len(who)) + np.repeat(tail - at, moved)
            # The moved suffixes take their group's last places, those that stay the places this leaves.
            marked[who] = True
            there = sa[slots]
            aside = there[~marked[there]]
            was = place[who]
            free = was[was < np.repeat(tail, moved)]
            sa[free] = aside
            place[aside] = free
            sa[slots] = who
            place[who] = slots
            marked[who] = False
            head[1:] |= count[1:] != count[:-1]
            at2 = np.flatnonzero(head)
            sizes = np.diff(np.append(at2, len(who)))
            size[old[at]] -= moved
            size[slots[at2]] = sizes
            group[who] = np.repeat(slots[at2], sizes)
        current = current[current > low[sa[current]]]
        current = group[sa[current - 1]]

    # Order within the groups, from the smallest up.
    rank = group.copy()
    heads = np.unique(group)
    heads = heads[size[heads] > 1]
    of = text[sa[heads]]
    nth = np.arange(len(heads)) - np.searchsorted(of, of)
    by_step = np.argsort(nth, kind="stable")
    heads, cuts = heads[by_step], np.cumsum(np.append(0, np.bincount(nth)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = ranges(heads[a:b], size[heads[a:b]])
        members = sa[at]
        after, depth, own = members + length[members], np.zeros(len(members), np.int64), group[members]
        # Repeats of the prefix stay in the group: fewer repeats come first, as what then follows is in a smaller one.
        todo = np.flatnonzero(group[after] == own)
        while len(todo):
            after[todo] += length[after[todo]]
            depth[todo] += 1
            todo = todo[group[after[todo]] == own[todo]]
        order = np.lexsort((rank[after], depth, own))
        sa[at] = members[order]
        rank[sa[at]] = at
    return rank
