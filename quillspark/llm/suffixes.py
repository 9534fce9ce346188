"""Suffix arrays by linear grouping: suffixes are gathered by their Lyndon prefix, highest group first, then listed group by
group; nothing is renamed or sorted again by recursion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> np.ndarray:
    """Starts of all suffixes of symbols in ascending order; a suffix that another one begins with comes first.

    Phase 1 keeps the suffixes dealt in groups, ordered among themselves, where a group is the place of its first member. It
    takes the groups from the highest down. Of each member, the previous-smaller pointer leads to the last suffix before it
    in a lower group, whose prefix is extended by the group's own: these suffixes move, within their group, to a new one
    right after it, those that more members point to further up. In the end, groups are suffixes of one Lyndon prefix.
    Phase 2 reads the array from the lowest on: the suffixes whose next smaller suffix is the one read are the one before it
    and those that previous-smaller pointers lead to from there; each is put at the front of what is left of its group.
    """
    n = len(symbols)
    s = np.concatenate((np.asarray(symbols, np.int64) + 1, [0])) if n else np.zeros(1, np.int64)  # a lowest one at the end
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    fresh = np.flatnonzero(np.diff(ranked, prepend=-1))
    sizes = np.diff(np.append(fresh, n + 1))
    size = dict(zip(fresh.tolist(), sizes.tolist()))
    group = np.empty(n + 1, np.int64)
    group[order] = np.repeat(fresh, sizes)
    where = np.empty(n + 1, np.int64)
    where[order] = np.arange(n + 1)
    array, group, where = order.tolist(), group.tolist(), where.tolist()
    before = list(range(-1, n))  # where to look for a lower group; leaps over what has been seen to be no lower
    previous = [-1] * (n + 1)
    end = n + 1
    while end:
        own = group[array[end - 1]]
        members = array[own:end]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            j = before[i]
            if j >= 0 and group[j] >= own:
                passed = [i]
                while j >= 0 and group[j] >= own:
                    passed.append(j)
                    j = before[j]
                for x in passed:
                    before[x] = j
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = own
        if not pointed:
            continue
        most = max(pointed.values())
        by_count = [list(pointed)] if most == min(pointed.values()) else [[j for j, c in pointed.items() if c == k] for k in sorted(set(pointed.values()), reverse=True)]
        for chosen in by_count:
            moved: dict[int, int] = {}
            for j in chosen:
                g = group[j]
                moved[g] = m = moved.get(g, 0) + 1
                last, at = g + size[g] - m, where[j]
                other = array[last]
                array[at], where[other] = other, at
                array[last], where[j] = j, last
            for g, m in moved.items():
                rest = size[g] - m
                if rest:
                    start = g + rest
                    size[g], size[start] = rest, m
                    for j in array[start : start + m]:
                        group[j] = start
    front: dict[int, int] = {}
    found = [-1] * (n + 1)
    found[0] = n
    placed = bytearray(n + 1)
    for i in range(n + 1):
        j = found[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = front.get(g, g)
            found[at], front[g], placed[j] = j, at + 1, 1
            j = previous[j]
    return np.array(found[1:], np.int64)
