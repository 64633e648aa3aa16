"""Suffix array by grouping: linear time, no renaming, no recursion.

Phase 1 keeps suffixes in ordered groups, at first by their first symbol, and takes the groups in descending
order.  For each suffix of a group it finds the previous smaller suffix (the next position to the left whose group
is lower); those predecessors are moved, by how often they were found, into new groups right above their own.
At the end a group holds the suffixes of one Lyndon prefix.  Phase 2 reads the order off: walking it in ascending
order, each suffix places the one before it, and from there along the previous-smaller pointers, at the next free
place of its group.
"""

from __future__ import annotations

import numpy as np


def grouping(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of an integer text in ascending order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # A last symbol below all others.
    codes, first = np.unique(np.asarray(text), return_inverse=True)
    group = (first + 1).tolist() + [0]
    size = n + 1
    members: list[list[int]] = [[n]]
    order = np.argsort(first, kind="stable")
    ends = np.cumsum(np.bincount(first)).tolist()
    order = order.tolist()
    members += [order[a:b] for a, b in zip([0, *ends], ends)]
    below = list(range(-1, len(codes)))  # the next lower group of each group
    above = [*range(1, len(codes) + 1), -1]
    pointer = [-2] * size  # previous smaller suffix; -2: not known yet
    at = len(codes)
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = own
        if len(own) == 1:
            i = own[0]
            j = i - 1
            while j >= 0 and pointer[j] != -2:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:  # one predecessor, found once
                new, g = len(members), group[j]
                up = above[g]
                members.append([j])
                group[j] = new
                below.append(g)
                above.append(up)
                above[g] = new
                below[up] = new
        elif own:
            own.sort()
            found: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and pointer[j] != -2:
                    j = pointer[j]
                pointer[i] = j
                if j >= 0:
                    found[j] = found.get(j, 0) + 1
            if found:
                by: dict[tuple[int, int], list[int]] = {}
                for j, times in found.items():
                    by.setdefault((times, group[j]), []).append(j)
                for times, g in sorted(by, reverse=True) if len(by) > 1 else by:
                    moved = by[times, g]
                    new, up = len(members), above[g]
                    members.append(moved)
                    for j in moved:
                        group[j] = new
                    below.append(g)
                    above.append(up)
                    above[g] = new
                    below[up] = new
        at = below[at]

    free, place, g = [0] * len(members), 0, 0
    while g >= 0:
        free[g] = place
        place += len(members[g])
        g = above[g]
    out = [-1] * size
    out[0] = n
    done = bytearray(size)
    done[n] = 1
    for i in range(size):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = pointer[j]
    return np.array(out[1:], np.int64)
