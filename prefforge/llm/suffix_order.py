"""Suffix arrays by linear grouping.

Every suffix belongs to the group of its Lyndon prefix, the longest Lyndon word that it begins with. Phase 1 starts from the
groups of single symbols and goes through them from the largest to the smallest: each member points back to the previous
suffix of a smaller group, and that one's prefix grows by the member's, once for each member that points to it. Phase 2
emits each group's order from left to right: the suffixes that a finished suffix is the next smaller one of are found by the
same pointers and take the next places of their groups. No renaming and no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of integer symbols >= 1; an end smaller than all of them is understood and left out."""
    n = len(symbols) + 1
    if n == 1:
        return np.empty(0, np.int64)
    text = np.append(np.asarray(symbols, np.int64), 0)
    order = np.argsort(text, kind="stable")
    first = np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1]))
    sizes = np.diff(np.append(first, n))
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    start = np.empty(n, np.int64)
    start[order] = np.repeat(first, sizes)
    size = np.zeros(n, np.int64)
    size[first] = sizes
    line, place, group, size = order.tolist(), at.tolist(), start.tolist(), size.tolist()
    back = _group(line, place, group, size, n)
    return np.array(_emit(group, back, n)[1:], np.int64)


def _group(line: list[int], place: list[int], group: list[int], size: list[int], n: int) -> list[int]:
    """Phase 1. line: suffixes by group; place: where each stands in it; group: the start of its group; size: of the group
    that starts there. Refines them and returns the pointers to the previous suffix of a smaller group."""
    back = [-1] * n
    end = n - 1
    while end > 0:
        here = group[line[end]]
        if here == end:  # a group of one
            s = line[end]
            p = s - 1
            while p >= 0 and group[p] > here:
                p = back[p]
            back[s] = p
            if p >= 0:
                g = group[p]
                k = size[g] - 1
                if k:
                    # p goes to the end of its group, and is a group of its own there
                    e = g + k
                    q = line[e]
                    i = place[p]
                    line[i], place[q] = q, i
                    line[e], place[p] = p, e
                    size[g] = k
                    size[e] = 1
                    group[p] = e
            end -= 1
            continue
        pointed: dict[int, int] = {}
        for s in sorted(line[here : end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= here:
                p = back[p]
            back[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1 or all(c == 1 for c in pointed.values()):
            _grow(pointed, line, place, group, size)
        else:
            by_count: dict[int, list[int]] = {}
            for p, c in pointed.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                _grow(by_count[c], line, place, group, size)
        end = here - 1
    return back


def _grow(suffixes, line: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Move suffixes to the ends of their groups, where they are groups of their own."""
    moved: dict[int, int] = {}
    for p in suffixes:
        g = group[p]
        k = size[g] - 1
        e = g + k
        q = line[e]
        i = place[p]
        line[i], place[q] = q, i
        line[e], place[p] = p, e
        size[g] = k
        moved[g] = moved.get(g, 0) + 1
    for p in suffixes:
        g = group[p]
        group[p] = g + size[g]
    for g, k in moved.items():
        size[g + size[g]] = k


def _emit(group: list[int], back: list[int], n: int) -> list[int]:
    """Phase 2: the order within each group."""
    out = [-1] * n
    out[0] = n - 1
    free = list(range(n))  # the next place of the group that starts here
    done = [False] * n
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            k = free[g]
            out[k] = s
            free[g] = k + 1
            done[s] = True
            s = back[s]
    return out
