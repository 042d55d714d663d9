"""Suffix arrays of many short strings, by linear grouping of Lyndon prefixes.

First pass: suffixes start in groups by their first byte, and groups are taken in descending order. The highest that is
left is final, its members' common word w is their Lyndon prefix. For each member the previous smaller suffix p is found
by following pointers past suffixes of higher groups. The word of p ends where the member begins: p leaves its group and
moves up into a new group of word + w^m, right above, where m members follow each other from there.

Second pass: suffixes are put in ascending order. Each one that stands (ends of strings first) puts those whose Lyndon
prefix ends there next in their groups, following the same pointers. There is no recursion and no renaming, and either
pass takes each pointer once.

A suffix ends with its string, and an end is smaller than any byte; equal suffixes stand in order of their strings.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(data: bytes, starts: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Previous smaller suffix (-1: none in its string), length of Lyndon prefix, and group of each suffix.

    Also the groups in ascending order, and the size of each. starts: where strings begin.
    """
    n = len(data)
    first = bytearray(n + 1)
    for s in starts:
        first[s] = 1
    values = np.frombuffer(data, np.uint8)
    by_byte = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[by_byte])) + 1
    members = [x.tolist() for x in np.split(by_byte, cuts)] if n else []
    group = np.cumsum(np.bincount(values, minlength=256) > 0)[values].tolist() if n else []
    group = [g - 1 for g in group]
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    word = [1] * len(members)
    previous, done, length = [-1] * n, bytearray(n), [1] * n
    ascending: list[int] = []
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        if own:
            ascending.append(g)
            own.sort()
            size = word[g]
            followers: dict[int, int] = {}
            for i in own:
                done[i] = 1
                length[i] = size
                p = i
                if first[i]:
                    continue
                p = i - 1
                while p >= 0 and done[p] and group[p] != g:
                    p = previous[p]
                if p >= 0:
                    if done[p]:
                        p = previous[p]
                    if p >= 0:
                        previous[i] = p
                        followers[p] = followers.get(p, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for p, m in followers.items():
                moves.setdefault((group[p], m), []).append(p)
            tops: dict[int, int] = {}
            for u, m in sorted(moves):  # counts of one group ascend, so each new group goes on top of the last
                new, top = len(members), tops.get(u, u)
                tops[u] = new
                members.append(moves[u, m])
                word.append(word[u] + m * size)
                below.append(top)
                above.append(above[top])
                below[above[top]] = new
                above[top] = new
                for p in moves[u, m]:
                    group[p] = new
        g = below[g]
    ascending.reverse()
    return previous, length, group, ascending, [len(m) for m in members]


def suffix_array(data: bytes, starts: list[int]) -> np.ndarray:
    """Starts of all suffixes of the strings of data, in order."""
    previous, length, group, ascending, sizes = lyndon_groups(data, starts)
    slot = [0] * len(sizes)
    total = 0
    for g in ascending:
        slot[g] = total
        total += sizes[g]
    out = [0] * len(data)
    first = bytearray(len(data) + 1)
    for s in starts:
        first[s] = 1

    def put(s: int, p: int) -> None:
        while p >= 0 and p + length[p] == s:
            g = group[p]
            out[slot[g]] = p
            slot[g] += 1
            p = previous[p]

    for e in [*starts[1:], len(data)] if starts else ():
        put(e, e - 1)
    for k in range(len(data)):
        s = out[k]
        if not first[s]:
            put(s, s - 1)
    return np.array(out, np.int64)
