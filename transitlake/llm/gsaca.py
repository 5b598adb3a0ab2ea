"""Suffix array by linear grouping (after U. Baier, "Linear-time Suffix
Sorting", CPM 2016).

Phase 1 groups the suffixes by their longest Lyndon prefix.  Groups are taken
in descending order; for every suffix s of the group the previous smaller
suffix p (the last one before s in a lower group) is found by following the
pointers of suffixes already done.  The prefix of p grows by the group's prefix
once for each s that points to it, so p moves to a new group directly above
its old one, further up the more suffixes point to it.

Phase 2 emits the order: the order of the suffixes within a group is that of
the suffixes that follow their Lyndon prefixes, so reading the array upward,
each suffix places the ones before it, along the same pointers, at the next
free place of their groups.  Nothing is renamed or sorted recursively."""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    n = len(text)
    if not n:
        return []
    members: list[list[int]] = []
    of_byte: dict[int, int] = {}
    group = [0] * n
    for i, b in enumerate(text):
        g = of_byte.get(b)
        if g is None:
            g = of_byte[b] = len(members)
            members.append([])
        members[g].append(i)
        group[i] = g
    order = [of_byte[b] for b in sorted(of_byte)]
    down = {g: lower for g, lower in zip(order, [-1, *order])}
    up = {g: higher for g, higher in zip(order, [*order[1:], -1])}
    prev = [-2] * n  # -2: not done yet; -1: no smaller suffix before
    final: list[list[int]] = []
    top = order[-1]
    while top != -1:
        mine = [s for s in members[top] if group[s] == top]  # the others have moved up
        if mine:
            final.append(mine)
        moved: dict[tuple[int, int], list[int]] = {}
        last, count = -1, 0
        for s in mine:
            p = s - 1
            while p >= 0 and prev[p] != -2:
                p = prev[p]
            prev[s] = p
            if p == last:  # positions ascend, so equal pointers follow each other
                count += 1
            else:
                if last >= 0:
                    moved.setdefault((group[last], count), []).append(last)
                last, count = p, 1
        if last >= 0:
            moved.setdefault((group[last], count), []).append(last)
        for old, count in sorted(moved, reverse=True):  # each directly above the old group: fewer pointers lower
            new = len(members)
            members.append(moved[old, count])
            for p in members[new]:
                group[p] = new
            higher = up[old]
            down[new], up[new], up[old] = old, higher, new
            down[higher] = new
        top = down[top]

    front, at = {}, 0
    for mine in reversed(final):
        front[group[mine[0]]] = at
        at += len(mine)
    out, placed = [0] * n, bytearray(n)
    for i in range(-1, n):
        s = (out[i] if i >= 0 else n) - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            s = prev[s]
    return out
