"""Suffix sorting by linear grouping: Lyndon-prefix groups from the highest down, then each group's order."""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """Suffixes by their longest Lyndon prefix, groups in ascending order, and the length of each prefix.

    Groups begin as the suffixes of one first symbol and are taken from the highest down. When a group is
    taken, its prefix is final. Each member points to the nearest suffix on its left whose group is
    still open (its previous smaller suffix), jumping along the pointers of taken ones. A suffix that c
    members point to has its prefix followed by c copies of the group's, so it moves to a new group just
    above its own, the one with more copies higher; if its whole group would move alike, the group
    stays as it is. Every suffix points once and is jumped over once, up to shortened paths.
    """
    n, top = len(text), max(text, default=-1) + 1
    size, of = [1] * n, list(text)
    members: list[list[int]] = [[] for _ in range(top)]
    for i, c in enumerate(text):
        members[c].append(i)
    alive = [len(m) for m in members]
    # neighbours in the order of groups; the last entry stands above all
    down, up = [*range(-1, top - 1), top - 1], [*range(1, top), top, -1]
    members.append([])
    alive.append(0)
    prev = [-2] * n  # -2: not taken yet
    taken: list[list[int]] = []
    g = top - 1
    while g >= 0:
        group = members[g]
        if len(group) > 1:
            if len(group) != alive[g]:
                group = [i for i in group if of[i] == g]
            group.sort()
        elif group and of[group[0]] != g:
            group = []
        if not group:
            g = down[g]
            continue
        taken.append(group)
        grown = size[group[0]]
        counts: dict[int, int] = {}
        for s in group:
            p = s - 1
            while p >= 0 and (q := prev[p]) != -2:
                p = q
            prev[s] = p
            if p >= 0:
                if p in counts:
                    counts[p] += 1
                else:
                    counts[p] = 1
        if len(counts) == 1:
            for p, c in counts.items():
                h = of[p]
                size[p] += c * grown
                if alive[h] > 1:
                    alive[h] -= 1
                    of[p] = t = len(members)
                    members.append([p])
                    alive.append(1)
                    u = up[h]
                    down.append(h)
                    up.append(u)
                    up[h] = down[u] = t
        elif counts:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, c in counts.items():
                size[p] += c * grown
                key = (of[p], c)
                if key in moved:
                    moved[key].append(p)
                else:
                    moved[key] = [p]
            if len(moved) > 1:
                moved = dict(sorted(moved.items(), reverse=True))
            for (h, c), ps in moved.items():
                if len(ps) < alive[h]:
                    alive[h] -= len(ps)
                    t = len(members)
                    for p in ps:
                        of[p] = t
                    members.append(ps)
                    alive.append(len(ps))
                    u = up[h]
                    down.append(h)
                    up.append(u)
                    up[h] = down[u] = t
        g = down[g]
    taken.reverse()
    return taken, size


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes in ascending order, for non-negative symbols.

    A suffix is its Lyndon prefix followed by its next smaller suffix. Suffixes are met in ascending
    order; the one met sends each suffix that ends its prefix there to the next free place of its
    group. No group is renamed or sorted again.
    """
    groups, size = lyndon_groups(text)
    n = len(text)
    out, of, free = [0] * n, [0] * n, []
    # suffixes of groups of several, by where their prefix ends
    first, more = [-1] * (n + 1), [-1] * n
    at = 0
    for group in groups:
        if len(group) == 1:
            out[at] = group[0]
        else:
            g = len(free)
            free.append(at)
            for i in group:
                j = i + size[i]
                of[i] = g
                more[i] = first[j]
                first[j] = i
        at += len(group)
    i = first[n]
    while i >= 0:
        g = of[i]
        out[free[g]] = i
        free[g] += 1
        i = more[i]
    for k in range(n):
        i = first[out[k]]
        while i >= 0:
            g = of[i]
            out[free[g]] = i
            free[g] += 1
            i = more[i]
    return out
