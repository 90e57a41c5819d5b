"""Suffix sorting by grouping, for many small problems at once.

The linear construction in two phases. First, suffixes are grouped by their Lyndon prefixes: groups are taken in
descending order; for each of its suffixes the previous smaller suffix is found by following pointers over what is
known to be larger, and those previous suffixes move into new groups right above their old ones, by how many suffixes
point at them. Then each group's order is emitted: in ascending order, every suffix places those for which it is the
next smaller one at the next free place of their groups. Nothing is renamed and nothing recurses.

Problems are independent, so each step takes one group (or one suffix) of every problem at a time, as array operations.
"""

from __future__ import annotations

import numpy as np


def suffix_order(t: np.ndarray, problem: np.ndarray) -> np.ndarray:
    """Positions of t ordered by problem and then by suffix.

    t: numbers, 0 ends a segment; every segment has its end, and ends are smaller than all else, earlier ends first.
    problem: a number for each position, ascending. Suffixes end at their segment's end.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    slots = np.arange(n)
    letters = int(t.max()) + 1
    if (int(problem[-1]) + 1) * letters * n < 1 << 63:
        sa = np.sort((problem * letters + t) * n + slots) % n  # by problem, number and place
    else:
        sa = np.lexsort((t, problem))
    pos = np.empty(n, np.int64)
    pos[sa] = slots
    ts, ps = t[sa], problem[sa]
    new = np.ones(n, bool)
    new[1:] = (ts[1:] != ts[:-1]) | (ps[1:] != ps[:-1]) | (ts[1:] == 0)
    starts = np.flatnonzero(new)
    g = np.empty(n, np.int64)
    g[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    gend = np.zeros(n, np.int64)
    gend[starts] = np.append(starts[1:], n) - 1
    first = np.flatnonzero(np.append(True, ps[1:] != ps[:-1]))
    size = np.diff(np.append(first, n))
    ends = np.add.reduceat((ts == 0).astype(np.int64), first)

    prev = slots - 1
    prev[0] = -1
    prev[1:][t[:-1] == 0] = -1
    moved = np.zeros(n, bool)
    cur, low = first + size - 1, first + ends
    act = np.flatnonzero(cur >= low)
    while len(act):
        e = cur[act]
        st = g[sa[e]]
        many = e - st + 1
        mem = sa[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - st, many)]
        idx = mem
        while True:
            p = prev[idx]
            go = p >= 0
            go &= g[p] >= g[idx]
            idx = idx[go]
            if not len(idx):
                break
            prev[idx] = prev[p[go]]
        pm = prev[mem]
        pv, c = np.unique(pm[pm >= 0], return_counts=True)
        if len(pv):
            h = g[pv]
            o = np.lexsort((c, h))
            pv, h, c = pv[o], h[o], c[o]
            head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            in_h = np.diff(np.append(head, len(h)))
            old_end = gend[h[head]]
            lo = old_end - in_h + 1
            tgt = np.arange(len(h)) - np.repeat(head - lo, in_h)
            moved[pv] = True
            occ = sa[tgt]
            away = occ[~moved[occ]]
            moved[pv] = False
            src = pos[pv]
            free = src[src < np.repeat(lo, in_h)]
            sa[free], pos[away] = away, free
            sa[tgt], pos[pv] = pv, tgt
            gend[h[head]] = lo - 1
            cut = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            in_cut = np.diff(np.append(cut, len(h)))
            g[pv] = np.repeat(tgt[cut], in_cut)
            gend[tgt[cut]] = tgt[cut] + in_cut - 1
        cur[act] = st - 1
        act = act[cur[act] >= low[act]]

    out = np.full(n, -1, np.int64)
    is_end = t == 0
    out[pos[is_end]] = np.flatnonzero(is_end)
    free = slots.copy()  # by a group's start: its next free slot
    done = is_end.copy()
    before = slots - 1  # what stands before a position in its segment
    before[prev == -1] = np.where(is_end[np.maximum(slots[prev == -1] - 1, 0)] | (slots[prev == -1] == 0), -1, slots[prev == -1] - 1)
    order = np.argsort(-size, kind="stable")
    base, left = first[order], size[order]
    k = len(base)
    for step in range(int(size.max())):
        while left[k - 1] <= step:
            k -= 1
        j = before[out[base[:k] + step]]
        j = j[j >= 0]
        j = j[~done[j]]
        while len(j):
            at = free[g[j]]
            free[g[j]] = at + 1
            out[at] = j
            done[j] = True
            j = prev[j]
            j = j[j >= 0]
            j = j[~done[j]]
    return out
