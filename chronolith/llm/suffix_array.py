"""Linear suffix sorting by grouping.

Suffixes are first grouped by their first symbol, by counting. Groups are taken in descending order: of each suffix in the
group the nearest earlier suffix of a smaller group is its previous smaller one, and those are moved, by how many suffixes
of the group point to them, into new groups right above what is left of their own. In the end a group holds the suffixes
with one Lyndon prefix, and groups are in order. A second pass emits each group's own order from left to right: whenever a
suffix is placed, the one before it and those it points to take the next places of their groups. Nothing is renamed,
nothing is compared but group numbers, there is no recursion, and no step sorts: symbols and pointer counts are bucketed.
"""

from __future__ import annotations

import numpy as np

_UNSET = -2


def _buckets(symbols: np.ndarray) -> np.ndarray:
    """Places by symbol, in order of place within each: a radix sort by 16 bits at a time."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    rest = symbols >> 16
    while rest.any():
        order = order[np.argsort((rest[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        rest = rest >> 16
    return order


def suffix_array(symbols) -> list[int]:
    """Starts of the suffixes in order; symbols are whole numbers from 1 on."""
    s = np.append(np.asarray(symbols, dtype=np.int64), 0)
    n = len(s)
    by_symbol = _buckets(s)
    order = by_symbol.tolist()
    sorted_symbols = s[by_symbol]
    new = np.flatnonzero(np.concatenate(([True], sorted_symbols[1:] != sorted_symbols[:-1])))
    sizes = np.diff(np.append(new, n))
    held = np.empty(n, dtype=np.int64)
    held[by_symbol] = np.arange(n)
    place = held.tolist()  # of a suffix in order
    held[by_symbol] = np.repeat(new, sizes)
    group = held.tolist()  # of a suffix: the place its group starts at
    end = [0] * n  # of a group, by its start
    for start, size in zip(new.tolist(), sizes.tolist(), strict=True):
        end[start] = start + size
    previous = [_UNSET] * n
    high = n
    while high:
        g = group[order[high - 1]]
        counts: dict[int, int] = {}
        for i in order[g:high]:
            if previous[i] == _UNSET:
                # Suffixes of the same group that stand before i come first; what waits for them is stacked.
                waiting = [i]
                while waiting:
                    j = waiting[-1]
                    p = j - 1
                    while p >= 0 and group[p] >= g:
                        q = previous[p]
                        if q == _UNSET:
                            waiting.append(p)
                            break
                        p = q
                    else:
                        previous[j] = p
                        waiting.pop()
            p = previous[i]
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        high = g
        if not counts:
            continue
        most = max(counts.values())
        if most == 1:
            levels = [list(counts)]
        else:
            levels = [[] for _ in range(most)]
            for p, c in counts.items():
                levels[most - c].append(p)
        for level in levels:
            parted: dict[int, int] = {}  # group -> its end before this level
            for p in level:
                of = group[p]
                last = end[of] - 1
                parted.setdefault(of, last + 1)
                other, at = order[last], place[p]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
                end[of] = last
            for of, was in parted.items():
                fresh = end[of]
                if fresh != of:
                    for at in range(fresh, was):
                        group[order[at]] = fresh
                end[fresh] = was
    # Emission: the smallest suffix is the end mark.
    out = [-1] * n
    free = list(range(n))  # next free place of a group
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for at in range(n):
        i = out[at] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = 1
            i = previous[i]
    return out[1:]
