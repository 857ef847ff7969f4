"""Suffix arrays of many short texts at once by linear grouping.

First every suffix is put in a group by its first symbol. Groups are taken in descending order:
each suffix of the group points to the nearest earlier one in a lower group (its previous smaller
suffix), and the suffixes pointed to move up within their own group, the further the more often
they are pointed to. In the end a group holds the suffixes that begin with the same Lyndon word.
Then the order inside the groups is emitted by following the same pointers from the least suffix
on, without renaming anything.

A group is a run of slots, so its first slot is its name and its rank; moving suffixes up is a
swap of slots. All texts are worked on in step, one group of each at a time, with numpy.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _group(symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group (its first slot) and previous smaller suffix of every position. Texts are [first, last]; first - 1 is a stop."""
    n = len(symbols)
    position = _ranges(first, last - first + 1)
    text = np.repeat(np.arange(len(first)), last - first + 1)
    group = np.full(n, -1, np.int64)
    suffix_at = np.zeros(n, np.int64)
    order = np.lexsort((symbols[position], text))
    suffix_at[position] = position[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (symbols[position][order][1:] != symbols[position][order][:-1])
    starts = position[np.flatnonzero(new)]
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    group[position[order]] = np.repeat(starts, sizes)
    size = np.zeros(n, np.int64)
    size[starts] = sizes
    slot = np.zeros(n, np.int64)
    slot[suffix_at[position]] = position
    previous = np.arange(n) - 1
    moved = np.zeros(n, bool)
    bottom, top = first.copy(), last + 1
    while len(top):
        start = group[suffix_at[top - 1]]
        own = suffix_at[_ranges(start, top - start)]
        level = np.repeat(start, top - start)
        open_ = np.arange(len(own))
        while len(open_):
            at = previous[own[open_]]
            further = group[at] >= level[open_]
            open_ = open_[further]
            previous[own[open_]] = previous[at[further]]
        pointed, times = np.unique(previous[own], return_counts=True)
        real = group[pointed] >= 0
        pointed, times = pointed[real], times[real]
        if len(pointed):
            old = group[pointed]
            order = np.lexsort((times, old))
            pointed, times, old = pointed[order], times[order], old[order]
            change = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            count = np.diff(np.append(change, len(old)))
            low = np.repeat(old[change] + size[old[change]] - count, count)
            goal = low + np.arange(len(old)) - np.repeat(change, count)
            moved[pointed] = True
            holders = suffix_at[goal]
            holders = holders[~moved[holders]]
            moved[pointed] = False
            left = slot[pointed]
            left = left[left < low]
            suffix_at[left], slot[holders] = holders, left
            suffix_at[goal], slot[pointed] = pointed, goal
            block = np.append(True, (old[1:] != old[:-1]) | (times[1:] != times[:-1]))
            at = np.flatnonzero(block)
            lengths = np.diff(np.append(at, len(old)))
            size[old[change]] -= count
            size[goal[at]] = lengths
            group[pointed] = np.repeat(goal[at], lengths)
        go_on = start > bottom
        bottom, top = bottom[go_on], start[go_on]
    return group, previous


def suffix_arrays(symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sorted suffixes: slots [first, last] of each text hold its positions in the order of their suffixes.

    ``symbols`` are numbers; text t is ``symbols[first[t]:last[t] + 1]``, its last symbol is its
    least and occurs in it once, and the place before it belongs to no text.
    """
    group, previous = _group(symbols, first, last)
    front = np.arange(len(symbols))
    found = np.full(len(symbols), -1, np.int64)
    done = np.zeros(len(symbols), bool)
    done[first - 1] = True
    found[first], done[last] = last, True
    front[first] += 1
    at, end, suffix = first.copy(), last.copy(), last - 1
    while len(at):
        stop = done[suffix]
        own = suffix[~stop]
        place = front[group[own]]
        found[place], done[own] = own, True
        front[group[own]] = place + 1
        suffix[~stop] = previous[own]
        at[stop] += 1
        go_on = at <= end
        if not go_on.all():
            at, end, suffix, stop = at[go_on], end[go_on], suffix[go_on], stop[go_on]
        suffix[stop] = found[at[stop]] - 1
    return found
