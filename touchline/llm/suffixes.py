"""Suffix arrays of many short texts at once, by the linear grouping construction.

The texts of a batch are blocks of one array, built in step with each other: each step takes one suffix group of every block,
so that its work is done by whole arrays.

First phase. Suffixes are grouped by their first letter, then groups are taken in descending order. Of each suffix in the
group the previous smaller suffix is found: the last one before it whose group is lower, along the pointers of the suffixes
between them. A suffix with l pointers of the group has its Lyndon prefix prolonged by l times the group's, and moves to a group
of its own kind right after its old one, those of more pointers after those of fewer. When all groups are taken, a group
is the suffixes of one Lyndon prefix, and groups stand in the order of these.

Second phase. In ascending order, each group's suffixes are put in the order of what follows their common prefix: the next
smaller suffix, whose place is known unless it is in the same group; then it is the number of steps in the group, and the
place of the first one beyond it. No text is renamed and built again.

A block's end counts as smaller than every letter.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``lengths`` of them, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


class Groups:
    """Suffix groups of the blocks of ``text``; a group is named by the place where it begins in ``order``."""

    def __init__(self, text: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        n = len(text)
        self.begins, self.ends = begins, begins + sizes
        self.block_begin, self.block_end = np.repeat(begins, sizes), np.repeat(self.ends, sizes)
        self.order = np.lexsort((text, self.block_begin))
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        first = np.ones(n, bool)
        if n:
            letters, blocks = text[self.order], self.block_begin[self.order]
            first[1:] = (letters[1:] != letters[:-1]) | (blocks[1:] != blocks[:-1])
        starts = np.flatnonzero(first)
        self.size = np.zeros(n + 1, np.int64)
        self.size[starts] = np.diff(np.append(starts, n))
        self.group = np.empty(n + 1, np.int64)
        self.group[self.order] = np.repeat(starts, self.size[starts])
        self.group[n] = -1
        self.prefix = np.ones(n, np.int64)
        self.previous = np.full(n, -1, np.int64)
        self.moving = np.zeros(n, bool)

    def refine(self) -> None:
        """First phase."""
        begins, tops = self.begins, self.ends.copy()
        begins, tops = begins[tops > begins], tops[tops > begins]
        while len(tops):
            groups = self.group[self.order[tops - 1]]
            counts = tops - groups
            members = self.order[_ranges(groups, counts)]
            of = np.repeat(groups, counts)
            smaller = self._previous_smaller(members, of)
            pointing = np.flatnonzero(smaller >= 0)
            if len(pointing):
                self._move(smaller[pointing], self.prefix[members[pointing]])
            left = groups > begins
            begins, tops = begins[left], groups[left]

    def _previous_smaller(self, members: np.ndarray, of: np.ndarray) -> np.ndarray:
        at = members - 1
        at[at < self.block_begin[members]] = -1
        # Groups taken before are higher, and their own pointers lead past more of the same.
        higher = np.flatnonzero((at >= 0) & (self.group[at] > of))
        while len(higher):
            at[higher] = self.previous[at[higher]]
            higher = higher[(at[higher] >= 0) & (self.group[at[higher]] > of[higher])]
        self.previous[members] = at
        # Members of the same group stand in line; halve the line each time.
        same = np.flatnonzero((at >= 0) & (self.group[at] == of))
        while len(same):
            at[same] = self.previous[at[same]]
            self.previous[members[same]] = at[same]
            same = same[(at[same] >= 0) & (self.group[at[same]] == of[same])]
        return at

    def _move(self, pointed: np.ndarray, prefixes: np.ndarray) -> None:
        # Sorting leaves a block's pointers together, so that the prefix lengths, alike in a block, stay with them.
        pointed = np.sort(pointed)
        one = np.flatnonzero(np.concatenate([[True], pointed[1:] != pointed[:-1]]))
        suffixes, times = pointed[one], np.diff(np.append(one, len(pointed)))
        self.prefix[suffixes] += times * prefixes[one]
        old = self.group[suffixes]
        by = np.argsort(old * (times.max() + 1) + times, kind="stable")
        suffixes, times, old = suffixes[by], times[by], old[by]
        new_old = np.ones(len(old), bool)
        new_old[1:] = old[1:] != old[:-1]
        firsts = np.flatnonzero(new_old)
        moved = np.diff(np.append(firsts, len(old)))
        tails = old[firsts] + self.size[old[firsts]] - moved
        targets = _ranges(tails, moved)
        # Who stands in the tail and does not move takes the places that those from before the tail leave.
        self.moving[suffixes] = True
        there = self.order[targets]
        staying = there[~self.moving[there]]
        self.moving[suffixes] = False
        places = self.place[suffixes]
        freed = places[places < np.repeat(tails, moved)]
        self.order[freed] = staying
        self.place[staying] = freed
        self.order[targets] = suffixes
        self.place[suffixes] = targets
        new_kind = new_old.copy()
        new_kind[1:] |= times[1:] != times[:-1]
        kinds = np.flatnonzero(new_kind)
        sizes = np.diff(np.append(kinds, len(old)))
        self.size[old[firsts]] -= moved
        self.size[targets[kinds]] = sizes
        self.group[suffixes] = np.repeat(targets[kinds], sizes)

    def emit(self) -> None:
        """Second phase."""
        steps = np.zeros(len(self.order), np.int64)
        beyond = np.empty(len(self.order), np.int64)
        groups, ends = self.begins, self.ends
        groups, ends = groups[ends > groups], ends[ends > groups]
        while len(groups):
            counts = self.size[groups]
            several = counts > 1
            if several.any():
                starts, lengths = groups[several], counts[several]
                places = _ranges(starts, lengths)
                members = self.order[places]
                of = np.repeat(starts, lengths)
                last = self.block_end[members]
                after = members + self.prefix[members]
                beyond[members], steps[members] = after, 0
                inside = np.flatnonzero((after < last) & (self.group[after] == of))
                while len(inside):
                    via = after[inside]
                    more, far = steps[via] + 1, beyond[via]
                    steps[members[inside]] += more
                    beyond[members[inside]] = after[inside] = far
                    inside = inside[(far < last[inside]) & (self.group[far] == of[inside])]
                follows = np.where(after < last, self.place[np.minimum(after, len(self.place) - 1)], -1)
                hops = steps[members]
                if hops.any():
                    members = members[np.lexsort((follows, hops, of))]
                else:
                    members = members[np.argsort(of * (len(self.order) + 2) + follows, kind="stable")]
                self.order[places] = members
                self.place[members] = places
            groups = groups + counts
            left = groups < ends
            groups, ends = groups[left], ends[left]


def suffix_arrays(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ``text``, block by block, in the order of the suffixes that begin there and end with the block.

    Blocks lie end to end: ``begins`` and ``sizes`` say where, in ascending order.
    """
    groups = Groups(text, np.asarray(begins, np.int64), np.asarray(sizes, np.int64))
    groups.refine()
    groups.emit()
    return groups.order
