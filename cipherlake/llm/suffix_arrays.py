"""Suffix arrays by induced sorting at every size, and permuted common prefixes, in numpy passes over stretches."""

from __future__ import annotations

import numpy as np

#: Strings with a longer run of one value are induced place by place: stretches would be short.
MAX_RUN = 1024


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type). `t` ends with its unique smallest value."""
    n = len(t)
    kinds = np.ones(n, dtype=bool)
    if n > 1:
        differs = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
        decides = np.minimum.accumulate(differs[::-1])[::-1]
        kinds[:-1] = (t[:-1] < t[1:])[decides]
    return kinds


def induce_stretches(t: np.ndarray, kinds: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order.

    A left-to-right pass places L-type suffixes before, a right-to-left pass S-type ones behind what they precede. The
    array is read in stretches that end before the first place which the stretch itself fills, so all of a stretch is
    known when it is read.
    """
    n = len(t)
    ends = np.cumsum(sizes)
    sa = np.full(n, -1, dtype=np.int32)
    chars = t[lms]
    order = np.argsort(chars, kind="stable")
    counts = np.bincount(chars, minlength=len(sizes))
    rank = np.arange(len(lms)) - np.repeat(np.cumsum(counts) - counts, counts)
    slots = (ends - counts)[chars[order]] + rank
    sa[slots] = lms[order]

    # For each suffix whether the pass places the one before it; the last entry stands for an empty place.
    wanted = [np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)]
    wanted[0][1:n], wanted[1][1:n] = ~kinds[:-1], kinds[:-1]

    def sweep(at: np.ndarray, small: bool) -> None:
        """Reads every place in order (backwards if `small`) and appends what precedes its suffix to its bucket."""
        i, width, step = 0, 256, -1 if small else 1
        view = sa[::step]  # the stretch is always view[i:e], in reading order
        steps = np.arange(1 << 20)
        while i < n:
            e = min(n, i + width)
            w = view[i:e]
            source = wanted[small][w].nonzero()[0]
            values = w[source] - 1
            if len(values):
                c = t[values]
                by = c.argsort(kind="stable")
                c = c[by]
                new = np.empty(len(c), dtype=bool)
                new[0] = True
                np.not_equal(c[1:], c[:-1], out=new[1:])
                first = new.nonzero()[0]
                turn = steps[: len(c)] - first[new.cumsum() - 1]
                place = n - at[c] + turn if small else at[c] + turn  # in reading order
                stop = int(place.min())
                if stop < e:
                    e = stop
                    keep = (source[by] < e - i).nonzero()[0]
                    by, c, place = by[keep], c[keep], place[keep]
                view[place] = values[by]
                np.add.at(at, c, step)
            width = min(1 << 20, 2 * width) if e - i == width else max(32, 2 * (e - i))
            i = e

    sweep(ends - sizes, False)
    sa[slots] = -1
    sa[0] = n - 1
    sweep(ends.copy(), True)
    return sa


def induce_places(t: np.ndarray, kinds: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same, one place after another: in linear time whatever the string."""
    ends = np.cumsum(sizes)
    value = t.tolist()
    # What precedes a suffix, if a pass has to place it; 0 stands for an empty place too, as nothing precedes suffix 0.
    large, small = np.arange(-1, len(t) - 1), np.arange(-1, len(t) - 1)
    large[1:][kinds[:-1]] = -1
    small[1:][~kinds[:-1]] = -1
    sa = [0] * len(t)
    tail = ends.tolist()
    slots = []
    for i in lms[::-1].tolist():
        c = value[i]
        tail[c] -= 1
        sa[tail[c]] = i
        slots.append(tail[c])
    head, before = (ends - sizes).tolist(), large.tolist()
    for v in sa:
        j = before[v]
        if j >= 0:
            c = value[j]
            sa[head[c]] = j
            head[c] += 1
    for k in slots:
        sa[k] = 0
    sa[0] = len(t) - 1
    tail, before = ends.tolist(), small.tolist()
    for v in reversed(sa):
        j = before[v]
        if j >= 0:
            c = value[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return np.array(sa, dtype=np.int32)


def suffix_array(t: np.ndarray, n_values: int) -> np.ndarray:
    """The suffix array of non-negative integers that end with 0, which occurs nowhere else."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    breaks = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
    induce = induce_stretches if np.diff(breaks).max() <= MAX_RUN else induce_places
    kinds = classify(t)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[1:] = kinds[1:] & ~kinds[:-1]
    lms = np.flatnonzero(is_lms)
    sizes = np.bincount(t, minlength=n_values)
    # From the leftmost-smaller suffixes in any order, inducing sorts the substrings that reach to the next one.
    rough = induce(t, kinds, lms, sizes)
    substrings = rough[is_lms[rough]]
    length = np.zeros(n, dtype=np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = substrings[:-1], substrings[1:]
    new = np.ones(len(substrings), dtype=bool)
    alike = np.flatnonzero(length[a] == length[b])
    if len(alike):
        spans = length[a[alike]]
        starts = np.cumsum(spans) - spans
        within = np.arange(spans.sum()) - np.repeat(starts, spans)
        equal = t[np.repeat(a[alike], spans) + within] == t[np.repeat(b[alike], spans) + within]
        new[alike + 1] = ~np.logical_and.reduceat(equal, starts)
    names = np.zeros(n, dtype=np.int32)
    names[substrings] = np.cumsum(new) - 1
    reduced, distinct = names[lms], int(new.sum())
    if distinct == len(lms):
        order = np.empty(len(lms), dtype=np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = suffix_array(reduced, distinct)
    return induce(t, kinds, lms[order], sizes)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of an int16 array, the length of the prefix that its suffix shares with the one before it in
    the suffix array; and where that one starts (-1 for the first).

    Where both suffixes follow equal values, the length is the previous position's less one; only the others are
    compared, four values at a time.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    bound = (here > 0) & (before > 0)
    bound[bound] = t[here[bound] - 1] == t[before[bound] - 1]
    todo = np.flatnonzero(~bound & (before >= 0))
    padded = np.concatenate([t, np.zeros(4, dtype=np.int16)])
    fours = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(2,))
    size = np.zeros(n, dtype=np.int64)
    i, j, at = todo, before[todo], np.zeros(len(todo), dtype=np.int64)
    while len(i):
        # The last value occurs once, so the two suffixes differ before either ends.
        same = fours[np.minimum(i + at, n - 1)] == fours[np.minimum(j + at, n - 1)]
        p, q, k = i[~same], j[~same], at[~same]
        alive = np.ones(len(p), dtype=bool)
        for _ in range(3):
            alive &= padded[p + k] == padded[q + k]
            k[alive] += 1
        size[p] = k
        i, j, at = i[same], j[same], at[same] + 4
    source = np.maximum.accumulate(np.where(bound, 0, here))
    return np.maximum(size[source] - (here - source), 0), before


def repeated_starts(pieces: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each byte string a mask of the starts of `length`-byte windows that occur at another start in any of them."""
    t = np.zeros(sum(len(p) + 1 for p in pieces) + 1, dtype=np.int16)
    at, places = 0, []
    for p in pieces:
        t[at : at + len(p)] = p
        t[at : at + len(p)] += 2
        t[at + len(p)] = 1
        places.append(at)
        at += len(p) + 1
    sa = suffix_array(t, 258)
    shared, before = permuted_prefixes(t, sa)
    # Such a prefix has no separator, or the next suffix would not share it: both starts are windows.
    hit = np.zeros(len(t), dtype=bool)
    long = np.flatnonzero(shared >= length)
    hit[long] = True
    hit[before[long]] = True
    return [hit[a : a + max(0, len(p) - length + 1)] for a, p in zip(places, pieces, strict=True)]
