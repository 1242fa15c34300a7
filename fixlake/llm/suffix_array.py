"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

A suffix is of the smaller type if it is less than the one that begins one place later, and leftmost-smaller if the one before it is not. Suffixes that are
leftmost-smaller are sorted first: an induced pass over them in any order sorts the substrings between each two, the substrings get names in that order, and if names repeat, the
suffixes of the string of names are sorted in the same way, one level down. A second induced pass gives all suffixes from them.

An induced pass scans the array and puts the suffix before each one that it meets into the next free place of its first symbol's bucket. Here it takes as many entries at
once as are filled in already, and deals their predecessors out by a stable sort, which is the order in which a scan one by one would place them. Where few are filled at once,
as in runs of one symbol, it goes on one by one for a while.
"""

from __future__ import annotations

import numpy as np

#: Strings of up to so many symbols are sorted directly.
DIRECT = 32
#: Fewer filled entries than FEW are taken one by one, for up to SLOWLY entries.
FEW, SLOWLY = 12, 2048


def _first_negative(a: np.ndarray, begin: int) -> int:
    """The first place from begin on with a negative entry, or the end."""
    step = 64
    while begin < len(a):
        found = np.flatnonzero(a[begin : begin + step] < 0)
        if len(found):
            return begin + int(found[0])
        begin += step
        step *= 4
    return len(a)


def _scan(array: np.ndarray, symbol: np.ndarray, free: np.ndarray, step: int) -> None:
    """The induced pass. `symbol` is negative for suffixes that aren't to be placed; `free` has the next place of each bucket, which moves by step.
    With step 1 the array is scanned from the left, with step -1 it is given reversed and so are the places."""
    at, size = 0, len(array)
    while at < size:
        end = _first_negative(array, at)
        if end == at:
            raise AssertionError("an entry was never placed")
        if end - at < FEW:
            stop = min(size, at + SLOWLY)
            while at < stop and (k := int(array[at])) >= 0:
                c = int(symbol[k - 1])
                if c >= 0:
                    array[free[c]] = k - 1
                    free[c] += 1
                at += 1
            continue
        before = array[at:end] - 1
        c = symbol[before]
        take = c >= 0
        before, c = before[take], c[take]
        if len(c):
            order = np.argsort(c, kind="stable")
            c = c[order]
            starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            sizes = np.diff(np.append(starts, len(c)))
            buckets = c[starts]
            array[np.arange(len(c)) + np.repeat(free[buckets] - starts, sizes)] = before[order]
            free[buckets] += sizes
        at = end


def _induce(s: np.ndarray, sigma: int, smaller: np.ndarray, leftmost: np.ndarray, small: type) -> np.ndarray:
    """All suffixes in order, given those that are leftmost-smaller in order (or all in the order of their first substrings)."""
    n = len(s)
    counts = np.bincount(s, minlength=sigma)
    larger = np.bincount(s[~smaller], minlength=sigma)
    firsts = np.bincount(s[leftmost], minlength=sigma)
    # larger ones from the left: buckets hold them, then the leftmost-smaller ones
    sizes = larger + firsts
    begin = np.cumsum(sizes) - sizes
    array = np.full(len(s) - int(smaller.sum()) + len(leftmost), -1, dtype=np.int32)
    order = leftmost[np.argsort(s[leftmost].astype(small), kind="stable")]
    ranks = np.arange(len(order)) - np.repeat(np.cumsum(firsts) - firsts, firsts)
    array[np.repeat(begin + larger, firsts) + ranks] = order
    symbol = np.where(smaller, -1, s).astype(small)
    _scan(array, symbol, begin.copy(), 1)
    # smaller ones from the right, on the array reversed
    found = array[~smaller[array]]
    sizes = counts[::-1]
    begin = np.cumsum(sizes) - sizes
    tail = (counts - larger)[::-1]
    back = np.full(n, -1, dtype=np.int32)
    held = larger[::-1]
    ranks = np.arange(len(found)) - np.repeat(np.cumsum(held) - held, held)
    back[np.repeat(begin + tail, held) + ranks] = found[::-1]
    back[n - 1] = n - 1
    symbol = np.where(smaller, s, -1).astype(small)
    symbol[n - 1] = -1
    _scan(back, symbol, begin[::-1].copy(), 1)
    return back[::-1]


def _names(s: np.ndarray, ordered: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The names of substrings that begin at `ordered` (in order): equal ones share one."""
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = length[1:] != length[:-1]
    pairs = np.flatnonzero(~new)
    a, b, left = ordered[pairs - 1], ordered[pairs], length[pairs]
    at = 0
    while len(pairs):
        if len(pairs) < 8:
            for p, x, y, k in zip(pairs.tolist(), a.tolist(), b.tolist(), left.tolist(), strict=True):
                new[p] = not np.array_equal(s[x + at : x + k], s[y + at : y + k])
            break
        differ = s[a + at] != s[b + at]
        new[pairs[differ]] = True
        at += 1
        keep = ~differ & (left > at)
        pairs, a, b, left = pairs[keep], a[keep], b[keep], left[keep]
    return np.cumsum(new) - 1


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes of s in order; s holds numbers from 0 to sigma - 1, of which the last is the only 0."""
    n = len(s)
    if n <= DIRECT:
        plain = s.tolist()
        return np.array(sorted(range(n), key=lambda i: plain[i:]), dtype=np.int32)
    small = np.int16 if sigma < 1 << 15 else np.int32
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1])
    step[-1] = 1
    known = np.where(step != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    smaller = step[known] > 0
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    array = _induce(s, sigma, smaller, leftmost, small)
    is_first = np.zeros(n, dtype=bool)
    is_first[leftmost] = True
    ordered = array[is_first[array]]
    length = np.zeros(n, dtype=np.int32)
    length[leftmost] = np.append(np.diff(leftmost) + 1, 1)
    names = _names(s, ordered, length[ordered])
    if names[-1] + 1 < len(ordered):
        by_place = np.zeros(n, dtype=np.int32)
        by_place[ordered] = names
        ordered = leftmost[suffix_array(by_place[leftmost], int(names[-1]) + 1)]
    return _induce(s, sigma, smaller, ordered, small)


def common_prefixes(data: np.ndarray, array: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each place of data the length of what it has in common with the suffix just before it in order (array: the suffix array, of data's places only), within `left` bytes, those that
    are left of each place's own string. Values are worked out where the symbols before differ, and fall by one from place to place elsewhere."""
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    own = np.ones(n, dtype=bool)
    own[1:] = (before[1:] <= 0) | (data[:-1] != data[before[1:] - 1]) | (left[:-1] == 0) | (left[before[1:] - 1] == 0)
    places = np.flatnonzero(own)
    value = np.zeros(len(places), dtype=np.int64)
    there = before[places]
    most = np.where(there >= 0, np.minimum(left[places], left[there]), 0)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    words = np.ndarray(n, dtype="<u8", buffer=padded, strides=(1,))
    go = np.flatnonzero(most > 0)
    x, y, at = places[go], there[go], 0
    while len(go):
        differ = words[x + at] ^ words[y + at]
        equal = differ == 0
        value[go] = at + np.where(equal, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        at += 8
        keep = equal & (most[go] > at)
        go, x, y = go[keep], x[keep], y[keep]
    value = np.minimum(value, most)
    nearest = np.cumsum(own) - 1
    return np.maximum(value[nearest] - (np.arange(n) - places[nearest]), 0)
