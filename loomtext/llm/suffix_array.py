"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are classified as larger or smaller than the next one; the leftmost-smaller substrings are sorted by one round of
induction, named, and their order found recursively; a second round induces all suffixes from theirs.  A round goes bucket by
bucket, and all that a bucket induces is placed at once.  So that there are few buckets at every level, names above `DIGIT`
are written as several digits, which leaves the order of suffixes as it is.  The recursion ends where all names differ, or where
they are few; those, and names that digits would make as long as the string they come from, are ordered by doubling prefixes.
"""

from __future__ import annotations

import numpy as np

DIGIT = 10  # bits
#: Strings of up to so many names of several digits end the recursion: doubling prefixes orders them.
SHORT = 1 << 14


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an array of integers in [0, 2**DIGIT], in order; a suffix sorts before its continuations."""
    n = len(text) + 1
    if n <= 2:
        return np.arange(n - 1, dtype=np.int64)
    t = np.zeros(n, np.int16)
    t[:-1] = text
    t[:-1] += 1
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:] - t[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    smaller = step[np.minimum.accumulate(at[::-1])[::-1]] > 0  # than the next suffix
    leftmost = smaller.copy()
    leftmost[1:] &= ~smaller[:-1]
    leftmost[0] = False
    places = np.flatnonzero(leftmost).astype(np.int32)
    buckets = np.concatenate([[0], np.cumsum(np.bincount(t))])
    sa = induce(t, buckets, places[np.argsort(t[places], kind="stable")])
    ordered = sa[leftmost[sa]]
    names = named(t, places, ordered)
    if names.max() + 1 < len(places):
        ordered = places[order_of(names, n)]
    return induce(t, buckets, ordered)[1:]


def induce(t: np.ndarray, buckets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes, induced from leftmost-smaller ones in the given order.

    The suffix before one that begins with c is larger than it if its own first letter is above c, and smaller if it is below;
    with the same letter it is what its successor is.
    """
    n, size = len(t), len(buckets) - 1
    sa = np.full(n, -1, np.int32)
    head, tail = buckets[:-1].copy(), buckets[1:].copy()
    seed_at = np.concatenate([[0], np.cumsum(np.bincount(t[seeds], minlength=size))]).tolist()
    begin = buckets.tolist()
    used = np.flatnonzero(np.diff(buckets)).tolist()
    every = np.arange(int(np.diff(buckets).max()))

    for c in used:
        # A bucket's own, run after run.
        found, first = [], begin[c]
        while (last := int(head[c])) > first:
            before = sa[first:last]
            found.append(before)
            before = before - np.int32(1)
            before = before[t[before] == c]
            sa[last : last + len(before)] = before
            head[c] = last + len(before)
            first = last
        found.append(seeds[seed_at[c] : seed_at[c + 1]])
        before = (np.concatenate(found) if len(found) > 1 else found[0]) - np.int32(1)
        to = t[before]  # the letter before the text is its end, which is above nothing
        above = to > c
        before, to = before[above], to[above]
        if len(to):
            order = np.argsort(to, kind="stable")
            count = np.bincount(to, minlength=size)
            to = to[order]
            sa[(head - np.cumsum(count) + count)[to] + every[: len(to)]] = before[order]
            head += count
    for c in reversed(used):
        found, last = [], begin[c + 1]
        while (first := int(tail[c])) < last:
            before = sa[first:last][::-1]
            found.append(before)
            before = before - np.int32(1)
            before = before[(t[before] == c) & (before >= 0)]
            sa[first - len(before) : first] = before[::-1]
            tail[c] = first - len(before)
            last = first
        found.append(sa[begin[c] : int(head[c])][::-1])
        before = (np.concatenate(found) if len(found) > 1 else found[0]) - np.int32(1)
        to = t[before]
        below = (to < c) & (before >= 0)
        before, to = before[below], to[below]
        if len(to):
            order = np.argsort(to, kind="stable")
            count = np.bincount(to, minlength=size)
            to = to[order]
            sa[(tail - 1 + np.cumsum(count) - count)[to] - every[: len(to)]] = before[order]
            tail -= count
    sa[0] = n - 1
    return sa


def named(t: np.ndarray, places: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings in text order: equal substrings have one, in the order of the substrings."""
    length = np.zeros(len(t), np.int32)
    length[places[:-1]] = np.diff(places) + 1
    length[places[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    rest = np.flatnonzero(same)
    k = 0
    while len(rest):
        equal = t[a[rest] + k] == t[b[rest] + k]
        same[rest[~equal]] = False
        k += 1
        rest = rest[equal]
        rest = rest[length[a[rest]] > k]
    name = np.zeros(len(t), np.int32)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[places]


def order_of(names: np.ndarray, above: int) -> np.ndarray:
    """The order of the suffixes of a string of names."""
    bits = max(1, int(names.max()).bit_length())
    digits = -(-bits // DIGIT)
    if digits * len(names) >= above or digits > 1 and len(names) <= SHORT:
        return doubled(names)
    each = -(-bits // digits)
    written = np.stack([(names >> (each * (digits - 1 - i))) & ((1 << each) - 1) for i in range(digits)], 1).ravel()
    sa = suffix_array(written)
    return sa if digits == 1 else sa[sa % digits == 0] // digits


def doubled(names: np.ndarray) -> np.ndarray:
    """The same order by doubling prefixes, of those suffixes only whose place is still open."""
    n, width = len(names), 1
    order = np.argsort(names, kind="stable")
    value = names[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a rank is the first place of its group
    rank = np.empty(n, np.int64)
    rank[order] = first
    open_at = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_at):
        own = order[open_at]
        after = own + width
        key = rank[own] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[open_at] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        open_at = open_at[~(new & np.append(new[1:], True))]
        width *= 2
    return order


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each start, how much its suffix shares with the one before it in order.

    Only where the letters before the two differ is it counted; elsewhere it is one less than at the start before.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    counted = (before <= 0) | (i == 0)
    free = ~counted
    counted[free] = text[i[free] - 1] != text[before[free] - 1]
    at = np.flatnonzero(counted)
    # Four letters a word; past the end, letters that differ from all and from each other's ends.
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = text.astype(np.uint64) + np.uint64(1)
    word = padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)
    shared = np.zeros(n, np.int64)
    left = at[before[at] >= 0]
    a, b = left.copy(), before[left]
    while len(left):
        differ = word[a] ^ word[b]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 4, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // 16).astype(np.int64))
        shared[left] += same
        go = (same == 4) & (np.maximum(a, b) + 4 < n)
        left, a, b = left[go], a[go] + 4, b[go] + 4
    last = np.maximum.accumulate(np.where(counted, i, 0))
    return shared[last] - (i - last)


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the starts of its strings of `length` bytes that also start elsewhere in these texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    ends = np.cumsum(sizes + 1) - 1
    joined[ends] = 0
    sa = suffix_array(joined)
    long = permuted_prefixes(joined, sa)[sa] >= length
    hit = np.zeros(len(joined), bool)
    hit[sa[long]] = True
    hit[sa[:-1][long[1:]]] = True
    begin = ends - sizes
    hits = np.flatnonzero(hit)
    own = np.searchsorted(ends, hits, "left")
    hits -= begin[own]
    good = hits + length <= sizes[own]
    hits, own = hits[good], own[good]
    return np.split(hits, np.searchsorted(own, np.arange(1, len(texts))))
