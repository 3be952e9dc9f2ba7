"""Which places of some byte strings start a string of a given length that starts at another place too.

The strings are put in a row behind separators and their suffixes are sorted by prefix doubling, as far as the length asks for. On
the Burrows-Wheeler transform of that order, intervals of suffixes with a common prefix are extended backward, one character at a time
and breadth first, from the empty prefix on: the right end of an interval of prefixes of l + 1 characters that has no value yet is a place
where neighbouring suffixes have exactly l characters in common. Values so come in ascending order, and the expansion stops at the
wanted length: neighbours whose place has no value by then have at least that many characters in common.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Places of text (values from 0 to 256) in the order of the suffixes there, by their first `length` values at least.

    Ranks of three neighbouring pieces make a number of 63 bits while there are at most 2^21 places, else those of two.
    """
    n = len(text)
    values = np.zeros(257, np.int64)
    values[np.unique(text)] = 1
    values = np.cumsum(values)  # from 1, in the same order
    bits = int(values[-1]).bit_length()
    wide, many = 63 // bits, 3 if n < 1 << 21 else 2
    step = 63 // many
    ahead = np.concatenate([values[text], np.zeros(wide, np.int64)])
    key = ahead[:n].copy()
    for k in range(1, wide):
        key <<= bits
        key |= ahead[k : k + n]
    del ahead
    rank = np.empty(n, np.int64)
    while True:
        order = np.argsort(key, kind="stable" if n < 1000 else None)
        ranked = key[order]
        rank[order[0]] = 1
        rank[order[1:]] = np.cumsum(ranked[1:] != ranked[:-1]) + 1
        if wide >= length or rank[order[-1]] == n:
            return order
        key = rank.copy()
        for k in range(1, many):
            key <<= step
            if k * wide < n:
                key[: n - k * wide] |= rank[k * wide :]
        wide *= many


def short_of(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of the order but the first: whether it has less than `length` characters in common with the one before."""
    n = len(text)
    last = text[order - 1].astype(np.int32)  # the Burrows-Wheeler transform; the text begins with a separator
    by_char = np.argsort(last, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=257))])
    step = np.empty(n, np.int32)  # where a single suffix goes when its character is put before
    step[by_char] = np.arange(n, dtype=np.int32)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    known[np.count_nonzero(text == 0)] = True  # behind the separators
    low, high = np.zeros(1, np.int32), np.full(1, n, np.int32)

    leads = np.zeros(n + 1, bool)
    leads[first] = True
    owner = np.zeros(n, np.int32)

    def several(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of three or more, extended: suffixes with the same character go to neighbouring places, in order."""
        sizes = j - i
        ends = np.cumsum(sizes, dtype=np.int32)
        own = np.repeat(np.arange(len(i), dtype=np.int32), sizes)
        to = step[np.arange(ends[-1], dtype=np.int32) + np.repeat(i - (ends - sizes), sizes)]
        owner[to] = own
        to.sort()
        own = owner[to]
        new = leads[to]
        new[0] = True
        new[1:] |= (to[1:] != to[:-1] + 1) | (own[1:] != own[:-1])
        begin = np.flatnonzero(new)
        lead = to[begin]
        return lead, lead + np.diff(np.append(begin, len(to))).astype(np.int32)

    for _ in range(length):
        if not len(low):
            break
        sizes = high - low
        one, two = low[sizes == 1], low[sizes == 2]
        a, b = step[two], step[two + 1]
        same = last[two] == last[two + 1]
        one = np.concatenate([step[one], a[~same], b[~same]])
        parts = [(one, one + 1), (a[same], a[same] + 2)]
        if len(more := np.flatnonzero(sizes > 2)):
            parts.append(several(low[more], high[more]))
        low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = (low >= first[1]) & ~known[high]
        low, high = low[new], high[new]
        known[high] = True
    return known[1:n]


def repeated(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string: its places where a string of `length` bytes starts that starts at another place too, in any of the strings."""
    sizes = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(sizes + 1) - sizes
    text = np.zeros(int(sizes.sum()) + len(strings) + 1, np.int64)
    for b, s in zip(begin.tolist(), strings, strict=True):
        text[b : b + len(s)] = np.frombuffer(s, np.uint8)
        text[b : b + len(s)] += 1
    order = suffix_order(text, length)
    group = np.concatenate([[0], np.cumsum(short_of(text, order, length))])
    ends = np.repeat(begin + sizes, sizes + 1) if len(strings) else np.zeros(0, np.int64)  # for all places but the last separator
    starts = np.zeros(len(text), bool)
    starts[: len(ends)] = ends - np.arange(len(ends)) >= length
    starts[begin - 1] = False  # separators
    real = starts[order]
    many = np.bincount(group[real], minlength=group[-1] + 1) > 1
    hit = np.zeros(len(text), bool)
    hit[order[real & many[group]]] = True
    return [np.flatnonzero(hit[b : b + s]) for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]
