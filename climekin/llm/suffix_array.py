"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successor.
The leftmost S suffixes of each run (LMS) are put at their bucket ends; a
sweep to the right induces the order of L suffixes and one to the left that
of S suffixes.  Done on the unsorted LMS positions this sorts the LMS
substrings; they are named, the string of names is sorted, and a second
pair of sweeps induces the whole array.

All steps are array operations.  Over few characters a sweep goes bucket by
bucket, and within a bucket the entries that induce entries of that same
bucket go in waves, which is the order of the sequential sweep.  The string of
names, which is sorted by the same recursion, has many small buckets: there a
sweep takes runs of neighbouring buckets together, and orders what they
induce among themselves by as many rounds as such chains are long.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last element is the unique smallest."""
    n = len(s)
    differ = np.flatnonzero(s[:-1] != s[1:])
    # The next place at or after i where neighbours differ decides.
    smaller = s[differ] < s[differ + 1]
    lengths = np.diff(np.concatenate(([-1], differ)))
    out = np.ones(n, bool)
    out[: lengths.sum()] = np.repeat(smaller, lengths)
    return out


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Array of suffixes from sorted (or, for substrings, any) LMS positions in bucket order."""
    n = len(s)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    sa = np.full(n, -1, np.int32)
    used = np.flatnonzero(sizes)
    lms_char = s[lms]
    counts = np.bincount(lms_char, minlength=len(sizes))
    lms_from = np.concatenate(([0], np.cumsum(counts)))

    # L suffixes, from small buckets to large ones.
    pending: dict[int, list[np.ndarray]] = {int(c): [] for c in used}
    for c in used:
        c = int(c)
        wave = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int32)
        waves = []
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(s[before] == c)]  # equal to an L suffix's character: L as well
        own = np.concatenate(waves) if waves else np.empty(0, np.int32)
        sa[heads[c] : heads[c] + len(own)] = own
        both = np.concatenate((own, lms[lms_from[c] : lms_from[c + 1]]))
        before = both[both > 0] - 1
        before = before[~is_s[before]]
        chars = s[before]
        keep = chars > c
        before, chars = before[keep], chars[keep]
        if len(before):
            order = np.argsort(chars, kind="stable")
            before, chars = before[order], chars[order]
            cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
            for part, first in zip(np.split(before, cuts), np.concatenate(([0], cuts))):
                pending[int(chars[first])].append(part)
        pending[c] = []

    # S suffixes, from large buckets to small ones; each list is in descending order.
    for c in used[::-1]:
        c = int(c)
        wave = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int32)
        waves = []
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(s[before] == c)]
        own = np.concatenate(waves) if waves else np.empty(0, np.int32)
        sa[ends[c] - len(own) : ends[c]] = own[::-1]
        larger = sa[heads[c] : ends[c] - len(own)][::-1]
        both = np.concatenate((own, larger))
        before = both[both > 0] - 1
        before = before[is_s[before]]
        chars = s[before]
        keep = chars < c
        before, chars = before[keep], chars[keep]
        if len(before):
            order = np.argsort(chars, kind="stable")
            before, chars = before[order], chars[order]
            cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
            for part, first in zip(np.split(before, cuts), np.concatenate(([0], cuts))):
                pending[int(chars[first])].append(part)
        pending[c] = []
    sa[0] = n - 1  # the unique smallest, which no suffix induces
    return sa


def _induce_wide(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same for a string with many characters."""
    n = len(s)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    blocks = min(256, 1 + n // 2048)
    block = ((np.maximum(ends, 1) - 1) * blocks // n).astype(np.int16)  # 16 bits are sorted by radix
    place = np.full(n, -1, np.int64)

    def put(items: np.ndarray, from_end: bool) -> None:
        """Places of items by their character and the place of what follows them."""
        items = items[np.argsort(s[items].astype(np.int64) * n + place[items + 1])]
        chars = s[items]
        first = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
        counts = np.diff(np.concatenate((first, [len(items)])))
        base = ends[chars[first]] - counts if from_end else heads[chars[first]]
        place[items] = np.repeat(base - first, counts) + np.arange(len(items))

    def sweep(seeds: np.ndarray, smaller: bool) -> None:
        pending: list[list[np.ndarray]] = [[] for _ in range(blocks)]

        def wait(items: np.ndarray) -> None:
            of = block[s[items]]
            order = np.argsort(of, kind="stable")
            items, of = items[order], of[order]
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(items)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    pending[of[i]].append(items[i:j])

        wait(seeds)
        for b in range(blocks - 1, -1, -1) if smaller else range(blocks):
            if not pending[b]:
                continue
            have, later = np.concatenate(pending[b]), []
            put(have, smaller)
            wave = have
            while len(wave):
                before = wave[wave > 0] - 1
                before = before[is_s[before] == smaller]
                inner = block[s[before]] == b
                later.append(before[~inner])
                wave = before[inner]
                if len(wave):
                    # What lies in the block already may move, but keeps its order.
                    have = np.concatenate((have, wave))
                    put(have, smaller)
            wait(np.concatenate(later))
            pending[b] = []

    counts = np.bincount(s[lms], minlength=len(sizes))
    place[lms] = np.repeat(ends - counts - (np.cumsum(counts) - counts), counts) + np.arange(len(lms))
    place[n - 1] = 0
    inner = lms[lms > 0]
    sweep(inner - 1, False)
    larger = np.flatnonzero(~is_s)
    larger = larger[larger > 0]
    sweep(larger[is_s[larger - 1]] - 1, True)
    sa = np.empty(n, np.int64)
    sa[place] = np.arange(n)
    return sa


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers, the empty suffix not included."""
    if len(text) == 0:
        return np.empty(0, np.int32)
    return _suffixes(np.concatenate((text.astype(np.int32) + 1, [0])).astype(np.int16))[1:]


def _suffixes(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string whose last element is its only smallest one, 0."""
    n = len(s)
    is_s = _types(s)
    sizes = np.bincount(s)
    induce = _induce if len(sizes) <= 300 else _induce_wide
    is_lms = np.zeros(n, bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        # Order of the LMS substrings, from unsorted LMS positions.
        sa = induce(s, is_s, lms[np.argsort(s[lms], kind="stable")], sizes)
        sub = sa[is_lms[sa]]
        names = _names(s, is_lms, lms, sub)
        number = np.empty(n, np.int32)
        number[lms] = np.arange(len(lms))
        string = np.empty(len(lms), np.int64)
        string[number[sub]] = names
        ordered = lms[_suffixes(string)] if names[-1] != len(lms) - 1 else sub
    else:
        ordered = lms
    return induce(s, is_s, ordered, sizes)


def _names(s: np.ndarray, is_lms: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of LMS substrings in their order; equal ones get the same name."""
    length = np.empty(len(s), np.int32)
    length[lms] = np.concatenate((lms[1:], lms[-1:])) - lms + 1
    length = length[ordered]
    same = np.zeros(len(ordered), bool)
    same[1:] = length[1:] == length[:-1]
    at = np.flatnonzero(same)
    a, b, left = ordered[at - 1], ordered[at], length[at]
    step = 0
    alive = np.arange(len(at))
    while len(alive):
        equal = s[a[alive] + step] == s[b[alive] + step]
        same[at[alive[~equal]]] = False
        step += 1
        alive = alive[equal & (left[alive] > step)]
    return np.cumsum(~same) - 1


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, cap: int) -> np.ndarray:
    """Permuted: for each position, the prefix its suffix shares with the one before it in order.

    ``text`` are bytes.  Where the bytes before both suffixes are equal the
    value is the left neighbour's less one; the others are compared, up to
    ``cap``.  Positions in ``starts`` are always compared, so that a value of
    at most ``cap`` less the distance to the last start is exact.
    """
    n = len(text)
    phi = np.empty(n, np.int32)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    compared = np.ones(n, bool)
    inner = (at > 0) & (phi > 0)
    i = at[inner]
    compared[i] = text[i - 1] != text[phi[i] - 1]
    compared[starts] = True
    heads = np.flatnonzero(compared)
    value = np.zeros(len(heads), np.int64)
    padded = np.concatenate((text, np.zeros(cap + 8, np.uint8))).tobytes()
    words = np.ndarray((n + cap + 1,), np.dtype("<u8"), padded, strides=(1,))
    alive = np.flatnonzero(phi[heads] >= 0)
    for step in range(0, cap, 8):
        if not len(alive):
            break
        a, b = heads[alive], phi[heads[alive]]
        x = words[a + step] ^ words[b + step]
        value[alive] += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8)
        alive = alive[x == 0]
    value = np.minimum(value, n - np.maximum(heads, phi[heads]))
    last = np.maximum.accumulate(np.where(compared, at, 0))
    full = np.zeros(n, np.int64)
    full[heads] = value
    return np.maximum(full[last] - (at - last), 0)
