"""Suffix sorting by linear grouping.

Suffixes are first grouped by their Lyndon prefixes. Groups are processed from the
highest to the lowest: the previous-smaller pointers of a group's suffixes say
which suffixes of lower groups its word extends, and these move behind the rest
of their group, those extended most often last. Then each group's order is
emitted from the order of what follows: a finished suffix places every suffix
whose Lyndon prefix ends where it starts. No names are made and nothing is sorted
recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(data: bytes) -> list[int]:
    n = len(data)
    codes = np.frombuffer(data, np.uint8)
    order = np.argsort(codes, kind="stable")
    sa = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at = place.tolist()
    begins = np.searchsorted(codes[order], np.arange(257))
    group = begins[codes].tolist()  # where a suffix's group begins
    size = [0] * n
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b > a:
            size[a] = b - a
    prev = [-1] * n
    end = n
    while end:
        g = group[sa[end - 1]]
        members = sa[g:end]
        if len(members) > 1:
            members.sort()
        counts: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > g:
                p = prev[p]
            if p >= 0:
                if group[p] == g:  # the same word just before: it has the same pointer
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
        end = g
        if not counts:
            continue
        levels: dict[int, list[int]] = {}
        for p, c in counts.items():
            levels.setdefault(c, []).append(p)
        for c in sorted(levels, reverse=True):
            by_group: dict[int, list[int]] = {}
            for p in levels[c]:
                by_group.setdefault(group[p], []).append(p)
            for o, moved in by_group.items():
                rest = size[o] - len(moved)
                if not rest:
                    continue
                tail = o + size[o]
                for p in moved:
                    tail -= 1
                    q, x = sa[tail], at[p]
                    sa[x], at[q] = q, x
                    sa[tail], at[p] = p, tail
                size[o] = rest
                size[tail] = len(moved)
                for p in moved:
                    group[p] = tail
    free = list(range(n))
    done = [False] * n
    out = [0] * n
    j = n - 1
    while j >= 0:
        g = group[j]
        out[free[g]] = j
        free[g] += 1
        done[j] = True
        j = prev[j]
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = prev[j]
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its substrings of `length` bytes start anywhere else too.

    The texts are joined with zero bytes between; neighbours in the suffix array
    that agree on `length` bytes within their texts are repeats.
    """
    joined = b"\x00".join(texts) + b"\x00"
    sizes = np.array([len(t) for t in texts])
    firsts = np.cumsum(sizes + 1) - sizes - 1
    sa = np.array(suffix_array(joined))
    valid = np.zeros(len(joined), bool)
    for a, n in zip(firsts.tolist(), sizes.tolist(), strict=True):
        valid[a : a + max(0, n - length + 1)] = True
    both = valid[sa[:-1]] & valid[sa[1:]]
    a, b = sa[:-1][both], sa[1:][both]
    raw = np.frombuffer(joined + bytes(8), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(np.uint64).ravel()
    step = min(8, length)
    for t in [*range(0, length - step + 1, step), length - step]:
        x, y = words[a + t], words[b + t]
        if step < 8:
            mask = np.uint64((1 << 8 * step) - 1)
            x, y = x & mask, y & mask
        same = x == y
        a, b = a[same], b[same]
    hit = np.zeros(len(joined), bool)
    hit[a] = True
    hit[b] = True
    return [hit[s : s + max(0, n - length + 1)] for s, n in zip(firsts.tolist(), sizes.tolist(), strict=True)]
