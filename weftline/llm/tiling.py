"""Greedy string tiling with running Karp-Rabin matching, on arrays of word hashes."""

from __future__ import annotations

import heapq

import numpy as np

from .common import mix

_U64 = np.uint64
_B = 0x2545F4914F6CDD1D


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    if words.size < size:
        return np.zeros(0, _U64)
    out = words[: words.size - size + 1].copy()
    for k in range(1, size):
        out = mix(out) + words[k : words.size - size + 1 + k]
    return mix(out)


def _running(words: np.ndarray, size: int, powers: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `size` words, from running sums; multiplied so that a run's place does not matter."""
    sums = np.concatenate([[_U64(0)], np.add.accumulate(words * powers[: words.size])])
    return (sums[size:] - sums[:-size]) * powers[powers.size - 1 - np.arange(words.size - size + 1)]


#: Pairs of places that are looked at together.
PAIRS = 1 << 18


def _runs(pattern: np.ndarray, text: np.ndarray, free_p: np.ndarray, free_t: np.ndarray, size: int, powers: np.ndarray):
    """(length, place in pattern, place in text) of the common runs of free words that are at least `size` long and cannot be extended."""
    ok_p = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(free_p, size).all(1))
    ok_t = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(free_t, size).all(1))
    if not ok_p.size or not ok_t.size:
        return
    hp, ht = _running(pattern, size, powers)[ok_p], _running(text, size, powers)[ok_t]
    order = np.argsort(hp, kind="stable")
    hp, ok_p = hp[order], ok_p[order]
    low, high = np.searchsorted(hp, ht), np.searchsorted(hp, ht, side="right")
    many = high - low
    ok_t, low, many = ok_t[many > 0], low[many > 0], many[many > 0]
    ends = np.cumsum(many)
    for at in range(0, ends[-1] if ends.size else 0, PAIRS):
        k = np.arange(at, min(at + PAIRS, ends[-1]))
        row = np.searchsorted(ends, k, side="right")
        i, j = ok_p[low[row] + k - (ends[row] - many[row])], ok_t[row]
        before = (i > 0) & (j > 0)
        before[before] = free_p[i[before] - 1] & free_t[j[before] - 1] & (pattern[i[before] - 1] == text[j[before] - 1])
        i, j = i[~before], j[~before]  # the others are parts of runs that begin earlier
        n = np.zeros(i.size, np.int64)
        live = np.arange(i.size)
        while live.size:
            live = live[(i[live] + n[live] < pattern.size) & (j[live] + n[live] < text.size)]
            x, y = i[live] + n[live], j[live] + n[live]
            live = live[free_p[x] & free_t[y] & (pattern[x] == text[y])]
            n[live] += 1
        yield from zip(*(v[n >= size].tolist() for v in (-n, i, j)), strict=True)


def tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, length) of the tiles: the longest common run of unmarked words first, until none has `least` words.

    Runs of equal length are taken in order of their place in the pattern, then in the text. The search length starts at the pattern's
    length and is halved. A run that a tile has cut comes back with the parts that are left, so every tile is the longest of its time.
    """
    free_p, free_t = np.ones(pattern.size, bool), np.ones(text.size, bool)
    out: list[tuple[int, int, int]] = []
    size = min(pattern.size, text.size)
    powers = np.multiply.accumulate(np.concatenate([[_U64(1)], np.full(max(pattern.size, text.size), _U64(_B))]))
    while size >= least:
        queue = list(_runs(pattern, text, free_p, free_t, size, powers))
        heapq.heapify(queue)
        left_p, left_t = bytearray(free_p), bytearray(free_t)
        while queue:
            n, i, j = heapq.heappop(queue)
            n = -n
            p, t = left_p[i : i + n], left_t[j : j + n]
            if 0 not in p and 0 not in t:
                left_p[i : i + n] = left_t[j : j + n] = bytes(n)
                out.append((i, j, n))
            elif p.count(1) >= size and t.count(1) >= size:
                free = bytes(x & y for x, y in zip(p, t, strict=True))
                a = 0
                for part in free.split(b"\0"):
                    if len(part) >= size:
                        heapq.heappush(queue, (-len(part), i + a, j + a))
                    a += len(part) + 1
        free_p, free_t = np.frombuffer(bytes(left_p), bool), np.frombuffer(bytes(left_t), bool)
        if not free_p.any():
            break
        if size == least:
            break
        size = max(least, size // 2)
    return out


def condensed(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that lie in runs of `size` from `starts`, and their places; runs that do not touch are parted by a word that matches nothing."""
    at = np.unique((starts[:, None] + np.arange(size)).ravel())
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    apart = mix(at[gaps].astype(_U64) + _U64(0x51ED270B0F1C9E37))
    return np.insert(words[at], gaps, apart), np.insert(at, gaps, -1)
