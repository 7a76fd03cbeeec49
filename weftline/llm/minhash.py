"""ProbMinHash signatures of weighted word shingles.

A text's elements are its distinct five-word shingles; an element that occurs tf times weighs 1 + log2(tf). Each element is a
Poisson process whose rate is its weight; every arrival goes to a random register, and a register keeps the element that came
first. Two texts agree in a register with the probability Jaccard similarity of their weighted sets, which is the plain
Jaccard similarity where all weights are equal. An element stops as soon as its arrival is later than what every register
holds (early termination); all texts of a run go through the arrivals together.
"""

from __future__ import annotations

import numpy as np

from .common import mix

_U64 = np.uint64
SHINGLE = 5


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` words; a shorter text is one shingle, an empty one has none."""
    if not words.size:
        return words
    width = min(size, words.size)
    out = words[: words.size - width + 1] * _U64(width * 2 + 1)
    for k in range(1, width):
        out = mix(out) + words[k : words.size - width + 1 + k]
    return mix(out)


def weighted(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights."""
    found, times = np.unique(shingles(words, size), return_counts=True)
    return found, 1 + np.log2(times)


def signatures(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """A row of `registers` element hashes for each text; text i has elements offsets[i]:offsets[i + 1]. A text without elements has zeros."""
    n = offsets.size - 1
    first = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, _U64)
    of = np.repeat(np.arange(n), np.diff(offsets))
    element, rate, when = elements, weights, np.zeros(elements.size)
    k = np.zeros(1, _U64)
    while element.size:
        k = k + _U64(1)
        draw = mix(element + k * _U64(0x9E3779B97F4A7C15))
        when = when - np.log(((draw >> _U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        at = of * registers + (mix(draw + _U64(0xD1B54A32D192ED03)) % _U64(registers)).astype(np.int64)
        np.minimum.at(first, at, when)
        won = first[at] == when
        holder[at[won]] = element[won]
        latest = first.reshape(n, registers).max(1)
        live = when < latest[of]
        of, element, rate, when = of[live], element[live], rate[live], when[live]
    return holder.reshape(n, registers)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each run of `rows` registers, as signed 64-bit integers."""
    n, m = signature.shape
    parts = signature.reshape(n, m // rows, rows)
    out = np.tile(np.arange(1, m // rows + 1, dtype=_U64), (n, 1))
    for k in range(rows):
        out = mix(out + parts[:, :, k])
    return out.view(np.int64)
