"""Suffix arrays by the difference-cover algorithm of Kärkkäinen and Sanders (2003), in numpy."""

from __future__ import annotations

import numpy as np


def _joined(high: np.ndarray, low: np.ndarray, span: int) -> tuple[np.ndarray, int]:
    """Keys that order as the pairs (high, low) do, low < span, and their bound; squeezed to ranks where 63 bits don't hold them."""
    top = int(high.max(initial=0)) + 1
    if top * span >= 1 << 62:
        high = np.unique(high, return_inverse=True)[1].astype(np.int64)
        top = int(high.max(initial=0)) + 1
    return high * span + low, top * span


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (whole numbers of 1 or more) in ascending order; an end sorts before any symbol.

    The suffixes at places 1 and 2 modulo 3 are the sample: their triples are sorted and named,
    and where names repeat, the string of names is sorted in turn. The others are sorted by their
    first symbol and the rank of the rest, which is in the sample, and merged with the sample by
    the ranks one or two places on.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    span = int(t.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a last empty triple parts the two halves
    sample = np.concatenate([one, two])
    key, _ = _joined(t[sample], t[sample + 1], span)
    key, _ = _joined(key, t[sample + 2], span)
    distinct, names = np.unique(key, return_inverse=True)
    if len(distinct) < len(sample):
        order = suffix_array(names + 1)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(len(sample))
    else:
        order = np.empty(len(sample), np.int64)
        order[names] = np.arange(len(sample))
    ranks = len(sample) + 2
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names + 1
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]

    zero = np.arange(0, n, 3)
    by_one = t * ranks  # first symbol and the rank of what follows
    by_one[: n + 2] += rank[1:]
    zero = zero[np.argsort(by_one[zero], kind="stable")]
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(by_one[ones], by_one[zero])
    both = np.concatenate([zero, twos])
    pair, _ = _joined(t[both], t[both + 1], span)
    by_two, _ = _joined(pair, rank[both + 2], ranks)
    before += np.searchsorted(by_two[len(zero) :], by_two[: len(zero)])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at] = zero
    out[rest] = sorted_sample
    return out


def equal_neighbours(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in order but the first: whether its next ``length`` (8 or more) bytes equal those of the one before.

    data: uint8, with length bytes at least after each place in order.
    """
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    same = np.arange(1, len(order))
    for at in [*range(0, length - 7, 8), length - 8]:
        same = same[words[order[same] + at] == words[order[same - 1] + at]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[same - 1] = True
    return out
