"""Repeated substrings of a block by threshold-bounded interval expansion.

Suffixes are sorted to the threshold's depth. From the Burrows-Wheeler transform, intervals of
suffixes with a common prefix grow backwards by one symbol a level, all of a level at once. A
level closes the borders between suffixes whose common prefix has exactly its length, so common
prefixes come by increasing value; it stops at the minimum length. Suffixes with no border between
them share at least that many symbols.
"""

from __future__ import annotations

import numpy as np

from .bpe import gather


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first `depth` symbols at least, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    bits = np.uint64(9)  # symbols are bytes + 1, and 0 ends a string
    for i in range(7):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key)
    sorted_ = key[order]
    done = 7
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1]))
        if done >= depth or rank[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: n - done] = rank[done:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        sorted_ = key[order]
        done *= 2


def borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """borders[i]: do suffixes order[i - 1] and order[i] differ within `length` symbols, or end."""
    n = len(text)
    previous = text[order - 1]  # the suffix at 0 has the last symbol before it, an end
    by_symbol = np.argsort(previous, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    # the next and the last earlier place with the same symbol before it
    same = previous[by_symbol[1:]] == previous[by_symbol[:-1]]
    later, earlier = np.full(n, n), np.full(n, -1)
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]
    closed = np.zeros(n + 1, bool)
    closed[0] = closed[n] = True
    ends = int(np.count_nonzero(text == 0))
    closed[: ends + 1] = True
    # level 0: the empty prefix extends to every symbol, that of an end included
    count = np.bincount(text)
    right = np.cumsum(count[count > 0])
    left = right - count[count > 0]
    closed[right] = True
    for _ in range(1, length):
        # an interval of one suffix extends as well: it can close a border
        size = right - left
        at = gather(np.arange(n), left, size)
        low, high = np.repeat(left, size), np.repeat(right, size)
        inner = previous[at] != 0
        first = np.sort(lf[at[inner & (earlier[at] < low)]])
        last = np.sort(lf[at[inner & (later[at] >= high)]])
        new = ~closed[last + 1]
        left, right = first[new], last[new] + 1
        closed[right] = True
        if not len(left):
            break
    return closed[:n]


def repeat_classes(strings: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in `strings`) of every substring of `length` bytes within a string, and class
    numbers that are equal where the substrings are."""
    size = np.diff(offsets)
    text = np.zeros(len(strings) + len(size), np.int64)
    where = np.arange(len(strings)) + np.repeat(np.arange(len(size)), size)
    text[where] = strings.astype(np.int64) + 1
    order = sort_suffixes(text, length)
    group = np.cumsum(borders(text, order, length))
    class_ = np.empty(len(text), np.int64)
    class_[order] = group
    starts = gather(np.arange(len(strings)), offsets[:-1], np.maximum(size - length + 1, 0))
    return starts, class_[where[starts]]
