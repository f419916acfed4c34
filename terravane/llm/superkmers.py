"""Windows of a sequence grouped by their minimizer, so that equal windows meet without a row each.

A window's anchor is its leftmost gram of least hash. It depends on the window's content alone:
equal windows, wherever they start, have equal anchors at equal distance. Neighbouring windows
with the same anchor occurrence form a run; one record stands for all of a run's windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import textvec

_DISTANCE = np.uint64(0xFF)


@dataclass
class Runs:
    """text: its number in the step; first: start of the first window in the text; count: of
    windows; anchor: the gram's hash; context: hash of all the run's windows cover."""

    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    context: np.ndarray


def runs(symbols: np.ndarray, offsets: np.ndarray, window: int, gram: int, seed: int = 0) -> Runs:
    """Runs of all windows of the sequences symbols[offsets[i]:offsets[i + 1]]."""
    spread = window - gram + 1
    assert 1 <= spread <= 255
    none = np.zeros(0, np.int64)
    if len(symbols) < window:
        return Runs(none, none, none, none, none)
    grams = textvec.hash_windows(symbols, gram, seed)
    starts, ends = offsets[:-1], offsets[1:]
    n = len(grams) - spread + 1
    away = np.empty(n, np.uint8)
    for a in range(0, n, textvec.STRIDE):
        # the low byte is the distance to the least gram; leftmost wins, as the distance grows
        least, width = grams[a : a + textvec.STRIDE + spread - 1] & ~_DISTANCE, 1
        while width < spread:
            step = min(width, spread - width)
            least = np.minimum(least[: len(least) - step], least[step:] + np.uint64(step))
            width += step
        away[a : a + len(least)] = least & _DISTANCE
    whole = np.zeros(n + 1, np.int32)
    long_ = ends - starts >= window
    np.add.at(whole, starts[long_], 1)
    np.add.at(whole, ends[long_] - window + 1, -1)
    valid = np.cumsum(whole[:-1]) > 0
    fresh = valid.copy()
    # the same gram is one nearer to the next window
    fresh[1:] &= (away[1:] + np.uint8(1) != away[:-1]) | ~valid[:-1]
    fresh[starts[long_]] = True
    begin = np.flatnonzero(fresh)
    # a run ends before the next begins, or with the last window of its text
    text = np.searchsorted(ends, begin, "right")
    stop = np.minimum(np.append(begin[1:], n), ends[text] - window + 1)
    return Runs(text, begin - starts[text], stop - begin, grams[begin + away[begin]].view(np.int64), textvec.hash_spans(symbols, begin, stop + window - 1, seed).view(np.int64))


def anchors_at(anchor: np.ndarray, symbols: np.ndarray, offsets: np.ndarray, window: int, gram: int, seed: int = 0) -> np.ndarray:
    """Where in `symbols` the anchor of each run stands, of sequences that are what a run covers: it is
    the leftmost one of the first window."""
    grams = textvec.hash_windows(symbols, gram, seed)
    places = offsets[:-1, None] + np.arange(window - gram + 1)
    return offsets[:-1] + np.argmax((grams[places] ^ anchor.view(np.uint64)[:, None]) & ~_DISTANCE == 0, axis=1)


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 texts: their byte starts and ends, hashes as symbols, and
    each text's offsets in them."""
    gap = (data == 0x20) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~gap
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    start = np.flatnonzero(word & (before | edge[:-1]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    symbols = textvec.hash_spans(data, start, end)
    return start, end, symbols, np.searchsorted(start, offsets)
