"""Vectorised text: code points, pre-tokenizer splits and word hashes of many texts at once."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np

#: Code points below this are classified by table; texts with others take the library's splitter.
TABLE = 0x2100
SLOW, LETTER, NUMBER, OTHER, SPACE = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, low = np.zeros(TABLE, np.uint8), np.arange(TABLE, dtype=np.uint32)
    for c in range(TABLE):
        plain = c < 0x250 and not 0x1C <= c <= 0x1F and c != 0x130
        if not (plain or 0x2010 <= c <= 0x2027 or 0x2030 <= c <= 0x205E or 0x20A0 <= c <= 0x20BF):
            continue
        category = unicodedata.category(chr(c))
        if category == "Cn":
            continue
        kind[c] = LETTER if category[0] == "L" else NUMBER if category[0] == "N" else SPACE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) or category[0] == "Z" else OTHER
        if len(chr(c).lower()) == 1:
            low[c] = ord(chr(c).lower())
    kind[low >= TABLE] = SLOW
    return kind, np.where(low < TABLE, low, np.arange(TABLE)).astype(np.uint32)


KIND, LOWER = _tables()
#: Byte blocks of a span that are hashed in rounds; longer spans take a digest each.
_LONG = 4096
#: Windows that are hashed together: their arrays stay in a core's cache.
STRIDE = 8192
_C = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
_MASK = np.array([*((1 << 8 * i) - 1 for i in range(8)), 2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def blocks(units: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on, as an integer; bytes behind the end are 0."""
    raw = np.concatenate([np.ascontiguousarray(units).view(np.uint8), np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) - 7, np.dtype("<u8"), raw.data, strides=(1,))


def hash_spans(units: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes, code points or 64-bit symbols, eight bytes a round.

    A round is a product and a shift, so sums or powers of symbols play no part; spans of one
    length up to eight bytes never collide.
    """
    view, wide = blocks(units), units.itemsize
    at, size = np.asarray(start, np.int64) * wide, (np.asarray(end, np.int64) - start) * wide
    out = (size.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    done, live = 0, np.arange(len(size))
    far = size > _LONG
    if far.any():
        raw = np.ascontiguousarray(units).view(np.uint8)
        for i in np.flatnonzero(far):
            key = seed.to_bytes(8, "little")
            out[i] = int.from_bytes(hashlib.blake2b(raw[at[i] : at[i] + size[i]].data, digest_size=8, key=key).digest(), "little")
        live = np.flatnonzero(~far)
    while len(live):
        now = (out[live] ^ (view[at[live] + done] & _MASK[np.minimum(size[live] - done, 8)])) * _C
        now ^= now >> _HALF
        out[live] = now
        done += 8
        live = live[size[live] > done]
    return mix(out)


def hash_windows(units: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of every window of `size` bytes or 64-bit symbols, by start."""
    n = len(units) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if units.itemsize == 8:
        view, steps = units.view(np.uint64), range(size)
    elif size >= 8:
        view, steps = blocks(units), [*range(0, size - 8, 8), size - 8]
    else:
        view, steps = blocks(units) & _MASK[size], [0]
    out = np.full(n, np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))
    for a in range(0, n, STRIDE):
        part = out[a : a + STRIDE]
        for at in steps:
            part ^= view[a + at : a + at + len(part)]
            part *= _C
            part ^= part >> _HALF
        part[:] = mix(part)
    return out


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Is a[a_start : a_start + size] equal to b[b_start : b_start + size], for every span."""
    wide = a.itemsize
    x, y = blocks(a), blocks(b)
    at, to, size = np.asarray(a_start, np.int64) * wide, np.asarray(b_start, np.int64) * wide, np.asarray(size, np.int64) * wide
    out = np.ones(len(size), bool)
    live, done = np.flatnonzero(size > 0), 0
    while len(live):
        equal = (x[at[live] + done] ^ y[to[live] + done]) & _MASK[np.minimum(size[live] - done, 8)] == 0
        out[live[~equal]] = False
        done += 8
        live = live[equal & (size[live] > done)]
        if done >= _LONG and len(live):
            p, q = (np.ascontiguousarray(v).view(np.uint8) for v in (a, b))
            for i in live:
                out[i] = np.array_equal(p[at[i] + done : at[i] + size[i]], q[to[i] + done : to[i] + size[i]])
            break
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 `data` and each text's offsets in them."""
    cps = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) == len(data):
        return cps, offsets
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return cps, lead[offsets]


def _join_contractions(cps: np.ndarray, kind: np.ndarray, fresh: np.ndarray, text_start: np.ndarray, begin: np.ndarray) -> None:
    """Joins 's 't 'm 'd 're 've 'll to their apostrophe, in `begin`."""
    n = len(cps)
    at = np.flatnonzero((cps == 0x27) & begin)
    at = at[at + 1 < n]
    at = at[fresh[at + 1] & ~text_start[at + 1] & (kind[at + 1] == LETTER)]
    if not len(at):
        return
    second = cps[at + 1]
    one = at[(second == 0x73) | (second == 0x74) | (second == 0x6D) | (second == 0x64)]
    begin[one + 1] = False
    begin[one[one + 2 < n] + 2] = True
    two = at[at + 2 < n]
    a, b = cps[two + 1], cps[two + 2]
    pair = (((a == 0x72) | (a == 0x76)) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
    two = two[pair & ~fresh[two + 2]]
    begin[two + 1] = False
    begin[two[two + 3 < n] + 3] = True


def split(cps: np.ndarray, kind: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens of texts whose every code point is classified.

    words=True: letter runs, single numbers and runs of others; white space is dropped. False: the
    byte-level pattern, where one blank goes with what follows and white space is kept.
    """
    n = len(cps)
    text_start = np.zeros(n, bool)
    text_start[offsets[:-1][offsets[:-1] < n]] = True
    fresh = text_start.copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    begin = fresh.copy()
    if words:
        begin |= kind == NUMBER
    else:
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[1:])
        begin[last] = True
        begin[last[cps[last] == 0x20] + 1] = False
    _join_contractions(cps, kind, fresh, text_start, begin)
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n) if len(start) else start
    if words:
        kept = kind[start] != SPACE
        start, end = start[kept], end[kept]
    return start, end
