"""BPE encoding and decoding [method: batched numpy merge rounds].

Symbols of many words lie in one flat array. A round finds every adjacent pair's rank by binary
search over sorted pair keys, takes each word's lowest, merges all its occurrences from the left
and looks up only the pairs that changed. Distinct words are merged once: an open-addressing
table of word hashes leads to their ids, so a text is split, hashed and gathered as arrays. Every
word found is compared with the table's own characters; texts with a word that differs, as hashes
can collide, take the way of the next paragraph.

Texts in scripts outside the split table, or with the strings of special tokens, are split by the
tokenizers library itself and then merged by the same rounds.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, textvec

_NONE = np.int32(2**31 - 1)


class Merges:
    """The merge rules of a tokenizers JSON file as sorted pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens") or []
        vocab = model["vocab"]
        self.path = path
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words = bool(self.suffix)  # the pattern that drops white space and lowers case
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.size = max(self.tokens) + 1
        alphabet = byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in alphabet], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # a pair stated twice has its first rank
        self.keys, rank = np.unique(keys, return_index=True)
        self.rank = rank.astype(np.int32)
        self.new = new

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as UTF-8 bytes, flat, and the number of each word's ids."""
        size = np.diff(offsets)
        word = np.repeat(np.arange(len(size)), size)
        symbol = self.first[data]
        ends = offsets[1:][size > 0] - 1
        symbol[ends] = self.last[data[ends]]
        rank = np.full(len(symbol), _NONE, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(start, len(word)))
            least = np.minimum.reduceat(rank, start)
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, count)
                done.append((word[gone], symbol[gone]))
                symbol, word, rank = symbol[~gone], word[~gone], rank[~gone]
                least, count = least[~over], count[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            # of touching occurrences (a pair of one symbol twice), every other one from the left
            run = np.append(True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]]))
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            symbol[hit] = self.new[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            stale = np.concatenate([at, at[at > 0] - 1])
            inside = stale[stale + 1 < len(word)]
            inside = inside[word[inside] == word[inside + 1]]
            rank[stale] = _NONE
            rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
        word, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(size))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class HashTable:
    """64-bit keys to positions 0, 1, 2, ..., all steps over arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions, -1 where absent."""
        slot = self._slots(h)
        key = self.keys[slot]
        out = np.where(key == h, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((key != h) & (key != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            key = self.keys[slot]
            hit = key == h[open_]
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (key != 0)
            open_, slot = open_[more], slot[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct keys that are absent get the next positions in their order."""
        while (self.count + len(h)) * 2 > 1 << self.bits:
            old = self.values[self.keys != 0], self.keys[self.keys != 0]
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(old[1], old[0])
        self._place(h, np.arange(self.count, self.count + len(h), dtype=np.int32))
        self.count += len(h)

    def _place(self, h: np.ndarray, value: np.ndarray) -> None:
        slot = self._slots(h)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.values[slot[won]] = value[won]
            h, value, slot = h[~won], value[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] for every i, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - size), size)]


def _with_room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, doubled until it holds n."""
    while n > len(a):
        a = np.concatenate([a, np.zeros_like(a)])
    return a


class Encoder:
    """Text to ids. Keeps the ids of up to `words` distinct pre-tokens, then starts anew."""

    def __init__(self, path: str, words: int = 400_000):
        self.merges, self.limit = Merges(path), words
        self._library = None
        self._reset()
        longest = max((len(t.encode()) for t in self.merges.tokens.values()), default=1)
        assert longest < 1 << 16
        names = [(self.merges.tokens.get(i, "") + " ").encode() for i in range(self.merges.size)]
        self._names = np.frombuffer(b"".join(names), np.uint8)
        self._name_size = np.array([len(x) for x in names], np.int64)
        self._name_start = np.cumsum(self._name_size) - self._name_size

    def _reset(self) -> None:
        self.table = HashTable()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.chars, self.chars_used = np.zeros(1 << 16, np.uint16), 0
        self.char_start, self.char_size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.by_word: dict[bytes, np.ndarray] = {}

    def _library_ids(self, text: str) -> np.ndarray:
        """Ids of a text that the library splits; its words are merged by the same rounds."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.merges.path)
            self._byte = {c: b for b, c in enumerate(byte_alphabet())}
        words: list[bytes | int] = []
        at = 0
        while at <= len(text):
            found = min(((i, -len(c), c) for c in self.merges.special if (i := text.find(c, at)) >= 0), default=(len(text), 0, ""))
            part = text[at : found[0]]
            if part:
                normal = self._library.normalizer.normalize_str(part) if self._library.normalizer else part
                words += [bytes(map(self._byte.__getitem__, piece)) for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]
            if not found[2]:
                break
            words.append(self.merges.special[found[2]])
            at = found[0] + len(found[2])
        new = list({w for w in words if isinstance(w, bytes) and w not in self.by_word})
        if new:
            ids, count = self.merges.merge(np.frombuffer(b"".join(new), np.uint8), np.append(0, np.cumsum([len(w) for w in new])))
            self.by_word.update(zip(new, np.split(ids.astype(np.uint32), np.cumsum(count)[:-1])))
        return np.concatenate([np.zeros(0, np.uint32), *(self.by_word[w] if isinstance(w, bytes) else np.array([w], np.uint32) for w in words)])

    def _append(self, keys: np.ndarray, chars: np.ndarray, char_size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        n, m = self.table.count, len(keys)
        self.table.add(keys)
        self.flat = _with_room(self.flat, self.used + len(ids))
        self.chars = _with_room(self.chars, self.chars_used + len(chars))
        for name in ("start", "size", "char_start", "char_size"):
            setattr(self, name, _with_room(getattr(self, name), n + m))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(count) - count
        self.size[n : n + m] = count
        self.chars[self.chars_used : self.chars_used + len(chars)] = chars
        self.char_start[n : n + m] = self.chars_used + np.cumsum(char_size) - char_size
        self.char_size[n : n + m] = char_size
        self.used += len(ids)
        self.chars_used += len(chars)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32, flat) of UTF-8 texts and each text's offsets in them."""
        if self.table.count + len(self.by_word) > self.limit:
            self._reset()
        texts = len(offsets) - 1
        cps, off = textvec.code_points(data, offsets)
        inside = np.minimum(cps, textvec.TABLE - 1)
        kind = textvec.KIND[inside]
        kind[cps >= textvec.TABLE] = textvec.SLOW
        slow = np.zeros(texts, bool)
        odd = np.flatnonzero(kind == textvec.SLOW)
        slow[np.searchsorted(off, odd, "right") - 1] = True
        raw = data.tobytes()
        for special in self.merges.special:
            at = raw.find(special.encode())
            while at >= 0:
                slow[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(special.encode(), at + 1)
        # code points that the table knows have 16 bits; other texts go to the library
        chars = (textvec.LOWER[inside] if self.merges.words else inside).astype(np.uint16)
        start, end = textvec.split(chars, kind, off, self.merges.words)
        text = np.repeat(np.arange(texts), np.diff(np.searchsorted(start, off)))
        if slow.any():
            kept = ~slow[text]
            start, end, text = start[kept], end[kept], text[kept]
        keys = self._keys(chars, start, end)
        seen = self.table.find(keys)
        if len(missing := np.flatnonzero(seen < 0)):
            new, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            size = end[first] - start[first]
            own = gather(chars, start[first], size)
            wide = np.ones(len(own), np.int64) + (own >= 0x80) + (own >= 0x800)
            byte_ends = np.append(0, np.cumsum(wide))
            word_off = np.append(0, byte_ends[np.cumsum(size)])
            flat = np.frombuffer(own.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            self._append(new, own, size, *self.merges.merge(flat, word_off))
            seen[missing] = self.table.find(keys[missing])
        same = self.char_size[seen] == end - start
        same[same] = textvec.same_spans(chars, start[same], self.chars, self.char_start[seen[same]], self.char_size[seen[same]])
        if not same.all():
            slow[text[~same]] = True
            kept = ~slow[text]
            seen, text = seen[kept], text[kept]
        size = self.size[seen]
        ids = gather(self.flat, self.start[seen], size)
        bounds = np.append(0, np.cumsum(size))[np.searchsorted(text, np.arange(texts + 1))]
        if not slow.any():
            return ids, bounds
        parts = [self._library_ids(raw[offsets[i] : offsets[i + 1]].decode()) if slow[i] else ids[bounds[i] : bounds[i + 1]] for i in range(texts)]
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    def _keys(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textvec.hash_spans(chars, start, end) | np.uint64(1)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of decode(ids, skip_special_tokens=False), as the library gives it."""
        if self.merges.words:  # no decoder: tokens joined by a blank
            return gather(self._names, self._name_start[ids], self._name_size[ids])[:-1].tobytes()
        special = set(self.merges.special.values())
        if not hasattr(self, "_plain"):
            back = {c: b for b, c in enumerate(byte_alphabet())}
            self._plain = [t.encode() if i in special else bytes(map(back.__getitem__, t)) for i, t in sorted(self.merges.tokens.items())]
        return b"".join(map(self._plain.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, flat ids, their offsets) in steps of bounded size."""
    enc = encoder(path)
    for batch in batches:
        data, offsets = common.text_view(batch.column(text))
        for a, b in common.chunks(offsets):
            part = offsets[a : b + 1]
            yield batch.slice(a, b - a), *enc.encode(data[part[0] : part[-1]], part - part[0])


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every text. A null text is empty and has no ids.

    Rows are independent: repeated rows give repeated results, an empty table an empty one; other
    columns of the input are not read.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select(key, text)

    def run(batches):
        for rows, ids, off in encoded(batches, vocabulary, text):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))], ["key", "ids"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded_docs: DataFrame, vocabulary: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of every id list, special tokens included; a null list is empty text."""
    docs = encoded_docs.select(key, ids)

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            out = [enc.decode(np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64)).decode() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "text"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the very ids.

    Null text: empty. One pass, no shuffle; memory is bounded by a step of texts and the word table.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        for rows, ids, off in encoded(batches, vocabulary):
            enc = encoder(vocabulary)
            shas, decoded = [], []
            for a, b in zip(off[:-1], off[1:]):
                own = ids[a:b]
                shas.append(hashlib.sha256(own.astype("<u4").data).hexdigest())
                decoded.append(hashlib.sha256(enc.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(off)), pa.array(shas), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def crc32s(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each span of ids as little-endian 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64)
