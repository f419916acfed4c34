import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terravane.llm import bpe, common, packing, token_files

FILES = {n: public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
LIBRARY = {n: Tokenizer.from_file(p) for n, p in FILES.items()}


def mine(name, texts):
    enc = bpe.encoder(FILES[name])
    ids, off = enc.encode(*common.text_view(pa.array(texts, pa.string())))
    return [ids[a:b] for a, b in zip(off[:-1], off[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 'stremvdl \n\t.,!12é—ßΣ日"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_ids_and_text_are_the_librarys(texts):
    for name, library in LIBRARY.items():
        for text, got in zip(texts, mine(name, texts)):
            want = library.encode(text, add_special_tokens=False).ids
            assert got.tolist() == want, (name, text)
            assert bpe.encoder(FILES[name]).decode(got).decode() == library.decode(want, skip_special_tokens=False)


def thue_morse(n):
    """A word and its complement, which sums of symbols times powers can't tell apart."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 2048, 8192])
def test_words_that_weak_hashes_confuse(n):
    texts = [*thue_morse(n), " ".join(thue_morse(n))]
    for name, library in LIBRARY.items():
        for text, got in zip(texts, mine(name, texts)):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_whose_hashes_collide(few_docs, monkeypatch):
    monkeypatch.setattr(bpe.Encoder, "_keys", lambda self, chars, start, end: (chars[start].astype(np.uint64) % np.uint64(3)) + np.uint64(1 << 62))
    texts = [r.text for r in few_docs.limit(20).collect()] + ["a b", "d", "", "e d a d"]
    for name, library in LIBRARY.items():
        enc = bpe.Encoder(FILES[name])
        ids, off = enc.encode(*common.text_view(pa.array(texts, pa.string())))
        for text, a, b in zip(texts, off[:-1], off[1:]):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests(few_docs, odd_docs, no_docs):
    library = LIBRARY["word_bpe_49k.json"]
    for docs in (few_docs, odd_docs):
        want = []
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = [tuple(r) for r in bpe.round_trip_digests(docs, FILES["word_bpe_49k.json"]).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.round_trip_digests(no_docs, FILES["word_bpe_49k.json"]).count() == 0


def test_encode_then_decode(odd_docs):
    path = FILES["byte_bpe_50k.json"]
    back = bpe.decode(bpe.encode(odd_docs, path), path)
    assert sorted(map(str, back.collect())) == sorted(map(str, odd_docs.selectExpr("doc_id", "coalesce(text, '') text").collect()))


def test_token_files(few_docs, odd_docs, no_docs, tmp_path):
    library = LIBRARY["byte_bpe_50k.json"]
    for k, docs in enumerate((few_docs.repartition(5), odd_docs, no_docs)):
        root = f"file://{tmp_path}/{k}"
        token_files.write(docs, root, FILES["byte_bpe_50k.json"], 2)
        got = token_files.read(docs.sparkSession, root).orderBy("start").collect()
        rows = docs.collect()
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d))
        want = sorted((str(r.doc_id), len(ids := [*library.encode(r.text or "", add_special_tokens=False).ids, 2]), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for r in rows)
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
        starts = [r.start for r in got]
        assert starts == [0, *np.cumsum([r.n_tokens for r in got]).tolist()][: len(got)]


def best_fit_decreasing(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, left in enumerate(room) if left >= s]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= s
        else:
            room.append(capacity - s)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_over_counts(sizes):
    histogram = {s: sizes.count(s) for s in set(sizes)}
    taken = {}
    for length, first, n, at, offset, each in packing.plan(histogram, 40):
        for r in range(n):
            taken.setdefault(at + r // each, []).append((offset + length * (r % each), length))
    for slots in taken.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 40
    assert sorted(length for slots in taken.values() for _, length in slots) == sorted(sizes)
    assert len(taken) <= best_fit_decreasing(sizes, 40)


@pytest.mark.parametrize("capacity", [4096, 100])
def test_packing(few_docs, odd_docs, no_docs, capacity):
    library, path = LIBRARY["word_bpe_49k.json"], FILES["word_bpe_49k.json"]
    for docs in (few_docs.repartition(3), odd_docs, no_docs):
        want = []
        for r in docs.collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
            for i, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                want.append((str(r.doc_id), i, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
        got = packing.pack(docs, path, 1, capacity).collect()
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for slots in bins.values():
            ends = np.cumsum([n for _, n in sorted(slots)])
            assert [at for at, _ in sorted(slots)] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert len(bins) <= best_fit_decreasing([w[3] for w in want], capacity)


def test_packing_keeps_ids(odd_docs):
    got = packing.pack(odd_docs, FILES["word_bpe_49k.json"], 1, 64, keep_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32 for r in got)
