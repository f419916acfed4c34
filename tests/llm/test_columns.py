import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terravane.llm import language, media, sharding


def test_shards(few_docs, odd_docs, no_docs):
    for docs in (few_docs.repartition(3), odd_docs, no_docs):
        got = sharding.shard(docs).collect()
        rows = docs.collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
        sizes = [0] * 8
        for k in range(8):
            own = sorted((r for r in got if r.shard == k), key=lambda r: r.slot)
            assert [r.slot for r in own] == list(range(len(own)))
            sizes[k] = sum(r.size for r in own)
        total, longest = sum(sizes), max((w[1] for w in want), default=0)
        assert all(abs(s - total / 8) <= longest for s in sizes)
        in_order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert in_order == sorted(in_order, key=lambda d: (d is not None, d))


def test_media_digests(few_docs, odd_docs, no_docs):
    for docs in (few_docs, odd_docs, no_docs):
        want = []
        for r in docs.collect():
            raw = (r.text or "").encode()
            padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
            want.append((str(r.doc_id), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
        got = media.text_media_digests(docs).collect()
        assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(want)
        assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def slow_resize(gray, h, w):
    rows, cols = gray.shape
    out = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            y0, y1, x0, x1 = i * rows / h, (i + 1) * rows / h, j * cols / w, (j + 1) * cols / w
            for y in range(rows):
                for x in range(cols):
                    area = max(0, min(y + 1, y1) - max(y, y0)) * max(0, min(x + 1, x1) - max(x, x0))
                    out[i, j] += gray[y, x] * area
            out[i, j] /= (y1 - y0) * (x1 - x0)
    return out


@pytest.mark.parametrize("shape", [(1, 1), (3, 20), (17, 9), (8, 9), (30, 64)])
def test_area_resize(shape):
    gray = np.random.default_rng(1).integers(0, 256, shape).astype(float)
    assert np.allclose(media.area_resize(gray, 8, 9), slow_resize(gray, 8, 9))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 9), st.randoms())
def test_pictures_round_trip(width, height, random):
    pixels = np.array([random.randrange(256) for _ in range(width * height * 3)], np.uint8).reshape(height, width, 3)
    assert (media.decode(media.encode_ppm(pixels)) == pixels).all()
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert (media.read_tiles(media.npy_tiles(pixels, 4)) == pixels).all()


def test_other_netpbm_kinds():
    assert media.decode(b"P1 # note\n3 2\n1 0 1\n0 1 0").reshape(2, 3).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n\xa0\x40").reshape(2, 3).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n300\n7 299").dtype == np.uint16
    assert media.decode(b"P5\n2 1\n255\n\x07\x08").reshape(-1).tolist() == [7, 8]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").reshape(-1).tolist() == [258]
    for bad in (b"", b"P6\n9 9\n255\n123", b"BM123", b"P7\n", b"P2\n2 1\n0\n1 1", b"P6\n9"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_media_columns(spark):
    good = media.encode_ppm(np.full((2, 2, 3), 9, np.uint8))
    df = spark.createDataFrame([(1, good, "x"), (None, good, "y"), (2, None, None), (3, b"P6", "z"), (4, b"P5\n0 0\n255\n", "z")], "id long, tiles binary, dhash string")
    got = {r.id: r for r in media.media_columns(df.withColumnRenamed("tiles", "media"), "id", "media").collect()}
    assert got[1].tiles == got[None].tiles and (media.read_tiles(bytes(got[1].tiles)) == 9).all()
    assert got[2].tiles is None and got[2].error is None and got[3].error and got[4].error


def brute_log(word, prob, pieces):
    """In exact fractions, as long words have tiny likelihoods."""
    index = {p: i for i, p in enumerate(pieces)}
    exact = [Fraction(float(x)) for x in prob]
    total = [Fraction(1)] + [Fraction(0)] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(end):
            piece = index.get(word[begin:end], len(pieces) if end - begin == 1 else None)
            if piece is not None:
                total[end] += total[begin] * exact[piece]
    return math.log(total[-1].numerator) - math.log(total[-1].denominator)


def test_forward_sums_every_segmentation():
    from terravane.llm import common
    import pyarrow as pa

    pieces = sorted(["▁", "▁th", "th", "he", "e", "t", "h", "é", "▁the", "▁abcdefghijklmno", "bcdefghijklm"])
    prob = np.random.default_rng(3).dirichlet(np.ones(len(pieces) + 1), 2).T
    letters = np.array(sorted(map(ord, "abcdefghijklmnotheé")), np.uint32)
    scorer = language.Scorer(language.Model(["a", "b"], pieces, prob, letters))
    texts = ["The THE; he", "", "éééx 12", "日本the", "t" * 130, "abcdefghijklmno abcdefghijklmn", "日本 the", "12"]
    got, words, met = scorer.totals(*common.text_view(pa.array(texts)))
    for text, row, n, share in zip(texts, got, words, met):
        own = [w for w in language.words_of(text) if set(w) & set("abcdefghijklmnotheé")]
        assert n == len(own)
        every = [c for w in language.words_of(text) for c in w[1:]]
        assert share == (sum(c in "abcdefghijklmnotheé" for c in every) / len(every) if every else -1)
        for k in range(2):
            assert np.isclose(row[k], sum(brute_log(w, prob[:, k], pieces) for w in own))


def test_expected_uses_of_pieces():
    """Against the sum over all segmentations one by one; and in a word too long for plain products."""
    pieces = sorted(["▁", "a", "b", "ab", "▁a", "ba", "aba"])
    prob = np.random.default_rng(5).dirichlet(np.ones(len(pieces) + 1))
    lattice = language.Lattice(pieces)
    words, weight = ["▁abab", "▁bxa", "▁a"], np.array([2.0, 1.0, 5.0])

    def segmentations(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            piece = pieces.index(word[:n]) if word[:n] in pieces else len(pieces) if n == 1 else None
            if piece is not None:
                yield from ([piece, *rest] for rest in segmentations(word[n:]))

    want = np.zeros(len(pieces) + 1)
    for word, w in zip(words, weight):
        ways = list(segmentations(word))
        p = np.array([np.prod(prob[way]) for way in ways])
        for way, share in zip(ways, p / p.sum()):
            for piece in way:
                want[piece] += w * share
    cps, start, size = language._flat_words(words)
    assert np.allclose(lattice.expected(lattice.cuts(cps, start, size), size, prob, weight), want)
    cps, start, size = language._flat_words(["▁" + "x" * 3000])
    seen = lattice.expected(lattice.cuts(cps, start, size), size, prob * 1e-6, np.ones(1))
    assert np.isclose(seen[-1], 3000) and np.isclose(seen.sum(), 3001)


def test_language_accuracy_and_edges(spark, odd_docs, no_docs):
    from terravane.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    known = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in known) >= 0.97 * len(known)
    model = language.train(docs, queries.PIECES, rows=300)
    odd = language.predict(odd_docs, model).collect()
    assert len(odd) == odd_docs.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    assert language.predict(no_docs, model).count() == 0
    other = spark.createDataFrame([(1, "日" * 48), (2, "ж " * 48), (3, "日" * 30_000), (4, "the " * 20 + "日" * 80)], "doc_id long, text string")
    assert all(r.score < 0.5 and r.lang_pred in model.langs for r in language.predict(other.selectExpr("*", "1 AS score", "2 AS lang_pred"), model).collect())
    nothing = language.train(no_docs, queries.PIECES)
    assert {r.lang_pred for r in language.predict(odd_docs, nothing).collect()} == {"und"}
