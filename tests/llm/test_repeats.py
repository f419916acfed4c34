import hashlib
import random
import re

import numpy as np
import pytest

from terravane.llm import bwt, common, debruijn, repeats, substring_dedup, suffix_dedup, superkmers


def brute(rows, window, words):
    """By a dictionary of every window; equal rows are one document."""
    import xxhash

    def spark_hash(text):  # Spark's xxhash64 of a string: signed, seed 42
        return int(np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64))

    docs = [(r.doc_id, (r.text or "").encode()) for r in rows]
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0], spark_hash(docs[i][1])))
    seqs = [re.findall(rb"[^\x20\x09-\x0D]+", t) if words else list(t) for _, t in docs]
    first, out, done = {}, {}, {}
    for i in order:
        key = docs[i]
        if key in done:
            out[i] = done[key]
            continue
        gone = [False] * len(seqs[i])
        for at in range(len(seqs[i]) - window + 1):
            w = tuple(seqs[i][at : at + window])
            if first.setdefault(w, (i, at)) != (i, at):
                gone[at : at + window] = [True] * window
        kept = [x for x, g in zip(seqs[i], gone) if not g]
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        body = b" ".join(kept) if words else bytes(kept)
        done[key] = out[i] = (docs[i][0], len(seqs[i]), sum(gone), *([] if words else [spans]), hashlib.sha256(body).hexdigest())
    return sorted(map(str, out.values()))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("words", [True, False])
def test_against_brute_force(few_docs, odd_docs, no_docs, words):
    dedup = substring_dedup.dedup if words else suffix_dedup.dedup
    for docs in (few_docs, no_docs, odd_docs):
        assert got(dedup(docs)) == brute(docs.collect(), 20 if words else 100, words)


@pytest.mark.parametrize("words", [True, False])
def test_one_id_with_several_texts(spark, words):
    """Texts of one id count in order of their hashes, and share passages."""
    rng = random.Random(11)
    passage = [" ".join(f"p{k}-{i}" for i in range(30)) for k in range(4)]
    rows = [(rng.choice([None, 1, 2]), f"{rng.randint(0, 99)} {rng.choice(passage)} {rng.randint(0, 99)} {rng.choice(passage)}") for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dedup = substring_dedup.dedup if words else suffix_dedup.dedup
    assert got(dedup(docs)) == brute(docs.collect(), 20 if words else 100, words)


def test_words_that_weak_hashes_confuse(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{same} {word}"), (2, f"{same} {other}"), (3, f"{same} {word}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs).collect()} == {1: 0, 2: 0, 3: 20}


def test_hashes_that_collide_are_found_out(spark):
    """A span that isn't equal to its lead makes all be done anew with other hashes."""
    rows = [(1, "a b c d e f g"), (2, "x b c d e y y"), (3, "x b c d z")]
    docs = spark.createDataFrame(rows, "_rid long, text string")
    used = []
    said = {0: [(2, 0, 3, 1, 0)], 1: [(2, 1, 2, 1, 1), (3, 0, 2, 2, 0)]}

    def find(docs, seed):
        used.append(seed)
        return spark.createDataFrame(said[seed], "_rid long, first int, count int, lead_rid long, lead_first int")

    spans = repeats.repeated_spans(docs, common.Scratch(spark, "test"), True, 3, find)
    assert used == [0, 1]
    assert sorted(map(tuple, spans.collect())) == said[1]


def test_cut_keeps_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, 5, "s", 7, 8), (2, words, 6, "t", 9, 10)], "doc_id long, text string, _rid int, _spans string, `a.b` int, _h int")
    kept = sorted(map(tuple, substring_dedup.cut(docs).collect()))
    assert kept == [(1, words, 5, "s", 7, 8), (2, "", 6, "t", 9, 10)]


@pytest.mark.parametrize("words,group", [(True, 0), (False, 0), (False, 3), (False, 4096)])
def test_dense_repeats(spark, words, group):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        parts = [rng.choice(["a b a b a b", "a a a a", "c", "b c a", "aab aab", "é b"]) for _ in range(rng.randint(0, 14))]
        rows.append((i * 3 % 121, rng.choice([" ", "  ", "\n"]).join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scratch = common.Scratch(spark, "test")
    keyed = common.with_row_key(docs, scratch)
    window = 6 if words else 11
    found = set()
    spans = debruijn.repeated_paths(keyed, scratch, window, 3) if words else suffix_dedup.repeated_strings(keyed, scratch, window, 3, group)
    for r in spans.collect():
        found |= {(r._rid, r.first + k) for k in range(r["count"])}
    first, want = {}, set()
    for doc_id, text in sorted(rows):
        seq = text.encode().split() if words else list(text.encode())
        for at in range(len(seq) - window + 1):
            if first.setdefault(tuple(seq[at : at + window]), (doc_id, at)) != (doc_id, at):
                want.add((doc_id, at))
    assert found == want


def test_kept_texts(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"x  {words}\n y"), (2, f"before\t{words} after \n"), (3, None), (4, "  as it   is "), (5, words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: (r.text, r.n_chars, r.x) for r in substring_dedup.cut(docs.selectExpr("7 AS x", "*", "-1L AS n_chars")).collect()}
    assert kept == {1: (rows[0][1], -1, 7), 2: ("before\tafter \n", 14, 7), 3: (None, -1, 7), 4: ("  as it   is ", -1, 7), 5: ("", 0, 7)}


def test_interval_expansion():
    rng = np.random.default_rng(0)
    for _ in range(200):
        length = int(rng.integers(1, 12))
        strings = [bytes(rng.integers(0, rng.integers(1, 4) + 1, rng.integers(0, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        off = np.append(0, np.cumsum([len(s) for s in strings]))
        flat = np.frombuffer(b"".join(strings), np.uint8)
        if not len(flat):
            continue
        starts, class_ = bwt.repeat_classes(flat, off, length)
        assert starts.tolist() == [off[i] + j for i, s in enumerate(strings) for j in range(len(s) - length + 1)]
        pairs = {(flat[s : s + length].tobytes(), c) for s, c in zip(starts, class_)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_strings_are_cut_to_what_they_share():
    """Around their anchor, to as many bytes as the longest that another string has as well, NULs included."""
    rng = np.random.default_rng(3)
    window, gram, cut, kept = 8, 3, 0, 0
    for _ in range(150):
        size = rng.integers(0, 60, rng.integers(1, 12))
        off = np.append(0, np.cumsum(size))
        flat = rng.choice([0, 0, 0, 1, 9], off[-1]).astype(np.uint8)
        got = superkmers.runs(flat, off, window, gram)
        if not len(got.text):
            continue
        bodies = sorted({(a, flat[b : b + c + window - 1].tobytes()) for a, b, c in zip(got.anchor.tolist(), off[got.text] + got.first, got.count)})
        anchor, strings = np.array([a for a, _ in bodies]), [b for _, b in bodies]
        own = np.append(0, np.cumsum([len(b) for b in strings]))
        data = np.frombuffer(b"".join(strings), np.uint8)
        at = superkmers.anchors_at(anchor, data, own, window, gram) - own[:-1]
        begin, end = suffix_dedup.trimmed(anchor, data, own, window, gram, 0)

        def shared(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        for i, (a, p) in enumerate(zip(strings, at)):
            others = [(b, q) for j, (b, q) in enumerate(zip(strings, at)) if j != i and anchor[j] == anchor[i]]
            left = max((shared(a[:p][::-1], b[:q][::-1]) for b, q in others), default=0)
            right = max((shared(a[p + gram :], b[q + gram :]) for b, q in others), default=0)
            assert (begin[i] - own[i], end[i] - own[i]) == (p - left, p + gram + right)
            cut, kept = cut + (end[i] - begin[i] < len(a)), kept + (end[i] - begin[i] >= window)
            for k in range(len(a) - window + 1):
                if any(a[k : k + window] in b for b, _ in others):
                    assert begin[i] - own[i] <= k and k + window <= end[i] - own[i]
    assert cut and kept


def test_strings_that_share_a_line_only_are_not_sorted():
    """A common line among different neighbours: no suffix is left to sort."""
    rng = np.random.default_rng(4)
    line = b"a line of eighty bytes that is everywhere, among neighbours that are not, as it is"
    texts = [bytes(rng.integers(97, 123, 70).astype(np.uint8)) + line + bytes(rng.integers(97, 123, 70).astype(np.uint8)) for _ in range(200)]
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    got = superkmers.runs(flat, off, 100, 36)
    anchors, times = np.unique(got.anchor, return_counts=True)
    of_line = np.flatnonzero(np.isin(got.anchor, anchors[times > 1]))
    assert len(of_line) >= 100
    begin, size = (off[got.text] + got.first)[of_line], got.count[of_line] + 99
    data, own = np.concatenate([flat[b : b + n] for b, n in zip(begin, size)]), np.append(0, np.cumsum(size))
    a, b = suffix_dedup.trimmed(got.anchor[of_line], data, own, 100, 36, 0)
    assert (b - a < 100).all()
