import random
from collections import Counter

import numpy as np
import pyarrow as pa

from terravane.llm import common, minhash


def shingle_counts(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similar(a, b, counts):
    if not counts:
        return len(a.keys() & b.keys()) >= 0.8 * len(a.keys() | b.keys())
    return (a & b).total() >= 0.8 * (a | b).total()


def classes(rows, counts):
    docs = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in rows})
    sets = [shingle_counts(t) for _, _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and similar(sets[i], sets[j], counts):
                root[max(top(i), top(j))] = min(top(i), top(j))
    own = {d: docs[top(i)][:2] for i, d in enumerate(docs)}
    keys = [own[(r.doc_id is not None, r.doc_id or 0, r.text or "")] for r in rows]
    size = Counter(top(docs.index((r.doc_id is not None, r.doc_id or 0, r.text or ""))) for r in rows)
    return sorted(str((r.doc_id, k[1] if k[0] else None, size[top(docs.index((r.doc_id is not None, r.doc_id or 0, r.text or "")))])) for r, k in zip(rows, keys))


def got(df):
    return sorted(str((r.doc_id, r.class_id, r.class_size)) for r in df.collect())


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    hashes = np.sort(rng.integers(1, 2**63, 400, dtype=np.uint64))
    a, b = (rng.integers(1, 5, 400).astype(float) * (rng.random(400) < 0.8) for _ in range(2))
    b = np.where(rng.random(400) < 0.7, a, b)
    own = [hashes[w > 0] for w in (a, b)]
    weights = np.concatenate([a[a > 0], b[b > 0]])
    sig = minhash.signatures(np.concatenate(own), weights, np.array([0, len(own[0]), len(weights)]), 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05
    alone = minhash.signatures(own[0], a[a > 0], np.array([0, len(own[0])]), 2000)
    assert (alone[0] == sig[0]).all()
    assert (minhash.signatures(hashes[:0], a[:0], np.array([0, 0]), 8) == minhash._NONE).all()


def test_fractional_weights():
    h = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = np.full(39, 0.25)
    sig = minhash.signatures(np.concatenate([h, h]), np.concatenate([w, w * 2]), np.array([0, 39, 78]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.06


def test_shingles_are_those_of_a_loop(few_docs):
    texts = [r.text for r in few_docs.limit(30).collect()] + ["", "a", "a b c d", "a a a a a a a"]
    _, often, own = minhash.shingles(*common.text_view(pa.array(texts)))
    for text, a, b in zip(texts, own[:-1], own[1:]):
        assert sorted(often[a:b].tolist()) == sorted(shingle_counts(text).values())


def test_against_all_pairs(few_docs, odd_docs, no_docs):
    for docs, counts in ((few_docs, False), (few_docs, True), (no_docs, False), (odd_docs.where("text IS NULL OR text <> 'other text, same id'"), False)):
        assert got(minhash.near_duplicates(docs, counts=counts)) == classes(docs.collect(), counts)
    assert all(r.kept for r in minhash.near_duplicates(odd_docs).collect())


def test_families_with_shared_passages(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    template = rng.choices(words, k=60)
    rows = []
    for family in range(12):
        base = (template if family % 2 else []) + rng.choices(words, k=rng.choice([6, 40, 90]))
        for _ in range(rng.choice([1, 2, 12, 40])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(minhash.near_duplicates(docs, counts=False)) == classes(docs.collect(), False)


def test_one_large_family(spark, monkeypatch):
    """Two thousand near copies about the threshold: every link is found, none made up."""
    monkeypatch.setattr(minhash, "BANDS", 40)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    rows = [(0, " ".join(base))]
    for i in range(1, 2000):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice(([], [rng.choice(words)], [own[at], rng.choice(words)]))
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    sets = [shingle_counts(t) for _, t in rows]
    items = sorted({x for s in sets for x in s})
    column = {x: i for i, x in enumerate(items)}
    m = np.zeros((len(rows), len(items)), np.float32)
    for i, s in enumerate(sets):
        for x, n in s.items():
            assert n == 1
            m[i, column[x]] = n
    size = m.sum(axis=1)
    both = m @ m.T
    linked = both >= 0.8 * (size[:, None] + size - both) - 1e-3
    root = np.arange(len(rows))
    while True:
        new = np.where(linked, root[None, :], len(rows)).min(axis=1)
        if (new == root).all():
            break
        root = new
    assert found == dict(enumerate(root.tolist()))


def test_words_that_weak_hashes_confuse(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, f"{word} {other}"), (4, f"{word}  {other}")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_exact_shingles_when_hashes_collide(few_docs, monkeypatch):
    texts = [r.text for r in few_docs.limit(20).collect()] + ["", "a", "a b c d", "a a a a a a a"]
    want = [shingle_counts(t) for t in texts]
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(minhash.textvec, "hash_spans", lambda units, start, end, seed=0: (end - start).astype(np.uint64))
            monkeypatch.setattr(minhash.textvec, "mix", lambda h: h & np.uint64(3))
        item, often, own = minhash.exact_shingles(*common.text_view(pa.array(texts)))
        got = [dict(zip(item[a:b].tolist(), often[a:b].tolist())) for a, b in zip(own[:-1], own[1:])]
        for x, y, p, q in zip(want, want[1:], got, got[1:]):
            assert sorted(x.values()) == sorted(p.values())
            assert (x & y).total() == sum(min(n, q.get(k, 0)) for k, n in p.items())


def test_components_of_a_chain(spark):
    scratch = common.Scratch(spark, "chain")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 12)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in minhash.components(links, scratch, "c").collect()}
    assert roots == {**{i: 0 for i in range(1, 13)}, 95: 90, 100: 90}
    none = spark.createDataFrame([], "a long, b long")
    assert minhash.components(none, scratch, "n").count() == 0
