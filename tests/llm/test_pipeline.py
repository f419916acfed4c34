import re
import struct
import zlib

import numpy as np
import xxhash
from tests.llm.test_encoding import best_fit_decreasing
from tests.llm.test_minhash import classes, shingle_counts, similar
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_decisions(spark, few_docs):
    rows = few_docs.collect()
    named = corpus_pipeline.identify_language(spark, few_docs, "").collect()
    assert {r.doc_id for r in rows if any(c.isalpha() for c in r.text)} == {r.doc_id for r in named}
    alone = corpus_pipeline.drop_near_duplicates(spark, few_docs, "").collect()
    assert len(alone) == len({c.split(",")[1] for c in classes(rows, True)})
    docs = spark.createDataFrame(alone, few_docs.schema)
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    first, gone = {}, {}
    for r in sorted(alone, key=lambda r: r.doc_id):
        words = r.text.encode().split()
        flags = [False] * len(words)
        for at in range(len(words) - 19):
            if first.setdefault(tuple(words[at : at + 20]), (r.doc_id, at)) != (r.doc_id, at):
                flags[at : at + 20] = [True] * 20
        gone[r.doc_id] = sum(flags)
        assert cut[r.doc_id].text.encode().split() == [w for w, f in zip(words, flags) if not f]
        if not any(flags):
            assert cut[r.doc_id] == r
    assert cut.keys() == gone.keys()


def brute(rows):
    """The stages after language ID in plain Python: (doc_id, piece, start, length, crc) and how many
    sequences best-fit decreasing takes."""
    root = {}
    docs = sorted({(r.doc_id, r.text or "") for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0, spark_hash(d[1])))
    sets = [shingle_counts(t) for _, t in docs]
    for i in range(len(docs)):
        root[i] = i
        for j in range(i):
            if sets[i] and sets[j] and similar(sets[i], sets[j], True):
                a, b = sorted((top(root, i), top(root, j)))
                root[b] = a
    first, out, sizes = {}, [], []
    library = Tokenizer.from_file(corpus_pipeline.WORD_BPE)
    for i, (doc_id, text) in enumerate(docs):
        if top(root, i) != i:
            continue
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
        raw = text.encode()
        flags = [False] * len(words)
        for at in range(len(words) - 19):
            key = tuple(raw[a:b] for a, b in words[at : at + 20])
            if first.setdefault(key, (i, at)) != (i, at):
                flags[at : at + 20] = [True] * 20
        left, at, k = b"", 0, 0
        while k < len(words):
            if flags[k]:
                end = k
                while end < len(words) and flags[end]:
                    end += 1
                left += raw[at : words[k][0]]
                at = words[end][0] if end < len(words) else len(raw)
                k = end
            else:
                k += 1
        text = (left + raw[at:]).decode()
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            out.append((doc_id, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
            sizes.append(len(part))
    return sorted(map(str, out)), best_fit_decreasing(sizes, 4096)


def top(root, i):
    while root[i] != i:
        i = root[i]
    return i


def spark_hash(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64))


def check_run(rows, got):
    want, sequences = brute(rows)
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(slots) <= sequences
    for own in slots.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096


def test_run(spark, few_docs):
    """All four stages against plain Python: no text of the table is in an unknown script."""
    rows = [r for r in few_docs.collect() if any(c.isalpha() for c in r.text)]
    check_run(rows, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())


def test_run_on_odd_rows(spark, odd_docs, few_docs, no_docs, tmp_path):
    odd = odd_docs.select(*few_docs.columns)
    english = few_docs.where("lang = 'en' AND doc_id BETWEEN 20 AND 80")
    extra = spark.createDataFrame([(301, "日 " * 60, "ja", "s", 120), (302, "ж" * 90, None, "s", 90)], few_docs.schema)
    odd.union(english).union(extra).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = {r.doc_id for r in got}
    assert {r.doc_id for r in english.collect()} & kept and 302 not in kept and 8 not in kept and 7 not in kept
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
