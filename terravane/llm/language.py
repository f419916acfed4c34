"""Language ID [method: segmentation-marginalised unigrams].

Over the pieces of a fixed public vocabulary each language has its own probabilities, fitted by
expectation maximisation over all segmentations of its words. A text's likelihood is the
product of its words'; a word's sums over every way to cut it into pieces, by the forward
algorithm, run for many words at once, position by position.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textvec
from .bpe import HashTable, gather

#: Bound of the fit: labelled rows sampled (by hash of doc_id); and rounds of expectation maximisation.
TRAIN_ROWS, ROUNDS = 20_000, 4
#: What a piece counts beside what was seen, of as many pieces as SCALE in each language.
PRIOR, SCALE = 0.05, 1_000_000
#: Words and letters that a vectorised step holds.
STEP_WORDS, STEP_LETTERS = 10_000, 120_000
MARK = "▁"
_C = np.uint64(0xD6E8FEB86659FD93)


def pieces_of(path: str) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary, lower case, with the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        body = piece.removeprefix(MARK)
        if piece == MARK or body.isalpha():
            out.add(piece)
    return sorted(out)


class Lattice:
    """The pieces that begin at every letter of words: a table of all beginnings of pieces, by hash."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        number = {p: i for i, p in enumerate(pieces)}
        begins = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)})
        keys = np.zeros(len(begins), np.uint64)
        for k in range(max(map(len, begins), default=0)):
            live = [i for i, p in enumerate(begins) if len(p) > k]
            keys[live] = self._step(keys[live], np.array([ord(begins[i][k]) for i in live], np.uint64))
        keys, first = np.unique(keys | np.uint64(1), return_index=True)
        self.piece = np.array([number.get(begins[i], -1) for i in first], np.int64)
        self.table = HashTable(18)
        self.table.add(keys)

    @staticmethod
    def _step(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
        h = ((h ^ letter) + np.uint64(0x51ED27)) * _C
        return h ^ (h >> np.uint64(32))

    def cuts(self, cps: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For each end position 1, 2, ...: (words, their position where the piece begins, piece).
        A letter that is no piece is one of number `size`, the unknown."""
        word = np.repeat(np.arange(len(size)), size)
        at = gather(np.arange(len(cps)), start, size)
        place = at - start[word]
        h = np.zeros(len(at), np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            h = self._step(h, cps[at + n - 1].astype(np.uint64))
            entry = self.table.find(h | np.uint64(1))
            piece = np.where(entry >= 0, self.piece[entry], -1)
            if n == 1:
                piece = np.where(piece < 0, self.size, piece)
            hit = piece >= 0
            found.append((place[hit] + n, word[hit], place[hit], piece[hit]))
            live = (entry >= 0) & (place + n < size[word])
            at, word, place, h = at[live], word[live], place[live], h[live]
            if not len(at):
                break
        end, word, place, piece = (np.concatenate(x) for x in zip(*found))
        width = end - place
        order = np.lexsort((width, end))
        end, word, place, piece, width = end[order], word[order], place[order], piece[order], width[order]
        group = np.flatnonzero(np.append(True, (end[1:] != end[:-1]) | (width[1:] != width[:-1]))) if len(end) else np.zeros(0, int)
        out: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(int(size.max(initial=0)))]
        for a, b in zip(group, np.append(group[1:], len(end))):
            out[end[a] - 1].append((word[a:b], place[a:b], piece[a:b]))
        return out

    def forward(self, cuts, size: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward sums of shape (words, positions, languages) as mantissas and exponents of two, so
        that no length makes them vanish, and log likelihoods."""
        n, langs = len(size), prob.shape[1]
        alpha = np.zeros((n, len(cuts) + 1, langs))
        power = np.zeros((n, len(cuts) + 1, langs), np.int32)
        alpha[:, 0] = 1
        total = np.zeros((n, langs))
        for end, here in enumerate(cuts, 1):
            power[:, end] = power[:, end - 1]
            for words, begin, piece in here:
                alpha[words, end] += np.ldexp(alpha[words, begin] * prob[piece], power[words, begin] - power[words, end])
            alpha[:, end], shift = np.frexp(alpha[:, end])
            power[:, end] += shift
            done = size == end
            total[done] = np.log(alpha[done, end]) + power[done, end] * np.log(2)
        return alpha, power, total

    def expected(self, cuts, size: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is used, summed over all segmentations of words with weights; `prob`
        is one language's."""
        alpha, power, _ = self.forward(cuts, size, prob[:, None])
        alpha, power = alpha[:, :, 0], power[:, :, 0]
        beta, behind = np.zeros(alpha.shape), np.zeros(alpha.shape, np.int32)
        rows = np.arange(len(size))
        beta[rows, size] = 1
        whole, whole_power = alpha[rows, size], power[rows, size]
        seen = np.zeros(self.size + 1)
        for end in range(len(cuts), 0, -1):
            inside = size >= end
            beta[inside, end], shift = np.frexp(beta[inside, end])
            behind[inside, end] += shift
            for words, begin, piece in cuts[end - 1]:
                share = prob[piece] * beta[words, end]
                fresh = beta[words, begin] == 0
                behind[words[fresh], begin[fresh]] = behind[words[fresh], end]
                beta[words, begin] += np.ldexp(share, behind[words, end] - behind[words, begin])
                used = np.ldexp(alpha[words, begin] * share / whole[words], power[words, begin] + behind[words, end] - whole_power[words])
                np.add.at(seen, piece, weight[words] * used)
        return seen


def _flat_words(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size


def word_steps(size: np.ndarray) -> Iterator[np.ndarray]:
    """Words in steps of like lengths: their number times the longest is bounded, but for one word."""
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        to = min(len(order), at + STEP_WORDS)
        while to > at + 1 and (to - at) * int(size[order[to - 1]]) > STEP_LETTERS:
            to = at + (to - at + 1) // 2
        yield order[at:to]
        at = to


def words_of(text: str) -> list[str]:
    """Lower-case letter runs behind the word mark."""
    import regex

    return [MARK + w for w in regex.findall(r"\p{L}+", text.lower())]


def word_spans(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, and starts and ends of letter runs."""
    letters = np.zeros(len(cps), bool)
    small = cps < textvec.TABLE
    letters[small] = textvec.KIND[cps[small]] == textvec.LETTER
    low = cps.copy()
    low[small] = textvec.LOWER[cps[small]]
    other = np.flatnonzero(~small | (textvec.KIND[np.minimum(cps, textvec.TABLE - 1)] == textvec.SLOW))
    if len(other):  # code points outside the table, each distinct one asked for once
        kinds, back = np.unique(cps[other], return_inverse=True)
        letters[other] = np.array([chr(c).isalpha() for c in kinds])[back]
        low[other] = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in kinds], np.uint32)[back]
    edge = np.zeros(len(cps) + 1, bool)
    edge[off] = True
    begins = np.flatnonzero(letters & np.append(True, ~letters[:-1] | edge[1:-1]) if len(cps) else letters)
    ends = np.flatnonzero(letters & np.append(~letters[1:] | edge[1:-1], True) if len(cps) else letters) + 1
    return low, begins, ends


class Model:
    """Languages, pieces with probabilities (pieces and the unknown, languages), and the letters that
    were met in the fit."""

    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray, letters: np.ndarray):
        self.langs, self.pieces, self.prob, self.letters = langs, pieces, prob, letters


class Scorer:
    """Log likelihoods of distinct words, kept until there are `words` of them."""

    def __init__(self, model: Model, words: int = 400_000):
        self.model, self.limit = model, words
        self.lattice = Lattice(model.pieces)
        self._reset()

    def _reset(self) -> None:
        self.table, self.score, self.known = HashTable(), np.zeros((0, len(self.model.langs))), np.zeros(0, np.int64)

    def totals(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) log likelihoods; the number of words with evidence of each text; and the
        share of its letters that the fit has met, -1 where there is no letter. A word of none but
        other letters is no evidence."""
        if self.table.count > self.limit:
            self._reset()
        cps, off = textvec.code_points(data, offsets)
        low, start, end = word_spans(cps, off)
        keys = textvec.hash_spans(low, start, end) | np.uint64(1)
        at = self.table.find(keys)
        if len(missing := np.flatnonzero(at < 0)):
            new, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            self.table.add(new)
            got = np.zeros((len(new), len(self.model.langs)))
            size = end[first] - start[first]
            met = np.append(0, np.cumsum(np.isin(low, self.model.letters)))
            known = met[end[first]] - met[start[first]]
            for group in word_steps(size):
                flat = gather(low, start[first[group]], size[group])
                ends = np.cumsum(size[group] + 1)
                begin = ends - size[group] - 1
                marked = np.empty(int(ends[-1]), np.uint32)
                inner = np.ones(len(marked), bool)
                inner[begin] = False
                marked[begin], marked[inner] = ord(MARK), flat
                got[group] = self.lattice.forward(self.lattice.cuts(marked, begin, size[group] + 1), size[group] + 1, self.model.prob)[2]
            got[known == 0] = 0
            self.score, self.known = np.concatenate([self.score, got]), np.concatenate([self.known, known])
            at[missing] = self.table.find(keys[missing])
        bounds = np.searchsorted(start, off)

        def summed(values: np.ndarray) -> np.ndarray:
            sums = np.zeros((len(start) + 1, *values.shape[1:]), values.dtype)
            np.cumsum(values, axis=0, out=sums[1:])
            return sums[bounds[1:]] - sums[bounds[:-1]]

        letters = summed(end - start)
        share = np.where(letters > 0, summed(self.known[at]) / np.maximum(letters, 1), -1.0)
        return summed(self.score[at]), summed((self.known[at] > 0).astype(np.int64)), share


def train(docs: DataFrame, vocabulary: str, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """Fits on whole texts of at most about `rows` labelled rows, picked by doc_id's hash.

    Learns only from rows with text and lang whose crc32(doc_id as text) mod 5 isn't 0. Words are
    counted by Spark, and every round of expectation maximisation is a Spark job over the counts;
    the driver gets sums for each language and piece.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    pool = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n = pool.count()
    if n > rows:
        pool = pool.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < int((1 << 30) * rows / n))

    def count(batches):
        counts: Counter = Counter()

        def out():
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((lang, w) for w in words_of(text))
                if len(counts) > 300_000:
                    yield out()
                    counts.clear()
        yield out()

    scratch = common.Scratch(spark, "language")
    summed = pool.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    summed = scratch.keep(summed, "words")
    langs = sorted(r.lang for r in summed.select("lang").distinct().collect())
    pieces = pieces_of(vocabulary)
    prob = np.full((len(pieces) + 1, len(langs)), 1 / (len(pieces) + 1))
    seen = np.zeros(prob.shape)
    for _ in range(rounds if langs else 0):
        seen = np.zeros(prob.shape)
        for r in _expected(summed, langs, pieces, prob).groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            seen[r.piece, r.lang] = r.n
        # counts of one total in every language, so that what none has seen is alike in all
        share = seen / np.maximum(seen.sum(axis=0), 1e-9) * SCALE + PRIOR
        prob = share / share.sum(axis=0)
    scratch.drop("words")
    met = {c for p, used in zip(pieces, seen[:-1].sum(axis=1)) if used > 0.5 for c in p.removeprefix(MARK)}
    return Model(langs, pieces, prob, np.array(sorted(map(ord, met)), np.uint32))


def _expected(words: DataFrame, langs: list[str], pieces: list[str], prob: np.ndarray) -> DataFrame:
    """(lang, piece, n): expected uses of pieces, by numbers, in rows (lang, word, n)."""
    shared = words.sparkSession.sparkContext.broadcast((langs, pieces, prob))  # a number for each piece and language

    def run(batches):
        langs, pieces, prob = shared.value
        lattice, seen = Lattice(pieces), np.zeros(prob.shape)
        for batch in batches:
            lang, n = np.array([langs.index(x) for x in batch.column(0).to_pylist()], np.int64), np.asarray(batch.column(2), np.float64)
            words = np.array(batch.column(1).to_pylist(), object)
            for k in np.unique(lang):
                own, weight = words[lang == k].tolist(), n[lang == k]
                size = np.array([len(w) for w in own], np.int64)
                for group in word_steps(size):
                    cps, start, length = _flat_words([own[i] for i in group])
                    seen[:, k] += lattice.expected(lattice.cuts(cps, start, length), length, prob[:, k], weight[group])
        piece, lang = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(seen[piece, lang])], ["lang", "piece", "n"])

    return words.mapInArrow(run, "lang long, piece long, n double")


def held_out():
    """crc32(doc_id as text) mod 5 is 0 (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with lang_pred and score; columns of those names are replaced.

    `und` with score 0 where the text is null or has no letter, or where nothing was learned. The
    score is the language's posterior with equal priors, every segmentation summed, the evidence of
    a text tempered to that of 20 words so that it stays short of certainty, times the share of its
    letters that the fit has met: a text in another script has the score 0. Rows are independent;
    repeated rows have equal results, an empty table gives none.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    text = docs.columns.index("text")
    names = [*docs.columns, "lang_pred", "score"]

    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or _scorer(token, shared)
            langs = scorer.model.langs
            data, offsets = common.text_view(batch.column(text))
            pred, score = [], []
            for a, b in common.chunks(offsets):
                part = offsets[a : b + 1]
                if not langs:
                    pred += ["und"] * (b - a)
                    score += [0.0] * (b - a)
                    continue
                total, words, met = scorer.totals(data[part[0] : part[-1]], part - part[0])
                total = (total - total.max(axis=1, keepdims=True)) * np.minimum(1, 20 / np.maximum(words, 1))[:, None]
                share = np.exp(total)
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                pred += [langs[k] if m >= 0 else "und" for k, m in zip(best, met)]
                score += (share[np.arange(b - a), best] * np.maximum(met, 0)).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names)

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


_scorers: dict[str, Scorer] = {}


def _scorer(token: str, shared) -> Scorer:
    """One per Python worker and model."""
    if token not in _scorers:
        _scorers.clear()
        _scorers[token] = Scorer(shared.value)
    return _scorers[token]
