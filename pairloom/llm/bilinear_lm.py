"""Language-model scores of a log-bilinear model, trained by noise-contrastive estimation over the whole corpus.

Texts are coded in blocks: a block holds the different words of its documents and the places where they stand. What concerns a word
(its count, its vectors) is found in the group of the word, a share of the vocabulary by hash: a block sends each group the words it
has there, once each, and gets back what the group found, so no task holds more than one block or one group and no vocabulary is
sent around. The number of groups follows the vocabulary.

A token is predicted in two levels. The first one is a class: one for each of the most frequent words, one for all others. It is
told from the two tokens before, class words by vectors of their own, any other word by the vector of its class and one of its own on
top. The second level is the word among those of the last class in its group, by its smoothed count and a vector of its own against
the class of the token before. The own vectors are learnt by noise-contrastive estimation too, from all places of the word in training
documents. Both levels are normalised exactly: the probabilities of all known words and one place for unknown ones add up to 1 after
any context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import SPACES, fold
from pairloom.llm.words import coded as coded_words
from pairloom.session import pinned

#: Size of the model: words with a class of their own, width of a word's vector, and of the own vectors of all other words.
CLASSES, WIDTH, OWN = 256, 24, 8
BLOCK_TOKENS = 1_000_000
#: Bytes of text whose words are found at a time.
PIECE_BYTES = 1 << 23
#: Rows (a word once a block) of a group of words, and the least number of groups.
GROUP_ROWS, LEAST_GROUPS = 1_000_000, 16
#: Noise words for each word, rows of a batch, step size, passes over the training documents.
NOISE, BATCH, RATE, ROUNDS = 128, 4096, 0.1, 2
#: Pairs of words before a token whose sums over all classes are made at a time.
PAIRS = 1024
#: Own vectors: words fitted at a time, steps, precision of the normal prior, occurrences up to which equal words are fitted once.
FIT_WORDS, FIT_STEPS, PRIOR, FEW = 2048, 4, 8.0, 4
#: The end of a text: no word, as words hold no space.
END = " "
ALPHA = 0.1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACES.encode())] = False
_SALT = np.random.default_rng(31).integers(1, 1 << 62, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def packed(codes: np.ndarray) -> bytes:
    """32-bit integers, compressed, after their number."""
    return len(codes).to_bytes(8, "little") + pa.compress(codes.astype("<i4").tobytes(), "zstd", asbytes=True)


def unpacked(codes: bytes) -> np.ndarray:
    n = int.from_bytes(codes[:8], "little")
    return np.frombuffer(pa.decompress(codes[8:], 4 * n, "zstd", asbytes=True), "<i4")


def sent(**columns: pa.Array) -> bytes:
    """Columns of equal length as one compressed binary value."""
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def received(part: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(part).read_next_batch()


def _layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins, with the end of the last. Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string(), safe=False), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if len(texts) and at[-1] > at[0] else np.empty(0, np.uint8)
    return flat, at - at[0]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z in lower case, begin and end of every word in them, number of words of every text."""
    flat, at = _layout(texts)
    flat = _LOWER[flat]
    inside = _IN_WORD[flat]
    before, after = np.zeros(len(flat) + 1, bool), np.zeros(len(flat) + 1, bool)
    before[1:], after[:-2] = inside, inside[1:]
    before[at] = False
    after[at[at > 0] - 1] = False
    begins, ends = np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[:-1]) + 1
    return flat, begins, ends, np.diff(np.searchsorted(begins, at))


def blocks(docs: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, text, ...) -> block, words, trained (count of each word in training documents), ids, held, trains, lengths, codes.

    A document trains if crc32(doc_id as text) mod ``folds`` is not 0 (a null id never does). ``codes`` are places in ``words`` of all
    tokens of the block, frequent words first, packed by :func:`packed`; every text ends with END. A text of null counts as empty.
    """
    shape = "block long, words array<string>, trained array<long>, ids array<long>, held array<boolean>, trains array<boolean>, lengths array<int>, codes binary"
    lists = {"words": pa.string(), "trained": pa.int64(), "ids": pa.int64(), "held": pa.bool_(), "trains": pa.bool_(), "lengths": pa.int32()}
    schema = pa.schema([("block", pa.int64()), *[(k, pa.list_(t)) for k, t in lists.items()], ("codes", pa.binary())])

    def row(at: int, pieces: list[tuple]) -> pa.RecordBatch:
        flats, begins, ends, counts, ids, folds_ = zip(*pieces)
        moved = np.cumsum([0, *[len(f) for f in flats[:-1]]])
        spans, dictionary = coded_words(np.concatenate(flats), np.concatenate([b + m for b, m in zip(begins, moved)]), np.concatenate([e + m for e, m in zip(ends, moved)]))
        lengths, fold_ = np.concatenate(counts) + 1, pa.chunked_array(folds_).combine_chunks()
        last = np.cumsum(lengths) - 1
        codes, is_word = np.full(last[-1] + 1, len(dictionary), np.int64), np.ones(last[-1] + 1, bool)
        is_word[last] = False
        codes[is_word] = spans
        words = pa.concat_arrays([dictionary.cast(pa.large_string(), safe=False), pa.array([END], pa.large_string())])
        held, trains = (pc.fill_null(f(fold_, 0), False) for f in (pc.equal, pc.not_equal))
        trained = np.bincount(codes[np.repeat(trains.to_numpy(zero_copy_only=False), lengths)], minlength=len(words))
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        values = {
            "words": words.take(pa.array(order)).cast(pa.string(), safe=False), "trained": pa.array(trained[order]), "ids": pa.chunked_array(ids).combine_chunks(),
            "held": held, "trains": trains, "lengths": pa.array(lengths, pa.int32()),
        }
        whole = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in values.items()}
        own = pa.array([(TaskContext.get().partitionId() << 24) + at], pa.int64())
        return pa.RecordBatch.from_arrays([own, *[whole[k] for k in lists], pa.array([packed(place[codes])], pa.binary())], schema=schema)

    def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows in pieces of about PIECE_BYTES, a row at least each."""
        bounds, lo = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)), 0
        while lo < len(bounds):
            hi = max(lo + 1, int(np.searchsorted(bounds, (bounds[lo - 1] if lo else 0) + PIECE_BYTES, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held, at = [], 0, 0
        for batch in batches:
            for rows in pieces_of(batch):
                flat, begins, ends, counts = _words(rows.column("text"))
                first, total, lo = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(counts + 1), 0
                while lo < len(counts):
                    # The documents up to the one that fills the block.
                    before = total[lo - 1] if lo else 0
                    hi = min(len(counts), int(np.searchsorted(total, before + BLOCK_TOKENS - held)) + 1)
                    own = slice(first[lo], first[hi])
                    low, high = (begins[own][0], ends[own][-1]) if first[hi] > first[lo] else (0, 0)
                    pieces.append((flat[low:high], begins[own] - low, ends[own] - low, counts[lo:hi], rows.column("doc_id").slice(lo, hi - lo), rows.column("fold").slice(lo, hi - lo)))
                    held, lo = held + int(total[hi - 1] - before), hi
                    if held >= BLOCK_TOKENS:
                        yield row(at, pieces)
                        pieces, held, at = [], 0, at + 1
        if pieces:
            yield row(at, pieces)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), fold(F.col("doc_id"), folds).alias("fold")).mapInArrow(run, shape)


def _group_of(words: pa.Array, groups: int) -> np.ndarray:
    """The group of every word, by a hash of its bytes."""
    flat, at = _layout(words)
    if not len(words):
        return np.empty(0, np.int64)
    inside = np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
    mixed = np.add.reduceat(_SALT[inside % len(_SALT)] * (flat + np.uint64(1)), at[:-1])
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def _dealt(words: pa.Array, groups: int, columns: dict[str, pa.Array]) -> Iterator[tuple[int, bytes]]:
    """(group, its words with their columns), for the groups that have any."""
    group = _group_of(words, groups)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    taken = {k: v.take(pa.array(order)) for k, v in {"word": words, **columns}.items()}
    for g in np.flatnonzero(np.diff(bounds)):
        yield int(g), sent(**{k: v.slice(bounds[g], bounds[g + 1] - bounds[g]) for k, v in taken.items()})


def _together(parts: pa.ChunkedArray) -> tuple[pa.Table, np.ndarray, pa.Array]:
    """Rows of all parts of a group, the number of the word of every row, and the different words."""
    rows = pa.concat_tables([pa.Table.from_batches([received(p.as_buffer())]) for p in parts]).combine_chunks()
    found = pc.dictionary_encode(rows.column("word").combine_chunks())
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return rows, found.indices.to_numpy().astype(np.int64), found.dictionary


def word_counts(coded: DataFrame, groups: int) -> DataFrame:
    """(word, c): every word of all blocks, and how often it stands in training documents."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, trained in zip(batch.column("words"), batch.column("trained")):
                got = list(_dealt(words.values, groups, {"n": trained.values}))
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int32()), pa.array([p for _, p in got], pa.binary())], ["g", "part"])

    def added(table: pa.Table) -> pa.Table:
        rows, word, different = _together(table.column("part"))
        c = np.bincount(word, rows.column("n").to_numpy(), len(different)).astype(np.int64)
        return pa.table({"word": different.cast(pa.string(), safe=False), "c": pa.array(c)})

    return coded.select("words", "trained").mapInArrow(route, "g int, part binary").groupBy("g").applyInArrow(added, "word string, c long")


@dataclass
class Model:
    """Context vectors (classes, start of text), word vectors, biases, a weight vector for each of the two context places."""

    words: list[str]
    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    place: np.ndarray

    @classmethod
    def fresh(cls, words: list[str], counts: np.ndarray, rest: int) -> "Model":
        rng, n = np.random.default_rng(17), len(words) + 1
        share = np.append(counts, rest) + 0.5
        return cls(words, rng.normal(0, 0.3, (n + 1, WIDTH)), np.zeros((n, WIDTH)), np.log(share / share.sum()), np.ones((2, WIDTH)))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.bias, self.place]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def with_flat(self, flat: np.ndarray) -> "Model":
        cut, out = 0, []
        for p in self.parts():
            out.append(flat[cut : cut + p.size].reshape(p.shape).copy())
            cut += p.size
        return Model(self.words, *out)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of a word after the last token and after the one before it, and the log normaliser of every context: batched matrix
        products over all pairs of classes."""
        last, before = (self.context * self.place[0]) @ self.target.T + self.bias, (self.context * self.place[1]) @ self.target.T
        norm = np.empty((len(last), len(before)))
        for i, row in enumerate(last):
            s = row + before
            top = s.max(axis=1)
            norm[i] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return last, before, norm


def _contexts(classes: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of the token before each token and of the one before that; ``start`` before a text."""
    one, two = np.concatenate([[start], classes[:-1]]), np.concatenate([[start, start], classes[:-2]])[: len(classes)]
    first = np.cumsum(lengths) - lengths
    one[first], two[first] = start, start
    second = first[lengths > 1] + 1
    two[second] = start
    return one, two


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    d = values.shape[1]
    return np.bincount((rows[:, None] * d + np.arange(d)).ravel(), values.ravel(), n * d).reshape(n, d)


def _descend(model: Model, one: np.ndarray, two: np.ndarray, word: np.ndarray, weight: np.ndarray, noise: np.ndarray, memory: list[np.ndarray]) -> None:
    """A step of noise-contrastive estimation on a batch of weighted trigrams: tell a word from NOISE draws of the noise distribution.

    The draws enter by their expectation over all classes, one matrix product, which has no sampling variance. Steps shrink with the
    squared gradients so far.
    """
    m, n, rows = model, len(model.bias), np.arange(len(word))
    a, b = m.context[one], m.context[two]
    h = (a * m.place[0] + b * m.place[1]).astype(np.float32)
    target = m.target.astype(np.float32)
    real = 1 / (1 + np.exp(-(h @ target.T + (m.bias - np.log(NOISE * noise)).astype(np.float32))))
    pull = -(weight[:, None] * (NOISE * noise)).astype(np.float32) * real
    pull[rows, word] += (weight * (1 - real[rows, word])).astype(np.float32)
    back = pull @ target
    grads = [
        _scatter(one, back * m.place[0], n + 1) + _scatter(two, back * m.place[1], n + 1),
        pull.T @ h,
        pull.sum(axis=0),
        np.stack([(back * a).sum(axis=0), (back * b).sum(axis=0)]),
    ]
    for p, g, s in zip(m.parts(), grads, memory):
        g = g / weight.sum()
        s += g * g
        p += RATE * g / np.sqrt(s + 1e-12)


def _kinds(words: pa.Array, model: Model) -> np.ndarray:
    """The class of every word."""
    return pc.fill_null(pc.index_in(words, pa.array(model.words, pa.string())), len(model.words)).to_numpy().astype(np.int64)


def train(coded: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple[Model, dict]:
    """Model of the classes and totals (N, V, both for the words without a class, the counts of those with one). Every partition descends
    over all its training documents from the same model; the mean of their models, by tokens, is the next one."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = [(r["word"], r["c"]) for r in counts.orderBy(F.col("c").desc(), "word").limit(CLASSES).collect()]
    facts = {"n": total["n"], "v": total["v"], "rest_n": total["n"] - sum(c for _, c in top), "rest_v": total["v"] - len(top), "top": [c for _, c in top]}
    model = Model.fresh([w for w, _ in top], np.array([c for _, c in top], float), facts["rest_n"])
    noise = class_shares(facts)
    for _ in range(rounds if total["n"] else 0):
        begin = model

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            own = begin.with_flat(begin.flat())
            memory, rng, seen, n = [np.full(p.shape, 1e-4) for p in own.parts()], np.random.default_rng(29), 0, len(begin.words) + 1
            for batch in batches:
                for words, codes, lengths, trains in zip(*[batch.column(c) for c in ("words", "codes", "lengths", "trains")]):
                    classes, lengths = _kinds(words.values, begin)[unpacked(codes.as_py())], lengths.values.to_numpy()
                    one, two = _contexts(classes, lengths, n)
                    keep = np.repeat(trains.values.to_numpy(zero_copy_only=False), lengths)
                    trigram, weight = np.unique((one[keep] * (n + 1) + two[keep]) * n + classes[keep], return_counts=True)
                    order = rng.permutation(len(trigram))
                    for at in range(0, len(order), BATCH):
                        part = trigram[order[at : at + BATCH]]
                        _descend(own, part // n // (n + 1), part // n % (n + 1), part % n, weight[order[at : at + BATCH]].astype(float), noise, memory)
                    seen += int(keep.sum())
            if seen:
                slot = pa.array([TaskContext.get().partitionId() % 16], pa.int32())
                yield pa.RecordBatch.from_arrays([slot, pa.array([seen]), pa.array([own.flat() * seen])], ["slot", "tokens", "model"])

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"slot": pdf["slot"][:1], "tokens": [pdf["tokens"].sum()], "model": [np.sum(np.stack(pdf["model"].to_numpy()), axis=0)]})

        shape = "slot int, tokens long, model array<double>"
        sums = coded.select("words", "codes", "lengths", "trains").mapInArrow(descend, shape).groupBy("slot").applyInPandas(added, shape).collect()  # 16 rows of the size of the model
        model = begin.with_flat(np.sum([np.array(r["model"]) for r in sums], axis=0) / sum(r["tokens"] for r in sums))
    return model, facts


def class_shares(facts: dict) -> np.ndarray:
    """Smoothed share of every class in the training documents."""
    share = np.append(np.array(facts["top"], float), facts["rest_n"]) + 0.5
    return share / share.sum()


def _whitened(rows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The OWN directions in which weighted rows differ most, scaled to unit variance, and the rows in them (zero where there are fewer)."""
    centred = rows - weight @ rows / weight.sum()
    _, size, directions = np.linalg.svd(np.sqrt(weight / weight.sum())[:, None] * centred, full_matrices=False)
    scale = np.where(size > 1e-6, 1 / np.maximum(size, 1e-6), 0.0)[:OWN]
    lift = np.zeros((rows.shape[1], OWN))
    lift[:, : len(scale)] = directions[:OWN].T * scale
    return lift, centred @ lift


@dataclass
class Frame:
    """What own vectors are fitted against. As a context a word adds ``lift`` times its vector to the context vector of its class; the next
    class feels that by ``felt``, on top of ``level``. As a target it meets ``seen`` of the class before."""

    share: np.ndarray
    lift: np.ndarray
    felt: np.ndarray
    level: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, model: Model, facts: dict) -> "Frame":
        share, rest = class_shares(facts), len(model.words)
        lift, felt = _whitened(model.target * model.place[0], share)
        level = (model.context[rest] * model.place[0] + share @ model.context[:-1] * model.place[1]) @ model.target.T + model.bias
        _, seen = _whitened(model.context * model.place[0], np.append(share, share.mean()))
        return cls(share, lift, felt, level - np.logaddexp.reduce(level), seen)


def _fitted(n: np.ndarray, noise: np.ndarray, features: np.ndarray, offset: np.ndarray | float) -> np.ndarray:
    """A vector for each row of ``n``: Newton steps of noise-contrastive estimation, which tells ``n`` occurrences of each column from
    ``noise`` draws of it (their expectation), the logarithm of model over noise being features times vector plus offset."""
    n, noise, features = n.astype(np.float32), noise.astype(np.float32), features.astype(np.float32)
    products = (features[:, :, None] * features[:, None, :]).reshape(len(features), -1)
    z, both, prior = np.zeros((len(n), OWN), np.float32), n + noise, PRIOR * np.eye(OWN, dtype=np.float32)
    for _ in range(FIT_STEPS):
        real = 1 / (1 + np.exp(-(z @ features.T + np.asarray(offset, np.float32))))
        pull = both * real
        slope = (n - pull) @ features - PRIOR * z
        bend = ((pull * (1 - real)) @ products).reshape(-1, OWN, OWN) + prior
        step = np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        # No logarithm moves by more than 2 in a step, so that steps do not run past the top.
        z += step * np.minimum(1, 2 / np.maximum(np.abs(step @ features.T).max(axis=1, keepdims=True), 1e-6))
    return z


def _small(z: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors in 8 bits, and the unit."""
    unit = float(np.abs(z).max(initial=0)) / 127 or 1.0
    return np.round(z / unit).astype(np.int8), unit


def _alike(c: np.ndarray, first: np.ndarray, place: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Words whose vectors are fitted, and the one of them for every word: words of up to FEW occurrences in the same places share one."""
    code = -1 - np.arange(len(c))
    code[c <= FEW] = 0
    for k in range(FEW):
        own = np.flatnonzero((c > k) & (c <= FEW))
        code[own] = code[own] * (places + 1) + place[first[own] + k].astype(np.int64) + 1
    _, fitted, of = np.unique(code, return_index=True, return_inverse=True)
    return fitted, of


def _by_word(word: np.ndarray, place: np.ndarray, words: int, places: int, fit) -> np.ndarray:
    """Vectors of all words by ``fit(words, occurrences of each place)``, from the word and the place of every occurrence."""
    at = word.astype(np.int64) * places + place
    at.sort()
    c = np.bincount(word, minlength=words)
    place, first = (at % places).astype(np.uint16), np.cumsum(c) - c
    del at
    fitted, of = _alike(c, first, place, places)
    out = np.zeros((len(fitted), OWN), np.float32)
    for lo in range(0, len(fitted), FIT_WORDS):
        own = fitted[lo : lo + FIT_WORDS]
        row = np.repeat(np.arange(len(own)), c[own])
        begin = np.cumsum(c[own]) - c[own]
        found = place[np.arange(len(row)) + (first[own] - begin)[row]]
        out[lo : lo + FIT_WORDS] = fit(own, np.bincount(row * places + found, minlength=len(own) * places).reshape(len(own), places))
    return out[of]


def own_vectors(word: np.ndarray, before: np.ndarray, after: np.ndarray, words: int, frame: Frame) -> tuple:
    """Counts and own vectors (context, target, each with its unit) of the words of a group, and the logarithm of the sum over the group
    for each class before. ``word``, ``before``, ``after``: of every occurrence in training documents; ``after`` of the end of a text is no class."""
    n, c = len(frame.share), np.bincount(word, minlength=words)
    prior = np.where(c > 0, c + ALPHA, 0.0)
    prior /= max(prior.sum(), 1e-300)
    came = np.bincount(before, minlength=n + 1)
    level = frame.level - np.log(NOISE * frame.share)
    target, target_unit = _small(_by_word(word, before, words, n + 1, lambda w, follows: _fitted(follows, NOISE * prior[w, None] * came, frame.seen, -np.log(NOISE))))
    context, context_unit = _small(_by_word(word, after, words, n + 1, lambda w, leads: _fitted(leads[:, :n], NOISE * leads[:, :n].sum(axis=1)[:, None] * frame.share, frame.felt, level)))
    sums = np.zeros(n + 1)
    for lo in range(0, words, FIT_WORDS):
        sums += prior[lo : lo + FIT_WORDS] @ np.exp(target[lo : lo + FIT_WORDS] * target_unit @ frame.seen.T)
    return c, context, context_unit, target, target_unit, np.log(sums, where=sums > 0, out=np.zeros(n + 1))


def vectors(coded: DataFrame, model: Model, facts: dict, groups: int) -> DataFrame:
    """(block, part, norm): counts and own vectors of the words without a class, back at the blocks they stand in."""
    frame, rest = Frame.of(model, facts), len(model.words)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, codes, lengths, trains in zip(*[batch.column(c) for c in ("block", "words", "codes", "lengths", "trains")]):
                kind, codes, lengths = _kinds(words.values, model), unpacked(codes.as_py()), lengths.values.to_numpy()
                classes = kind[codes]
                before, _ = _contexts(classes, lengths, rest + 1)
                after = np.append(classes[1:], rest + 1)
                after[np.cumsum(lengths) - 1] = rest + 1
                keep = np.flatnonzero(np.repeat(trains.values.to_numpy(zero_copy_only=False), lengths) & (classes == rest))
                keep = keep[np.argsort(codes[keep], kind="stable")]
                own = np.flatnonzero(kind == rest)
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(codes[keep], minlength=len(kind))[own])]), pa.int32())
                columns = {"i": pa.array(own, pa.int32())} | {k: pa.ListArray.from_arrays(at, pa.array(x[keep], pa.uint16())) for k, x in (("before", before), ("after", after))}
                got = list(_dealt(words.values.take(pa.array(own)), groups, columns))
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int32()), pa.array([block.as_py()] * len(got), pa.int64()), pa.array([p for _, p in got], pa.binary())], ["g", "block", "part"])

    def fit(table: pa.Table) -> pa.Table:
        rows, word, different = _together(table.column("part"))
        sizes = pc.list_value_length(rows.column("before")).to_numpy()
        places = [pc.list_flatten(rows.column(k)).to_numpy() for k in ("before", "after")]
        rows = rows.select(["i"])
        c, context, context_unit, target, target_unit, norm = own_vectors(np.repeat(word.astype(np.int32), sizes), *places, len(different), frame)
        del places
        norm, parts, at = np.concatenate([[context_unit, target_unit], norm]).tobytes(), [], 0
        i = rows.column("i").combine_chunks()
        for part in table.column("part"):
            own = slice(at, at + received(part.as_buffer()).num_rows)
            at, w = own.stop, word[own]
            both = np.concatenate([context[w], target[w]], axis=1)
            vector = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * OWN), len(w), [None, pa.py_buffer(np.ascontiguousarray(both))])
            parts.append(sent(i=i.slice(own.start, len(w)), c=pa.array(c[w]), vector=vector))
        pa.default_memory_pool().release_unused()
        return pa.table({"block": table.column("block"), "part": pa.array(parts, pa.binary()), "norm": pa.array([norm] * len(parts), pa.binary())})

    routed = coded.select("block", "words", "codes", "lengths", "trains").mapInArrow(route, "g int, block long, part binary")
    return routed.groupBy("g").applyInArrow(fit, "block long, part binary, norm binary")


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Rows come back as often as they came. A null id is neither held out nor trained on. Without training documents the base score is
    0 and the model knows no word. An empty table gives an empty one.
    """
    coded = pinned(blocks(docs, folds))
    rows = coded.agg(F.coalesce(F.sum(F.size("trained")), F.lit(0))).first()[0]
    groups = max(LEAST_GROUPS, -(-rows // GROUP_ROWS))
    model, facts = train(coded, pinned(word_counts(coded, groups)).filter("c > 0"))
    tables, frame = model.tables(), Frame.of(model, facts)
    n, v, rest_n, rest_v, rest = (*[facts[k] for k in ("n", "v", "rest_n", "rest_v")], len(model.words))

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.array([packed(_kinds(words.values, model)) for words in batch.column("words")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("block"), kinds, *[batch.column(c) for c in ("ids", "held", "lengths", "codes")]], ["block", "kinds", "ids", "held", "lengths", "codes"])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([of_block(*[left.column(c)[i] for c in ("kinds", "ids", "held", "lengths", "codes")], right) for i in range(left.num_rows)])

    def of_block(kinds: pa.Scalar, ids: pa.Scalar, held: pa.Scalar, lengths: pa.Scalar, codes: pa.Scalar, parts: pa.Table) -> pa.Table:
        kind, codes, lengths = unpacked(kinds.as_py()).astype(np.int64), unpacked(codes.as_py()), lengths.values.to_numpy()
        words = len(kind)
        c, norm_of, norms = np.append(np.array(facts["top"], float), 0.0)[kind], np.zeros(words, np.int64), [np.zeros(rest + 2)]
        context, target = np.zeros((words + 1, OWN), np.float32), np.zeros((words, OWN), np.float32)
        for part, norm in zip(parts.column("part"), parts.column("norm")):
            got, norm = received(part.as_buffer()), np.frombuffer(norm.as_py(), float)
            i, vector = got.column("i").to_numpy(), np.frombuffer(got.column("vector").buffers()[1], np.int8).reshape(-1, 2 * OWN)
            c[i], context[i], target[i] = got.column("c").to_numpy(), vector[:, :OWN] * norm[0], vector[:, OWN:] * norm[1]
            norm_of[i] = np.where(c[i] > 0, len(norms), 0)
            norms.append(norm[2:])
        norms = np.stack(norms)
        base = np.log10((c + ALPHA) / (n + ALPHA * (v + 1)))
        inner = np.where(kind == rest, np.log10((c + ALPHA) / (rest_n + ALPHA * (rest_v + 1))), 0.0)
        classes, kind = kind[codes], np.append(kind, rest + 1)
        one, two = _contexts(codes, lengths, words)
        before = kind[one]
        own = _class_scores(model, frame, tables, kind, context, one, two, classes)
        at = np.flatnonzero(classes == rest)
        word = codes[at]
        own[at] += np.einsum("ij,ij->i", target[word].astype(float), frame.seen[before[at]]) * (norm_of[word] > 0) - norms[norm_of[word], before[at]]
        own = own / np.log(10) + inner[codes]
        first = np.cumsum(lengths) - lengths
        return pa.table({
            "doc_id": ids.values, "held_out": held.values, "n_tokens": pa.array(lengths, pa.int64()), "n_known": np.add.reduceat((c > 0)[codes].astype(np.int64), first),
            "train_tokens": pa.array(np.full(len(lengths), n, np.int64)), "base_score": np.add.reduceat(base[codes], first), "score": np.add.reduceat(own, first),
        })

    classed = coded.select("block", "words", "ids", "held", "lengths", "codes").mapInArrow(classified, "block long, kinds binary, ids array<long>, held array<boolean>, lengths array<int>, codes binary")
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return classed.groupBy("block").cogroup(vectors(coded, model, facts, groups).groupBy("block")).applyInArrow(scored, shape)


def _class_scores(model: Model, frame: Frame, tables: tuple, kind: np.ndarray, own: np.ndarray, one: np.ndarray, two: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log probability of the class of each token after the words ``one`` and ``two`` (the last ones are the start), from their classes and own vectors."""
    last, before, norm = tables
    out = last[kind[one], classes] + before[kind[two], classes] - norm[kind[one], kind[two]]
    near, far = (((model.context * p).astype(np.float32)[kind] + own.astype(np.float32) @ (frame.lift.T * p).astype(np.float32)) for p in model.place)
    target, bias, has = model.target.astype(np.float32), model.bias.astype(np.float32), own.any(axis=1)
    tokens = np.flatnonzero(has[one] | has[two])
    # Sums of exponentials need their largest term taken out only where one could leave the range of single precision.
    longest = [float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))) for x in (near, far, target)]
    small = (longest[0] + longest[1]) * longest[2] + float(np.abs(bias).max()) < 80
    pairs, pair = np.unique(one[tokens].astype(np.int64) * len(kind) + two[tokens], return_inverse=True)
    total = np.empty(len(pairs), np.float32)
    for at in range(0, len(pairs), PAIRS):
        own_pairs = pairs[at : at + PAIRS]
        s = (near[own_pairs // len(kind)] + far[own_pairs % len(kind)]) @ target.T
        s += bias
        top = 0 if small else s.max(axis=1, keepdims=True)
        if not small:
            s -= top
        np.exp(s, out=s)
        total[at : at + PAIRS] = np.log(s @ np.ones(len(bias), np.float32)) + (0 if small else top[:, 0])
    for at in range(0, len(tokens), 1 << 16):
        t = tokens[at : at + (1 << 16)]
        out[t] = np.einsum("ij,ij->i", near[one[t]] + far[two[t]], target[classes[t]]) + bias[classes[t]] - total[pair[at : at + (1 << 16)]]
    return out
