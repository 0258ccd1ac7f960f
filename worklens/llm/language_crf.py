"""Language identification: a linear-chain conditional random field labels the words of code-switched text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from worklens.llm.common import Words, mixed, slices
from worklens.llm.samples import fitted, labelled_rows

UNKNOWN = "und"
BITS = 18
BLOCK = 32
LEXICON_SALT = np.uint64(0x51ED270B7A14F2C9)


class WordFeatures:
    """Hashed features of distinct words: byte n-grams of one to four, with the word's edges as a byte.

    N-grams that hold an edge are the affixes; the whole word is a lexicon feature.
    Bytes of UTF-8 serve any script. ``features[i]`` belongs to word ``owners[i]``.
    """

    def __init__(self, distinct: pa.Array):
        words = [w.encode() for w in pc.utf8_lower(distinct).to_pylist()]
        sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
        text = np.frombuffer(b"".join(b"\0" + w + b"\0" for w in words), dtype=np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), sizes)
        features, owners = [], []
        key = np.zeros(len(text), dtype=np.uint64)
        whole = np.zeros(len(words), dtype=np.uint64)
        for n in range(1, 5):
            # key[i] is the hash of the n bytes from i on.
            tail = text[n - 1 :]
            key = mixed(key[: len(tail)] * np.uint64(257) + tail + np.uint64(n))
            inside = owner[: len(tail)] == owner[n - 1 :]
            features.append(key[inside])
            owners.append(owner[: len(tail)][inside])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(words) else np.empty(0, np.int64)
        if len(words):
            power = mixed(text * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(text)) - starts[owner]).astype(np.uint64))
            whole = mixed(np.add.reduceat(power, starts) ^ LEXICON_SALT)
        features.append(whole)
        owners.append(np.arange(len(words)))
        self.features = (np.concatenate(features) >> np.uint64(64 - BITS)).astype(np.int64)
        self.owners = np.concatenate(owners)
        self.count = len(words)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's features, for every label."""
        return np.stack(
            [np.bincount(self.owners, w[self.features], self.count) for w in weights], axis=1
        ) if self.count else np.zeros((0, len(weights)))


def marginals(emissions: np.ndarray, offsets: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior label shares of every word of every row, and the expected transitions of all rows.

    Exact forward-backward for rows of any length side by side: words are cut into
    blocks whose transfer matrices are multiplied first; a short scan over the blocks
    of a row gives the vectors at the block edges; then all blocks run forward and
    backward at once. The word before the first counts as of any label.
    """
    labels = emissions.shape[1]
    step = np.exp(transitions - transitions.max())
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    total = int(first[-1])
    if not total:
        return np.zeros((0, labels)), np.zeros((labels, labels))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(rows)) - offsets[:-1][rows]
    at = (first[rows] + within // BLOCK) * BLOCK + within % BLOCK
    grid = np.ones((total * BLOCK, labels))
    grid[at] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    grid = grid.reshape(total, BLOCK, labels)
    real = np.zeros(total * BLOCK, dtype=bool)
    real[at] = True
    real = real.reshape(total, BLOCK)

    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for s in range(BLOCK):
        moved = (product.reshape(-1, labels) @ step).reshape(product.shape) * grid[:, s, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        product = np.where(real[:, s, None, None], moved, product)

    forward = np.ones((total, labels))
    backward = np.ones((total, labels))
    order = np.argsort(-blocks, kind="stable")
    deep = int(blocks.max())
    for k in range(deep - 1):
        active = order[: int((blocks > k + 1).sum())]
        v = np.einsum("nl,nlm->nm", forward[first[active] + k], product[first[active] + k])
        forward[first[active] + k + 1] = v / v.max(axis=1, keepdims=True)
        last = first[active] + blocks[active] - 1 - k
        v = np.einsum("nlm,nm->nl", product[last], backward[last])
        backward[last - 1] = v / v.max(axis=1, keepdims=True)

    ahead = np.empty((BLOCK, total, labels))
    before = np.empty((BLOCK, total, labels))
    vector = forward
    for s in range(BLOCK):
        before[s] = vector
        moved = (vector @ step) * grid[:, s]
        moved /= moved.max(axis=1, keepdims=True)
        vector = np.where(real[:, s, None], moved, vector)
        ahead[s] = vector
    posterior = np.empty((total, BLOCK, labels))
    counts = np.zeros((labels, labels))
    vector = backward
    for s in reversed(range(BLOCK)):
        both = ahead[s] * vector
        posterior[:, s] = both / both.sum(axis=1, keepdims=True)
        heard = vector * grid[:, s]
        pair = before[s][real[:, s]][:, :, None] * step * heard[real[:, s]][:, None, :]
        counts += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        moved = heard @ step.T
        moved /= moved.max(axis=1, keepdims=True)
        vector = np.where(real[:, s, None], moved, vector)
    return posterior.reshape(-1, labels)[at], counts


def training_rows(texts: list[str], labels: list[int], seed: int = 3) -> tuple[list[str], list[int], np.ndarray]:
    """Words with labels in code-switched rows: the lines of all texts in random order, a few to a row."""
    lines = [(line.split(), y) for text, y in zip(texts, labels) for line in text.split("\n") if line.strip()]
    order = np.random.default_rng(seed).permutation(len(lines)).tolist()
    words: list[str] = []
    marks: list[int] = []
    offsets = [0]
    for place, i in enumerate(order, 1):
        own, y = lines[i]
        words += own
        marks += [y] * len(own)
        if place % 4 == 0 or place == len(order):
            offsets.append(len(words))
    return words, marks, np.array(offsets)


class CrfModel:
    """Feature weights and transitions of the labels, fitted by adaptive gradient steps on the log-likelihood."""

    def __init__(self, labels: list[str], texts: list[str], marks: list[int], steps: int = 40, rate: float = 0.5, decay: float = 1e-4):
        self.labels = labels
        n = len(labels)
        self.weights = np.zeros((n, 1 << BITS))
        self.transitions = np.zeros((n, n))
        words, gold, offsets = training_rows(texts, marks)
        if not words:
            return
        coded = pa.array(words).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        features = WordFeatures(coded.dictionary)
        lettered = has_letter(coded.dictionary)[codes][:, None]
        target = np.eye(n)[np.array(gold)]
        same_row = np.ones(len(codes), dtype=bool)
        same_row[offsets[:-1][offsets[:-1] < len(codes)]] = False
        moves = np.zeros((n, n))
        np.add.at(moves, (np.array(gold)[:-1][same_row[1:]], np.array(gold)[1:][same_row[1:]]), 1.0)
        firsts = np.array(gold)[~same_row]
        for y in firsts:
            moves[:, y] += 1.0 / n
        squares, squared_moves = np.full_like(self.weights, 1e-6), np.full((n, n), 1e-6)
        for _ in range(steps):
            emissions = features.emissions(self.weights)[codes] * lettered
            share, expected = marginals(emissions, offsets, self.transitions)
            miss = (target - share) * lettered
            for y in range(n):
                by_word = np.bincount(codes, miss[:, y], features.count)
                gradient = np.bincount(features.features, by_word[features.owners], 1 << BITS) / len(codes)
                gradient -= decay * self.weights[y] / len(codes)
                squares[y] += gradient**2
                self.weights[y] += rate * gradient / np.sqrt(squares[y])
            gradient = (moves - expected) / len(codes)
            squared_moves += gradient**2
            self.transitions += rate * gradient / np.sqrt(squared_moves)
        self.weights = self.weights.astype(np.float32)

    def shares(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Share of each label among the words of each text, and the number of words with letters."""
        words = Words(texts, lower=False)
        lettered = has_letter(words.distinct)
        emissions = WordFeatures(words.distinct).emissions(self.weights) * lettered[:, None]
        share, _ = marginals(emissions[words.codes], words.offsets, self.transitions)
        rows, told = words.rows(), lettered[words.codes].astype(float)
        count = np.bincount(rows, told, len(texts))
        sums = np.stack([np.bincount(rows, told * share[:, y], len(texts)) for y in range(len(self.labels))], axis=1)
        return sums / np.maximum(count, 1.0)[:, None], count

    def word_labels(self, text: str) -> list[tuple[str, str, float]]:
        """(word, label, share) of every word of one text; words without a letter are unknown."""
        words = Words(pa.array([text]), lower=False)
        lettered = has_letter(words.distinct)
        emissions = WordFeatures(words.distinct).emissions(self.weights) * lettered[:, None]
        share, _ = marginals(emissions[words.codes], words.offsets, self.transitions)
        listed = words.distinct.to_pylist()
        return [
            (listed[c], self.labels[int(p.argmax())] if lettered[c] else UNKNOWN, float(p.max()) if lettered[c] else 0.0)
            for c, p in zip(words.codes.tolist(), share)
        ]


def has_letter(words: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)


def fit(docs: DataFrame, where, per_label: int = 120, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> CrfModel | None:
    """The model of the documents with a language for which ``where`` holds; none without such documents.

    ``per_label`` bounds the rows of each language that the model is fitted on, by one
    executor task; each row counts for its own language. Only the weights come to the driver.
    """
    own = docs.filter(where).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("label"))
    return fitted(labelled_rows(own.filter("text is not null"), per_label), _built)


def _built(sample: pa.Table) -> CrfModel:
    rows = sorted(sample.to_pylist(), key=lambda r: (r["label"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    labels = sorted({r["label"] for r in rows})
    return CrfModel(labels, [r["text"] for r in rows], [labels.index(r["label"]) for r in rows])


def with_language(
    docs: DataFrame, model: CrfModel | None, text: str = "text", label: str = "lang_pred", share: str = "score"
) -> DataFrame:
    """The documents with language and share of the whole text; columns of these names are replaced.

    Every word gets its label shares by forward-backward; ``label`` is the label
    with the largest share over the words with letters (ties: the first by name) and
    ``share`` is that share. Texts that are null or have no letter, and all texts
    without a model, are ``und`` with score 0. Rows are labelled where they are.
    """
    kept = docs.drop(label, share)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = kept.columns.index(text)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, text, 1 << 20):
            if own is None:
                best, count = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
                shares = np.zeros((batch.num_rows, 1))
            else:
                shares, count = own.shares(batch.column(place))
                best = shares.argmax(axis=1)
            names = [own.labels[b] if c else UNKNOWN for b, c in zip(best.tolist(), count.tolist())]
            score = np.where(count > 0, shares[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())],
                names=[*batch.schema.names, label, share],
            )

    added = [T.StructField(label, T.StringType()), T.StructField(share, T.DoubleType())]
    return kept.mapInArrow(labelled, T.StructType([*kept.schema.fields, *added]))
