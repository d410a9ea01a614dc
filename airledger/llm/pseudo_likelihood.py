"""Masked pseudo-likelihood of documents by a bidirectional window network (operator 9).

A small network predicts each token from the tokens on both sides; the sum of the conditional
log-probabilities of all tokens is the document's score. Null and word-free texts have no tokens,
score 0 and a null mean. Repeated rows score alike. An empty table gives an empty result; extra
columns are not read. Texts are scored whole, and rows alike whatever their ids, null or repeated.

The network predicts a class: each of the most frequent words is one, all other words share classes by
hash. A word's probability is that of its class times its share of the class in the counts over all
documents; the table of counts grows with the corpus, and scoring joins it. A word that training did
not meet counts as met once. Every document is trained on once: documents are dealt to rounds, in each
of which every task trains on the texts it reads, from the same weights, and the tasks' weights are
averaged, slice by slice, in proportion to their tokens. Only the average (11,360 numbers) and the sums
of the classes reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, byte_set, chunks, int_lists, span_hashes, utf8, word_spans
from .shared import map_batches, settle

WORD = byte_set([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
#: The classes are FACTOR x FACTOR: the most frequent words, then all others by hash.
FACTOR, OTHERS = 32, 64
SIZE = FACTOR * FACTOR
WINDOW, WIDTH, HIDDEN = 2, 8, 24
BATCH, RATE = 4096, 0.15
#: Slices in which the tasks' weights are averaged.
SLICES = 16
#: Rounds among which the documents are dealt.
ROUNDS = 2

_SHAPES = {"emb": (SIZE + 1, WIDTH), "w1": (2 * WINDOW * WIDTH, HIDDEN), "b1": (HIDDEN,), "a": (HIDDEN, FACTOR), "a0": (FACTOR,), "ec": (FACTOR, HIDDEN), "b": (HIDDEN, FACTOR), "b0": (FACTOR,)}


@dataclass
class WindowModel:
    """Hashes of the frequent words (sorted, with their token), the network's weights, the number of
    words met in each class of others, and the table of all words (word, n)."""

    hashes: np.ndarray
    tokens: np.ndarray
    weights: dict[str, np.ndarray]
    met: np.ndarray
    words: DataFrame | None = None

    def without_words(self) -> WindowModel:
        """What is broadcast: some 200 kB."""
        return replace(self, words=None)


def _initial() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(9)
    return {k: (rng.standard_normal(shape) * (0.1 if len(shape) > 1 else 0)).astype(np.float32) for k, shape in _SHAPES.items()}


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in _SHAPES]).astype(np.float64)


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def word_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(word: 64-bit hash, n) over all documents; each task counts its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in chunks(offsets, 8 << 20):
                part = data[offsets[i] : offsets[j]]
                starts, ends, _ = word_spans(part, offsets[i : j + 1] - offsets[i], WORD)
                words, n = np.unique(span_hashes(LOWER[part], starts, ends), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    return map_batches(documents.select(F.col(text_col).cast("string")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _token_rows(model: WindowModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, their rows, the classes around each (SIZE where the document ends), and word hashes."""
    starts, ends, rows = word_spans(data, offsets, WORD)
    h = span_hashes(LOWER[data], starts, ends)
    token = (SIZE - OTHERS + (h % np.uint64(OTHERS))).astype(np.int64)
    if len(model.hashes):
        at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
        token = np.where(model.hashes[at] == h, model.tokens[at], token)
    n = len(token)
    around = np.full((n, 2 * WINDOW), SIZE, dtype=np.int64)
    for k, step in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        i = np.arange(max(0, -step), n - max(0, step))
        same = rows[i] == rows[i + step]
        around[i[same], k] = token[i[same] + step]
    return token, rows, around, h


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _forward(w: dict[str, np.ndarray], token: np.ndarray, around: np.ndarray) -> tuple:
    x = w["emb"][around].reshape(len(token), -1)
    hid = np.tanh(x @ w["w1"] + w["b1"])
    outer = _softmax(hid @ w["a"] + w["a0"])
    inner_hid = np.tanh(hid + w["ec"][token // FACTOR])
    inner = _softmax(inner_hid @ w["b"] + w["b0"])
    return x, hid, outer, inner_hid, inner


def log_likelihoods(w: dict[str, np.ndarray], token: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each token given those around it."""
    out = np.empty(len(token))
    for i in range(0, len(token), BATCH):
        t = token[i : i + BATCH]
        _, _, outer, _, inner = _forward(w, t, around[i : i + BATCH])
        at = np.arange(len(t))
        out[i : i + BATCH] = np.log(outer[at, t // FACTOR].astype(np.float64) + 1e-12) + np.log(inner[at, t % FACTOR].astype(np.float64) + 1e-12)
    return out


def train_step(w: dict[str, np.ndarray], power: dict[str, np.ndarray], token: np.ndarray, around: np.ndarray) -> None:
    """One adaptive-gradient step on a batch."""
    n, at = len(token), np.arange(len(token))
    x, hid, outer, inner_hid, inner = _forward(w, token, around)
    d_outer, d_inner = outer, inner
    d_outer[at, token // FACTOR] -= 1
    d_inner[at, token % FACTOR] -= 1
    d_outer /= n
    d_inner /= n
    d_ih = (d_inner @ w["b"].T) * (1 - inner_hid**2)
    d_hid = (d_outer @ w["a"].T + d_ih) * (1 - hid**2)
    d_x = (d_hid @ w["w1"].T).reshape(-1, WIDTH)
    flat = around.ravel()
    grads = {
        "a": hid.T @ d_outer, "a0": d_outer.sum(axis=0), "b": inner_hid.T @ d_inner, "b0": d_inner.sum(axis=0),
        "ec": np.stack([np.bincount(token // FACTOR, weights=d_ih[:, k], minlength=FACTOR) for k in range(HIDDEN)], axis=1),
        "w1": x.T @ d_hid, "b1": d_hid.sum(axis=0),
        "emb": np.stack([np.bincount(flat, weights=d_x[:, k], minlength=SIZE + 1) for k in range(WIDTH)], axis=1),
    }
    for k, g in grads.items():
        power[k] += g.astype(np.float32) ** 2
        w[k] -= (RATE * g / np.sqrt(power[k] + 1e-8)).astype(np.float32)


def _round(texts: DataFrame, model: WindowModel) -> dict[str, np.ndarray]:
    """The average of what all tasks make of the model's weights."""
    shared = texts.sparkSession.sparkContext.broadcast(model.without_words())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = {k: x.copy() for k, x in m.weights.items()}
        power = {k: np.full(x.shape, 1e-6, dtype=np.float32) for k, x in w.items()}
        seen = 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in chunks(offsets):
                token, _, around, _ = _token_rows(m, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(0, len(token), BATCH):
                    train_step(w, power, token[k : k + BATCH], around[k : k + BATCH])
                seen += len(token)
        if seen:
            parts = np.array_split(_flat(w) * seen, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), type=pa.int32()), pa.array([seen] * SLICES, type=pa.int64()), pa.array([x.tobytes() for x in parts], type=pa.binary())], names=["slice", "seen", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in table["sums"].to_pylist())
        return pa.table({"slice": table["slice"][:1], "mean": pa.array([(total / sum(table["seen"].to_pylist())).tobytes()], type=pa.binary())})

    rows = map_batches(texts, run, "slice int, seen long, sums binary").groupBy("slice").applyInArrow(add, "slice int, mean binary").collect()
    if not rows:
        return model.weights
    return _shaped(np.concatenate([np.frombuffer(r["mean"], dtype=np.float64) for r in sorted(rows, key=lambda r: r["slice"])]))


def train(documents: DataFrame, text_col: str = "text") -> WindowModel:
    """Count all words, then train on every text in one of the rounds."""
    counts = settle(word_counts(documents, text_col))
    top = counts.orderBy(F.desc("n"), "word").limit(SIZE - OTHERS).collect()
    hashes = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    met = np.zeros(OTHERS)
    for r in counts.groupBy(F.col("word").bitwiseAND(OTHERS - 1).alias("other")).agg(F.sum("n").alias("n")).collect():
        met[r["other"]] = r["n"]
    for r in top:
        met[r["word"] & (OTHERS - 1)] -= r["n"]
    model = WindowModel(hashes[order], np.arange(len(top))[order], _initial(), np.maximum(met, 1), counts)
    texts = documents.select(F.col(text_col).cast("string").alias("text"))
    for k in range(ROUNDS):
        model.weights = _round(texts.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k), model)
    return model


def score(documents: DataFrame, model: WindowModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, pseudo_log_likelihood, mean_log_likelihood) of every row.

    A task scores the classes and lists each document's words outside the frequent ones, with how
    often each occurs; these are joined to the table of counts, and their shares added by row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.without_words())
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        classes = np.log(m.met)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                token, rows, around, h = _token_rows(m, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                value = log_likelihoods(m.weights, token, around)
                other = token >= SIZE - OTHERS
                value[other] -= classes[token[other] - (SIZE - OTHERS)]
                n = np.bincount(rows, minlength=j - i)
                total = np.bincount(rows, weights=value, minlength=j - i).astype(np.float64)  # integers if there is no token
                where, word = rows[other], h[other]
                order = np.lexsort((word, where))
                where, word = where[order], word[order]
                first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (word[1:] != word[:-1])])) if len(where) else np.zeros(0, dtype=np.int64)
                lengths = np.bincount(where[first], minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(total), int_lists(word[first].view(np.int64), lengths), int_lists(np.diff(first, append=len(where)), lengths, np.int32)],
                    names=["id", "n_tokens", "total", "words", "times"],
                )

    rows = map_batches(documents.select(id_col, F.col(text_col).cast("string").alias("text")), run, f"id {id_type}, n_tokens long, total double, words array<long>, times array<int>")
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))  # the numbers are only used behind the checkpoint
    parts = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    shares = parts.join(model.words.where("n > 1"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("shares"))
    out = rows.select("row", "id", "n_tokens", "total").join(shares, "row", "left").withColumn("value", F.col("total") + F.coalesce("shares", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("value").alias("pseudo_log_likelihood"), F.when(F.col("n_tokens") > 0, F.col("value") / F.col("n_tokens")).alias("mean_log_likelihood"))
