"""Quality classifier with Naive Bayes support vectors (operator 1).

Indicators of byte n-grams are scaled by the classes' log-count ratios, and a linear hinge-loss
model is fitted to them by dual coordinate descent. Every text gets a score, null and empty ones
that of a document without n-grams; very long texts are read whole. Rows are scored alike whatever
their ids, null or repeated; labels without an id are left out, of labels that differ for one id the
higher holds, and documents that share a labelled id are each learned from. Without rows of both classes all scores are the share of
label 1 among the labelled rows (0.5 if there is none). An empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import byte_set, chunks, int_lists, span_hashes, utf8, word_spans
from .ngrams import BUCKETS, class_counts, gram_buckets
from .shared import map_batches

WORD = ~byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Shares of repeated words from which an indicator is set.
TWIN_SHARES = (0.0, 0.1, 0.25, 0.5)
#: Rows of one block of the fit; every labelled row is in a block and the blocks' weights are averaged.
BLOCK_ROWS = 4096
EPOCHS, COST, SMOOTHING, SHARPNESS = 8, 1.0, 1.0, 4.0
#: Labels up to this count are joined by broadcast (16 bytes each, 32 MB); more are shuffled.
BROADCAST_ROWS = 2_000_000


@dataclass
class QualityModel:
    """Weight and squared scale of each bucket (bounded: 2 x 65,536 floats), and the bias."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    constant: float | None = None


def _row_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distinct buckets of each row; its ends count as line feeds.

    Bigrams of a word and itself share one indicator, and further ones tell whether they make up a
    tenth, a quarter or half of the words: such words differ too much to be met again one by one.
    """
    seen = np.zeros(BUCKETS, dtype=bool)
    starts, ends, rows = word_spans(data, offsets, WORD)
    h = span_hashes(data, starts, ends)
    twin = np.flatnonzero((h[1:] == h[:-1]) & (rows[1:] == rows[:-1])) + 1
    words = np.bincount(rows, minlength=len(offsets) - 1)
    twins = np.bincount(rows[twin], minlength=len(offsets) - 1)
    grams = gram_buckets(data, offsets, 10)
    for row in range(len(offsets) - 1):
        seen[grams[offsets[row] : offsets[row + 1]]] = True
        for k, share in enumerate(TWIN_SHARES):
            if twins[row] and twins[row] >= share * words[row]:
                seen[k] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield row, found


def fit_block(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss over one block's unit-length rows."""
    w, bias = np.zeros(BUCKETS), 0.0
    balance = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    upper = cost * balance
    values = [ratio[x] / max(1e-12, np.sqrt((ratio[x] ** 2).sum())) for x in rows]
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            norm = 2.0 if len(x) else 1.0  # a unit row and the constant 1 of the bias
            new = min(max(alpha[i] - gradient / norm, 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on all labelled rows: class counts by Spark, then one block of about 4,096 rows per task."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = marks.count()
    if n <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(marks, "id")
    counts = class_counts(rows.select(F.col("label").cast("string").alias("label"), "text"), _row_buckets).toPandas()
    per = np.full((2, BUCKETS), SMOOTHING)
    size = [0, 0]
    for label, bucket, count in counts.itertuples(index=False):
        if bucket < 0:
            size[int(label)] = int(count)
        else:
            per[int(label), bucket] += count
    if not all(size):
        return QualityModel(np.zeros(BUCKETS), np.ones(BUCKETS), 0.0, size[1] / sum(size) if sum(size) else 0.5)
    ratio = np.log(per[1] / per[1].sum()) - np.log(per[0] / per[0].sum())
    blocks = max(1, round(sum(size) / BLOCK_ROWS))
    shared = documents.sparkSession.sparkContext.broadcast(ratio)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                found = [x for _, x in _row_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), int_lists(np.concatenate(found), [len(x) for x in found], np.int32), batch.column(2).slice(i, j - i)], names=["id", "grams", "label"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        w, bias = fit_block([np.asarray(x) for x in pdf.grams], np.where(pdf.label == 1, 1.0, -1.0), shared.value)
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": np.append(at, -1), "w": np.append(w[at], bias)})

    id_type = documents.schema[id_col].dataType.simpleString()
    spread = map_batches(rows.select("id", "text", "label"), features, f"id {id_type}, grams array<int>, label int").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    fitted = spread.groupBy("block").applyInPandas(fit, "bucket long, w double").groupBy("bucket").agg((F.sum("w") / blocks).alias("w")).toPandas()
    weights = np.zeros(BUCKETS)
    inner = fitted.bucket >= 0
    weights[fitted.bucket[inner]] = fitted.w[inner]
    return QualityModel(weights * ratio, ratio**2, float(fitted.w[~inner].sum()))


def score(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                margin = np.full(j - i, m.bias)
                if m.constant is None:
                    for row, found in _row_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                        if len(found):
                            margin[row] += m.weights[found].sum() / max(1e-12, np.sqrt(m.squares[found].sum()))
                value = 1 / (1 + np.exp(-SHARPNESS * np.clip(margin, -50, 50))) if m.constant is None else np.full(j - i, m.constant)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return map_batches(documents.select(id_col, F.col(text_col).cast("string").alias("text")), run, f"`{id_col}` {id_type}, score double, predicted int")
