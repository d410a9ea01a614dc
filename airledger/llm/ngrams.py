"""Hashed byte n-gram counts gathered per class over all rows, for the trained models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import CHUNK_BYTES, chunks, utf8
from .shared import map_batches

#: Buckets that byte n-grams are hashed to.
BUCKETS = 1 << 16


def held_out(id_col: str, folds: int, fold: int) -> F.Column:
    """Whether crc32(id as text) mod folds is the given fold; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def gram_buckets(codes: np.ndarray, offsets: np.ndarray, outside: int) -> np.ndarray:
    """Bucket of the three bytes around each position; beyond a row's ends there is `outside`."""
    x = codes.astype(np.uint32)
    left, right = np.empty_like(x), np.empty_like(x)
    left[1:], right[:-1] = x[:-1], x[1:]
    bounds = offsets[:-1][offsets[:-1] < len(x)]
    left[bounds] = outside
    bounds = offsets[1:] - 1
    right[bounds[bounds >= 0]] = outside
    return ((left * np.uint32(65536) + x * np.uint32(256) + right) * np.uint32(2654435761)) >> np.uint32(16)


def class_counts(rows: DataFrame, row_buckets: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]], count_rows: bool = True) -> DataFrame:
    """(label, bucket, n): occurrences in all rows of (label, text), summed in each task first.

    row_buckets yields (row, buckets) of a chunk; bucket -1 counts the rows of a label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                for row, found in row_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    total = sums.setdefault(labels[i + row], np.zeros(BUCKETS + 1, dtype=np.int64))
                    total[:BUCKETS] += np.bincount(found, minlength=BUCKETS)
                    total[BUCKETS] += 1
        for label, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), type=pa.string()), pa.array(np.where(at == BUCKETS, -1, at)), pa.array(total[at])], names=["label", "bucket", "n"])

    return map_batches(rows, run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
