"""Best-fit packing of documents into sequences (operator 11).

Best-fit decreasing: pieces from the longest to the shortest, each into the open bin with the least
room that still takes it, else into a new one. A piece's place depends on its length and its number
among those of its length only, so the whole packing follows from 1,024 counts, however many
documents there are: the driver plans it for runs of equal pieces (a segment tree over remaining
capacities finds the tightest open bins), and every task looks its pieces up in the plan. The result
is that of best-fit decreasing over all pieces at once, not over parts of them.

Rows are independent. Null and empty texts are one piece, the end id. Repeated rows, and rows with
repeated or null ids, are packed like any other; equal lengths are numbered in the order in which
they were written. An empty table gives an empty result; extra columns are not read. A long document
is cut into pieces of the capacity, of which the first may be shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .coding import byte_level_coder, share_file
from .shared import map_batches, written

#: Largest capacity of a sequence: a plan has at most 4 x capacity x capacity runs (see `plan`).
MAX_CAPACITY = 1024
#: Token ids of one batch of pieces.
BATCH_IDS = 1 << 20


class Capacities:
    """A segment tree over remaining capacities: how many bins have just so much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.counts[at] += bins
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least so much that a bin has."""
        at = least + self.leaves
        if not self.counts[at]:
            while at > 1 and (at & 1 or not self.counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.counts[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, first bin, pieces a bin takes, offset of the first) of the packing of
    so many pieces of each length, in order of length and rank.

    Bins of equal room are kept as ranges of bin numbers. A length adds at most four ranges, where
    its pieces run out in the middle of one and where it opens new bins, so there are never more than
    4 x capacity, and at most that many runs per length.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    tree, runs, bins = Capacities(capacity), [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            room.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            left = tree.tightest(length)
            each = (left or capacity) // length
            need = -(-(n - rank) // each)
            if left is None:
                left, first, have = capacity, bins, need
                bins += need
            else:
                first, have = room[left].pop()
                tree.add(left, -have)
            used = min(have, need)
            placed = min(n - rank, used * each)
            runs.append((length, rank, first, each, capacity - left))
            full = placed // each
            put(left - each * length, first, full)
            if full < used:
                put(left - (placed - full * each) * length, first + full, 1)
            put(left, first + used, have - used)
            rank += placed
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def cut(documents: DataFrame, tokenizer_path: str, capacity: int = MAX_CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, token_ids) of the ids and the end id of every text, by a byte-level
    tokenizer and without its added special tokens. token_ids are little-endian unsigned 32-bit."""
    texts = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema[0].dataType
    kind, file = to_arrow_type(id_type), share_file(documents.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = byte_level_coder(file.value, plain=False), np.array([end_id], dtype="<u4")
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            of, piece, start, length, ids = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(of, type=kind), pa.array(piece, type=pa.int32()), pa.array(start, type=pa.int64()), pa.array(length, type=pa.int64()), pa.array(ids, type=pa.binary())], names=[id_col, "piece", "start", "length", "token_ids"])

        for part in batches:
            for of, text in zip(part.column(0), part.column(1), strict=True):
                ids = np.concatenate([coder.ids(text.as_py() or ""), end])
                first = (len(ids) - 1) % capacity + 1
                starts = [0, *range(first, len(ids), capacity)]
                for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((of.as_py(), k, i, j - i, ids[i:j].tobytes()))
                held += len(ids)
                if held >= BATCH_IDS:
                    yield batch()
                    rows.clear()
                    held = 0
        if rows:
            yield batch()

    fields = [T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    return map_batches(texts, run, T.StructType(fields))


def _numbered(pieces: DataFrame) -> DataFrame:
    """pieces with the number of the task that wrote them and their rank in it among those of their
    length; written down, so that a task that runs again does not deal other ranks."""
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(0, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            lengths = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(lengths):
                continue
            seen = np.pad(seen, (0, max(0, int(lengths.max()) + 1 - len(seen))))
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            sizes = np.diff(np.append(begins, len(ordered)))
            rank = np.empty(len(lengths), dtype=np.int64)
            rank[order] = np.arange(len(ordered)) - np.repeat(begins, sizes) + seen[ordered]
            seen[ordered[begins]] += sizes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), task)), pa.array(rank)], names=[*batch.schema.names, "_task", "_rank"])

    return written(map_batches(pieces, run, T.StructType([*pieces.schema.fields, T.StructField("_task", T.LongType()), T.StructField("_rank", T.LongType())])))


def pack(pieces: DataFrame, capacity: int = MAX_CAPACITY) -> DataFrame:
    """pieces, of which each has a length of 1 to capacity, with sequence_id and offset.

    To the driver go the counts of at most `capacity` lengths; what is broadcast is the plan, whose
    size depends on the capacity and not on the rows.
    """
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"a capacity of {capacity} is not between 1 and {MAX_CAPACITY}")
    rows = _numbered(pieces)
    counts = rows.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if totals and not 1 <= min(totals) <= max(totals) <= capacity:
        raise ValueError(f"lengths from {min(totals)} to {max(totals)} are not between 1 and {capacity}")
    shared = rows.sparkSession.sparkContext.broadcast(plan(totals, capacity))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = rows.join(first, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_first")).select(*pieces.columns, "_rank")
    columns, at = pieces.columns, pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            length, rank = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            found = runs[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            k = rank - found[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found[:, 2] + k // found[:, 3]), pa.array(found[:, 4] + k % found[:, 3] * length)], names=[*columns, "sequence_id", "offset"])

    return map_batches(ranked, run, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
