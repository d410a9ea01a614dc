"""Alignment of two tokenizers over the same bytes (operator 12).

Tokenizer A (byte-level) encodes a space and the text, tokenizer B (pieces, which adds the space
itself) the text. Every token points to the overlapping token of the other side that reaches
farthest right; where both end together the B token points to itself. Doubling these pointers for
all tokens of a batch at once takes each to the last token of its group, which labels the group.

Link counts of id pairs are taken over the corpus: a block of documents counts its own pairs first,
the counts are summed by pair in a shuffle, and come back to the blocks that have the pair. A pair
thus has one row per block, however often it occurs.

Null and empty texts, and those whose token bytes differ from space + text on either side, have no
tokens: zeros and an empty string of groups. Rows are independent: repeated rows and repeated or
null ids are aligned like any other and count in the corpus as often as they are there. An empty
table gives an empty result; extra columns are not read. A block closes with the text that takes it
over BLOCK_BYTES, so that it holds less than that besides one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from sentencepiece import SentencePieceProcessor

from .bpe import _pack, _unpack
from .coding import byte_level_coder, byte_level_tokens, share_file
from .shared import giving_back_pair, map_batches, written

#: Bytes of text from which a block is closed.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are aligned at a time.
CHUNK_BYTES = 1 << 20
#: The numbers of a document besides its id.
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def piece_tokens(model: SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> the byte HH."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


def group_labels(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two tilings of the same bytes, by the ends of their tiles: the label of each tile's group (the
    number of its last B tile) on either side, and the first and the number of B tiles that each A
    tile overlaps."""
    start_a, start_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
    n, m = len(end_a), len(end_b)
    last_b = np.searchsorted(start_b, end_a) - 1
    last_a = np.searchsorted(start_a, end_b) - 1
    to = np.concatenate([n + last_b, np.where(end_a[last_a] > end_b, last_a, n + np.arange(m))])
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            break
        to = farther
    first = np.searchsorted(end_b, start_a, side="right")
    return to[:n] - n, to[n:] - n, first, last_b - first + 1


@dataclass
class Block:
    """What a block keeps of its documents: ids, numbers, digests and, link by link, the id pairs."""

    ids: list = field(default_factory=list)
    numbers: list = field(default_factory=list)
    digests: list = field(default_factory=list)
    groups: list = field(default_factory=list)
    links: list = field(default_factory=list)
    size: int = 0


class Aligner:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, file_a: bytes, file_b: bytes):
        self.a, self.b = byte_level_coder(file_a, plain=True), SentencePieceProcessor(model_proto=file_b)
        self.bytes_a, self.bytes_b = byte_level_tokens(self.a.tokenizer), piece_tokens(self.b)
        self.len_a, self.len_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        #: Each id of A and then of B as text, before a comma, a bar and a semicolon.
        self.shown = [f"{i}{end}" for t in (self.bytes_a, self.bytes_b) for i in range(len(t)) for end in ",|;"]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out, none = [], np.zeros(0, dtype=np.int64)
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            a = self.a.ids(f" {text}") if text else none
            raw = f" {text}".encode()
            same = text and b"".join(map(self.bytes_b.__getitem__, b)) == raw and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw
            out.append((a, np.array(b, dtype=np.int64)) if same else (none, none))
        return out

    def add(self, block: Block, ids: list, texts: list[str], keep_groups: bool) -> None:
        """Align some documents and put them into the block."""
        found = self.tokens(texts)
        size_a, size_b = (np.array([len(x[k]) for x in found], dtype=np.int64) for k in (0, 1))
        a, b = (np.concatenate([x[k] for x in found]).astype(np.int64) for k in (0, 1))
        group_a, group_b, first, count = group_labels(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
        of_a, of_b = np.repeat(np.arange(len(ids)), size_a), np.repeat(np.arange(len(ids)), size_b)
        n_links = np.bincount(of_a, weights=count, minlength=len(ids)).astype(np.int64)
        n_groups = np.bincount(of_b[group_b == np.arange(len(b))], minlength=len(ids))
        block.numbers.append(np.stack([size_a, size_b, n_groups, n_links]))
        linked = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        block.links.append(np.repeat(a, count) << 32 | b[linked])
        block.ids += ids

        group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(group, kind="stable")
        group, side = group[order], side[order]
        end = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        shown = (np.concatenate([a, b + len(self.bytes_a)])[order] * 3 + np.append(end, 2)[: len(order)]).tolist()
        at = 0
        for n in (size_a + size_b).tolist():
            said = "".join(map(self.shown.__getitem__, shown[at : at + n]))[:-1]
            at += n
            block.digests.append(hashlib.sha256(said.encode()).hexdigest() if n else "")
            if keep_groups:
                block.groups.append(said)


def _blocks(batches: Iterator[pa.RecordBatch], aligner: Aligner, keep_groups: bool) -> Iterator[Block]:
    block, ids, texts, waiting = Block(), [], [], 0
    for batch in batches:
        for of, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(of.as_py())
            texts.append(text.as_py() or "")
            waiting += len(texts[-1].encode())
            if waiting >= CHUNK_BYTES:
                aligner.add(block, ids, texts, keep_groups)
                block.size += waiting
                ids, texts, waiting = [], [], 0
                if block.size >= BLOCK_BYTES:
                    yield block
                    block = Block()
    if ids:
        aligner.add(block, ids, texts, keep_groups)
    if block.ids:
        yield block


def _parts(texts: DataFrame, path_a: str, path_b: str, keep_groups: bool) -> DataFrame:
    """A block's record (pair -1: ids, numbers, digests, packed links) and its id pairs with their
    number in the block and their links."""
    id_type = texts.schema[0].dataType
    kind, file_a, file_b = to_arrow_type(id_type), share_file(texts.sparkSession, path_a), share_file(texts.sparkSession, path_b)
    fields = {"block": T.LongType(), "pair": T.LongType(), "no": T.IntegerType(), "links": T.LongType(), "ids": T.ArrayType(id_type), "numbers": T.ArrayType(T.LongType()), "digests": T.ArrayType(T.StringType()), "groups": T.ArrayType(T.StringType()), "sequence": T.BinaryType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = Aligner(file_a.value, file_b.value), TaskContext.get().partitionId()
        for k, block in enumerate(_blocks(batches, aligner, keep_groups)):
            pairs, sequence, links = np.unique(np.concatenate(block.links), return_inverse=True, return_counts=True)
            order = np.argsort(-links, kind="stable")  # frequent pairs get small numbers, which pack well
            rank = np.empty(len(pairs), dtype=np.uint32)
            rank[order] = np.arange(len(pairs), dtype=np.uint32)
            none = pa.nulls(len(pairs) + 1)
            one = lambda value, of: pa.array([*[None] * len(pairs), value], type=of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(pairs) + 1, task << 32 | k)),
                    pa.array(np.append(pairs[order], -1)),
                    pa.array(np.append(np.arange(len(pairs)), -1).astype(np.int32)),
                    pa.array(np.append(links[order], 0)),
                    one(block.ids, pa.list_(kind)),
                    one(np.concatenate(block.numbers, axis=1).ravel(), pa.list_(pa.int64())),
                    one(block.digests, pa.list_(pa.string())),
                    one(block.groups, pa.list_(pa.string())) if keep_groups else none.cast(pa.list_(pa.string())),
                    one(_pack(rank[sequence], 3), pa.binary()),
                ],
                names=list(fields),
            )

    return map_batches(texts, run, T.StructType([T.StructField(name, of) for name, of in fields.items()]))


def align(documents: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, and with
    keep_groups the groups themselves, as `a1,a2|b1;a3|b2,b3` of ids in order."""
    texts = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema[0].dataType
    parts = written(_parts(texts, path_a, path_b, keep_groups))
    pairs = parts.where("pair >= 0").select("block", "pair", "no", "links")
    total = pairs.groupBy("pair").agg(F.sum("links").alias("total"))
    by_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = total.groupBy(by_b.alias("b")).agg(F.max("total").alias("top"))
    judged = total.withColumn("b", by_b).join(top, "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    back = pairs.join(judged, "pair").select(F.col("block").alias("home"), "no", "total", "best")

    def finish(records: pa.Table, known: pa.Table) -> pa.Table:
        record = records.slice(0, 1).to_pylist()[0]
        ids = record["ids"]
        numbers = np.array(record["numbers"], dtype=np.int64).reshape(len(NUMBERS), len(ids))
        order = np.argsort(known["no"].to_numpy())
        total, best = known["total"].to_numpy()[order], known["best"].to_numpy()[order]
        sequence, n_links = _unpack(record["sequence"]), numbers[-1]
        of = np.repeat(np.arange(len(ids)), n_links)
        sums = np.zeros((2, len(ids)), dtype=np.int64)
        np.add.at(sums[0], of, best[sequence].astype(np.int64))
        np.add.at(sums[1], of, total[sequence])
        columns = {id_col: pa.array(ids, type=to_arrow_type(id_type))} | dict(zip([*NUMBERS, "n_best", "count_sum"], map(pa.array, [*numbers, *sums]), strict=True)) | {"groups_sha256": pa.array(record["digests"], type=pa.string())}
        return pa.table(columns | ({"groups": pa.array(record["groups"], type=pa.string())} if keep_groups else {}))

    fields = [T.StructField(id_col, id_type), *[T.StructField(c, T.LongType()) for c in (*NUMBERS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())]
    fields += [T.StructField("groups", T.StringType())] if keep_groups else []
    records = parts.where("pair = -1").select("block", "ids", "numbers", "digests", "groups", "sequence")
    return records.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(giving_back_pair(finish), T.StructType(fields))
