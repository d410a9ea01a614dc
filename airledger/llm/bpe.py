"""Byte-level BPE encoding and decoding by a global distinct-word shuffle (operator 8).

Texts are cut into blocks of whole documents and split into pre-tokens once. A block's record keeps
the sequence of its pre-tokens as numbers of its own word list; the lists are shuffled by word, so
that each distinct word of the corpus is encoded once, its ids go back to the blocks that have it,
and each block puts its documents together by position. Blocks are made in one place only, so
nothing depends on how the input is split. Null and empty texts have no ids. Rows are independent:
repeated rows and rows with repeated or null ids are encoded like any other. An empty table gives an
empty result; extra columns are not read. A very long text closes the block that it falls into, so
that a block holds less than BLOCK_BYTES besides one text.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import giving_back, map_batches

#: Bytes of text from which a block is closed.
BLOCK_BYTES = 20 << 20
#: Slices that words hash to: the grain of the word shuffle.
SLICES = 1024
#: Words whose ids a task remembers (at about 200 bytes 50 MB); beyond that it starts afresh.
KNOWN_WORDS = 250_000
#: Largest vocabulary that is broadcast (at 16 bytes a token about 16 MB).
MAX_VOCABULARY = 1 << 20


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file; the driver reads it, and its size is checked."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {len(ranks)} tokens is beyond the broadcast bound of {MAX_VOCABULARY}")
    return ranks


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until no pair is a token."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _encode_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[x] for x in parts]


def _encode_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs over a linked list, for words of many bytes."""
    import heapq

    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[parts[i] + parts[i + 1]], i, len(parts[i]), len(parts[i + 1])) for i in range(n - 1) if parts[i] + parts[i + 1] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, x, y = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or len(parts[i]) != x or len(parts[j]) != y:
            continue
        parts[i] += parts[j]
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (rank := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (rank, a, len(parts[a]), len(parts[b])))
    return [ranks[x] for x, keep in zip(parts, alive, strict=True) if keep]


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _pack(numbers: np.ndarray, level: int = 1) -> bytes:
    """Unsigned 32-bit integers as byte planes, compressed."""
    planes = [(numbers >> shift).astype(np.uint8).tobytes() for shift in (0, 8, 16, 24)]
    return struct.pack("<q", len(numbers)) + zstandard.ZstdCompressor(level=level).compress(b"".join(planes))


def _pack_words(words: list[bytes]) -> bytes:
    lengths = _pack(np.array([len(x) for x in words], dtype=np.uint32))
    return struct.pack("<q", len(lengths)) + lengths + zstandard.ZstdCompressor(level=1).compress(b"".join(words))


def _unpack_words(packed: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<q", packed)
    ends = np.cumsum(_unpack(packed[8 : 8 + n])).tolist()
    flat = zstandard.ZstdDecompressor().decompress(packed[8 + n :])
    return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _unpack(packed: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<q", packed)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[8:], max_output_size=4 * n or 1), dtype=np.uint8).reshape(4, n).astype(np.uint32)
    return planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16) | planes[3] << np.uint32(24)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, list, list[int], np.ndarray, list[str]]]:
    """Of each block of a task: number, ids, pre-tokens of each document, sequence and word list.
    Frequent words come first in the list, so that the sequence packs well."""
    split = regex.compile(pattern).findall
    no, seq = TaskContext.get().partitionId(), 0
    ids, lengths, found, number, size = [], [], [], _Numbers(), 0

    def block():
        sequence, words = np.concatenate(found), list(number)
        order = np.argsort(-np.bincount(sequence, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        return no << 32 | seq, ids, lengths, rank[sequence], [words[i] for i in order]

    for batch in batches:
        texts = batch.column(1)
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            words = split(text)
            found.append(np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words)))
            ids.append(batch.column(0)[i].as_py())
            lengths.append(len(words))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield block()
                seq += 1
                ids, lengths, found, number, size = [], [], [], _Numbers(), 0
    if ids:
        yield block()


def _parts_schema(id_type: T.DataType) -> T.StructType:
    """A part is a block's record (slice -1: ids, lengths, packed sequence, slice of each word) or
    the words of a block that hash to a slice, packed and later coded."""
    kinds = {"block": T.LongType(), "slice": T.IntegerType(), "ids": T.ArrayType(id_type), "lengths": T.ArrayType(T.LongType()), "data": T.BinaryType(), "slices": T.BinaryType()}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def block_parts(texts: DataFrame, pattern: str) -> DataFrame:
    """The parts of all blocks, by _parts_schema."""
    id_type = texts.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, lengths, sequence, known in _blocks(batches, pattern):
            words = [x.encode() for x in known]
            slices = np.fromiter((zlib.crc32(x) % SLICES for x in words), dtype=np.uint32, count=len(words))
            order, sizes = np.argsort(slices, kind="stable"), np.bincount(slices, minlength=SLICES)
            ends, some = np.cumsum(sizes), np.flatnonzero(sizes)
            packed = [_pack_words([words[i] for i in order[ends[k] - sizes[k] : ends[k]]]) for k in some]
            none = [None] * len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some) + 1, block)),
                    pa.array(np.append(some, -1).astype(np.int32)),
                    pa.array([*none, ids], type=pa.list_(_arrow(id_type))),
                    pa.array([*none, lengths], type=pa.list_(pa.int64())),
                    pa.array([*packed, _pack(sequence, 3)], type=pa.binary()),
                    pa.array([*none, _pack(slices)], type=pa.binary()),
                ],
                names=["block", "slice", "ids", "lengths", "data", "slices"],
            )

    return map_batches(texts, run, _parts_schema(id_type))


def encode_words(parts: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The parts with words coded. A slice's words of all blocks come to one task, which encodes
    each distinct word when it first meets it; block records pass through, dealt out by block."""
    shared = parts.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column(1)[0].as_py() >= 0:
                    out = []
                    for word in _unpack_words(row.column(4)[0].as_py()):
                        ids = known.get(word)
                        if ids is None:
                            if len(known) >= KNOWN_WORDS:
                                known.clear()
                            ids = known[word] = np.array(encode_word(word, table), dtype="<u4").tobytes()
                        out.append(ids)
                    counts = _pack(np.fromiter(map(len, out), dtype=np.uint32, count=len(out)) // np.uint32(4))
                    coded = struct.pack("<q", len(counts)) + counts + _pack(np.frombuffer(b"".join(out), dtype="<u4"))
                    row = row.set_column(4, "data", pa.array([coded], type=pa.binary()))
                yield row

    dealt = parts.repartition(F.when(F.col("slice") >= 0, F.col("slice").cast("long")).otherwise(F.col("block")))
    return map_batches(dealt, run, parts.schema)


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, token_ids: the ids as little-endian unsigned 32-bit integers) of every row."""
    texts = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema[0].dataType

    def join(parts: pa.Table) -> pa.Table:
        order = np.argsort(parts["slice"].to_numpy())
        record = parts.slice(int(order[0]), 1)
        sizes, flat = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
        for i in order[1:]:
            coded = parts["data"][int(i)].as_py()
            (n,) = struct.unpack_from("<q", coded)
            sizes.append(_unpack(coded[8 : 8 + n]).astype(np.int64))
            flat.append(_unpack(coded[8 + n :]))
        flat, by_slice = np.concatenate(flat).astype("<u4"), np.concatenate(sizes)
        slices = _unpack(record["slices"][0].as_py())
        size, first = np.empty(len(slices), dtype=np.int64), np.empty(len(slices), dtype=np.int64)
        by = np.argsort(slices, kind="stable")
        size[by], first[by] = by_slice, np.cumsum(by_slice) - by_slice
        ids, lengths, sequence = record["ids"][0].as_py(), np.asarray(record["lengths"][0].as_py(), dtype=np.int64), _unpack(record["data"][0].as_py())
        out = []
        for end, n in zip(np.cumsum(lengths), lengths, strict=True):
            part = sequence[end - n : end]
            count = size[part]
            where = np.repeat(first[part] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            out.append(flat[where].tobytes())
        return pa.table({id_col: pa.array(ids, type=_arrow(id_type)), "token_ids": pa.array(out, type=pa.binary())})

    coded = encode_words(block_parts(texts, pattern), ranks)
    return coded.groupBy("block").applyInArrow(giving_back(join), T.StructType([T.StructField(id_col, id_type), T.StructField("token_ids", T.BinaryType())]))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids") -> DataFrame:
    """Adds `decoded`, the bytes of the ids: a broadcast join with the token-byte table, whose size
    is checked when it is read. Ids outside the table raise an error."""
    table = sorted((rank, token) for token, rank in ranks.items())
    known = np.full(table[-1][0] + 1 if table else 0, -1, dtype=np.int64)
    known[[rank for rank, _ in table]] = [len(token) for _, token in table]
    shared = encoded.sparkSession.sparkContext.broadcast((known, b"".join(token for _, token in table)))
    columns = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, raw = shared.value
        raw = np.frombuffer(raw, dtype=np.uint8)
        begin = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for x in part.column(columns.index(ids_col)).to_pylist():
                    ids = np.frombuffer(x or b"", dtype="<u4").astype(np.int64)
                    n = length[ids]
                    if len(n) and n.min() < 0:
                        raise ValueError("an id is not in the token table")
                    total = int(n.sum())
                    where = np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(total)
                    out.append(raw[where].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, type=pa.binary())], names=[*columns, "decoded"])

    return map_batches(encoded, run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
