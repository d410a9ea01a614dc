"""Removal of repeated byte strings by a distributed, common-prefix-aware suffix sort (operator 6).

A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id,
or in the same document before. Rows: one per document row. Null texts are empty; texts shorter
than `length` keep all their bytes; between rows that repeat an id the smaller start is earlier, and
equal starts are no earlier than each other; rows without an id come after all others, as rows that
repeat the id 2^63 - 1. A very long text makes up a block, which one task holds
packed; what is derived from it is made piece by piece, and equal contexts are kept once. An empty
table gives an empty result; extra columns are not read.

Only suffixes at anchors are sorted. An anchor is the place of the smallest fingerprint of GRAM
bytes in some string of `length` bytes, so equal strings have theirs at equal places. Documents are
packed into blocks once, in a table of the checkpoint folder, so that nothing depends on how the input
is split later on. Blocks go through these steps:

1. Fingerprints of all anchors meet in slices; an anchor whose fingerprint is single is left out.
2. The others' contexts (the bytes from the anchor on, then those before it, backwards) are sorted
   within each block, front-coded, and exchanged by ranges of their first bytes.
3. A range combines its runs with a loser tree over common-prefix lengths. Sorted contexts and
   their common prefixes give, for each place of a string around its anchor, the classes of equal
   strings and the first of each.
4. Anchors whose fingerprint occurs more than `spread` times are kept out of the ranges, as their
   contexts could not be split there. Blocks that hold some send the digests of their strings, each
   with its first occurrence in the block, and a minimum per digest finds the first of all.
5. Each block gets back which of its strings are not first, and drops the bytes they cover.

Slices and ranges grow in number with the blocks, so that neither grows in size.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import BYTE_CODE, _P, _P_INV, mix, powers, utf8
from .shared import giving_back, giving_back_pair, map_batches, settle

_U = np.uint64
#: Bytes of an anchor's fingerprint.
GRAM = 32
#: Bytes of text of a block; fingerprints meet in at least SLICES slices, and one for so many blocks.
BLOCK_BYTES, SLICES, SLICE_BLOCKS = 2 << 20, 512, 32
#: Bytes in which a block's anchors are found at once, and contexts that are compared at once.
PIECE_BYTES, PIECE_ROWS = 1 << 19, 1 << 15
#: Stands for the id of rows without one.
NO_ID = (1 << 63) - 1
#: The sort has one range per block. At most so many are cut by bytes (the cuts are broadcast, 32
#: bytes each); with more blocks, each of these is dealt into several by fingerprint.
MAX_CUTS = 16384
#: Occurrences above which the strings around a fingerprint meet by digest.
SPREAD = 1 << 17


class Suspects(NamedTuple):
    """Anchors of a block whose fingerprint occurs more than once, and their distinct contexts."""

    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    #: Place, id of the document and place in it, of each anchor, in order of context, id and place in it.
    at: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    #: The number of each anchor's context, and the first anchor of each context.
    number: np.ndarray
    first: np.ndarray
    #: Sorted contexts, their fingerprints, and which of them meet by digest.
    rows: np.ndarray
    prints: np.ndarray
    heavy: np.ndarray


def _grouped(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with its indices, in order."""
    order = np.argsort(values, kind="stable")
    found, begin = np.unique(values[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, begin[1:]), strict=False)


def _sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) of each `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = take(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte places and fingerprints of the anchors of concatenated documents."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    prefix = np.zeros(n + 1, dtype=_U)
    np.cumsum(BYTE_CODE[data] * powers(n, _P), out=prefix[1:])
    h = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(n + 1, _P_INV)[: n - GRAM + 1]) | _U(1)
    least = _sliding(h, width, np.minimum)
    inside = np.zeros(n + 1, dtype=np.int32)
    spans = offsets[1:] - offsets[:-1] >= length
    np.add.at(inside, offsets[:-1][spans], 1)
    np.add.at(inside, offsets[1:][spans] - length + 1, -1)
    least[np.cumsum(inside)[: len(least)] <= 0] = 0  # such a string would cross documents
    pad = np.zeros(width - 1, dtype=_U)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, ids, bytes and offsets of each block of a task, its documents in order of id."""
    no, seq, ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def block():
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        lengths = np.array([len(parts[i]) for i in order], dtype=np.int64)
        return no << 32 | seq, np.array(ids, dtype=np.int64)[order], np.concatenate([parts[i] for i in order]), np.concatenate([[0], np.cumsum(lengths)])

    for batch in batches:
        data, offsets = utf8(batch.column(1))
        keys = batch.column(0).to_pylist()
        for i, key in enumerate(keys):
            ids.append(key)
            parts.append(data[offsets[i] : offsets[i + 1]].copy())
            size += len(parts[-1])
            if size >= BLOCK_BYTES:
                yield block()
                seq += 1
                ids, parts, size = [], [], 0
    if ids:
        yield block()


def _block_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """anchors() of a block, some documents or a piece of a long one at a time. A piece is read with
    the bytes around it that decide on its anchors."""
    i, around = 0, 2 * length
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, side="right")) - 1)
        begin, end = int(offsets[i]), int(offsets[j])
        for lo in range(begin, end, PIECE_BYTES) if j == i + 1 else [begin]:
            hi = min(lo + PIECE_BYTES, end) if j == i + 1 else end
            first, last = max(begin, lo - around), min(end, hi + around)
            bounds = np.array([0, last - first]) if j == i + 1 else offsets[i : j + 1] - begin
            at, h = anchors(data[first:last], bounds, length)
            own = (at + first >= lo) & (at + first < hi)
            yield at[own] + first, h[own]
        i = j


def distinct_contexts(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts of the places, sorted, and the number of each place's context. They are
    made and folded some at a time, so that a text of few different contexts takes little memory."""
    rows, which, n = [contexts(data, offsets, places[:0], length)], [np.zeros(0, dtype=np.int64)], 0
    for at in range(0, len(places), PIECE_ROWS):
        part = contexts(data, offsets, places[at : at + PIECE_ROWS], length)
        _, first, number = np.unique(_strings(part), return_index=True, return_inverse=True)
        rows.append(part[first])
        which.append(number + n)
        n += len(first)
    whole = np.concatenate(rows)
    _, first, number = np.unique(_strings(whole), return_index=True, return_inverse=True)
    return whole[first], number[np.concatenate(which)] if n else np.concatenate(which)


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints of a block, and how often each occurs."""
    pairs = [np.unique(h, return_counts=True) for h in parts]
    values, which = np.unique(np.concatenate([np.zeros(0, dtype=_U), *(h for h, _ in pairs)]), return_inverse=True)
    return values, np.bincount(which, weights=np.concatenate([np.zeros(0), *(n for _, n in pairs)]), minlength=len(values)).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of bytes and integers as one compressed value; _loosen gives them back."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sq", x.dtype.str[1:].encode(), x.nbytes) for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def _loosen(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, at, out = raw[0], 1, []
    heads = [struct.unpack_from("<2sq", raw, 1 + 10 * i) for i in range(n)]
    at += 10 * n
    for kind, size in heads:
        out.append(np.frombuffer(raw, dtype="<" + kind.decode(), count=size // np.dtype("<" + kind.decode()).itemsize, offset=at))
        at += size
    return out


def contexts(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """One row per anchor: `length` bytes from it on, the bytes before it backwards, and how many
    of either there are; what lies beyond the document is 0."""
    back = length - GRAM
    row = np.searchsorted(offsets, places, side="right") - 1
    right = np.minimum(offsets[row + 1] - places, length)
    left = np.minimum(places - offsets[row], back)
    out = np.zeros((len(places), length + back + 2), dtype=np.uint8)
    top = max(0, len(data) - 1)
    for k in range(length):
        out[:, k] = np.where(k < right, data[np.minimum(places + k, top)], 0)
    for k in range(back):
        out[:, length + k] = np.where(k < left, data[np.maximum(places - 1 - k, 0)], 0)
    out[:, -2], out[:, -1] = right + 1, left + 1
    return out


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before; 0 for the first."""
    out = np.zeros(len(rows), dtype=np.int64)
    for i in range(1, len(rows), 65536):
        a, b = rows[i - 1 : min(i + 65535, len(rows) - 1)], rows[i : i + 65536]
        differs = a != b
        out[i : i + len(b)] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def _strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefixes of sorted rows, and the bytes after them."""
    lcp = common_prefixes(rows)
    keep = np.arange(rows.shape[1])[None, :] >= lcp[:, None]
    return lcp.astype(np.uint8), rows[keep]


def decoded(lcp: np.ndarray, tails: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    raw, at, last = tails.tobytes(), 0, b""
    for k in lcp.tolist():
        last = last[:k] + raw[at : at + width - k]
        at += width - k
        yield k, last


def merge_runs(runs: list[Iterator[tuple[int, bytes]]], width: int) -> Iterator[tuple[int, int, bytes]]:
    """(common prefix with the row before, run, row) of all runs in order, by a loser tree.

    Each run's head carries its common prefix with the last row that came out: of two heads the one
    with the longer prefix is smaller, and only equal prefixes are compared, from there on. The
    loser keeps the prefix that it has in common with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    prefix = [0] * k
    for i, run in enumerate(runs):
        first = next(run, None)
        heads[i] = first[1] if first else None
    number = int.from_bytes

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); ends of runs lose, ties go to the lower run."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        differs = number(x[p:], "big") ^ number(y[p:], "big")
        same = width - (differs.bit_length() + 7) // 8
        if same >= width:
            win, lose = (a, b) if a < b else (b, a)
        else:
            win, lose = (a, b) if x[same] < y[same] else (b, a)
        prefix[lose] = same
        return win, lose

    losers = [0] * k
    level = list(range(k))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            win, lose = play(level[i], level[i + 1])
            losers[(len(level) + i) // 2] = lose
            up.append(win)
        level = up
    best = level[0]
    while heads[best] is not None:
        yield prefix[best], best, heads[best]
        following = next(runs[best], None) if best < len(runs) else None
        heads[best] = following[1] if following else None
        prefix[best] = following[0] if following else 0
        node = (best + k) // 2
        while node:
            win, lose = play(best, losers[node])
            losers[node] = lose
            best = win
            node //= 2


def later_strings(rows: np.ndarray, lcp: np.ndarray, docs: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """For distinct sorted contexts with their first occurrences: [row, k] tells whether the string
    that starts k bytes before the anchor also starts around an earlier one.

    Strings of one k are equal if `length` - k bytes from the anchor and k before it are: both
    classes follow from common prefixes of a sorted order, once from the anchor on and once back.
    """
    back, n = length - GRAM, len(rows)
    out = np.zeros((n, back + 1), dtype=bool)
    group = np.cumsum(lcp < GRAM)
    several = np.flatnonzero(np.bincount(group, minlength=group[-1] + 1)[group] > 1) if n else np.zeros(0, dtype=np.int64)
    if not len(several):
        return out
    right, left = rows[several, -2].astype(np.int64) - 1, rows[several, -1].astype(np.int64) - 1
    # Between two chosen rows the common prefix is the least of those passed; groups are contiguous.
    ahead = np.where(np.concatenate([[True], group[several][1:] != group[several][:-1]]), 0, lcp[several])
    behind = rows[several, length : length + back]
    order = np.argsort(_strings(np.concatenate([behind, np.full((len(several), 1), 1, dtype=np.uint8)], axis=1)), kind="stable")
    lcp_back = common_prefixes(behind[order])
    rank = np.empty(len(several), dtype=np.int64)
    rank[np.lexsort((places[several], docs[several]))] = np.arange(len(several))
    # Equal (doc, place) are no earlier than each other: they share a rank.
    by = np.argsort(rank)
    fresh = np.ones(len(by), dtype=np.int64)
    fresh[1:] = (docs[several][by][1:] != docs[several][by][:-1]) | (places[several][by][1:] != places[several][by][:-1])
    rank[by] = np.cumsum(fresh) - 1
    for k in range(back + 1):
        fits = (left >= k) & (right >= length - k)
        if not fits.any():
            continue
        a = np.cumsum(ahead < length - k)
        b = np.empty(len(several), dtype=np.int64)
        b[order] = np.cumsum(lcp_back < k) if k else 0
        chosen = np.flatnonzero(fits)
        key = a[chosen] * (len(several) + 1) + b[chosen]
        _, which = np.unique(key, return_inverse=True)
        first = np.full(which.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, which, rank[chosen])
        out[several[chosen], k] = rank[chosen] > first[which]
    return out


def string_digests(rows: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """For each k: the contexts with a string that starts k bytes before the anchor, and the 128-bit
    digests of k and the string."""
    right, left = rows[:, -2].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
    for k in range(length - GRAM + 1):
        some = np.flatnonzero((left >= k) & (right >= length - k))
        if len(some):
            whole = np.concatenate([rows[some, : length - k], rows[some, length : length + k], np.full((len(some), 1), k + 1, dtype=np.uint8)], axis=1)
            values, which = np.unique(_strings(whole), return_inverse=True)
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in values.tolist()]
            yield k, some, [digests[i] for i in which.tolist()]


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_text: bool = False, spread: int = SPREAD
) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of each row; kept_text is what
    is left, without characters that were cut in part."""
    if not GRAM < length <= 250:
        raise ValueError(f"length must lie between {GRAM + 1} and 250")
    spark = documents.sparkSession
    back = length - GRAM
    width = length + back + 2
    texts = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, packed in _packed(batches):
            _, offsets, data = _loosen(packed)
            h, often = _counted([h for _, h in _block_anchors(data, offsets, length)])
            rest = h // _U(slices)
            some, packed = [], []
            for s, own in _grouped((h % _U(slices)).astype(np.int64)):
                some.append(s)
                packed.append(_squeeze(rest[own].astype(np.uint32), (rest[own] >> _U(32)).astype(np.uint16), often[own].astype(np.uint32)))
            columns = [pa.array(np.full(len(some), block)), pa.array(some, type=pa.int64()), pa.array(packed, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "slice", "prints"])

    def meet(table: pa.Table) -> pa.Table:
        """Which of a slice's fingerprints more than one block has, and which occur too often for a range."""
        parts = [_loosen(x) for x in table["prints"].to_pylist()]
        sets = [lo.astype(_U) | hi.astype(_U) << _U(32) for lo, hi, _ in parts]
        values, which, blocks_of = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        heavy = (np.bincount(which, weights=np.concatenate([x[2] for x in parts])) > spread)[which]
        many, at, marks, any_heavy = (blocks_of > 1)[which], 0, [], []
        for x in sets:
            own = slice(at, at := at + len(x))
            marks.append(_squeeze(np.packbits(many[own]), np.packbits(heavy[own])))
            any_heavy.append(bool(heavy[own].any()))
        return pa.table({"of": table["block"], "at": table["slice"], "marks": pa.array(marks, type=pa.binary()), "heavy": pa.array(any_heavy, type=pa.bool_())})

    def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

    def packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, data, offsets in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_squeeze(ids, offsets, data)], type=pa.binary())], names=["block", "texts"])

    def suspects(left: pa.Table, right: pa.Table) -> Suspects:
        ids, offsets, data = _loosen(left["texts"][0].as_py())
        found = [(at.astype(np.int64), h) for at, h in _block_anchors(data, offsets, length)]
        known, often = _counted([h for _, h in found])
        marks = dict(zip(right["at"].to_pylist(), right["marks"].to_pylist(), strict=True))
        many, heavy = often > 1, np.zeros(len(known), dtype=bool)
        for s, own in _grouped((known % _U(slices)).astype(np.int64)):
            others, loads = (np.unpackbits(x)[: len(own)].astype(bool) for x in _loosen(marks[s]))
            many[own] |= others
            heavy[own] = loads
        which_print = [np.searchsorted(known, h) for _, h in found]
        places = np.concatenate([np.zeros(0, dtype=np.int64), *(at[many[w]] for (at, _), w in zip(found, which_print, strict=True))])
        prints = np.concatenate([np.zeros(0, dtype=np.int64), *(w[many[w]] for w in which_print)])
        rows, which = distinct_contexts(data, offsets, places, length)
        doc = np.searchsorted(offsets, places, side="right") - 1
        by = np.lexsort((places - offsets[doc], ids[doc], which))
        number = which[by]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        own = prints[by][first]
        return Suspects(ids, offsets, data, places[by], ids[doc[by]], (places - offsets[doc])[by], number, first, rows, known[own], heavy[own])

    source = settle(map_batches(texts, packed_blocks, "block long, texts binary"))
    blocks = source.count()
    slices, deals = max(SLICES, -(-blocks // SLICE_BLOCKS)), max(1, -(-blocks // MAX_CUTS))
    met = map_batches(source, prints, "block long, slice long, prints binary").groupBy("slice").applyInArrow(giving_back(meet), "of long, at long, marks binary, heavy boolean")
    fingerprints = settle(met)
    sample = _splitters(documents, text_col, length, max(1, min(MAX_CUTS, blocks)), max(0.01, min(1.0, 8 / max(1, blocks))))
    cuts = np.frombuffer(sample, dtype=f"S{GRAM}") if sample else np.zeros(0, dtype=f"S{GRAM}")
    shared = spark.sparkContext.broadcast(cuts)

    def ranges(x: Suspects) -> Iterator[tuple[int, np.ndarray]]:
        """The ranges of a block's contexts, each with their numbers in order; heavy ones have none."""
        light = np.flatnonzero(~x.heavy)
        cut = np.searchsorted(shared.value, _strings(x.rows[light, :GRAM]), side="right") if len(light) else light
        for r, own in _grouped(cut * deals + (x.prints[light] % _U(deals)).astype(np.int64)):
            yield r, light[own]

    def runs(left: pa.Table, right: pa.Table) -> pa.Table:
        x = suspects(left, right)
        doc, begin = x.doc[x.first], x.begin[x.first]
        out = {"range": [], "block": [], "run": []}
        for r, part in ranges(x):
            lcp, tails = front_code(x.rows[part])
            out["range"].append(r), out["block"].append(left["block"][0].as_py())
            out["run"].append(_squeeze(lcp, tails, doc[part], begin[part]))
        return pa.table({"range": pa.array(out["range"], pa.int64()), "block": pa.array(out["block"], pa.int64()), "run": pa.array(out["run"], pa.binary())})

    def heavy_strings(left: pa.Table, right: pa.Table) -> pa.Table:
        """The strings of a block's heavy contexts by digest, each with its first occurrence there."""
        x = suspects(left, right)
        heavy = np.flatnonzero(x.heavy)
        starts = list(zip(x.doc[x.first][heavy].tolist(), x.begin[x.first][heavy].tolist(), strict=True))
        least: dict[bytes, tuple[int, int]] = {}
        for _, some, digests in string_digests(x.rows[heavy], length):
            for i, digest in zip(some.tolist(), digests, strict=True):
                least[digest] = min(least.get(digest, starts[i]), starts[i])
        docs, begins = zip(*least.values(), strict=True) if least else ((), ())
        block = np.full(len(least), left["block"][0].as_py(), dtype=np.int64)
        return pa.table({"digest": pa.array(list(least), pa.binary()), "id": pa.array(docs, pa.int64()), "begin": pa.array(begins, pa.int64()), "of": block})

    def combine(table: pa.Table) -> pa.Table:
        """Sort a range's runs into one, find the first of all strings, and answer each block."""
        runs = [_loosen(x) for x in table["run"].to_pylist()]
        rows, lcps, docs, places, member_run, member_class, at = bytearray(), array("q"), array("q"), array("q"), array("q"), array("q"), [0] * len(runs)
        for lcp, i, row in merge_runs([decoded(x[0], x[1], width) for x in runs], width):
            doc, place = int(runs[i][2][at[i]]), int(runs[i][3][at[i]])
            at[i] += 1
            if lcp < width or not lcps:
                rows += row
                lcps.append(lcp), docs.append(doc), places.append(place)
            elif (doc, place) < (docs[-1], places[-1]):
                docs[-1], places[-1] = doc, place
            member_run.append(i), member_class.append(len(lcps) - 1)
        docs, places = np.array(docs, dtype=np.int64), np.array(places, dtype=np.int64)
        matrix = np.frombuffer(rows, dtype=np.uint8).reshape(-1, width)
        later = np.packbits(later_strings(matrix, np.array(lcps), docs, places, length), axis=1)
        members = np.array(member_class)[np.argsort(np.array(member_run), kind="stable")]
        answers, ends = [], np.cumsum([len(x[0]) for x in runs])
        for i, x in enumerate(runs):
            cls = members[ends[i] - len(x[0]) : ends[i]]
            mine = (docs[cls] == x[2]) & (places[cls] == x[3])
            answers.append(_squeeze(np.packbits(mine), later[cls[mine]].ravel()))
        return pa.table({"of": table["block"], "at": pa.array(table["range"].to_numpy() + slices, pa.int64()), "marks": pa.array(answers, type=pa.binary())})

    fields = [T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_text", T.StringType())] * keep_text

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["at"]
        marks = right.filter(pa.compute.and_(pa.compute.greater_equal(at, 0), pa.compute.less(at, slices)))
        firsts = set(right.filter(pa.compute.less(at, 0))["marks"].to_pylist())
        merged = right.filter(pa.compute.greater_equal(at, slices))
        answers = dict(zip(merged["at"].to_pylist(), merged["marks"].to_pylist(), strict=True))
        x = suspects(left, marks)
        ids, offsets, data = x.ids, x.offsets, x.data
        mine, later = x.heavy.copy(), np.zeros((len(x.rows), back + 1), dtype=bool)
        for r, part in ranges(x):
            own, bits = _loosen(answers[r + slices])
            part = part[np.unpackbits(own)[: len(part)].astype(bool)]
            mine[part] = True
            later[part] = np.unpackbits(bits.reshape(len(part), (back + 8) // 8), axis=1)[:, : back + 1]
        heavy = np.flatnonzero(x.heavy)
        starts = [struct.pack(">qq", *pair) for pair in zip(x.doc[x.first][heavy].tolist(), x.begin[x.first][heavy].tolist(), strict=True)]
        for k, some, digests in string_digests(x.rows[heavy], length):
            later[heavy[some], k] = [digest + starts[i] not in firsts for i, digest in zip(some.tolist(), digests, strict=True)]
        change = np.zeros(len(data) + 1, dtype=np.int64)
        if len(x.rows):
            right_, left_ = x.rows[x.number, -2].astype(np.int64) - 1, x.rows[x.number, -1].astype(np.int64) - 1
            # Occurrences that share (id, place) with the first are no later than it.
            top = mine[x.number] & (x.doc == x.doc[x.first][x.number]) & (x.begin == x.begin[x.first][x.number])
            low, high = np.maximum(0, length - right_), left_
            whole = ~top & (low <= high)
            np.add.at(change, x.at[whole] - high[whole], 1)
            np.add.at(change, x.at[whole] - low[whole] + length, -1)
            hit, k = np.nonzero(later[x.number[top]])
            np.add.at(change, x.at[top][hit] - k, 1)
            np.add.at(change, x.at[top][hit] - k + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = {f.name: [] for f in fields}
        for d in range(len(ids)):
            text, cut = data[offsets[d] : offsets[d + 1]], gone[offsets[d] : offsets[d + 1]]
            rest = text[~cut].tobytes()
            out["id"].append(int(ids[d])), out["n_bytes"].append(len(text)), out["n_removed"].append(int(cut.sum()))
            out["n_spans"].append(int((cut[1:] & ~cut[:-1]).sum() + (cut[0] if len(cut) else 0)))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                out["kept_text"].append(rest.decode("utf-8", "ignore"))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({name: pa.array(x, type=kind) for (name, x), kind in zip(out.items(), kinds, strict=False)})

    marks = fingerprints.select("of", "at", "marks")
    sorted_runs = source.groupBy("block").cogroup(marks.groupBy("of")).applyInArrow(giving_back_pair(runs), "range long, block long, run binary")
    back_to = marks.union(sorted_runs.groupBy("range").applyInArrow(giving_back(combine), "of long, at long, marks binary"))
    loaded = fingerprints.where("heavy").select("of").distinct()
    if not loaded.isEmpty():
        held = source.join(loaded, source.block == loaded.of, "left_semi").groupBy("block").cogroup(marks.join(loaded, "of", "left_semi").groupBy("of"))
        strings = settle(held.applyInArrow(giving_back_pair(heavy_strings), "digest binary, id long, begin long, of long"))
        # All columns are keys of the join: a string that every block holds has its first in few of them.
        least = strings.groupBy("digest").agg(F.min(F.struct("id", "begin")).alias("least")).select("digest", "least.*")
        start = [F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("id", "begin")]
        back_to = back_to.union(strings.join(least, ["digest", "id", "begin"]).select("of", F.lit(-1).cast("long").alias("at"), F.concat("digest", *start).alias("marks")))
    out = source.groupBy("block").cogroup(back_to.groupBy("of")).applyInArrow(giving_back_pair(drop), T.StructType(fields))
    return out.withColumn("id", F.nullif("id", F.lit(NO_ID))).withColumnRenamed("id", id_col)


def _splitters(documents: DataFrame, text_col: str, length: int, ranges: int, share: float) -> bytes:
    """GRAM-byte strings that cut the anchors of a share of the documents into so many equal ranges.
    They only balance the ranges: any cuts give the same result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            at = np.concatenate([np.zeros(0, dtype=np.int64), *(at[(h >> _U(8)) % _U(16) == 0] for at, h in _block_anchors(data, offsets, length))])
            rows = data[np.minimum(at[:, None] + np.arange(GRAM), len(data) - 1)] if len(at) else np.zeros((0, GRAM), dtype=np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rows], type=pa.binary())], names=["gram"])

    if ranges < 2:
        return b""
    found = map_batches(documents.select(F.col(text_col).cast("string")).sample(share, seed=1), run, "gram binary")
    numbered = found.orderBy(F.xxhash64("gram")).limit(32 * ranges)
    grams = sorted(bytes(row.gram) for row in numbered.collect())
    return b"".join(grams[i * len(grams) // ranges] for i in range(1, ranges) if grams)
