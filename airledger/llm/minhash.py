"""Near-duplicate documents by b-bit MinHash (operator 5).

Rows: one per document row, with the size of its shingle set, the smallest id of its group and
whether it is that document. Null or word-free texts have an empty set and link with nothing.
Very long texts are read whole.
Rows of one id are one document: they share a group, with all that any of their texts links with,
also where the texts are unlike; n_shingles is that of each row. Rows without an id link with
nothing and name no group: their component_id is null and kept is false. An empty table gives an empty
result. Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, byte_set, chunks, distinct_per_row, int_lists, mix, span_hashes, utf8, word_spans
from .shared import connected_components, giving_back, map_batches, settle

#: Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and return.
WORD = ~byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
_U = np.uint64

#: 32 bands of 4 minima: a pair at similarity 0.8 misses every band with probability 5e-8.
BANDS, ROWS = 32, 4
#: Low bits of each minimum that the packed signature retains.
LOW_BITS = 2
#: Rounds of canopies before what is left of a bucket is compared pair by pair.
CANOPY_ROUNDS = 3
#: Shingles of one side of a block of sets at most, so that blocks of long texts have fewer sets.
BLOCK_SHINGLES = 1 << 19
#: Shingles that a block multiplies at once.
STRIP = 2048
#: Ids up to which texts are picked by a broadcast (8 bytes each), and beyond which by a shuffle.
BROADCAST_IDS = 1_000_000


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of k linear permutations of 32-bit integers."""
    seed = mix(np.arange(1, 2 * k + 1, dtype=_U) * _U(0xA0761D6478BD642F))
    return (seed[:k] >> _U(32)).astype(np.uint32) | np.uint32(1), (seed[k:] >> _U(32)).astype(np.uint32)


def shingle_rows(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word shingles of each row, rows ascending, hashes sorted.

    A row of fewer words than a shingle has one shingle, the whole sequence.
    """
    starts, ends, rows = word_spans(data, offsets, WORD)
    if not len(starts):
        return rows, np.zeros(0, dtype=_U)
    h = span_hashes(LOWER[data], starts, ends)
    n = len(h)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(count, out=first[1:])
    at = np.arange(n) - first[rows]
    take = np.minimum(words, count[rows])  # words in this row's shingles
    full = at + take <= count[rows]
    where = np.flatnonzero(full)
    out = np.zeros(len(where), dtype=_U)
    for k in range(words):
        inside = take[where] > k
        out[inside] = mix(out[inside] * _U(0x9E3779B97F4A7C15) + h[where[inside] + k] + _U(k))
    return distinct_per_row(rows[where], out)


def signatures(documents: DataFrame, id_col: str, text_col: str, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, n_shingles, a 128-bit digest of the set (d0, d1), packed low bits (array of
    longs, one per 64 minima and bit) and one bucket per band. Empty sets have null digests."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = permutations(k)
        band_no = mix(np.arange(bands, dtype=_U) + _U(77))
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                o = offsets[i : j + 1] - offsets[i]
                row, h = shingle_rows(data[offsets[i] : offsets[j]], o, words)
                n = np.bincount(row, minlength=j - i).astype(np.int64)
                some = np.flatnonzero(n)
                edges = np.zeros(len(some), dtype=np.int64)
                np.cumsum(n[some][:-1], out=edges[1:])
                d0, d1 = np.zeros(j - i, dtype=_U), np.zeros(j - i, dtype=_U)
                minima = np.zeros((len(some), k), dtype=np.uint32)
                if len(some):
                    d0[some] = mix(np.add.reduceat(mix(h + _U(1)), edges) + n[some].astype(_U))
                    d1[some] = mix(np.add.reduceat(mix(h ^ _U(0x5851F42D4C957F2D)), edges))
                    low = (h >> _U(32)).astype(np.uint32)
                    for x in range(k):
                        minima[:, x] = np.minimum.reduceat(low * mult[x] + add[x], edges)
                packed = np.zeros((j - i, LOW_BITS * ((k + 63) // 64)), dtype=np.int64)
                for bit in range(LOW_BITS):
                    plane = np.packbits(((minima >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8), axis=1)
                    plane = np.pad(plane, ((0, 0), (0, -plane.shape[1] % 8)))
                    packed[some, bit :: LOW_BITS] = np.ascontiguousarray(plane).view(np.int64)
                bucket = np.zeros((len(some), bands), dtype=_U) + band_no
                for r in range(rows):
                    bucket = mix(bucket * _U(0x2545F4914F6CDD1D) + minima[:, r::rows][:, :bands])
                null = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n),
                        pa.array(d0.view(np.int64), mask=null),
                        pa.array(d1.view(np.int64), mask=null),
                        int_lists(packed.ravel(), np.full(j - i, packed.shape[1])),
                        int_lists(bucket.ravel().view(np.int64), np.where(null, 0, bands)),
                    ],
                    names=["id", "n_shingles", "d0", "d1", "packed", "buckets"],
                )

    return map_batches(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, n_shingles long, d0 long, d1 long, packed array<long>, buckets array<long>")


def shingle_sets(documents: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Per row: id and its full sorted shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                row, h = shingle_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), int_lists(h.view(np.int64), np.bincount(row, minlength=j - i))], names=["id", "shingles"])

    return map_batches(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, shingles array<long>")


def estimated_similarity(left: str, right: str, k: int = BANDS * ROWS) -> F.Column:
    """Collision-corrected similarity of two packed signatures: agreeing minima are counted by bits,
    and the chance that low bits agree by accident is taken off."""
    equal = F.lit(k)
    for word in range((k + 63) // 64):
        differs = None
        for bit in range(LOW_BITS):
            i = word * LOW_BITS + bit
            x = F.get(F.col(left), F.lit(i)).bitwiseXOR(F.get(F.col(right), F.lit(i)))
            differs = x if differs is None else differs.bitwiseOR(x)
        equal = equal - F.bit_count(differs)
    chance = 0.5**LOW_BITS
    return (equal / F.lit(float(k)) - chance) / (1 - chance)


def slack(threshold: float, k: int = BANDS * ROWS, deviations: float = 6.5) -> float:
    """How far below the threshold an estimate may lie and its pair still be confirmed."""
    chance = 0.5**LOW_BITS
    p = chance + (1 - chance) * threshold
    return deviations * (p * (1 - p) / k) ** 0.5 / (1 - chance)


def _linked(table: pa.Table, percent: int) -> pa.Table:
    """Links between the asking sets of a block and its others of another component."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    asks = table["asks"].to_numpy()
    if not asks.any() or asks.all():
        return none
    ids, comp = table["id"].to_numpy(), table["comp"].to_numpy()
    sets = table["shingles"].combine_chunks()
    size = np.asarray(sets.value_lengths())
    flat = sets.flatten().to_numpy()
    row = np.repeat(np.arange(len(ids)), size)
    tokens, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    useful = count > 1  # a shingle of one set is in no intersection
    number = np.cumsum(useful) - 1
    keep = useful[at]
    row, col = row[keep], number[at[keep]]
    place = np.where(asks, np.cumsum(asks) - 1, np.cumsum(~asks) - 1)
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    common = np.zeros((len(x), len(y)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(useful.sum()), STRIP):
        i, j = np.searchsorted(col, [lo, lo + STRIP])
        r, c = row[i:j], col[i:j] - lo
        left, right = np.zeros((len(x), STRIP), dtype=np.float32), np.zeros((len(y), STRIP), dtype=np.float32)
        mine = asks[r]
        left[place[r[mine]], c[mine]] = 1
        right[place[r[~mine]], c[~mine]] = 1
        common += left @ right.T
    union = size[x][:, None] + size[y][None, :] - common
    u, v = np.nonzero((100 * common >= percent * union) & (comp[x][:, None] != comp[y][None, :]))
    a, b = ids[x[u]], ids[y[v]]
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)}) if len(a) else none


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block: int = 1024) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of each row of documents.

    Documents link if 100 * |intersection| >= percent * |union| of their distinct word shingles.
    Equal sets fold into one class first. In a bucket, members are estimated and confirmed against
    its smallest class only, which leads a canopy of all that are near it; by the triangle
    inequality two linked members of a bucket share a canopy. Canopies are only made of buckets
    that the first links left in several components, and those that overlap form a family. The
    members outside a family's largest component are compared with all its members exactly, in a
    grid of blocks of about `block` sets a side, fewer if they are long, and only links come out.
    """
    signed = settle(signatures(documents, id_col, text_col, words))
    some = signed.where("id is not null and d0 is not null")
    classes = some.groupBy("d0", "d1").agg(F.min(F.struct("id", "packed", "buckets", "n_shingles")).alias("first"))
    classes = settle(classes.select("d0", "d1", F.col("first.id").alias("rep"), F.col("first.packed").alias("packed"), F.col("first.buckets").alias("buckets"), F.col("first.n_shingles").alias("n_shingles")))
    members = classes.select(F.col("rep").alias("id"), F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1")
    shared = settle(members.join(shared, "bucket"))
    facts = classes.select(F.col("rep").alias("id"), "packed")
    floor = percent / 100 - slack(percent / 100)

    def likely(pairs: DataFrame, least: float) -> DataFrame:
        p = pairs.join(facts.select(F.col("id").alias("a"), F.col("packed").alias("pa")), "a").join(facts.select(F.col("id").alias("b"), F.col("packed").alias("pb")), "b")
        return p.select("a", "b", estimated_similarity("pa", "pb").alias("estimate")).where(F.col("estimate") >= least).groupBy("a", "b").agg(F.max("estimate").alias("estimate"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """The full set of each id; texts are shuffled only if the ids are too many to broadcast."""
        ids = settle(ids.distinct())
        texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
        return shingle_sets(texts, "id", "text", words)

    def confirmed(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        p = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return p.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()

    stars = settle(likely(shared.where("id <> center").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct(), floor))
    links = settle(confirmed(stars.select("a", "b")))
    groups = settle(connected_components(links))
    placed = shared.where("n > 2").join(groups, "id", "left").select("bucket", "id", "center", F.coalesce("component_id", "id").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    left_over = settle(placed.join(mixed, "bucket", "left_semi").select("bucket", "id", "center"))
    # Canopies: the smallest member of a bucket takes all that may link with any it holds; those
    # that it holds are done with the bucket, the others go on to their own smallest member.
    # After CANOPY_ROUNDS what is left of a bucket is mostly unlike: those meet pair by pair in salted
    # blocks, where only pairs that may link come out.
    canopies = None
    for _ in range(CANOPY_ROUNDS):
        near = left_over.where("id <> center").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct()
        near = settle(likely(near, floor - (1 - percent / 100)))
        canopies = near if canopies is None else canopies.union(near)
        held = near.where(F.col("estimate") >= floor).select(F.col("a").alias("id"), F.col("b").alias("center"))
        out = left_over.where("id <> center").join(held, ["id", "center"], "left_anti").select("bucket", "id")
        again = out.groupBy("bucket").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1")
        left_over = settle(out.join(again, "bucket"))
    tail = left_over.join(facts, "id").withColumn("salts", F.ceil(F.col("n") / block).cast("int"))
    left = tail.select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("a"), F.col("packed").alias("pa"))
    right = tail.select("bucket", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("b"), F.col("packed").alias("pb"))
    tail = left.join(right, ["bucket", "salt"]).where((F.col("a") > F.col("b")) & (estimated_similarity("pa", "pb") >= floor)).select("a", "b").distinct()
    canopies = canopies.select("a", "b").union(tail)
    families = connected_components(canopies).withColumnRenamed("component_id", "family")
    sizes = classes.groupBy(F.col("rep").alias("id")).agg(F.max("n_shingles").alias("n_shingles"))
    held = settle(families.join(groups, "id", "left").join(sizes, "id").select("family", "id", F.coalesce("component_id", "id").alias("comp"), "n_shingles"))
    by_comp = held.groupBy("family", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    mixed = by_comp.groupBy("family").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"), F.count("*").alias("comps"), (F.sum("shingles") / BLOCK_SHINGLES).alias("least")).where("comps > 1")
    mixed = mixed.withColumn("cols", F.ceil(F.greatest(F.col("size") / block, "least")).cast("int")).withColumn("rows", F.ceil(F.greatest((F.col("size") - F.col("most")) / block, "least")).cast("int"))
    open_ = settle(held.drop("n_shingles").join(mixed.select("family", "main", "cols", "rows"), "family"))
    open_ = open_.join(sets_of(open_.select("id")).dropDuplicates(["id", "shingles"]), "id")
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = open_.where("comp <> main").withColumn("x", salt("rows")).select("family", "x", every("cols").alias("y"), F.lit(True).alias("asks"), "id", "comp", "shingles")
    asked = open_.withColumn("y", salt("cols")).select("family", every("rows").alias("x"), "y", F.lit(False).alias("asks"), "id", "comp", "shingles")
    rest = asking.union(asked).groupBy("family", "x", "y").applyInArrow(giving_back(lambda t: _linked(t, percent)), "a long, b long")
    more = settle(rest.distinct())
    # An id may have rows of several classes, which then are one document's.
    digest = F.struct(F.coalesce("d0", F.lit(0)), F.coalesce("d1", F.lit(0)))
    several = settle(signed.where("id is not null").groupBy("id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("id"))
    of = some.select("id", "d0", "d1").join(several, "id", "left_semi").distinct().join(classes.select("d0", "d1", "rep"), ["d0", "d1"])
    same = of.join(of.groupBy("id").agg(F.min("rep").alias("least")), "id").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    final = connected_components(links.union(more).union(same.distinct()))
    placed = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("d0", "d1", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("id", "n_shingles", "d0", "d1").join(placed, ["d0", "d1"], "left")
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    # Rows of such an id that have no words are in its group too.
    least = out.join(several, "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("least"))
    out = out.join(least, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
