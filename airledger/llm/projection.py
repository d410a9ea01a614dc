"""Near-duplicate vectors by sorted projection passes (operator 3).

Rows: one per distinct vec_id, with its number of links, the smallest id of its component and
whether it is that vector. A vector that is null, zero, or holds a null or non-finite component
links with nothing; vectors of different lengths never link. Rows repeating an id count once (the
smallest vector, should they differ); rows without an id have no result. An empty table gives an
empty result; extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, giving_back, map_batches, settle

#: Signs of random projections that are concatenated to a sort key.
KEY_BITS = 62
#: Numbers in a block of vectors at most, so that blocks of long vectors have fewer rows.
BLOCK_NUMBERS = 1 << 20
#: Rows of a block that are multiplied at once, and pairs that are looked at once.
STRIP, AGAIN = 512, 1 << 16
#: A window grows on while at least one of so many pairs at its end is a link not found before.
DENSE = 4096
#: Parts in which a group of equal vectors is joined.
SALTS = 16


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros to one width, and their lengths.

    Rows that are null, zero or hold null or non-finite components get length 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
    out = np.zeros((n, int(lengths.max(initial=1))))
    row = np.repeat(np.arange(n), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = values
    with np.errstate(all="ignore"):
        top = np.abs(out).max(axis=1, keepdims=True)
        scaled = out / top
        scaled /= np.linalg.norm(scaled, axis=1, keepdims=True)
    fine = np.isfinite(top[:, 0]) & (top[:, 0] > 0) & np.isfinite(scaled).all(axis=1)
    scaled[~fine] = 0
    return scaled, np.where(fine, lengths, 0)


def passes_for(rows: int, block: int, cosine: float, miss: float) -> int:
    """Passes after which a pair at the threshold itself, among vectors spread evenly, has met in no
    window with probability `miss`: in a pass it meets when the signs agree that tell blocks apart."""
    meets = (1 - acos(cosine) / pi) ** max(0.0, log2(max(rows, 1) / block))
    return 1 if meets >= 1 else max(1, ceil(log(miss) / log(1 - meets)))


def mean_directions(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the unit vectors of each length: what vectors of one model have in common tells none
    of them apart. One vector per length reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                u, dims = unit_rows(batch.column(0).slice(at, STRIP))
                for d in np.unique(dims):
                    some = dims == d
                    sums[int(d)] = sums.get(int(d), 0) + np.append(u[some, :d].sum(axis=0), some.sum())
        for d, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), d, dtype=np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["dims", "place", "total"])

    found: dict[int, list[float]] = {}
    for r in map_batches(rows.select("vec"), run, "dims int, place int, total double").groupBy("dims", "place").agg(F.sum("total").alias("total")).orderBy("dims", "place").collect():
        found.setdefault(r.dims, []).append(r.total)
    return {d: np.array(x[:-1]) / x[-1] for d, x in found.items()}


def sort_keys(rows: DataFrame, passes: int) -> DataFrame:
    """(pass, dims, key, id): per pass, the concatenated signs of random projections of (id, vec), by
    what sets the vectors off from their mean."""
    means = mean_directions(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                part = batch.slice(at, STRIP)
                ids = np.asarray(part.column(0))
                u, dims = unit_rows(part.column(1))
                for d in np.unique(dims):
                    some = dims == d
                    for p in range(passes):
                        if (p, d) not in planes:
                            planes[p, d] = np.random.default_rng([p, int(d)]).standard_normal((d, KEY_BITS), dtype=np.float32)
                        key = (((u[some, :d] - means[int(d)]) @ planes[p, d]) > 0) @ weights
                        n = len(key)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, dtype=np.int32)), pa.array(np.full(n, d, dtype=np.int32)), pa.array(key), pa.array(ids[some])], names=["pass", "dims", "key", "id"])

    return map_batches(rows.select("id", "vec"), run, "pass int, dims int, key long, id long")


def sorted_blocks(keyed: DataFrame, block: int) -> DataFrame:
    """(id, blocks): for each pass the number of the vector's block of `block` rows in sorted order."""
    order = ["pass", "dims", "key", "id"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", "id", F.monotonically_increasing_id().alias("at"))
    placed = settle(placed.withColumn("part", F.shiftright("at", 33)))
    # One row per pass and partition: not more than partitions and passes together.
    parts = placed.groupBy("pass", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("pass", "part", (before - F.col("first")).alias("shift"))
    ranked = placed.join(F.broadcast(parts), ["pass", "part"]).select("id", "pass", F.floor((F.col("at") + F.col("shift")) / block).cast("int").alias("block"))
    return ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pass", "block"))).alias("b")).select("id", F.col("b.block").alias("blocks"))


CELL = "id long, first long, n long, x int, y int, pairs long"


def _cell_links(table: pa.Table, cosine: float, at: int) -> pa.Table:
    """Compares two blocks x and y of pass `at` (or x with itself, together with y = x + 1).

    Rows with id: a vector, the smallest id that it reaches by links of this cell, and how many it
    has that no earlier pass compared, each weighted by its number of equal vectors. Rows without:
    how many new links there were between x and y, and pairs. Products in single precision decide
    those beyond their rounding error, double precision the others."""
    ids, side, size = table["id"].to_numpy(), table["side"].to_numpy(), table["size"].to_numpy()
    x, y = table["x"][0].as_py(), table["y"][0].as_py()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    u, dims = unit_rows(table["vec"])
    wide = lambda name: np.asarray(table[name].combine_chunks().flatten()).reshape(len(ids), -1)
    blocks, reach = wide("blocks"), wide("reach")
    single = u.astype(np.float32)
    margin = (u.shape[1] + 8) * 2.0**-23
    links, comp, between = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), 0
    for own, others in ((True, left), (False, right)) if y == x + 1 else ((False, right),):
        across = np.ascontiguousarray(single[others].T)
        for k in range(0, len(left) if len(others) else 0, STRIP):
            rows = left[k : k + STRIP]
            cos = single[rows] @ across
            near = (cos >= cosine - margin) & (dims[rows][:, None] == dims[others][None, :])
            if own:
                near &= np.arange(k, k + len(rows))[:, None] < np.arange(len(others))[None, :]
            r, c = np.nonzero(near & (cos <= cosine + margin))
            for m in range(0, len(r), AGAIN):
                i, j = r[m : m + AGAIN], c[m : m + AGAIN]
                near[i, j] = np.einsum("ij,ij->i", u[rows[i]], u[others[j]]) >= cosine
            r, c = np.nonzero(near)
            for m in range(0, len(r), AGAIN):
                i, j = rows[r[m : m + AGAIN]], others[c[m : m + AGAIN]]
                new = np.ones(len(i), dtype=bool)
                for q in range(at):
                    bi, bj = blocks[i, q], blocks[j, q]
                    new &= np.abs(bi - bj) > np.where(bi <= bj, reach[i, q], reach[j, q])
                i, j = i[new], j[new]
                links += np.bincount(i, weights=size[j], minlength=len(ids)).astype(np.int64) + np.bincount(j, weights=size[i], minlength=len(ids)).astype(np.int64)
                between += 0 if own else len(i)
            for m in np.flatnonzero(near.any(axis=1)):
                parts = comp[others[near[m]]]
                if (parts != comp[rows[m]]).any():
                    parts = np.unique(np.append(parts, comp[rows[m]]))
                    comp[np.isin(comp, parts)] = parts[0]
    first = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(first, comp, ids)
    some = np.flatnonzero((links > 0) | (first[comp] < ids))
    n = len(some) + 1
    tail = lambda v, kind: pa.array([None] * (n - 1) + [v], type=kind)
    head = lambda v: pa.array([*v.tolist(), None], type=pa.int64())
    return pa.table({"id": head(ids[some]), "first": head(first[comp[some]]), "n": pa.array([*links[some].tolist(), between], type=pa.int64()), "x": tail(x, pa.int32()), "y": tail(y, pa.int32()), "pairs": tail(len(left) * len(right), pa.int64())})


def _compare(cells: DataFrame, cosine: float, at: int) -> DataFrame:
    cells = cells.select("x", "y", "side", "id", "vec", "size", "blocks", "reach")
    return settle(cells.groupBy("x", "y").applyInArrow(giving_back(lambda t: _cell_links(t, cosine, at)), CELL))


def window_pass(rows: DataFrame, at: int, cosine: float) -> tuple[DataFrame, DataFrame | None]:
    """(links, grown): (id, first, n) of what pass `at` finds anew, and (block, far) of the blocks
    whose windows reached further than the next block, None if there are none.

    Every block is compared with itself and the next one. Where links not found before are
    more than one in DENSE pairs at the end of a window, the window doubles, until they are not: work
    beyond the first windows is thus bounded by the links that it finds, and no group is too large
    for a window.
    """
    own = F.element_at("blocks", at + 1)
    placed = rows.withColumn("block", own)
    cells = placed.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("x", F.col("block") - F.col("side")).withColumn("y", F.col("x") + 1)
    found = _compare(cells, cosine, at)
    links, grown, far = found.where("id is not null"), None, 1
    while True:
        ends = found.where(f"id is null and y - x = {far} and n > 0 and n * {DENSE} >= pairs").select(F.col("x").alias("block"))
        if ends.isEmpty():
            break
        more = ends.select(F.col("block").alias("x"), F.explode(F.expr(f"sequence(block + {far + 1}, block + {2 * far})")).alias("y"))
        both = more.select("x", "y", F.lit(0).alias("side"), F.col("x").alias("block")).union(more.select("x", "y", F.lit(1).alias("side"), F.col("y").alias("block")))
        found = _compare(placed.join(both, "block"), cosine, at)
        far *= 2
        ends = ends.withColumn("far", F.lit(far))
        links, grown = links.union(found.where("id is not null")), ends if grown is None else grown.union(ends)
    return links.select("id", "first", "n"), None if grown is None else settle(grown.groupBy("block").agg(F.max("far").alias("far")))


def near_duplicate_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, block: int = 1024, miss: float = 1e-3) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each vector.

    Equal vectors stand for one another (told by 128 bits of hashes). The others are sorted once per
    pass by concatenated signs of random projections; in each order a vector is compared with all of
    its block of `block` rows and its neighbours' blocks, and further where links are dense (see
    window_pass). Links are verified by the cosine in double precision. A pair counts in the first
    pass that compares it, which each vector's block numbers of earlier passes tell, so that links of
    all passes are united without a row per pair. No pair below the threshold links; a pair at the
    threshold itself is missed with a probability of about `miss` among vectors spread evenly, closer
    pairs far less; the number of passes follows from the number of rows (passes_for).
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null")
    if not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    number = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = rows.where(F.coalesce(number, F.lit(False)))
    hashed = usable.select("id", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), F.reverse("vec")).alias("g"))
    groups = settle(hashed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1"))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = settle(hashed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["h", "g", "salt"]).select("id", "rep"))
    firsts = usable.join(copies.where("id <> rep").select("id"), "id", "left_anti")
    n, width = firsts.agg(F.count("*"), F.max(F.size("vec"))).first()
    block = max(1, min(block, BLOCK_NUMBERS // (width or 1)))
    placed = sorted_blocks(sort_keys(firsts, passes_for(n, block, cosine, miss)), block)
    sizes = groups.select(F.col("rep").alias("id"), "size")
    table = settle(firsts.join(placed, "id").join(sizes, "id", "left").select("id", "vec", F.coalesce("size", F.lit(1)).cast("long").alias("size"), "blocks", F.array_repeat(F.lit(1), F.size("blocks")).alias("reach")))
    links = None
    for at in range(passes_for(n, block, cosine, miss)):
        found, grown = window_pass(table, at, cosine)
        links = found if links is None else links.union(found)
        if grown is not None:
            set_far = F.concat(F.slice("reach", 1, at), F.array(F.coalesce("far", F.lit(1))), F.expr(f"slice(reach, {at + 2}, size(reach))"))
            table = table.withColumn("block", F.element_at("blocks", at + 1)).join(grown, "block", "left").withColumn("reach", set_far).select("id", "vec", "size", "blocks", "reach")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(links.select(F.col("id").alias("a"), F.col("first").alias("b")).where("a <> b").distinct())
    heads = rows.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    facts = counts.join(parts, "id", "full").join(sizes, "id", "full").select(F.col("id").alias("rep"), (F.coalesce("n", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("n_links"), "component_id")
    # A group of equal vectors may be large, so its facts are joined in parts as well.
    facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = heads.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(facts, ["rep", "salt"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
