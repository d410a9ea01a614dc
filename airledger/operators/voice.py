"""Voice profiles: building, identifying, and how well voices separate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..plans.folders import written
from .blocks import met, packed

#: Profiles that are broadcast at most: a few MB of centroids.
BROADCAST_PROFILES = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, not at each of its places (and for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unit(v: Column) -> Column:
    norm = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x))
    return _let(v, lambda u: _let(norm(u), lambda k: F.when(k > 0, F.transform(u, lambda x: x / k)).otherwise(u)))


def build_profiles(embeddings: DataFrame, order_col: str = "ordinal", max_samples: int = 12) -> DataFrame:
    """(callsign, centroid, n, samples, through): an ordered fold, as the centroid is made a unit vector
    after every sample; through is the order of the last one. embeddings: callsign, order_col, vector.
    One station's samples are one group: a few dozen vectors in a radio log."""
    rows = _in_order(embeddings, order_col)
    return _folded(rows.withColumn("start", F.struct(F.array().cast("array<double>").alias("c"), F.lit(0).cast("long").alias("n"))).withColumn("had", F.array().cast("array<array<double>>")), max_samples)


def extend_profiles(stored: DataFrame, embeddings: DataFrame, order_col: str = "ordinal", max_samples: int = 12) -> tuple[DataFrame, DataFrame]:
    """(profiles, refused): stored profiles that go on with later samples, and stations that are new.

    The fold takes up a station's centroid and number, so the earlier samples are not read again. A
    sample that is not later than all its station has is refused, as its place in the order is past:
    build the profiles of the refused callsigns anew from all their samples. Stored profiles without
    through (of an older file) take any sample.
    """
    had = stored if "through" in stored.columns else stored.withColumn("through", F.lit(None).cast(embeddings.schema[order_col].dataType))
    known_ = had.select("callsign", F.struct(F.col("centroid").alias("c"), F.col("n").cast("long").alias("n")).alias("start"), F.col("samples").alias("had"), F.col("through").alias("before"))
    met = embeddings.join(known_.select("callsign", "before"), "callsign", "left")
    late = F.coalesce(F.col(order_col) <= F.col("before"), F.lit(False))
    new = _in_order(met.where(~late), order_col)
    rows = known_.join(new, "callsign", "full")
    start = F.coalesce("start", F.struct(F.array().cast("array<double>").alias("c"), F.lit(0).cast("long").alias("n")))
    out = _folded(rows.withColumn("start", start).withColumn("had", F.coalesce("had", F.array().cast("array<array<double>>"))).withColumn("s", F.coalesce("s", F.expr("filter(s, x -> false)"), F.array().cast(new.schema["s"].dataType))), max_samples)
    return out.join(known_.select("callsign", "before"), "callsign", "left").withColumn("through", F.coalesce("through", "before")).drop("before"), met.where(late).select(embeddings.columns)


def _in_order(embeddings: DataFrame, order_col: str) -> DataFrame:
    return embeddings.groupBy("callsign").agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.transform("vector", lambda x: x.cast("double")).alias("v")))).alias("s"))


def _folded(rows: DataFrame, max_samples: int) -> DataFrame:
    """Profiles of (callsign, start: centroid and number before, had: samples before, s: new samples)."""

    def step(acc: Column, x: Column) -> Column:
        v = _unit(x.v)
        moved = F.when(acc.n == 0, v).otherwise(_unit(F.zip_with(acc.c, v, lambda a, b: (a * acc.n + b) / (acc.n + 1))))
        return F.struct(moved.alias("c"), (acc.n + 1).alias("n"))

    every = F.concat("had", F.transform("s", lambda x: _unit(x.v)))
    last = F.slice(every, F.greatest(F.size(every) - max_samples, F.lit(0)) + 1, max_samples)
    folded = rows.withColumn("f", F.aggregate("s", F.col("start"), step))
    return folded.select("callsign", F.col("f.c").alias("centroid"), F.col("f.n").alias("n"), last.alias("samples"), F.array_max(F.transform("s", lambda x: x.o)).alias("through"))


def known(profiles: DataFrame, min_enrolments: int = 2) -> DataFrame:
    return profiles.where(F.col("n") >= min_enrolments).orderBy("callsign")


def forget(profiles: DataFrame, callsigns: list[str]) -> DataFrame:
    return profiles.where(~F.col("callsign").isin(*callsigns))


def identify(clips: DataFrame, profiles: DataFrame, min_similarity: float = 0.82, margin: float = 0.06, min_enrolments: int = 2, block: int = BROADCAST_PROFILES) -> DataFrame:
    """(clip, callsign, score, runner_up, runner_up_score, reason): the nearest voice, unless it is far
    or another comes close. Profiles are one row per station; up to `block` of them are broadcast, of
    more each clip meets the blocks one by one. The rows are the same."""
    usable = profiles.where(F.col("n") >= min_enrolments).select("callsign", "centroid")
    blocks = -(-usable.count() // block)
    if blocks <= 1:
        met = clips.select("clip", "vector").crossJoin(F.broadcast(usable))
    else:
        dealt = usable.withColumn("block", F.pmod(F.xxhash64("callsign"), F.lit(blocks)).cast("int"))
        met = clips.select("clip", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(dealt, "block")
    pairs = met.select("clip", "callsign", cosine(F.col("vector"), F.col("centroid")).alias("score"))
    # Kept to two rows per clip before the shuffle already.
    top = pairs.withColumn("place", F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("score"), F.desc("callsign")))).where("place <= 2")
    of = lambda place, col: F.max(F.when(F.col("place") == place, F.col(col)))
    best = top.groupBy("clip").agg(of(1, "callsign").alias("callsign"), of(1, "score").alias("score"), of(2, "callsign").alias("runner_up"), of(2, "score").alias("runner_up_score"))
    rows = clips.select("clip").join(best, "clip", "left")
    reason = F.when(F.col("callsign").isNull(), "no profiles").when(F.col("score") < min_similarity, "too far").when(F.col("score") - F.col("runner_up_score") < margin, "too close")
    return rows.withColumn("reason", reason).select("clip", F.when(F.col("reason").isNull(), F.col("callsign")).alias("callsign"), "score", "runner_up", "runner_up_score", "reason")


#: Vectors of a block; a task multiplies two blocks, a tile of STRIP rows and TILE columns at a time.
PAIR_BLOCK, STRIP, TILE = 8192, 256, 2048
#: Rows of an Arrow batch that a task sends.
ROWS = 1 << 18


def voice_blocks(samples: DataFrame, block: int | None = None) -> DataFrame:
    """Samples (callsign, vector) packed into blocks, for several of the functions below; null vectors
    are left out. Blocks are returned as they are."""
    if "rows" in samples.columns:
        return samples
    rows = samples.where("vector is not null").select("callsign", "vector", *(["ordinal"] if "ordinal" in samples.columns else []))
    return packed(rows, block or PAIR_BLOCK)


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, pa.Array]:
    """The vectors of a block as a matrix of doubles, and their stations."""
    lists = rows.field("vector")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1), pc.fill_null(rows.field("callsign"), "")


def _clipped(products: np.ndarray) -> np.ndarray:
    """Similarities between 0 and 1, in place; what is no number counts as 1, as in SQL."""
    return np.fmax(np.fmin(products, 1.0, out=products), 0.0, out=products)


def _places(found: np.ndarray) -> np.ndarray:
    """np.flatnonzero, looking at eight places at once, as few are found."""
    if len(found) % 8:
        return np.flatnonzero(found)
    words = np.flatnonzero(found.view(np.uint64))
    at = np.flatnonzero(found.reshape(-1, 8)[words])
    return words[at // 8] * 8 + at % 8


class Sides:
    """Two blocks that meet, or one that meets itself (`once`: each pair once), in the order of their
    stations, so that pairs of one station are rectangles."""

    def __init__(self, a: pa.StructArray, b: pa.StructArray, once: bool, strip: int, tile: int) -> None:
        (x, left), (y, right) = _matrix(a), _matrix(b)
        code = pa.concat_arrays([left, right]).dictionary_encode().indices.to_numpy()
        left, right = code[: len(x)], code[len(x) :]
        rows, columns = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        self.x, self.left, self.y, self.right = x[rows], left[rows], y[columns], right[columns]
        self.once, self.strip, self.tile = once, strip, tile
        self.finite = bool(np.isfinite(x).all() and np.isfinite(y).all())
        many, mine, theirs = code.max(initial=0) + 1, *(np.bincount(side, minlength=code.max(initial=0) + 1) for side in (left, right))
        self.shared = [c for c in range(many) if mine[c] and theirs[c]]
        each = mine * (mine - 1) // 2 if once else mine * theirs
        pairs = len(x) * (len(x) - 1) // 2 if once else len(x) * len(y)
        self.n = {True: int(each.sum()), False: pairs - int(each.sum())}

    def same(self) -> Iterator[np.ndarray]:
        """Similarities of pairs of the same station."""
        for code in self.shared:
            (a, b), (c, d) = (np.searchsorted(side, (code, code + 1)) for side in (self.left, self.right))
            for k in range(a, b, self.strip):
                low = k if self.once else c
                s = self.x[k : min(k + self.strip, b)] @ self.y[low:d].T
                yield _clipped(s[np.arange(len(s))[:, None] < np.arange(d - low)] if self.once else s.ravel())

    def different(self, kind: type = np.float64, tile: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, products) of tiles, as they are; -inf where there is no pair of
        different stations."""
        x, y, tile = self.x.astype(kind), self.y.astype(kind), tile or self.tile
        for k in range(0, len(x), self.strip):
            mine = self.left[k : k + self.strip]
            for low in range(k if self.once else 0, len(y), tile):
                theirs = self.right[low : low + tile]
                s = x[k : k + self.strip] @ y[low : low + tile].T
                if not self.finite:
                    np.nan_to_num(s, copy=False, nan=2.0, posinf=2.0, neginf=-1.0)
                if self.once and low < k + len(s):
                    s[np.arange(k, k + len(s))[:, None] >= np.arange(low, low + s.shape[1])] = -np.inf
                if mine[0] <= theirs[-1] and theirs[0] <= mine[-1]:
                    both = np.intersect1d(mine, theirs)
                    ends = [np.searchsorted(side, both, where) for side in (mine, theirs) for where in ("left", "right")]
                    for a, b, c, d in zip(*ends, strict=True):
                        s[a:b, c:d] = -np.inf
                yield k, low, s

    def coarse(self) -> tuple[type, float]:
        """The kind of float in which products may be taken to tell which are to be taken exactly, and
        how far such a product may be off: none if it is double."""
        if self.finite and len(self.x) and len(self.y):
            norms = [np.sqrt((side * side).sum(1).max()) for side in (self.x, self.y)]
            off = 1.1 * (self.x.shape[1] + 3) * 2.0**-24 * norms[0] * norms[1] + 2e-7
            if off <= 1e-4:
                return np.float32, float(off)
        return np.float64, 0.0

    def products(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Similarities of some pairs, each added up in order."""
        at = range(0, len(rows), 1 << 14)
        return _clipped(np.concatenate([np.add.accumulate(self.x[rows[k : k + (1 << 14)]] * self.y[columns[k : k + (1 << 14)]], axis=1)[:, -1] for k in at]))

    def some(self, kind: type) -> np.ndarray:
        """Products of pairs of different stations among evenly spaced samples, to see how they lie."""
        rows, columns = (np.unique(np.linspace(0, len(side) - 1, most).astype(int)) for side, most in ((self.x, 512), (self.y, 1024)))
        s = self.x[rows].astype(kind) @ self.y[columns].astype(kind).T
        return s[self.left[rows][:, None] != self.right[columns]]


def block_pairs(samples: DataFrame, told: Callable[[Sides], Iterator[pa.Table]], schema: str, block: int | None = None) -> DataFrame:
    """told(two blocks) of all pairs of blocks, of which each pair of samples is in one. samples:
    callsign, vector, or their blocks. Every two blocks meet in a task; what leaves it is what `told`
    makes of their pairs."""
    blocks, strip, tile, most = voice_blocks(samples, block), STRIP, TILE, ROWS

    def run(i: int, a: pa.StructArray, j: int, b: pa.StructArray) -> Iterator[pa.RecordBatch]:
        for table in told(Sides(a, b, i == j, strip, tile)):
            yield from table.to_batches(max_chunksize=most)

    return met(blocks, blocks, run, schema, once=True)


def voice_pairs(samples: DataFrame, digits: int | None = None) -> DataFrame:
    """(same, similarity) of each unordered pair of samples, once. samples: callsign, ordinal, vector.
    With `digits` (6 at most) similarities are rounded, and a task counts its pairs by similarity and
    returns them in that order: what is written of them is short where similarities repeat.

    This is quadratic in the samples by its meaning; calibration and separation read the pairs where
    they are made and write none.
    """
    if digits is not None and not 0 <= digits <= 6:
        raise ValueError("digits must be from 0 to 6")
    most = ROWS

    def each(sides: Sides) -> Iterator[pa.Table]:
        for s in sides.same():
            yield pa.table({"same": np.full(len(s), True), "similarity": s})
        for _, _, s in sides.different(tile=len(sides.y)):
            s = _clipped(s[s > -np.inf])
            yield pa.table({"same": np.full(len(s), False), "similarity": s})

    def counted(sides: Sides) -> Iterator[pa.Table]:
        for same in (False, True):
            n, taken = np.zeros(10**digits + 1, np.int64), 0
            for s in sides.same() if same else (_clipped(s).ravel() for _, _, s in sides.different(tile=len(sides.y))):
                s *= 10.0**digits
                whole = s.astype(np.int32)
                whole += s - whole >= 0.5
                n += np.bincount(whole, minlength=len(n))
                taken += len(s)
            n[0] -= taken - sides.n[same]  # places of tiles that are no pairs were taken as 0
            values = np.flatnonzero(n)
            ends = np.cumsum(n[values])
            for start in range(0, sides.n[same], most):
                end = min(start + most, sides.n[same])
                part = slice(np.searchsorted(ends, start, "right"), np.searchsorted(ends, end) + 1)
                times = np.minimum(ends[part], end) - np.maximum(ends[part] - n[values[part]], start)
                yield pa.table({"same": np.full(end - start, same), "similarity": np.repeat(values[part] / 10.0**digits, times)})

    return block_pairs(samples, each if digits is None else counted, "same boolean, similarity double")


def _sums(pieces: Iterator[np.ndarray], n: int) -> tuple[int, float, float]:
    """n, and sums of similarities less a half and of their squares, which lose no digits of similarities.
    Places that are no pairs are 0."""
    first = second = 0.0
    for s in pieces:
        first, second = first + float(s.sum()), second + float(np.vdot(s, s))
    return n, first - 0.5 * n, second - first + 0.25 * n


def _moments(parts: DataFrame) -> DataFrame:
    """(same, n, mean_similarity, spread) of rows (same, n, first, second) of sums."""
    total = parts.groupBy("same").agg(F.sum("n").alias("n"), F.sum("first").alias("s"), F.sum("second").alias("q")).where("n > 0")
    mean = F.col("s") / F.col("n")
    return total.select("same", "n", (mean + 0.5).alias("mean_similarity"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("spread"))


def pair_moments(samples: DataFrame) -> DataFrame:
    """(same, n, mean_similarity, spread): number, mean and population deviation of pairs of the same and
    of different stations, put together from sums of each two blocks."""

    def told(sides: Sides) -> Iterator[pa.Table]:
        sums = [_sums(sides.same(), sides.n[True]), _sums((_clipped(s) for _, _, s in sides.different()), sides.n[False])]
        n, first, second = zip(*sums, strict=True)
        yield pa.table({"same": [True, False], "n": n, "first": first, "second": second})

    return _moments(block_pairs(samples, told, "same boolean, n long, first double, second double"))


def separation(samples: DataFrame) -> DataFrame:
    """(same, n, mean_similarity) of the pairs of samples."""
    return pair_moments(samples).select("same", "n", "mean_similarity")


def pair_numbers(samples: DataFrame) -> dict[bool, int]:
    """How many pairs of samples are of the same (True) and of different stations."""
    per = samples.where("vector is not null").groupBy(F.coalesce("callsign", F.lit("")).alias("callsign")).count()
    row = per.agg(F.sum("count").alias("all"), F.sum(F.expr("count * (count - 1) div 2")).alias("same")).first()
    all_, same = row["all"] or 0, row["same"] or 0
    return {True: same, False: all_ * (all_ - 1) // 2 - same}


#: Bins that an interval of similarities is cut into by a task, and by a look for a rank in what was
#: told; pairs of different stations near a rank that are few enough to be told exactly.
TAIL_BINS, RANK_BINS, FEW_PAIRS = 1 << 14, 4096, 10_000_000


def _ranked(told: DataFrame, rank: int) -> float | None:
    """The value of (value, n) rows that `rank` (from 0) others exceed: the bin that holds it is cut into
    bins again until it is one value. None if there are not so many."""
    low, high = told.agg(F.min("value"), F.max("value")).first()
    while low is not None and low < high:
        at = F.least(F.floor((F.col("value") - low) / (high - low) * RANK_BINS), F.lit(RANK_BINS - 1))
        bins = told.where(F.col("value").between(low, high)).groupBy(at.alias("bin")).agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
        for b in sorted(bins, reverse=True):  # at most RANK_BINS
            if rank < b.n:
                break
            rank -= b.n
        else:
            return None
        low, high, told = b.low, b.high, told.where(F.col("value").between(b.low, b.high))
    return low if low is not None and rank < told.agg(F.sum("n")).first()[0] else None


def _interval(samples: DataFrame, rank: int, different: int, few: int) -> tuple[float, float]:
    """An interval that holds the similarity of the pair of different stations of that rank, and few
    others. Products are taken in single precision at first, and as far as they may be off it is wider."""
    low, high, coarse, tail = 0.0, 1.0, True, 3 * (rank + 1) / different
    while True:
        bins = TAIL_BINS

        def told(sides: Sides, low: float = low, high: float = high, coarse: bool = coarse, tail: float = tail) -> Iterator[pa.Table]:
            kind, off = sides.coarse() if coarse else (np.float64, 0.0)
            least, floor, above, n, kept, size = np.finfo(kind).min if low <= 0 else low, low, 0, np.zeros(bins, np.int64), [], 0
            if tail < 0.25 and sides.finite:  # what is far below the rank is not binned
                some = sides.some(kind)
                if len(some) * tail > 1000:
                    edge = float(np.partition(some, int(len(some) * (1 - tail)))[int(len(some) * (1 - tail))])
                    if edge > low:
                        least = floor = edge

            def add() -> None:
                nonlocal kept, size
                if kept:
                    n[:] += np.bincount(np.concatenate(kept), minlength=bins)
                kept, size = [], 0

            for _, _, s in sides.different(kind):
                s = s.ravel()
                x = _clipped(s[_places(s >= least)].astype(np.float64))
                above += int(np.count_nonzero(x > high))
                x = x[x <= high]
                kept.append(np.clip((x - low) / (high - low) * bins, 0, bins - 1).astype(np.int64))
                size += len(x)
                if size > 1 << 20:
                    add()
            add()
            found = np.flatnonzero(n)
            yield pa.table({"what": pa.repeat("bin", len(found)), "value": found.astype(np.float64), "n": n[found]})
            yield pa.table({"what": ["floor", "off", "above"], "value": [floor, off, None], "n": pa.array([None, None, above], pa.int64())})

        rows = written(block_pairs(samples, told, "what string, value double, n long").groupBy("what", "value").agg(F.sum("n").alias("n")))
        marks = {r.what: r for r in rows.where("what <> 'bin'").groupBy("what").agg(F.max("value").alias("value"), F.sum("n").alias("n")).collect()}
        floor, off, width = marks["floor"].value, marks["off"].value, (high - low) / bins
        known = rows.where("what = 'bin'").select("value", "n")
        at = _ranked(known.where(F.col("value") > (floor - low) / width) if floor > low else known, rank - marks["above"].n)
        if at is None:
            if floor <= low:
                raise ValueError(f"there is no pair of rank {rank}")
            tail = 1.0
            continue
        around = off + 1e-12
        near = known.where(F.col("value").between(at - 1 - around / width, at + 1 + around / width)).agg(F.sum("n")).first()[0]
        low, high, coarse, tail = max(0.0, low + at * width - around), min(1.0, low + (at + 1) * width + around), False, 1.0
        if near <= few or high - low < 1e-11:
            return low, high


def _near(sides: Sides, rows: np.ndarray, columns: np.ndarray, s: np.ndarray, off: float, low: float, high: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Of products of some pairs: how many similarities are above high, and those from low to high, each
    with its number."""
    values, times = [], []

    def add(value: np.ndarray | float, n: np.ndarray | int) -> None:
        if np.size(n) and np.any(n):
            values.append(np.atleast_1d(value))
            times.append(np.atleast_1d(n))

    top, bottom = (1.0 if high >= 1 else high) + off, (0.0 if low <= 0 else low) - off
    above = int(np.count_nonzero(s > top))
    if high >= 1:
        add(1.0, above)
        above = 0
    if low <= 0:
        add(0.0, int(np.count_nonzero(s < bottom)))
    open_ = np.flatnonzero((s >= bottom) & (s <= top))
    if len(open_):
        exact = _clipped(s[open_]) if s.dtype == np.float64 else sides.products(rows[open_], columns[open_])
        above += int(np.count_nonzero(exact > high))
        add(*np.unique(exact[(exact >= low) & (exact <= high)], return_counts=True))
    if not values:
        return above, np.zeros(0), np.zeros(0, np.int64)
    return above, np.concatenate(values), np.concatenate(times)


def rank_and_reach(samples: DataFrame, rank: int, step: float = 0.0, few: int | None = None) -> tuple[float, dict[bool, tuple[int, int]], DataFrame]:
    """(similarity of the pair of different stations that `rank` (from 0) others exceed; of pairs of the
    same (True) and of different stations, how many there are and how many are as similar as that and
    `step` more; moments of pairs of the same station).

    All pairs are read twice: once in single precision, for an interval that holds the rank, and once for
    what is above it and, exactly, for what is in it.
    """
    numbers, samples = pair_numbers(samples), voice_blocks(samples)
    low, high = _interval(samples, rank, numbers[False], FEW_PAIRS if few is None else few)
    wider = 0.0
    while True:
        low, high = max(0.0, low - wider), min(1.0, high + wider)

        def told(sides: Sides, low: float = low, high: float = high) -> Iterator[pa.Table]:
            kind, off = sides.coarse()
            edges = {"rank": (low, high), "reach": (low + step - 1e-12, high + step + 1e-12)}
            over, kept = {"rank": 0, "reach": 0, "same": 0}, {"rank": [], "reach": [], "same": []}

            def rows(most: int) -> Iterator[pa.Table]:
                """What was kept, when it is more than `most`."""
                for what, parts in kept.items():
                    if sum(len(n) for _, n in parts) > most:
                        value, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                        none = pa.nulls(len(n), pa.float64())
                        yield pa.table({"what": pa.repeat(what, len(n)), "value": value, "n": n, "first": none, "second": none})
                        kept[what] = []

            for k, at, s in sides.different(kind):
                width, s = s.shape[1], s.ravel()
                places = _places(s >= (np.finfo(kind).min if low <= 0 else low - off))
                row, column, s = places // width + k, places % width + at, s[places]
                for what in edges:
                    above, value, n = _near(sides, row, column, s, off, *edges[what])
                    over[what] += above
                    kept[what].append((value, n))
                yield from rows(ROWS)
            first = second = 0.0
            for s in sides.same():
                first, second = first + float(s.sum()), second + float(np.vdot(s, s))
                over["same"] += int(np.count_nonzero(s > edges["reach"][1]))
                kept["same"].append(np.unique(s[(s >= edges["reach"][0]) & (s <= edges["reach"][1])], return_counts=True))
                yield from rows(ROWS)
            yield from rows(0)
            size = sides.n[True]
            none = [None] * len(over)
            yield pa.table({"what": [*(f"over {what}" for what in over), "sums"], "value": pa.nulls(len(over) + 1, pa.float64()), "n": [*over.values(), size], "first": [*none, first - 0.5 * size], "second": [*none, second - first + 0.25 * size]})

        parts = block_pairs(samples, told, "what string, value double, n long, first double, second double")
        found = written(parts.groupBy("what", "value").agg(*(F.sum(c).alias(c) for c in ("n", "first", "second"))))
        over = {r.what: r.n for r in found.where("what like 'over %'").groupBy("what").agg(F.sum("n").alias("n")).collect()}
        value = _ranked(found.where("what = 'rank'").select("value", "n"), rank - over["over rank"]) if over["over rank"] <= rank else None
        if value is not None:
            break
        if (low, high) == (0.0, 1.0):
            raise ValueError(f"there is no pair of rank {rank}")
        wider = max(1e-9, 1000 * wider)  # another machine's products may differ in their last digits
    more = {r.what: r.n for r in found.where(F.col("what").isin("reach", "same") & (F.col("value") >= value + step)).groupBy("what").agg(F.sum("n").alias("n")).collect()}
    reach = {same: (numbers[same], over[f"over {what}"] + more.get(what, 0)) for same, what in ((True, "same"), (False, "reach"))}
    return value, reach, _moments(found.where("what = 'sums'").select(F.lit(True).alias("same"), "n", "first", "second"))


def ranked_similarity(samples: DataFrame, rank: int, few: int | None = None) -> float:
    """The similarity of the pair of different stations that `rank` (from 0) others exceed."""
    return rank_and_reach(samples, rank, few=few)[0]
