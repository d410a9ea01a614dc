"""Frame levels: the rolling noise gate, and bursts of speech (batch form)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .windows import in_ranges

#: Frames of one source that one window partition of the noise gate holds, those before it aside.
CHUNK_FRAMES = 4096
#: Rows of snapshots that a chunk of time has on average when a fleet's state is folded.
FLEET_ROWS = 1 << 16
#: Signals of all sources that a range of time has on average when snapshots are made.
SIGNAL_ROWS = 1 << 16
#: Intervals of a heartbeat that one window holds at most.
BEATS = 4096
#: Seconds after which an alarm that is due has rung.
RING_S = 0.001


class LevelWindow:
    """The last levels of a source, also kept in order, so that a percentile is read and not sorted for."""

    def __init__(self, width: int, levels: list[float | None] = ()):
        self.width, self.levels = width, deque(levels)
        self.ordered = sorted(x for x in levels if x is not None)

    def push(self, level: float | None) -> None:
        self.levels.append(level)
        if level is not None:
            insort(self.ordered, level)
        if len(self.levels) > self.width:
            old = self.levels.popleft()
            if old is not None:
                self.ordered.pop(bisect_left(self.ordered, old))

    def percentile(self, share: float) -> float | None:
        """Interpolated between the two nearest levels."""
        if not self.ordered:
            return None
        at = share * (len(self.ordered) - 1)
        low = int(at)
        return self.ordered[low] + (self.ordered[min(low + 1, len(self.ordered) - 1)] - self.ordered[low]) * (at - low)


def _numbered(frames: DataFrame, keys: list[str]) -> DataFrame:
    """frames with _n, their number in the source from 0. Frames are numbered within ranges of frame_no,
    whose sizes are summed up, so that a long source is no single task's work."""
    part = F.floor(F.col("frame_no") / CHUNK_FRAMES)
    rows = frames.withColumn("_part", part)
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_part").eqNullSafe(F.col("_of"))]
    met = rows.join(first, reduce(lambda x, y: x & y, same)).drop(*[f"_{k}" for k in keys], "_of")
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("frame_no")) - 1 + F.col("_first")).drop("_part", "_first")


def noise_gate(frames: DataFrame, window_ms: int = 10_000, pct: float = 10, min_floor: float = 300, margin: float = 1.5, frame_ms: int = 30, warm_up_ms: int = 300) -> DataFrame:
    """Adds floor and open per frame of (source, session if present, frame_no, rms).

    The floor is a percentile of the window's levels, interpolated; frames without a level take their
    place in the window but do not count. The first frames (before the warm-up is over) and quiet
    floors are open; otherwise the level must stand out by the margin. A source's frames are cut into
    chunks that carry the frames of a window before them; a task goes through its chunks in order and
    keeps the window's levels sorted.
    """
    keys = [c for c in ("source", "session") if c in frames.columns]
    width = max(1, window_ms // frame_ms)
    size = max(CHUNK_FRAMES, width)
    n, chunk = F.col("_n"), F.floor(F.col("_n") / size)
    ahead = F.when(n % size > size - width, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = _numbered(frames, keys).withColumn("_chunk", F.explode(ahead)).repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_n")
    names, early = rows.columns, warm_up_ms // frame_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, window = None, LevelWindow(width)
        for batch in batches:
            of = list(zip(*(batch.column(names.index(c)).to_pylist() for c in (*keys, "_chunk")), strict=True))
            levels, numbers = batch.column(names.index("rms")).to_pylist(), batch.column(names.index("_n")).to_pylist()
            floors, opens = [], []
            for key, level, number in zip(of, levels, numbers, strict=True):
                if key != now:
                    now, window = key, LevelWindow(width)
                window.push(level)
                if number // size != key[-1]:
                    continue
                floor = window.percentile(pct / 100)
                floors.append(floor)
                opens.append(True if number + 1 < early or (floor is not None and floor < min_floor) else None if floor is None or level is None else level >= margin * floor)
            home = pa.array([number // size == key[-1] for key, number in zip(of, numbers, strict=True)], type=pa.bool_())
            held = batch.filter(home)
            yield pa.RecordBatch.from_arrays([*held.columns[: len(names) - 2], pa.array(floors, type=pa.float64()), pa.array(opens, type=pa.bool_())], names=[*names[:-2], "floor", "open"])

    shape = T.StructType([*frames.schema.fields, T.StructField("floor", T.DoubleType()), T.StructField("open", T.BooleanType())])
    return rows.mapInArrow(run, shape)


def gate(frames: DataFrame, **limits: float) -> DataFrame:
    """frames whose is_speech also needs the gate; the gate looks at every frame."""
    return noise_gate(frames, **limits).withColumn("is_speech", F.col("is_speech") & F.col("open")).drop("floor", "open")


@dataclass
class BurstRules:
    frame_ms: int = 30
    silence_ms: int = 800
    min_clip_ms: int = 400
    max_clip_ms: int = 120_000
    preroll_ms: int = 300
    trigger_ratio: float = 0.7


@dataclass
class BurstState:
    """What a source carries from frame to frame: frames seen, the pre-roll flags, and the open
    burst's first frame, frames and silent frames at its end."""

    seen: int = 0
    ring: list[bool] = field(default_factory=list)
    start: int = -1
    frames: int = 0
    quiet: int = 0

    def push(self, speech: bool, rules: BurstRules) -> tuple[int, int] | None:
        """Take one frame; (first frame, frames) of a burst that it ends."""
        full = max(1, rules.preroll_ms // rules.frame_ms)
        self.seen += 1
        if self.start < 0:
            self.ring = [*self.ring, speech][-full:]
            if len(self.ring) == full and sum(self.ring) > rules.trigger_ratio * full:
                self.start, self.frames, self.quiet, self.ring = self.seen - full, full, 0, []
            return None
        self.frames += 1
        self.quiet = 0 if speech else self.quiet + 1
        ended = self.quiet >= max(1, rules.silence_ms // rules.frame_ms) or self.frames >= max(1, rules.max_clip_ms // rules.frame_ms)
        return self.close(rules) if ended else None

    def close(self, rules: BurstRules) -> tuple[int, int] | None:
        """End the open burst; without its trailing silence it must be long enough."""
        found = (self.start, self.frames - self.quiet) if self.start >= 0 and (self.frames - self.quiet) * rules.frame_ms >= rules.min_clip_ms else None
        self.start, self.frames, self.quiet, self.ring = -1, 0, 0, []
        return found


def bursts(frames: DataFrame, **limits: float) -> DataFrame:
    """(source, session, seq, start_offset_ms, duration_ms) of speech bursts.

    A burst opens when the full pre-roll ring is mostly speech, so this is not a session window; each
    (source, session) runs through the state machine in order of its frames, a chunk at a time.
    """
    rules = BurstRules(**limits)
    rows = frames if "session" in frames.columns else frames.withColumn("session", F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, seq, out = None, BurstState(), 0, []

        def note(found: tuple[int, int] | None) -> None:
            nonlocal seq
            if found:
                out.append((*key, seq, found[0] * rules.frame_ms, found[1] * rules.frame_ms))
                seq += 1

        for pdf in batches:
            for source, session, speech in zip(pdf["source"], pdf["session"], pdf["is_speech"], strict=True):
                if (source, session) != key:
                    if key:
                        note(state.close(rules))
                    key, state, seq = (source, session), BurstState(), 0
                note(state.push(bool(speech), rules))
            yield pd.DataFrame(out, columns=["source", "session", "seq", "start_offset_ms", "duration_ms"])
            out.clear()
        if key:
            note(state.close(rules))
            yield pd.DataFrame(out, columns=["source", "session", "seq", "start_offset_ms", "duration_ms"])

    ordered = rows.select(F.col("source").cast("string"), F.col("session").cast("string"), "frame_no", "is_speech").repartition("source", "session").sortWithinPartitions("source", "session", "frame_no")
    return ordered.mapInPandas(run, "source string, session string, seq long, start_offset_ms long, duration_ms long")


def islands(frames: DataFrame, frame_ms: int = 30, silence_ms: int = 800) -> DataFrame:
    """Approximate bursts for large scans, in window functions only: speech frames less than the
    silence apart form one. It opens at the first speech frame, not on a full ring."""
    keys = [c for c in ("source", "session") if c in frames.columns]
    w = Window.partitionBy(*keys).orderBy("frame_no")
    rows = frames.where("is_speech").withColumn("_new", F.coalesce((F.col("frame_no") - F.lag("frame_no").over(w)) * frame_ms > silence_ms, F.lit(True)).cast("int"))
    return rows.withColumn("burst", F.sum("_new").over(w)).groupBy(*keys, "burst").agg(F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"), F.count("*").alias("speech_frames"))


#: Counters of a source: the kind of signal that a counter counts, and that whose last value it is.
COUNTED = {"frames": ("frame",), "clips": ("clip",), "transcriptions": ("transcript",), "errors": ("failed", "error")}
LAST = {"spill": "spill", "spilled": "spilled", "buffer_fill": "buffer", "overflows": "overflow", "level": "frame", "factor": "factor", "backlog": "backlog", "last_transcribe_s": "transcript"}
#: How counters of several sources come together.
SUMS = ("frames", "clips", "transcriptions", "errors", "overflows")
LARGEST = ("spill", "spilled", "level", "factor", "buffer_fill", "backlog", "last_transcribe_s")


def snapshots(signals: DataFrame, stall_s: float = 5, silence_s: float = 300, silence_rms: float = 15) -> DataFrame:
    """Counters of each source, as `health` reads them, after every signal and where an alarm rings.

    signals: source, clock (seconds), kind (started, stopped, failed, finished, frame, clip, transcript,
    error, spill, spilled, buffer, overflow, factor, backlog; others change nothing), value; those of one
    clock in order of seq, if there is one. A start begins a new time of grace. What is missing has no
    row of its own: where a source sends nothing until an alarm is due, a row of that instant stands
    between its signals. no tells rows of one source and clock in their order.

    Time is cut into ranges of SIGNAL_ROWS signals on average (part, which rises with a source's rows).
    Each range sums up what its signals say, and its rows go on from the sums of those before it, so
    that a long source is no single task's work.
    """
    order = [c for c in ("clock", "seq") if c in signals.columns]
    kind, began = F.col("kind"), F.col("kind") == "started"
    last = {
        "capturing": F.when(kind.isin("started", "stopped", "failed", "finished"), began),
        "finished": F.when(kind.isin("started", "finished"), kind == "finished"),
        "last_frame": F.when(kind.isin("started", "frame"), F.col("clock")),
        "last_loud": F.when(began | ((kind == "frame") & (F.col("value") >= silence_rms)), F.col("clock")),
        **{name: F.when(kind == k, F.col("value")) for name, k in LAST.items()},
    }
    rows, highest = in_ranges(signals.select("source", *order, "kind", "value"), "clock", SIGNAL_ROWS, "part")
    rows = rows.select("*", *[F.when(kind.isin(*k), 1).otherwise(0).cast("long").alias(name) for name, k in COUNTED.items()], F.lit(1).cast("long").alias("no"))
    at, counts = F.struct(*order), [*COUNTED, "no"]
    sums = rows.repartition(highest + 1, "source", "part").groupBy("source", "part").agg(
        *[F.max_by(x, F.when(x.isNotNull(), at)).alias(name) for name, x in last.items()], *[F.sum(name).alias(name) for name in counts], F.min("clock").alias("first")
    )
    parts = Window.partitionBy("source").orderBy("part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    begin = F.struct(*[F.last(name, ignorenulls=True).over(earlier).alias(name) for name in last], F.lead("first").over(parts).alias("after"))
    begin = sums.select("source", "part", begin.alias("begin"), *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in counts])
    rows = rows.unionByName(begin, allowMissingColumns=True).repartition(highest + 1, "source", "part")
    # A range's first row tells what was before it.
    w = Window.partitionBy("source", "part").orderBy(F.col("begin").isNull(), *order)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    missing = {"capturing": F.lit(False), "finished": F.lit(False), "last_frame": F.lit(None), "last_loud": F.lit(None)}
    rows = rows.select(
        "source",
        "clock",
        *[F.coalesce(F.last(F.coalesce(x, F.col("begin")[name]), ignorenulls=True).over(sofar), missing.get(name, F.lit(0.0))).alias(name) for name, x in last.items()],
        *[F.sum(name).over(sofar).alias(name) for name in counts],
        F.coalesce(F.lead("clock").over(w), F.first("begin.after").over(sofar)).alias("_next"),
        "part",
        F.col("begin").isNull().alias("_signal"),
    ).where("_signal")
    due = F.array_distinct(F.array(F.col("last_frame") + stall_s + RING_S, F.col("last_loud") + silence_s + RING_S))
    rings = F.filter(due, lambda t: F.coalesce(F.col("capturing") & (t > F.col("clock")) & (t < F.col("_next")), F.lit(False)))
    return rows.withColumn("clock", F.explode(F.concat(F.array("clock"), rings))).drop("_next", "_signal")


def health(snapshots: DataFrame, stall_s: float = 5, silence_s: float = 300, silence_rms: float = 15) -> DataFrame:
    """(source, clock, state, issues) of snapshots of a source's counters.

    snapshots: source, clock, capturing, finished, last_frame, last_loud (clocks), spill, buffer_fill,
    overflows. Not capturing, stalled and silent exclude each other in that order; spill, a full
    buffer and overflows warn besides. The worst severity is the state; issues are worst first.
    """
    idle = F.when(~F.col("capturing") & ~F.col("finished"), F.struct(F.lit(2).alias("severity"), F.lit("not capturing").alias("text"))).when(
        F.col("capturing") & ~F.col("finished") & (F.col("clock") - F.col("last_frame") > stall_s), F.struct(F.lit(2).alias("severity"), F.lit("no audio frames").alias("text"))
    ).when(F.col("capturing") & ~F.col("finished") & (F.col("clock") - F.col("last_loud") > silence_s), F.struct(F.lit(1).alias("severity"), F.lit("silent").alias("text")))
    warn = lambda cond, text: F.when(cond, F.struct(F.lit(1).alias("severity"), F.lit(text).alias("text")))
    found = F.filter(F.array(idle, warn(F.col("spill") > 0, "clips waiting on disk"), warn(F.col("buffer_fill") > 0.5, "buffer filling"), warn(F.col("overflows") > 0, "overflows")), lambda x: x.isNotNull())
    ordered = F.transform(F.array_sort(F.transform(found, lambda x: F.struct((-x.severity).alias("s"), x.text.alias("text")))), lambda x: x.text)
    worst = F.coalesce(F.array_max(F.transform(found, lambda x: x.severity)), F.lit(0))
    rows = snapshots.withColumn("severity", worst).withColumn("issues", ordered)
    return rows.withColumn("state", F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("error")), F.col("severity") + 1))


STATES = ("ok", "warning", "error")


class Fleet:
    """The last snapshot of each source, and what they come to. Every change costs the source's own
    counters, not those of all sources."""

    def __init__(self, counters: list[str]):
        self.counters = counters
        self.last: dict[str, tuple] = {}
        self.severities, self.capturing, self.loud = [0, 0, 0], 0, set()
        self.totals = [0.0 if c in SUMS else [] for c in counters]

    def put(self, source: str, severity: int, capturing: bool, issues: list[str], values: list[float | None]) -> None:
        self._take_out(source)
        self.last[source] = severity, bool(capturing), list(issues), [x or 0.0 for x in values]
        self.severities[severity] += 1
        self.capturing += bool(capturing)
        if issues:
            self.loud.add(source)
        for k, x in enumerate(self.last[source][3]):
            if isinstance(self.totals[k], list):
                insort(self.totals[k], x)
            else:
                self.totals[k] += x

    def _take_out(self, source: str) -> None:
        if source not in self.last:
            return
        severity, capturing, _, values = self.last.pop(source)
        self.severities[severity] -= 1
        self.capturing -= capturing
        self.loud.discard(source)
        for k, x in enumerate(values):
            if isinstance(self.totals[k], list):
                self.totals[k].pop(bisect_left(self.totals[k], x))
            else:
                self.totals[k] -= x

    def severity(self) -> int:
        return max((k for k, n in enumerate(self.severities) if n), default=0)

    def row(self) -> tuple:
        """(severity, state, capturing, sources, issues, counters...)"""
        severity = self.severity()
        several = len(self.last) > 1
        issues = [f"{s}: {x}" if several else x for s in sorted(self.loud) for x in self.last[s][2]]
        return severity, STATES[severity], self.capturing > 0, len(self.last), issues, *[x[-1] if isinstance(x, list) and x else x or 0.0 for x in self.totals]


def fleet_fields(counters: list[str]) -> list[T.StructField]:
    """What Fleet.row() tells."""
    kinds = {"severity": T.IntegerType(), "state": T.StringType(), "capturing": T.BooleanType(), "sources": T.IntegerType(), "issues": T.ArrayType(T.StringType())}
    return [T.StructField(name, kind) for name, kind in (kinds | {c: T.DoubleType() for c in counters}).items()]


def fleet(rows: DataFrame, by: str = "clock", previous: bool = False) -> DataFrame:
    """One row per instant at which a source reports, over all sources: each counts with its last
    snapshot until its next. Worst state, issues named by source once there are several, sums of frames,
    clips, transcriptions, errors and overflows, the largest of spill, level, factor, fill and backlog
    (those that rows have), whether any captures, and how many sources have reported.

    rows: of `health`; those of one source and instant in order of no, if there is one, else the worst
    last. Time is cut into chunks of FLEET_ROWS rows on average. A chunk starts with the last snapshot
    that each source has before it, so chunks are folded apart, each as a stream of sorted rows.

    previous: with the state before each instant (ok at first), in the column previous.
    """
    counters = [c for c in (*SUMS, *LARGEST) if c in rows.columns]
    told = ["severity", "capturing", "issues", *counters]
    slim = rows.select(F.col("source").cast("string").alias("source"), F.col(by).cast("double").alias("clock"), F.col("no") if "no" in rows.columns else F.lit(0).cast("long").alias("no"), "severity", "capturing", "issues", *[F.col(c).cast("double").alias(c) for c in counters])
    slim, highest = in_ranges(slim.where("clock is not null"), "clock", FLEET_ROWS, "chunk")
    last = slim.groupBy("source", "chunk").agg(F.max_by(F.struct(*told), F.struct("clock", "no", "severity")).alias("row"))
    until = F.coalesce(F.lead("chunk").over(Window.partitionBy("source").orderBy("chunk")), F.lit(highest).cast("long"))
    held = last.withColumn("until", until).where("until > chunk").select("source", F.explode(F.sequence(F.col("chunk") + 1, "until")).alias("chunk"), *[F.col("row")[c].alias(c) for c in told])
    both = slim.withColumn("kind", F.lit(1)).unionByName(held.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartition(highest + 1, "chunk").sortWithinPartitions("chunk", "kind", "clock", "no", "severity")
    fields = [T.StructField(by, T.DoubleType()), *fleet_fields(counters), *([T.StructField("previous", T.StringType())] if previous else [])]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        chunk, state, clock, before, out = None, Fleet(counters), None, "ok", []

        def told_at(clock: float) -> tuple:
            return clock, *state.row(), *([before] if previous else [])

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in fields]
            return pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("source", "clock", "chunk", *told)}
            for k in range(batch.num_rows):
                now = columns["clock"][k]
                if clock is not None and (now != clock or columns["chunk"][k] != chunk):
                    out.append(told_at(clock))
                if columns["chunk"][k] != chunk:
                    chunk, state, clock = columns["chunk"][k], Fleet(counters), None
                if now != clock:
                    clock, before = now, STATES[state.severity()]
                state.put(columns["source"][k] or "", columns["severity"][k], columns["capturing"][k], columns["issues"][k] or [], [columns[c][k] for c in counters])
            yield made()
            out.clear()
        if clock is not None:
            out.append(told_at(clock))
            yield made()

    found = ordered.mapInArrow(run, schema)
    return found.select(*[F.col(c).cast("long").alias(c) if c in SUMS else F.col(c) for c in found.columns])


def heartbeat(fleet_rows: DataFrame, every_s: float, by: str = "clock") -> DataFrame:
    """The fleet's state and totals every so many seconds, as of then: (beat, fleet's columns), from the
    first interval that ends after a row to the last. Intervals in which nothing reports repeat."""
    rest = [c for c in fleet_rows.columns if c != by]
    beat = F.ceil(F.col(by) / every_s)
    ends = fleet_rows.withColumn("beat", beat).groupBy("beat").agg(F.max_by(F.struct(*rest), by).alias("row")).withColumn("range", F.floor(F.col("beat") / BEATS))
    # Within a range a row counts until the next one, and the range's last row until the next range's first.
    inner = ends.withColumn("until", F.coalesce(F.lead("beat").over(Window.partitionBy("range").orderBy("beat")) - 1, F.col("beat")))
    last = ends.groupBy("range").agg(F.max_by("row", "beat").alias("row"), (F.max("beat") + 1).alias("beat"), F.min("beat").alias("first"))
    outer = last.withColumn("until", F.lead("first").over(Window.orderBy("range")) - 1).where("until >= beat")
    rows = inner.select("beat", "until", "row").unionByName(outer.select("beat", "until", "row"))
    return rows.select(F.explode(F.sequence("beat", "until")).alias("beat"), "row.*").withColumn("beat", F.col("beat") * F.lit(float(every_s)))
