"""Streaming forms: gate, bursts and health with state per source, enrichment, live boards, heartbeat."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.boards import place_stations
from ..operators.frames import LARGEST, RING_S, SUMS, BurstRules, BurstState, Fleet, LevelWindow, fleet_fields, health
from ..operators.text import detect_traffic, flag_echo
from ..operators.windows import latest_per_key


def _timed(frames: DataFrame, late: str) -> DataFrame:
    rows = frames if "session" in frames.columns else frames.withColumn("session", F.lit(""))
    return rows.withColumn("source", F.col("source").cast("string")).withColumn("session", F.col("session").cast("string")).withWatermark("ts", late)


def _in_order(state: dict, rows: list[list], watermark_ms: int) -> list[list]:
    """The rows (frame_no, time in ms, ...) that are due: those that follow on the last one, and behind
    a gap those whose missing frames are too late to come. The others are held in the state."""
    held = sorted(state["held"] + rows)
    due = []
    while held and (state["next"] is None or held[0][0] <= state["next"] or held[0][1] <= watermark_ms):
        due.append(held.pop(0))
        state["next"] = max(due[-1][0] + 1, state["next"] or 0)
    state["held"] = held
    return due


@dataclass
class GateRules:
    """The noise gate in frames: window, percentile, frames before it works, least floor and margin."""

    window: int = 333
    quantile: float = 0.1
    warm_up: int = 10
    least: float = 300
    ratio: float = 1.5


class Gate:
    """The gate of one source: frames seen and the window's levels, which are its state."""

    def __init__(self, rules: GateRules, n: int = 0, levels: list[float | None] = ()):
        self.rules, self.n, self.window = rules, n, LevelWindow(rules.window, levels)

    def push(self, level: float | None) -> tuple[float | None, bool | None]:
        """Floor and open of one frame; open is unknown without a floor or a level, once warmed up."""
        self.n += 1
        self.window.push(level)
        floor = self.window.percentile(self.rules.quantile)
        if self.n < self.rules.warm_up or (floor is not None and floor < self.rules.least):
            return floor, True
        return floor, None if floor is None or level is None else level >= self.rules.ratio * floor

    def state(self) -> dict:
        return {"n": self.n, "levels": list(self.window.levels)}


def _frames_in_order(order: dict, batches: Iterator[pd.DataFrame], held: GroupState, columns: list[str], idle_ms: int) -> list[list]:
    """The frames that are due, as [frame_no, time in ms, columns...]; all that wait once the source is idle."""
    if held.hasTimedOut:
        due, order["held"] = order["held"], []
        order["next"] = max([x[0] + 1 for x in due], default=order["next"])
        return due
    rows = pd.concat(list(batches)).astype(object)
    rows = rows.where(rows.notna(), None)
    times = [int(t.timestamp() * 1000) for t in rows["ts"]]
    new = [[int(n), t, *(None if x is None else float(x) if c == "rms" else bool(x) for c, x in zip(columns, values, strict=True))] for n, t, *values in zip(rows["frame_no"], times, *(rows[c] for c in columns), strict=True)]
    held.setTimeoutTimestamp(max(*times, held.getCurrentWatermarkMs()) + idle_ms)
    return _in_order(order, new, held.getCurrentWatermarkMs())


def bursts_stream(frames: DataFrame, idle_ms: int = 10_000, late: str = "10 seconds", gate: GateRules | None = None, **limits: float) -> DataFrame:
    """Bursts of a stream of frames (source, frame_no, ts, is_speech, maybe session), in order of
    frame_no per source and session, also where frames of one batch belong before those of another.
    With a gate, frames also have rms, and are speech only where the gate is open; gate and segmenter
    are one step over the same ordered frames.

    The state is the same small machine as in the batch form, and the gate's window. A source that
    sends nothing for idle_ms of event time has its open burst closed; its frames are counted on from
    there. ended_at is the time of the frame that ends a burst, or of the last one of an idle source.
    """
    rules = BurstRules(**limits)
    fields = ("seen", "ring", "start", "frames", "quiet")
    columns = ["is_speech", "rms"] if gate else ["is_speech"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        order = json.loads(held.get[0]) if held.exists else {"next": None, "held": [], "machine": {}, "gate": {}, "last": None}
        state, found, opened = BurstState(**order["machine"]), [], Gate(gate, **order["gate"]) if gate else None
        for _, at, speech, *level in _frames_in_order(order, batches, held, columns, idle_ms):
            if order["last"] is not None and at - order["last"] > idle_ms and state.start >= 0:
                found.append((state.close(rules), order["last"]))  # idle, whether or not the timer came in between
            passed = opened is None or bool(opened.push(level[0])[1])  # the gate looks at every frame
            heard = bool(speech) and passed
            found.append((state.push(heard, rules), at))
            order["last"] = max(at, order["last"] or at)
        if held.hasTimedOut:
            found.append((state.close(rules), order["last"]))
        order["machine"] = {f: getattr(state, f) for f in fields}
        order["gate"] = opened.state() if opened else {}
        held.update((json.dumps(order),))
        yield pd.DataFrame([(*map(str, key), x[0] * rules.frame_ms, x[1] * rules.frame_ms, pd.Timestamp(at, unit="ms")) for x, at in found if x], columns=["source", "session", "start_offset_ms", "duration_ms", "ended_at"])

    rows = _timed(frames, late).select("source", "session", "frame_no", "ts", *columns)
    return rows.groupBy("source", "session").applyInPandasWithState(run, "source string, session string, start_offset_ms long, duration_ms long, ended_at timestamp", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def gate_stream(frames: DataFrame, late: str = "10 seconds", idle_ms: int = 10_000, rules: GateRules | None = None) -> DataFrame:
    """The noise gate over a stream of frames (source, frame_no, ts, rms, is_speech, maybe session):
    floor, open, and is_speech only where the gate is open. The state of a source is its last levels.
    For bursts of gated frames give the gate to bursts_stream."""
    rules = rules or GateRules()

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        order = json.loads(held.get[0]) if held.exists else {"next": None, "held": [], "gate": {}}
        gate, out = Gate(rules, **order["gate"]), []
        for number, at, level, speech in _frames_in_order(order, batches, held, ["rms", "is_speech"], idle_ms):
            floor, opened = gate.push(level)
            out.append((*map(str, key), number, pd.Timestamp(at, unit="ms"), floor, opened, bool(speech and opened)))
        order["gate"] = gate.state()
        held.update((json.dumps(order),))
        yield pd.DataFrame(out, columns=["source", "session", "frame_no", "ts", "floor", "open", "is_speech"])

    rows = _timed(frames, late).select("source", "session", "frame_no", "ts", "rms", "is_speech")
    return rows.groupBy("source", "session").applyInPandasWithState(run, "source string, session string, frame_no long, ts timestamp, floor double, open boolean, is_speech boolean", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def heartbeat(stream: DataFrame, every: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Totals per interval and source."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "source").agg(F.count("*").alias("lines"), F.count_if("matched").alias("matched"))


def enrich_stream(lines: DataFrame, roster: DataFrame, aliases: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Match arriving lines against the roster, with the aliases as they are when a batch arrives, tell
    declared traffic, and flag lines that look like the prompt coming back (suspect, echo_reason). trigger: as of
    DataStreamWriter.trigger, by default all that is there and then an end."""
    from ..operators.match import line_mentions, match_all, match_lines

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        found, known = line_mentions(held), aliases()
        one = match_lines(held, roster, known, found)
        echo = flag_echo(held.select("session", "id", "raw_text"), match_all(held, roster, known, found)).select("session", "id", "suspect", F.col("reason").alias("echo_reason"))
        sink(detect_traffic(held.join(one, ["session", "id"], "left").join(echo, ["session", "id"], "left"), "raw_text"), number)
        held.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


BOARD = "session string, kind string, key string, lines long, matched_lines long, stations long, outstanding long, awaiting long, first_seen string, first_id long, holding boolean, holding_since string, holding_id long, passed boolean"


class Boards(StatefulProcessor):
    """The boards of one session. State: the current row of each line, the lines of each callsign, and
    per receiver what its lines come to. A record of a known line takes the old row out first, so
    corrections and cleared traffic have their effect."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.line = handle.getMapState("line", "id long", "row string")
        self.station = handle.getMapState("station", "callsign string", "lines string")
        self.source = handle.getMapState("source", "source string", "totals string")

    @staticmethod
    def _get(state, key, default):
        return json.loads(state.getValue((key,))[0]) if state.containsKey((key,)) else default

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stations, sources = {}, {}

        def count(row: dict, step: int) -> None:
            callsign = row["callsign"]
            for source in {row["source"], TOTAL}:
                if source not in sources:
                    sources[source] = self._get(self.source, source, {"lines": 0, "awaiting": 0, "stations": {}, "holding": {}})
                total = sources[source]
                total["lines"] += step
                total["awaiting"] += step * row["awaiting"]
                for name, told in (("stations", row["matched"]), ("holding", row["open"])):
                    if callsign and told:
                        total[name][callsign] = total[name].get(callsign, 0) + step
                        if not total[name][callsign]:
                            del total[name][callsign]
            if callsign:
                if callsign not in stations:
                    stations[callsign] = self._get(self.station, callsign, {})
                if step > 0:
                    stations[callsign][str(row["id"])] = [row["timestamp"], row["matched"], row["open"], row["passed"]]
                else:
                    del stations[callsign][str(row["id"])]

        for pdf in rows:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for x in pdf.sort_values("seq").to_dict("records"):
                if not x["id"]:
                    continue
                old = self._get(self.line, int(x["id"]), None)
                if old and old["seq"] >= x["seq"]:
                    continue
                declared = x["traffic"] == "yes"
                new = {
                    "id": int(x["id"]), "seq": int(x["seq"]), "timestamp": x["timestamp"], "callsign": x["matched_callsign"], "matched": bool(x["matched"]), "source": x["source"] or "",
                    "awaiting": bool(x["escalation_pending"]), "open": declared and not x["traffic_cleared"], "passed": declared and bool(x["traffic_cleared"]),
                }
                if old:
                    count(old, -1)
                count(new, 1)
                self.line.updateValue((new["id"],), (json.dumps(new),))

        out = []
        for callsign, lines in stations.items():
            if lines:
                self.station.updateValue((callsign,), (json.dumps(lines),))
            elif self.station.containsKey((callsign,)):
                self.station.removeKey((callsign,))
            first = lambda told: min(((t, int(i)) for i, (t, *flags) in lines.items() if told(*flags)), default=(None, None))  # noqa: B023, E731
            heard, waiting = first(lambda matched, opened, passed: matched), first(lambda matched, opened, passed: opened and matched)
            holds = any(x[2] for x in lines.values())
            out.append((key[0], "station", callsign, len(lines), sum(x[1] for x in lines.values()), None, None, None, *heard, holds, *waiting, any(x[3] for x in lines.values())))
        for source, x in sources.items():
            self.source.updateValue((source,), (json.dumps(x),))
            out.append((key[0], "total" if source == TOTAL else "source", "" if source == TOTAL else source, x["lines"], None, len(x["stations"]), len(x["holding"]), x["awaiting"], None, None, None, None, None, None))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in BOARD.split(", ")]).astype({c: "Int64" for c in ("lines", "matched_lines", "stations", "outstanding", "awaiting", "first_id", "holding_id")} | {"holding": "boolean", "passed": "boolean"})

    def close(self) -> None:
        pass


#: Key of a session's totals over all receivers.
TOTAL = "\x00total"


def boards_stream(records: DataFrame) -> DataFrame:
    """Rows of the live boards of a stream of change records (session, seq, id, timestamp, matched,
    matched_callsign, traffic, traffic_cleared, source, escalation_pending): after each batch those of
    the stations (kind station), receivers (source) and sessions (total) that it touches, to be put in
    the place of earlier rows of the same session, kind and key (see keep_boards). The record of the
    largest seq holds for a line; id 0 is no line. A station without any line left has lines 0.

    A batch table of records gives the final rows. The session has to keep its state in RocksDB, as
    Spark asks for transformWithState.
    """
    rows = records.select("session", F.col("seq").cast("long").alias("seq"), F.col("id").cast("long").alias("id"), "timestamp", "matched", "matched_callsign", "traffic", "traffic_cleared", "source", "escalation_pending")
    return rows.groupBy("session").transformWithStateInPandas(Boards(), BOARD, "update", "none")


def keep_boards(board: DataFrame, path: str, checkpoint: str, compact_every: int = 50, trigger: dict | None = None):
    """Write a stream of board rows under path, batch by batch, so that read_boards shows the current
    ones. A batch that is run again replaces what it wrote. Every compact_every batches the current
    rows are written as one generation, and read_boards starts from the last of those."""
    spark = board.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("at", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batches/batch={number}")
        if number and number % compact_every == 0:
            read_boards(spark, path, number).write.mode("overwrite").parquet(f"{path}/whole/generation={number}")

    return board.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def read_boards(spark: SparkSession, path: str, through: int | None = None) -> DataFrame:
    """The current board rows that keep_boards has written under path (at is the batch of each)."""
    jvm = spark.sparkContext._jvm
    folder = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = folder("whole").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = lambda name: [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(folder(name)) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(folder(name)) else []
    whole = max([g for g in listed("whole") if through is None or g < through], default=None)
    batches = [b for b in listed("batches") if (whole is None or b > whole) and (through is None or b <= through)]
    paths = [f"{path}/batches/batch={b}" for b in batches] + ([f"{path}/whole/generation={whole}"] if whole is not None else [])
    shape = f"{BOARD}, at long"
    rows = spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)
    return latest_per_key(rows, ["session", "kind", "key"], "at")


def live_check_ins(board: DataFrame) -> DataFrame:
    """boards.check_ins of the current board rows."""
    first = board.where("kind = 'station' and matched_lines > 0")
    return _ordered(first, "first_seen", "first_id")


def live_holding(board: DataFrame) -> DataFrame:
    """boards.holding_traffic of the current board rows."""
    return _ordered(board.where("kind = 'station' and holding_since is not null"), "holding_since", "holding_id")


def _ordered(stations: DataFrame, since: str, number: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("session").orderBy(since, number, "key"))
    return stations.select("session", F.col("key").alias("callsign"), F.col(since).alias("first_seen"), place.alias("ordinal"))


def live_stats(board: DataFrame) -> DataFrame:
    """boards.log_stats of the current board rows."""
    total = F.col("kind") == "total"
    return board.where("kind in ('source', 'total') and lines > 0").select("session", F.when(~total, F.col("key")).alias("source"), "lines", "stations", "outstanding", "awaiting", total.alias("total"))


def live_roster(roster: DataFrame, board: DataFrame) -> DataFrame:
    """boards.board of the current board rows: every roster entry, heard or not."""
    lines = board.where("kind = 'station' and lines > 0").groupBy(F.col("key").alias("callsign")).agg(F.sum("lines").alias("lines"), F.bool_or("holding").alias("holding"))
    return place_stations(roster, lines)


def mark_late(lines: DataFrame) -> DataFrame:
    """Adds late: the line arrived after one of a later time. Batch form over the append log (arrival)."""
    before = F.max("timestamp").over(Window.partitionBy("session").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("late", F.coalesce(before > F.col("timestamp"), F.lit(False)))


def late_stream(lines: DataFrame) -> DataFrame:
    """mark_late of a stream of lines (session, arrival, timestamp, ...), however late they are: the
    state of a session is the largest time that has arrived. Nothing waits and nothing is dropped; of
    the lines of one batch arrival tells the order."""
    shape = T.StructType([*lines.schema.fields, T.StructField("late", T.BooleanType())])

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        latest = held.get[0] if held.exists else None
        rows = pd.concat(list(batches)).sort_values("arrival")
        late = []
        for at in rows["timestamp"]:
            at = None if pd.isna(at) else at
            late.append(bool(latest is not None and at is not None and latest > at))
            latest = at if latest is None or (at is not None and at > latest) else latest
        held.update((latest,))
        yield rows.assign(late=late)

    return lines.groupBy("session").applyInPandasWithState(run, shape, T.StructType([T.StructField("latest", lines.schema["timestamp"].dataType)]), "append", GroupStateTimeout.NoTimeout)


@dataclass
class SourceState:
    """What a source's health rests on: its counters, the clock they are of, signals that may still be
    overtaken by late ones, and the verdict that was sent last."""

    capturing: bool = False
    finished: bool = False
    last_frame: float | None = None
    last_loud: float | None = None
    spill: float = 0.0
    buffer_fill: float = 0.0
    overflows: float = 0.0
    clock: float | None = None
    held: list = field(default_factory=list)
    said: list | None = None

    def take(self, clock: float, kind: str, value: float, silence_rms: float) -> None:
        if kind in ("started", "stopped", "failed", "finished"):
            self.capturing = kind == "started"
        if kind in ("started", "finished"):
            self.finished = kind == "finished"
        if kind in ("started", "frame"):
            self.last_frame = clock
        if kind == "started" or (kind == "frame" and value >= silence_rms):
            self.last_loud = clock
        counter = {"spill": "spill", "buffer": "buffer_fill", "overflow": "overflows"}.get(kind)
        if counter:
            setattr(self, counter, value)
        self.clock = clock

    def rings(self, stall_s: float, silence_s: float) -> list[float]:
        """Instants at which an alarm rings if nothing comes before."""
        due = {since + limit + RING_S for since, limit in ((self.last_frame, stall_s), (self.last_loud, silence_s)) if since is not None}
        return sorted(t for t in due if self.capturing and t > self.clock)

    def verdict(self, stall_s: float, silence_s: float) -> list:
        over = [self.capturing and since is not None and self.clock - since > limit for since, limit in ((self.last_frame, stall_s), (self.last_loud, silence_s))]
        return [self.capturing, self.finished, *over, self.spill, self.buffer_fill > 0.5, self.overflows]


SNAPSHOT_SHAPE = "source string, clock double, capturing boolean, finished boolean, last_frame double, last_loud double, spill double, buffer_fill double, overflows double"
SNAPSHOT = ["capturing", "finished", "last_frame", "last_loud", "spill", "buffer_fill", "overflows"]


def signals_stream(signals: DataFrame, stall_s: float = 5, silence_s: float = 300, silence_rms: float = 15, late: str = "10 seconds") -> DataFrame:
    """Snapshots of a stream of signals (source, clock, kind, value), one wherever a verdict of `health`
    with the same limits may change; `watch` or `health` goes on from there.

    Each source has timers of event time: that it sends nothing shows once the clock of the stream has
    passed the alarm by `late`. Rows of kind tick, of any source, keep that clock going (a rate source
    makes them). Signals wait in the state until no earlier one can come.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = SourceState(**json.loads(kept.get[0])) if kept.exists else SourceState()
        if not kept.hasTimedOut:
            rows = pd.concat(list(batches))
            state.held += [[float(t), k, float(x)] for t, k, x in zip(rows["clock"], rows["kind"], rows["value"].fillna(0), strict=True) if k != "tick"]
            state.held.sort(key=lambda x: x[0])
        now, out = kept.getCurrentWatermarkMs() / 1000, []

        def say() -> None:
            verdict = state.verdict(stall_s, silence_s)
            if verdict != state.said:
                state.said = verdict
                out.append((str(key[0]), state.clock, *[getattr(state, f) for f in SNAPSHOT]))

        while True:
            coming = state.held[0][0] if state.held and state.held[0][0] <= now else None
            for t in state.rings(stall_s, silence_s):
                if t < coming if coming is not None else t <= now:
                    state.clock = t
                    say()
            if coming is None:
                break
            state.take(*state.held.pop(0), silence_rms)
            say()
        wake = [x[0] for x in state.held[:1]] + state.rings(stall_s, silence_s)[:1]
        kept.update((json.dumps(asdict(state)),))
        if wake:
            kept.setTimeoutTimestamp(int(max(min(wake), now) * 1000) + 1)
        yield pd.DataFrame(out, columns=["source", "clock", *SNAPSHOT])

    rows = signals.select(F.col("source").cast("string"), F.col("clock").cast("double"), "kind", F.col("value").cast("double"), F.timestamp_seconds("clock").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("source").applyInPandasWithState(run, SNAPSHOT_SHAPE, "state string", "append", GroupStateTimeout.EventTimeTimeout)


class SourceAlarms(StatefulProcessor):
    """Health of one source by timers of the clock on the wall: what it reported last, signals that came
    and count, and a timer for the next alarm that rings if nothing more comes."""

    def __init__(self, stall_s: float, silence_s: float, silence_rms: float):
        self.stall_s, self.silence_s, self.silence_rms = stall_s, silence_s, silence_rms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string")

    def _run(self, key: tuple, signals: list, now: float) -> Iterator[pd.DataFrame]:
        state = SourceState(**json.loads(self.state.get()[0])) if self.state.exists() else SourceState()
        out = []

        def say() -> None:
            verdict = state.verdict(self.stall_s, self.silence_s)
            if verdict != state.said:
                state.said = verdict
                out.append((str(key[0]), state.clock, *[getattr(state, f) for f in SNAPSHOT]))

        for coming in [*signals, None]:
            for t in state.rings(self.stall_s, self.silence_s):
                if t < coming[0] if coming else t <= now:
                    state.clock = t
                    say()
            if coming and (state.clock is None or coming[0] >= state.clock):
                state.take(*coming, self.silence_rms)
                say()
            elif coming:  # overtaken by a later one: it counts as if it came with that
                state.take(state.clock, *coming[1:], self.silence_rms)
                say()
        self.state.update((json.dumps(asdict(state)),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for t in state.rings(self.stall_s, self.silence_s)[:1]:
            self.handle.registerTimer(int(max(t, now) * 1000) + 1)
        yield pd.DataFrame(out, columns=["source", "clock", *SNAPSHOT])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        signals = [(float(t), k, float(x)) for t, k, x in zip(pdf["clock"], pdf["kind"], pdf["value"].fillna(0), strict=True) if k != "tick"]
        yield from self._run(key, sorted(signals, key=lambda x: x[0]), timerValues.getCurrentProcessingTimeInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, [], timerValues.getCurrentProcessingTimeInMs() / 1000)

    def close(self) -> None:
        pass


def alarms_stream(signals: DataFrame, stall_s: float = 5, silence_s: float = 300, silence_rms: float = 15) -> DataFrame:
    """signals_stream by timers of processing time: a source that stops alarms although no source sends
    any further row. The clocks of signals are seconds since 1970, as they were sent; a signal that
    was overtaken counts at the time of the one that overtook it. The session keeps its state in RocksDB."""
    rows = signals.select(F.col("source").cast("string").alias("source"), F.col("clock").cast("double").alias("clock"), "kind", F.col("value").cast("double").alias("value"))
    return rows.groupBy("source").transformWithStateInPandas(SourceAlarms(stall_s, silence_s, silence_rms), SNAPSHOT_SHAPE, "append", "processingTime")


class FleetState(StatefulProcessor):
    """The last snapshot of each source, and the state that was told last."""

    def __init__(self, counters: list[str], changes_only: bool):
        self.counters, self.changes_only = counters, changes_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "source string", "snapshot string")
        self.told = handle.getValueState("told", "clock double, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = Fleet(self.counters)
        for (source,), (snapshot,) in self.last.iterator():
            now.put(source, *json.loads(snapshot))
        clock, previous = self.told.get() if self.told.exists() else (None, "ok")
        pdf = pd.concat(list(rows)).sort_values(["clock", "no", "severity"], kind="stable")
        pdf["clock"] = pdf["clock"] if clock is None else pdf["clock"].clip(lower=clock)
        out = []
        for at, same in pdf.groupby("clock", sort=True):
            for x in same.to_dict("records"):
                snapshot = [int(x["severity"]), bool(x["capturing"]), list(x["issues"]), [None if pd.isna(x[c]) else float(x[c]) for c in self.counters]]
                now.put(x["source"], *snapshot)
                self.last.updateValue((x["source"],), (json.dumps(snapshot),))
            row = now.row()
            if not self.changes_only or row[1] != previous:
                out.append((float(at), previous, *row))
            clock, previous = float(at), row[1]
        self.told.update((clock, previous))
        yield pd.DataFrame(out, columns=["clock", "previous", "severity", "state", "capturing", "sources", "issues", *self.counters])

    def close(self) -> None:
        pass


def fleet_stream(snapshots: DataFrame, changes_only: bool = True) -> DataFrame:
    """The fleet over a stream of snapshots of sources, by frames.fleet: one row, with the state before,
    wherever the state changes, or at every instant. One operator holds each source's last snapshot, so
    a source counts with it however long it sends no other. A snapshot from before the last row counts
    at that row's time. The session keeps its state in RocksDB."""
    rows = health(snapshots)
    counters = [c for c in (*SUMS, *LARGEST) if c in rows.columns]
    number = F.col("no") if "no" in rows.columns else F.lit(0).cast("long")
    slim = rows.select(F.col("source").cast("string").alias("source"), F.col("clock").cast("double").alias("clock"), number.alias("no"), "severity", "capturing", "issues", *[F.col(c).cast("double").alias(c) for c in counters])
    slim = slim.withColumn("fleet", F.lit("all"))
    shape = T.StructType([T.StructField("clock", T.DoubleType()), T.StructField("previous", T.StringType()), *fleet_fields(counters)])
    return slim.groupBy("fleet").transformWithStateInPandas(FleetState(counters, changes_only), shape, "append", "none")


def watch(snapshots: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Changes of the fleet's state over a stream of snapshots, with the state before each, to sink(rows,
    batch number). trigger: as of DataStreamWriter.trigger, by default all that is there and then an end."""
    return fleet_stream(snapshots).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
