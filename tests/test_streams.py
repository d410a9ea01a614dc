"""Streams against their batch forms: gated bursts, boards, late lines, the fleet, alarms on the wall's clock."""

import random
import time

from pyspark.sql import functions as F

from airledger.operators import boards, frames, log, windows
from airledger.streaming import live

HEALTH = "source string, clock double, capturing boolean, finished boolean, last_frame double, last_loud double, spill double, buffer_fill double, overflows double"


def stream_of(spark, tmp_path, parts):
    """A stream that gets one part per batch."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={k}"))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def finish(query):
    query.awaitTermination(240)
    assert query.exception() is None


def collected(df, tmp_path, name, mode="append"):
    """All rows of a stream that runs to its end, with the number of their batch."""
    found = []
    finish(df.writeStream.outputMode(mode).foreachBatch(lambda rows, n: found.extend((n, r) for r in rows.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    return found


def test_gated_bursts_in_one_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for source in ("a", "b"):
        loud = False
        for n in range(1500):
            loud = loud if rng.random() < 0.98 else not loud
            rows.append((source, n, rng.uniform(900, 2000) if loud else rng.uniform(310, 700), rng.random() < (0.95 if loud else 0.6)))
    table = spark.createDataFrame(rows, "source string, frame_no long, rms double, is_speech boolean").withColumn("ts", F.timestamp_seconds(F.col("frame_no") * 0.03 + 1e9))
    n, idle = F.col("frame_no"), F.expr("interval 60 seconds")
    after = table.where(n >= 900).withColumn("ts", F.col("ts") + idle)  # an idle gap
    tick = spark.createDataFrame([("z", 0, 0.0, False)], "source string, frame_no long, rms double, is_speech boolean").withColumn("ts", F.timestamp_seconds(F.lit(1e9 + 50)))
    end = tick.withColumn("ts", F.timestamp_seconds(F.lit(1e9 + 500)))
    parts = [table.where((n < 400) | (n == 410)), table.where(((n >= 400) & (n < 410)) | ((n > 410) & (n < 900))), tick, after, end, end.withColumn("frame_no", F.lit(1).cast("long"))]
    got = [r for _, r in collected(live.bursts_stream(stream_of(spark, tmp_path, parts), gate=live.GateRules()), tmp_path, "cp")]
    gated = frames.gate(table)
    # The segmenter closes an open burst at the idle gap, so the batch form sees two sessions' worth of frames.
    want = {(r.source, r.start_offset_ms, r.duration_ms) for r in frames.bursts(gated.where(n < 900)).collect()}
    later = frames.bursts(gated.where(n >= 900)).collect()
    want |= {(r.source, r.start_offset_ms + 900 * 30, r.duration_ms) for r in later}
    plain = {(r.source, r.start_offset_ms, r.duration_ms) for r in frames.bursts(table).collect()}
    assert {(r.source, r.start_offset_ms, r.duration_ms) for r in got if r.source != "z"} == want and len(want) == 6 and want != plain
    assert all(r.ended_at is not None for r in got)


def records(spark, seed, n=160):
    """A log in which lines are logged again: other callsigns, cleared traffic, no match any more."""
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        matched = rng.random() < 0.8
        callsign = rng.choice(["W6ABC", "K7XYZ", "KJ7JXM", "N0CALL", None])
        out.append((rng.choice("st"), seq, rng.randint(0, 25), rng.choice(["entry", "correction", "traffic"]), f"2024-01-01T10:{rng.randint(0, 40):02d}", matched and callsign is not None, callsign, rng.choice(["yes", "yes", "no", ""]), rng.random() < 0.3, rng.choice(["east", "west", "", None]), rng.random() < 0.2))
    return spark.createDataFrame(out, "session string, seq long, id long, type string, timestamp string, matched boolean, matched_callsign string, traffic string, traffic_cleared boolean, source string, escalation_pending boolean")


def rows_of(df, *columns):
    return sorted(tuple(str(x) for x in r) for r in df.select(*columns).collect())


def test_boards_equal_batch_after_each_batch(spark, tmp_path):
    table = records(spark, 1)
    roster = spark.createDataFrame([(0, "W6ABC", "Ann", "gate"), (1, "K7XYZ", "Bo", ""), (2, "AA1A", "", "")], "ordinal int, callsign string, name string, position string")
    cuts = [0, 40, 80, 120, 160]
    parts = [table.where((F.col("seq") >= i) & (F.col("seq") < j)) for i, j in zip(cuts, cuts[1:], strict=False)]
    # The second and third part come in the other order: what is older than a line's row changes nothing.
    stream = stream_of(spark, tmp_path, [parts[0], parts[2], parts[1], parts[3]])
    path = str(tmp_path / "boards")
    finish(live.keep_boards(live.boards_stream(stream), path, str(tmp_path / "cp"), compact_every=2))
    seen = None
    for number, part in enumerate([parts[0], parts[2], parts[1], parts[3]]):
        seen = part if seen is None else seen.union(part)
        state = log.fold_log(seen.withColumnRenamed("seq", "line_no")).withColumn("source", F.coalesce("source", F.lit("")))
        board = live.read_boards(spark, path, number).cache()
        at = ("session", "callsign", "first_seen", "ordinal")
        assert rows_of(live.live_check_ins(board), *at) == rows_of(boards.check_ins(state), *at)
        assert rows_of(live.live_holding(board), *at) == rows_of(boards.holding_traffic(state), *at)
        stats = ("session", "source", "lines", "stations", "outstanding", "awaiting", "total")
        assert rows_of(live.live_stats(board), *stats) == rows_of(boards.log_stats(state), *stats)
        place = ("ordinal", "callsign", "lines", "heard", "holding", "place")
        assert rows_of(live.live_roster(roster, board), *place) == rows_of(boards.board(roster, state), *place)
        assert rows_of(board.where("passed"), "session", "key") == rows_of(boards.passed_traffic(state), "session", "callsign")
    assert (tmp_path / "boards" / "whole" / "generation=2").exists()


def test_an_open_line_holds_whatever_comes_after(spark):
    rows = spark.createDataFrame([("s", k, k, "entry", f"t{k}", True, "W6ABC", t, False, "", False) for k, t in ((1, "yes"), (2, ""))], records(spark, 0, 1).schema)
    assert [(r.key, r.lines, r.holding) for r in live.boards_stream(rows).where("kind = 'station'").collect()] == [("W6ABC", 2, True)]


def test_late_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.choice("st"), k, None if k == 7 else f"10:{rng.randint(0, 59):02d}", k % 3) for k in range(120)], "session string, arrival long, timestamp string, id int")
    parts = [rows.where(F.col("arrival").between(i, i + 29)).orderBy(F.rand(1)) for i in range(0, 120, 30)]
    got = [r for _, r in collected(live.late_stream(stream_of(spark, tmp_path, parts)), tmp_path, "cp")]
    want = {r.arrival: r.late for r in live.mark_late(rows).collect()}
    assert {r.arrival: r.late for r in got} == want and len(got) == 120 and 20 < sum(want.values()) < 110


def health_rows(spark, rows):
    """(source, clock, capturing, silent since, spill, overflows)"""
    return spark.createDataFrame([(s, float(t), up, False, float(t), float(t), float(spill), 0.0, float(over)) for s, t, up, spill, over in rows], HEALTH)


REPORTS = [("a", 1, False, 0, 1), ("b", 2, True, 3, 2), ("b", 3, True, 2, 2), ("a", 4, True, 0, 5), ("c", 5, True, 1, 0), ("c", 6, True, 0, 0), ("b", 6, True, 0, 2), ("a", 9, True, 0, 5)]


def test_a_failed_source_stays_failed_while_others_report(spark):
    found = frames.fleet(frames.health(health_rows(spark, REPORTS))).orderBy("clock").collect()
    assert [(r.clock, r.state, r.spill, r.overflows, r.sources) for r in found] == [
        (1, "error", 0, 1, 1), (2, "error", 3, 3, 2), (3, "error", 2, 3, 2), (4, "warning", 2, 7, 2), (5, "warning", 2, 7, 3), (6, "warning", 0, 7, 3), (9, "warning", 0, 7, 3)
    ]
    assert found[0].issues == ["not capturing", "overflows"] and found[1].issues[:2] == ["a: not capturing", "a: overflows"]


def test_fleet_in_chunks(spark, monkeypatch):
    rng = random.Random(3)
    rows = health_rows(spark, [(f"s{rng.randint(0, 6)}", k // 2, rng.random() < 0.8, rng.randint(0, 1), rng.randint(0, 4)) for k in range(600)])
    table = frames.health(rows.withColumn("no", F.monotonically_increasing_id())).cache()
    whole = sorted(map(tuple, frames.fleet(table).collect()), key=lambda x: x[0])
    monkeypatch.setattr(frames, "FLEET_ROWS", 20)
    assert sorted(map(tuple, frames.fleet(table).collect()), key=lambda x: x[0]) == whole and len(whole) == 300
    assert frames.fleet(table.limit(0)).count() == 0


def test_fleet_stream_equals_batch(spark, tmp_path):
    parts = [health_rows(spark, [x for x in REPORTS if x[1] in clocks]) for clocks in ((1, 2), (3,), (4, 5, 6), (9,))]
    stream = stream_of(spark, tmp_path, parts)
    batch = frames.fleet(frames.health(health_rows(spark, REPORTS)))
    every = [r for _, r in collected(live.fleet_stream(stream, changes_only=False), tmp_path, "every")]
    columns = [c for c in batch.columns]
    assert sorted(tuple(r[c] for c in columns) for r in every) == sorted(tuple(r) for r in batch.collect())
    found = []
    finish(live.watch(stream, lambda df, n: found.extend((r.clock, r.previous, r.state) for r in df.collect()), str(tmp_path / "watch")))
    changes = windows.state_changes(batch.withColumn("all", F.lit(0)), ["all"], "clock").orderBy("clock")
    assert found == [(r.clock, r.previous, r.state) for r in changes.collect()] == [(1.0, "ok", "error"), (4.0, "error", "warning")]


def test_heartbeat_repeats_what_holds(spark):
    fleet = frames.fleet(frames.health(health_rows(spark, REPORTS)))
    got = [(r.beat, r.state, r.overflows) for r in frames.heartbeat(fleet, 2).orderBy("beat").collect()]
    assert got == [(2, "error", 3), (4, "warning", 7), (6, "warning", 7), (8, "warning", 7), (10, "warning", 7)]


def test_a_source_that_stops_alarms_without_further_rows(spark, tmp_path):
    now = time.time()
    shape = "source string, clock double, kind string, value double"
    part = spark.createDataFrame([("a", now, "started", 0.0), ("b", now, "started", 0.0), ("a", now + 0.1, "frame", 60.0), ("b", now + 0.1, "finished", 0.0)], shape)
    found = []
    watched = live.fleet_stream(live.alarms_stream(stream_of(spark, tmp_path, [part]), stall_s=2, silence_s=60)
                                )
    # The limits of the verdict are those of the alarms; here both are short.
    query = watched.writeStream.foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    until = time.time() + 90
    while time.time() < until and not found and query.exception() is None:
        time.sleep(0.5)
    query.stop()
    assert query.exception() is None and [(r.previous, r.state, r.issues) for r in found] == [("ok", "error", ["a: no audio frames"])]
