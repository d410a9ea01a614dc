"""Refusals, folds, bursts, splits, readers and streams on small fixtures."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from airledger.functions.text import after_ms, level
from airledger.operators import calibrate, frames, history, log, match, split, voice
from airledger.sources import readers, writers
from airledger.streaming import live

ROSTER = "ordinal int, callsign string, name string, position string, sources array<string>"


@pytest.fixture()
def roster(spark):
    return spark.createDataFrame([(0, "W6ABC", "Ann", "start", []), (1, "K7XYZ", "Bo", "", ["east"]), (2, "K7XYA", "Cy", "", [])], ROSTER)


def test_match_refuses(spark, roster):
    cands = spark.createDataFrame([("W6ABC",), ("W6ABD",), ("K7XY",), ("K7XYZ",), ("QQ9QQQ",), ("",)], "candidate string")
    aliases = spark.createDataFrame([("QQ9QQQ", "W6ABC")], "candidate string, callsign string")
    got = {r.candidate: (r.callsign, r.reason) for r in match.match_candidates(cands, roster).collect()}
    assert got == {"W6ABC": ("W6ABC", None), "W6ABD": ("W6ABC", None), "K7XY": (None, "ambiguous"), "K7XYZ": ("K7XYZ", None), "QQ9QQQ": (None, "below_threshold")}
    assert {r.candidate: r.callsign for r in match.match_candidates(cands, roster, aliases).collect()}["QQ9QQQ"] == "W6ABC"
    assert {r.reason for r in match.match_candidates(cands, roster.limit(0)).collect()} == {"no_candidate"}


def test_blocked_join_equals_broadcast(spark, roster, monkeypatch):
    cands = spark.createDataFrame([("W6ABC",), ("W6ABD",), ("K7XY",), ("K7XYZ",)], "candidate string")
    whole = match.match_candidates(cands, roster).select("candidate", "callsign", "reason").orderBy("candidate").collect()
    monkeypatch.setattr(match, "BROADCAST_ROSTER", 0)
    assert match.match_candidates(cands, roster).select("candidate", "callsign", "reason").orderBy("candidate").collect() == whole


def test_large_roster_gives_the_same_rows(spark, monkeypatch):
    names = [f"{chr(65 + i % 26)}{chr(65 + i // 26 % 26)}{i % 10}{chr(65 + i * 3 % 26)}{chr(65 + i * 5 % 26)}A" for i in range(600)]
    roster = spark.createDataFrame([(i, x, f"n{i}", "", []) for i, x in enumerate(names)], ROSTER)
    cands = spark.createDataFrame([(x,) for x in ("AA0AAA", "AA0AAQ", "BC7", "ZZ9ZZZ", "QQ", "")], "candidate string")
    lines = spark.createDataFrame([("s", 1, "AA0AAQ here"), ("s", 2, "ZZ9ZZZ calling"), ("s", 3, "nothing")], "session string, id int, raw_text string")
    run = lambda: [sorted(map(str, df.collect())) for df in (match.match_candidates(cands, roster), match.match_lines(lines, roster), match.match_all(lines, roster), match.nearest(cands, roster))]
    blocked = run()
    monkeypatch.setattr(match, "BROADCAST_ROSTER", 10_000)
    assert blocked == run()
    assert len(blocked[3]) == 5 * 8


def test_lines(spark, roster):
    lines = spark.createDataFrame([("s", 1, "whiskey six alpha bravo charlie, go"), ("s", 2, "nothing here"), ("s", 3, "K7XYZ for W6ABC, K7XYZ")], "session string, id int, raw_text string")
    got = {r.id: (r.callsign, r.reason) for r in match.match_lines(lines, roster).collect()}
    assert got == {1: ("W6ABC", None), 2: (None, "no_candidate"), 3: ("K7XYZ", None)}
    assert [(r.id, r.callsign) for r in match.match_all(lines, roster).orderBy("id", "pos").collect()] == [(1, "W6ABC"), (3, "K7XYZ"), (3, "W6ABC")]


def pattern(spark, flags):
    return spark.createDataFrame([("a", i, c == "S") for i, c in enumerate(flags)], "source string, frame_no long, is_speech boolean")


@pytest.mark.parametrize(
    ("flags", "expected"),
    [("." * 50, []), ("." * 20 + "S" * 40 + "." * 40, [(540, 1260)]), ("S" * 5 + "." * 60, []), ("S" * 40, [(0, 1200)]), ("S" * 8 + "." * 60, []), ("S" * 30 + "." * 10 + "S" * 30 + "." * 40, [(0, 2100)])],
)
def test_bursts(spark, flags, expected):
    assert [(r.start_offset_ms, r.duration_ms) for r in frames.bursts(pattern(spark, flags)).orderBy("seq").collect()] == expected


def test_bursts_stream_equals_batch(spark, tmp_path):
    flags = "." * 20 + "S" * 40 + "." * 40 + "S" * 30 + "." * 40
    rows = pattern(spark, flags).withColumn("ts", F.timestamp_seconds(F.col("frame_no") * 0.03 + 1e9))
    rows.where("frame_no < 70").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("frame_no >= 70").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.bursts_stream(stream).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {(r.start_offset_ms, r.duration_ms) for r in frames.bursts(rows).collect()}
    assert {(r.start_offset_ms, r.duration_ms) for r in spark.table("found").collect()} == want and want


def test_split_and_refusals(spark):
    clips = spark.createDataFrame([(1, "AB1CDE over FG2HIJ here", 4000, False), (2, "AB1CDE over FG2HIJ here", 4000, False), (3, "AB1CDE over FG2HIJ here", 4000, True), (4, "AB1CDE over", 900, False)], "clip int, text string, duration_ms long, suspect boolean")
    words = [(c, k, w, 0.3 * k + gap * (k >= 2), 0.3 * k + 0.3 + gap * (k >= 2), o) for c, gap in ((1, 1.0), (2, 0.1), (3, 1.0)) for k, (w, o) in enumerate((("AB1CDE", 0), ("over", 7), ("FG2HIJ", 12), ("here", 19)))]
    words = spark.createDataFrame(words, "clip int, word_no int, text string, start double, end double, offset int")
    named = spark.createDataFrame([(c, "AB1CDE", 0, 6) for c in (1, 2, 3, 4)] + [(c, "FG2HIJ", 12, 18) for c in (1, 2, 3)], "clip int, callsign string, start int, end int")
    got = split.split_transmissions(clips, words, named).orderBy("clip", "seg_no").collect()
    assert [(r.clip, r.text, r.start_offset_ms, r.duration_ms) for r in got] == [(1, "AB1CDE over", 0, 1600), (1, "FG2HIJ here", 1600, 2400), (2, "AB1CDE over FG2HIJ here", 0, 4000), (3, "AB1CDE over FG2HIJ here", 0, 4000), (4, "AB1CDE over", 0, 900)]


def test_voice(spark):
    rows = spark.createDataFrame([("A", 0, [1.0, 0.0]), ("A", 1, [0.8, 0.6]), ("B", 2, [0.0, 1.0]), ("B", 3, [0.0, 2.0]), ("C", 4, [1.0, 0.0])], "callsign string, ordinal int, vector array<double>")
    profiles = voice.build_profiles(rows)
    got = {r.callsign: r for r in profiles.collect()}
    assert got["A"].n == 2 and abs(sum(x * x for x in got["A"].centroid) - 1) < 1e-9 and got["B"].centroid == [0.0, 1.0]
    clips = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.7071, 0.7071])], "clip int, vector array<double>")
    assert {r.clip: (r.callsign, r.reason) for r in voice.identify(clips, profiles, margin=0.5).collect()} == {1: ("B", None), 2: (None, "too close")}
    assert {r.clip: (r.callsign, r.reason) for r in voice.identify(clips, profiles.where("n > 9")).collect()} == {1: (None, "no profiles"), 2: (None, "no profiles")}


def test_identify_in_blocks(spark):
    rng = random.Random(8)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    make = lambda n: [(str(k), 2, unit([rng.gauss(0, 1) for _ in range(6)])) for k in range(n)]
    profiles = spark.createDataFrame(make(60) + [("twin", 2, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), ("twin2", 2, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "callsign string, n int, centroid array<double>")
    clips = spark.createDataFrame([(int(k), v) for k, _, v in make(30)] + [(30, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "clip int, vector array<double>")
    whole, parts = (sorted(map(tuple, voice.identify(clips, profiles, block=b).collect())) for b in (100, 7))
    assert whole == parts and len(whole) == 31 and whole[30][3:] == ("twin", 1.0, "too close")


def test_voice_threshold_from_blocks(spark, monkeypatch):
    """All pairs in blocks and strips, and a rank that is found by cutting bins, against all pairs in a list."""
    rng = random.Random(3)
    rows = [(f"s{k % 9}", k, [rng.gauss(0, 1) + (4 if i == k % 9 else 0) for i in range(12)]) for k in range(150)] + [("s1", 150, [1.0] * 12), ("s2", 151, [1.0] * 12)]
    unit = [(s, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for s, _, v in rows]
    pairs = [(a[0] == b[0], min(1.0, max(0.0, sum(x * y for x, y in zip(a[1], b[1], strict=True))))) for i, a in enumerate(unit) for b in unit[:i]]
    different, same = sorted((x for k, x in pairs if not k), reverse=True), [x for k, x in pairs if k]
    monkeypatch.setattr(voice, "STRIP", 7)
    samples = spark.createDataFrame([(s, i, v) for (s, v), (_, i, _) in zip(unit, rows, strict=True)], "callsign string, ordinal int, vector array<double>")
    monkeypatch.setattr(voice, "PAIR_BLOCK", 20)
    assert sorted((r.same, round(r.similarity, 9)) for r in voice.voice_pairs(samples).collect()) == sorted((k, round(x, 9)) for k, x in pairs)
    for rank in (0, 1, 40, 2000, len(different) - 1):
        assert voice.ranked_similarity(samples, rank, few=1) == pytest.approx(different[rank], abs=1e-12)
    got = calibrate.calibrate_voice(samples, target=0.02).first()
    raw = different[int(len(different) * 0.02)] + 0.005
    mean = sum(same) / len(same)
    assert got.threshold == pytest.approx(round(min(0.98, max(0.5, raw)), 3)) and (got.same_n, got.different_n) == (len(same), len(different))
    assert got.margin == pytest.approx(round(max(0.03, math.sqrt(sum((x - mean) ** 2 for x in same) / len(same))), 3))
    assert got.recall == pytest.approx(sum(x >= raw for x in same) / len(same)) and got.false_accepts == pytest.approx(sum(x >= raw for x in different) / len(different))
    assert {r.same: round(r.mean_similarity, 9) for r in voice.separation(samples).collect()} == {True: round(mean, 9), False: round(sum(different) / len(different), 9)}
    assert calibrate.calibrate_voice(samples.limit(3)).first().note == "too few pairs"


def test_profiles_go_on_from_stored_ones(spark):
    rng = random.Random(8)
    rows = [(f"s{k % 3}", k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(60)] + [("new", 90, [1.0, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "callsign string, ordinal int, vector array<double>")
    stored = voice.build_profiles(table.where("ordinal < 40 and callsign <> 's2'"))
    later = table.where("ordinal >= 40 or callsign = 's2'").union(table.where("ordinal in (3, 39)"))
    profiles, refused = voice.extend_profiles(stored, later)
    plain = lambda df: {r.callsign: ([round(x, 9) for x in r.centroid], r.n, [[round(x, 9) for x in s] for s in r.samples], r.through) for r in df.collect()}
    assert plain(profiles) == plain(voice.build_profiles(table)) and len(plain(profiles)) == 4
    assert sorted((r.callsign, r.ordinal) for r in refused.collect()) == [("s0", 3), ("s0", 39)]
    same, none = voice.extend_profiles(stored, later.limit(0))
    assert plain(same) == plain(stored) and none.count() == 0


def test_level_and_offset(spark):
    rows = spark.createDataFrame([(1, None), (2, -1.0), (3, 1.0), (4, 80.0), (5, 8000.0), (6, 1e9)], "k int, r double")
    assert [round(x.l, 3) for x in rows.select(level(F.col("r")).alias("l")).collect()] == [0, 0, 0, 0.488, 1, 1]
    times = spark.sql("SELECT '2024-02-28T23:59:59.900' AS t, 1100 AS ms UNION ALL SELECT '2024-03-01 00:00:00', null UNION ALL SELECT null, 5")
    assert {x.a for x in times.select(after_ms(F.col("t"), F.col("ms")).alias("a")).collect()} == {"2024-02-29T00:00:01.000", None}


def test_readers(spark, tmp_path):
    (tmp_path / "log").mkdir()
    entry = {"type": "entry", "id": 1, "raw_text": "one", "matched": True}
    lines = [json.dumps({"type": "session"}), json.dumps(entry), "", json.dumps(entry | {"type": "correction", "raw_text": "two", "unknown": 3}), json.dumps(entry | {"id": 0}), '{"type": "entry", "id": 2, "raw']
    (tmp_path / "log" / "net-a.jsonl").write_text("\n".join(lines))
    records = readers.read_sessions(spark, str(tmp_path / "log"))
    assert [(r.session, r.id, r.raw_text) for r in log.fold_log(records).collect()] == [("net-a", 1, "two")]
    assert log.fold_log(records, keep_zero=True).count() == 2
    assert readers.latest_session(spark, str(tmp_path / "log")).first().session == "net-a"
    (tmp_path / "r.csv").write_text("# roster\ncallsign,position,name,sources\nw6abc,start,Ann,\"east;west\"\n,,,\nW6ABC,again,,\nk7xyz,,Bo,\n")
    (tmp_path / "s.csv").write_text("n5def,Cy,east|west,gate\n")
    (tmp_path / "t.csv").write_text("callsign" + ",x" * 9 + ",name\nn6def" + "," * 10 + "Di\n")
    got = [(r.ordinal, r.callsign, r.name, r.position, r.sources) for r in readers.read_roster(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [(0, "W6ABC", "Ann", "start", ["east", "west"]), (1, "K7XYZ", "Bo", "", []), (2, "N5DEF", "Cy", "gate", ["east", "west"]), (3, "N6DEF", "Di", "", [])]
    label = {"timestamp": "t", "entry_id": 1, "candidate": "W6ABD", "from_callsign": None, "to_callsign": "W6ABC", "raw_text": "x", "more": 1}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "f.jsonl").write_text(json.dumps(label) + "\n" + json.dumps({k: v for k, v in label.items() if k != "from_callsign"}) + "\nnot json\n")
    assert [r.to_callsign for r in readers.read_corrections(spark, str(tmp_path / "c")).collect()] == ["W6ABC"]
    for engine, clip, words in (("a", "1", "hello"), ("a", "2", "there"), ("b", "1", "hallo")):
        (tmp_path / engine).mkdir(exist_ok=True)
        (tmp_path / engine / f"{clip}.txt").write_text(words)
    texts = readers.read_clip_texts(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")})
    assert {(r.engine, r.clip): r.text for r in texts.collect()} == {("a", "1"): "hello", ("a", "2"): "there", ("b", "1"): "hallo", ("b", "2"): ""}


def test_writers_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", True, "W6ABC", "hi")], "id long, timestamp string, matched boolean, matched_callsign string, raw_text string")
    writers.export_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().matched_callsign == "W6ABC"
    profiles = voice.build_profiles(spark.createDataFrame([("A", 0, [1.0, 0.0])], "callsign string, ordinal int, vector array<double>"))
    writers.write_profiles(profiles, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first()["count"] == 1


def test_recordings(spark):
    files = spark.createDataFrame([("a", 30.0), ("b", 90.0), ("c", 90.0)], "file string, seconds double")
    assert [r.file for r in readers.new_recordings(files, files.where("file = 'c'")).collect()] == ["b"]
    finished = spark.createDataFrame([("a.b.wav", 12.34), ("gone.wav", 1.0)], "file string, took_seconds double")
    assert [tuple(r) for r in readers.manifest_rows(spark.createDataFrame([("a.b.wav", 99), ("new.wav", 70)], "file string, seconds int"), finished).collect()] == [("a.b.wav", "net-a.b.jsonl", 1.6, 12.3)]


def stream_of(spark, tmp_path, parts):
    """A stream that gets one part per batch."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={k}"))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def run_stream(query):
    query.awaitTermination(180)
    assert query.exception() is None


def timed(rows):
    return rows.withColumn("ts", F.timestamp_seconds(F.col("frame_no") * 0.03 + 1e9))


def test_bursts_stream_keeps_its_place_over_an_idle_gap_and_late_frames(spark, tmp_path):
    flags = "S" * 20 + "." * 40 + "S" * 40 + "." * 40
    rows = timed(pattern(spark, flags))
    later = rows.where("frame_no >= 60").withColumn("ts", F.col("ts") + F.expr("interval 60 seconds"))
    tick = spark.createDataFrame([("z", 0, False)], "source string, frame_no long, is_speech boolean").withColumn("ts", F.timestamp_seconds(F.lit(1e9 + 50)))
    parts = [rows.where("frame_no < 20 or frame_no between 25 and 40"), rows.where("frame_no between 20 and 24 or frame_no between 41 and 59"), tick, later]
    query = live.bursts_stream(stream_of(spark, tmp_path, parts), min_clip_ms=300).writeStream.format("memory").queryName("gap").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run_stream(query)
    want = {(r.start_offset_ms, r.duration_ms) for r in frames.bursts(rows, min_clip_ms=300).collect()}
    assert {(r.start_offset_ms, r.duration_ms) for r in spark.table("gap").where("source = 'a'").collect()} == want and len(want) == 2


def test_gate_stream_equals_batch(spark, tmp_path):
    rows = timed(spark.range(600).select(F.lit("a").alias("source"), F.col("id").alias("frame_no"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 250).cast("double").alias("rms"), F.lit(True).alias("is_speech")))
    stream = stream_of(spark, tmp_path, [rows.where("frame_no < 250 or frame_no = 251"), rows.where("frame_no = 250 or frame_no > 251")])
    query = live.gate_stream(stream).writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run_stream(query)
    want = {(r.frame_no, round(r.floor, 6), r.open) for r in frames.noise_gate(rows).collect()}
    assert {(r.frame_no, round(r.floor, 6), r.open) for r in spark.table("gated").collect()} == want


def signals(spark, rows):
    return spark.createDataFrame([(s, float(t), k, None if x is None else float(x)) for s, t, k, x in rows], "source string, clock double, kind string, value double")


STORY = [("a", 1, "frame", 50), ("a", 2, "started", None), ("a", 4, "frame", 50), ("a", 12, "frame", 3), ("a", 13, "failed", None), ("a", 40, "started", None), ("a", 44, "frame", 50), ("a", 45, "spill", 2), ("a", 46, "spill", 0),
         ("a", 47, "finished", None), ("b", 3, "started", None), ("b", 6, "frame", 60), ("b", 50, "tick", None), ("c", 5, "started", None)] + [("c", t, "frame", 1) for t in range(6, 30)]
WANTED = {
    "a": [(1.0, "error"), (2.0, "ok"), (9.001, "error"), (12.0, "ok"), (13.0, "error"), (40.0, "ok"), (45.0, "warning"), (46.0, "ok")],
    "b": [(11.001, "error")],
    "c": [(15.001, "warning")],
}


def changes(rows):
    by = {}
    for r in sorted(rows, key=lambda r: r.clock):
        seen = by.setdefault(r.source, [(0, "ok")])
        if r.state != seen[-1][1]:
            seen.append((round(r.clock, 3), r.state))
    return {k: x[1:] for k, x in by.items()}


def test_alarms_for_what_is_missing(spark):
    found = frames.health(frames.snapshots(signals(spark, STORY), silence_s=10), silence_s=10)
    assert changes(found.collect()) == WANTED


def test_signals_stream_equals_batch(spark, tmp_path):
    early, late = [x for x in STORY if x[1] < 10], [x for x in STORY if x[1] >= 10]
    parts = [signals(spark, early[1:] + late[:1]), signals(spark, early[:1]), signals(spark, late[1:]), signals(spark, [("", 100, "tick", None)]), signals(spark, [("", 101, "tick", None)])]
    rows = frames.health(live.signals_stream(stream_of(spark, tmp_path, parts), silence_s=10), silence_s=10)
    query = rows.writeStream.format("memory").queryName("signals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run_stream(query)
    got = changes(spark.table("signals").collect())
    # The stream goes on after the last frame of c, which then stalls.
    assert got == WANTED | {"c": [(15.001, "warning"), (34.001, "error")]}


def test_noise_gate_over_chunks(spark, monkeypatch):
    rows = spark.range(1500).select(F.lit("a").alias("source"), F.col("id").alias("frame_no"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 250).cast("double").alias("rms"))
    whole = {tuple(r) for r in frames.noise_gate(rows).collect()}
    monkeypatch.setattr(frames, "CHUNK_FRAMES", 1)
    assert {tuple(r) for r in frames.noise_gate(rows).collect()} == whole and len(whole) == 1500


def test_draft_as_a_file(spark, tmp_path):
    mined = spark.createDataFrame([("W6ABC", True), ("K7XYZ", True), ("K7AAA", True), ("K7BBB", False)], "callsign string, likely boolean")
    checked = spark.createDataFrame([("K7AAA", "not issued"), ("W6ABC", "active")], "callsign string, status string")
    lines = history.draft_lines(mined, spark.createDataFrame([("s",), ("t",), ("s",)], "session string"), checked)
    writers.write_draft(lines, str(tmp_path / "draft"))
    text = [r.value for r in spark.read.text(str(tmp_path / "draft")).collect()]
    assert text[0] == "# Draft roster from 2 sessions. Nobody has checked it." and text[1].endswith(": 1") and text[3:] == ["callsign,name,sources,position", "K7XYZ,,,", "W6ABC,,,"]
    assert [r.callsign for r in readers.read_roster(spark, str(tmp_path / "draft"), "*.txt").orderBy("ordinal").collect()] == ["K7XYZ", "W6ABC"]


def test_heartbeat_and_live_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    records = [{"type": "entry", "session": "s", "seq": k, "id": k, "timestamp": f"2024-01-01 10:00:{k:02d}", "matched": k % 2 == 0, "source": "east"} for k in range(4)]
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, records)))
    lines = readers.stream_sessions(spark, str(tmp_path / "log")).withColumn("ts", F.to_timestamp("timestamp"))
    query = live.heartbeat(lines).writeStream.format("memory").queryName("beat").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run_stream(query)
    assert [(r.source, r.lines, r.matched) for r in spark.table("beat").collect()] == [("east", 4, 2)]


def test_enrichment(spark, roster, tmp_path):
    lines = spark.createDataFrame([("s", 1, "whiskey six alpha bravo charlie with traffic"), ("s", 2, "QQ9QQQ here"), ("s", 3, "K7XYZ and W6ABC, K7XYA")], "session string, id int, raw_text string")
    aliases = spark.createDataFrame([("QQ9QQQ", "W6ABC")], "candidate string, callsign string")
    found = {}
    run_stream(live.enrich_stream(stream_of(spark, tmp_path, [lines]), roster, lambda: aliases, lambda df, n: found.update({r.id: (r.callsign, r.declared, r.suspect, r.via_alias) for r in df.collect()}), str(tmp_path / "cp")))
    assert found == {1: ("W6ABC", "yes", False, False), 2: ("W6ABC", "", False, True), 3: ("K7XYZ", "", True, False)}


def test_lcs_of_short_and_long_strings(spark):
    from airledger.functions.text import lcs_length

    df = spark.createDataFrame([("AB" * 40, "BA" * 40, 79), ("K7XYZ", "K7" + "Q" * 70 + "XYZ", 5), ("A" * 61, "A" * 61, 61), ("A" * 80, "B" * 60, 0), ("ÄB", "BÄB", 2), ("", "A", 0)], "a string, b string, n int")
    assert all(r.n == r.got for r in df.withColumn("got", lcs_length(F.col("a"), F.col("b"))).collect())


def test_unsupported_clips(spark):
    rows = spark.createDataFrame([(k, "AB1C", k % 2 == 0) for k in range(20)], "clip int, callsign string, supported boolean")
    texts = spark.createDataFrame([(e, k, f"{e}{k}") for e in "xy" for k in range(20)], "engine string, clip int, text string")
    assert sorted({r.clip for r in match.unsupported_clips(rows, texts).collect()}) == [1, 3, 5, 7, 9, 11]
