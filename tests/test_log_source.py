"""The splitting source of log lines against reading files whole, in batches and as a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from airledger.operators import log
from airledger.sources import lines, readers


def record(rng, k):
    text = rng.choice(["", "é", "ünïcode ☃", "a" * rng.randint(0, 90)])
    return json.dumps({"type": rng.choice(["entry", "correction"]), "id": rng.randint(1, 20), "timestamp": f"t{k}", "raw_text": text}, ensure_ascii=False)


def write(path, seed, n=150, torn=True):
    rng = random.Random(seed)
    body = "".join(record(rng, k) + rng.choice(["\n", "\r\n", "\n\n", "\n  \n", "\nnot json\n"]) for k in range(n))
    path.write_bytes((body + ('{"type": "entry", "id": 3, "raw_te' if torn else "")).encode())


@pytest.mark.parametrize("split", [1 << 20, 700, 37])
def test_splits_give_the_same_lines(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(lines, "READ_BYTES", 64)
    for k in range(3):
        write(tmp_path / f"net-{k}.jsonl", k, torn=k != 1)
    (tmp_path / "net-empty.jsonl").write_text("")
    (tmp_path / "other.txt").write_text("x")
    columns = ["session", "type", "id", "timestamp", "raw_text"]
    order = ["session", "line_no"]
    whole = [tuple(r) for r in readers.read_sessions(spark, str(tmp_path)).orderBy(*order).select(*columns).collect()]
    parts = readers.split_log(spark, str(tmp_path), split_bytes=split)
    assert [tuple(r) for r in parts.orderBy(*order).select(*columns).collect()] == whole and len(whole) == 450
    assert parts.rdd.getNumPartitions() >= 3 * (1 if split > 1000 else 10)
    folded = [sorted(tuple(r) for r in log.fold_log(df).select(*columns).collect()) for df in (readers.read_sessions(spark, str(tmp_path)), parts)]
    assert folded[0] == folded[1]


def test_a_line_longer_than_a_split(spark, tmp_path):
    text = "y" * 5000
    (tmp_path / "net-a.jsonl").write_text(json.dumps({"type": "entry", "id": 1, "raw_text": text}) + "\n" + json.dumps({"type": "entry", "id": 2, "raw_text": "z"}))
    got = readers.split_log(spark, str(tmp_path), split_bytes=100).orderBy("line_no").select("id", "raw_text").collect()
    assert [tuple(r) for r in got] == [(1, text), (2, "z")]


def test_following_a_log(spark, tmp_path):
    folder, found = tmp_path / "log", []
    folder.mkdir()
    path = folder / "net-a.jsonl"

    def run():
        query = readers.follow_log(spark, str(folder), split_bytes=50).writeStream.foreachBatch(lambda df, n: found.extend((r.id, r.line_no) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    one = [json.dumps({"type": "entry", "id": k, "raw_text": "é" * k}) for k in range(1, 6)]
    path.write_text("\n".join(one[:2]) + "\n" + one[2][:20])
    run()
    assert sorted(i for i, _ in found) == [1, 2]
    path.write_text("\n".join(one[:4]) + "\n" + one[4])
    (folder / "net-b.jsonl").write_text(json.dumps({"type": "entry", "id": 9}) + "\n")
    run()
    assert sorted(i for i, _ in found) == [1, 2, 3, 4, 9]
    starts = {k + 1: sum(len(x.encode()) + 1 for x in one[:k]) for k in range(4)}
    assert {i: at for i, at in found if i != 9} == starts
