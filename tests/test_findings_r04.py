"""What the findings of round 4 showed: pairs of voices that take much disk, and too many passes over them."""

import math
import random

import numpy as np
import pytest

from airledger.operators import calibrate, voice
from airledger.plans import catalog

DATA = "/root/testdata/sf0.001"
SAMPLES = "callsign string, ordinal int, vector array<double>"


def test_equal_similarities_leave_a_task_together(spark, tmp_path):
    """What a task of voice_pairs writes is in order of its two columns, so repeated values are short in a file."""
    catalog.queries()["voice_pairs"](spark, DATA).write.parquet(f"{tmp_path}/pairs")
    for file in tmp_path.glob("pairs/*.parquet"):
        rows = [tuple(r) for r in spark.read.parquet(f"file://{file}").coalesce(1).collect()]
        assert rows == sorted(rows)


def test_counted_pairs_are_those_of_the_list(spark, monkeypatch):
    """Rounded similarities, counted by block, against all pairs one by one; no number counts as 1, as in SQL."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "c", None]), k, [rng.gauss(0, 0.6) for _ in range(3)]) for k in range(90)] + [("a", 90, [math.nan, 0.0, 0.0]), ("z", 91, [0.0, 0.0, 0.0]), ("b", 92, None)]
    samples = spark.createDataFrame(rows, SAMPLES)
    for name, value in (("PAIR_BLOCK", 20), ("STRIP", 7), ("ROWS", 50)):
        monkeypatch.setattr(voice, name, value, raising=False)
    made = [(s or "", v) for s, _, v in rows if v]
    dot = lambda u, v: sum(x * y for x, y in zip(u, v, strict=True))
    clip = lambda x: 1.0 if math.isnan(x) else min(1.0, max(0.0, x))
    want = sorted((a == b, math.floor(clip(dot(u, v)) * 1000 + 0.5) / 1000) for i, (a, u) in enumerate(made) for b, v in made[:i])
    assert sorted(map(tuple, voice.voice_pairs(samples, digits=3).collect())) == want
    plain = sorted((r.same, math.floor(r.similarity * 1000 + 0.5) / 1000) for r in voice.voice_pairs(samples).collect())
    assert plain == want


def _cases():
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cone = unit(rng.normal(size=(300, 8)) + 2)
    yield "spread", unit(rng.normal(size=(400, 6))), [f"s{k % 7}" for k in range(400)]
    yield "cone", cone, [f"s{k % 90}" for k in range(300)]
    yield "copies", np.concatenate([cone[:40]] * 6), [f"s{k % 11}" for k in range(240)]
    yield "one voice", np.repeat(cone[:1], 120, axis=0), [f"s{k % 3}" for k in range(120)]
    yield "long", 1e6 * rng.normal(size=(200, 5)), [f"s{k % 5}" for k in range(200)]
    yield "close", unit(np.ones((200, 4)) + 1e-9 * rng.normal(size=(200, 4))) * 0.8, [f"s{k % 5}" for k in range(200)]


@pytest.mark.parametrize(("case", "vectors", "stations"), list(_cases()), ids=[c[0] for c in _cases()])
def test_threshold_takes_two_passes(spark, monkeypatch, case, vectors, stations):
    """The rank, and what is above it, from two passes over the pairs, against a list of all pairs."""
    passes = []
    met = voice.met
    monkeypatch.setattr(voice, "met", lambda *a, **k: passes.append(1) or met(*a, **k))
    for name, value in (("PAIR_BLOCK", 90), ("STRIP", 32), ("TILE", 24), ("ROWS", 64)):
        monkeypatch.setattr(voice, name, value, raising=False)
    samples = spark.createDataFrame([(s, k, v.tolist()) for k, (s, v) in enumerate(zip(stations, vectors, strict=True))], SAMPLES)
    similar, same = np.clip(np.einsum("id,jd->ij", vectors, vectors), 0, 1), np.equal.outer(np.array(stations), np.array(stations))
    upper = np.triu(np.ones_like(same), 1).astype(bool)
    alike, unlike = similar[upper & same], np.sort(similar[upper & ~same])[::-1]
    for target in (0.01, 0.9) if case in ("spread", "copies") else (0.02,):
        passes.clear()
        got = calibrate.calibrate_voice(samples, target=target).first()
        raw = unlike[min(len(unlike) - 1, math.floor(len(unlike) * target))] + 0.005
        assert len(passes) == 2
        assert (got.same_n, got.different_n) == (len(alike), len(unlike))
        assert got.threshold == pytest.approx(min(0.98, max(0.5, raw)), abs=6e-4) and got.margin == pytest.approx(max(0.03, alike.std()), abs=6e-4)
        assert got.recall == pytest.approx((alike >= raw).mean()) and got.false_accepts == pytest.approx((unlike >= raw).mean())
