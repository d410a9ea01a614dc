"""Normalisation, mentions, traffic and echo rules on hand-made lines."""

import pytest
from pyspark.sql import functions as F

from airledger.functions.geo import grid_latitude, grid_longitude
from airledger.functions.text import indel_ratio
from airledger.operators import text

SPOKEN = [
    ("Papa Four Golf Hotel India", "P4GHI"),
    ("hello, tango nine leema mic november", "T9LMN"),
    ("romeo two x-ray golf viktor, back to control", "R2XGV"),
    ("sierra three tango uniform victor for the station", "S3TUV"),
    ("juliet oscar niner papa quebec", "JO9PQ"),
    ("golf four hotelindia juliet", "G4HIJ"),
    ("good evening, standing by", ""),
    ("lima to mike", "L2M"),
    ("oscar 7th papa romeo", "O7PR"),
    ("echo india 5tango uniform", "EI5TU"),
    ("juliet oscar 9 or papa quebec", "JO9PQ"),
    ("juliet oscar 9er papa quebec", "JO9PQ"),
    ("gate44 is shut", "GATE44 SHUT"),
    ("romeo 2XGV, good morning", "R2XGV"),
    ("RG2-TLP", "RG2TLP"),
    ("are gee two tee el pee", "RG2TLP"),
    ("double u four tea you vee", "W4TUV"),
    ("oh, I see why", "I SEE WHY"),
    ("quebec romeo IV papa romeo", "QR4PR"),
]


def test_normalise(spark):
    df = spark.createDataFrame([*SPOKEN, (None, None)], "t string, e string")
    rows = text.normalise(df, "t").select("t", "e", "normalised").collect()
    assert {r.t: r.normalised for r in rows} == {t: e for t, e in SPOKEN} | {None: None}


def test_spans_and_mentions(spark):
    df = spark.createDataFrame([("s", 1, "over, Whiskey six alpha bravo charlie and K7XYZ, K7XYZ")], "session string, id int, t string")
    rows = text.mentions(text.normalise(df, "t")).orderBy("pos").collect()
    assert [(r.candidate, r.start, r.end, r.best_rank) for r in rows] == [("W6ABC", 6, 37, 0), ("K7XYZ", 42, 47, 1), ("K7XYZ", 49, 54, 2)]


@pytest.mark.parametrize(
    ("line", "declared"),
    [("holding one piece of traffic", "yes"), ("anybody with traffic", ""), ("we carry no traffic", "no"), ("nothing further from the gate", "no"), ("one message for the tower", "yes"), ("traffic lights are out", ""), ("no traffic from me, Bo got traffic", "yes"), (None, ""), ("", "")],
)
def test_traffic(spark, line, declared):
    assert text.detect_traffic(spark.createDataFrame([(line,)], "t string"), "t").first().declared == declared


def test_echo(spark):
    lines = spark.createDataFrame([("s", 1, "W6ABC K7XYZ N5DEF"), ("s", 2, "here W6ABC W6ABC W6ABC"), ("s", 3, "W6ABC K7XYZ"), ("s", 4, "alpha bravo charlie delta"), ("s", 5, "alpha bravo charlie delta"), ("s", 6, "W6ABC with traffic for K7XYZ")], "session string, id int, raw_text string")
    named = [(1, ["W6ABC", "K7XYZ", "N5DEF"]), (2, ["W6ABC"] * 3), (3, ["W6ABC", "K7XYZ"]), (5, ["W6ABC"]), (6, ["W6ABC", "K7XYZ"])]
    matches = spark.createDataFrame([("s", i, k, c) for i, cs in named for k, c in enumerate(cs)], "session string, id int, pos int, callsign string")
    assert {r.id: r.suspect for r in text.flag_echo(lines, matches).collect()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}


def test_indel_ratio_and_grids(spark):
    df = spark.createDataFrame([("W6ABC", "W6ABD", 80.0), ("W6ABC", "W6ABC", 100.0), ("A", "B", 0.0), ("ABC", "", 0.0), ("KD9MNO", "K9MNO", 1000 / 11)], "a string, b string, s double")
    assert all(abs(r.x - r.s) < 1e-9 for r in df.withColumn("x", indel_ratio(F.col("a"), F.col("b"))).collect())
    g = spark.createDataFrame([("CN87",), ("cn87ts",), ("x",)], "g string").select(grid_latitude(F.col("g")).alias("a"), grid_longitude(F.col("g")).alias("b")).collect()
    assert (g[0].a, g[0].b) == (47.5, -123.0) and abs(g[1].a - 47.770833) < 1e-5 and g[2].a is None
