"""How well and how fast engines did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_matches(matches: DataFrame, expected: DataFrame) -> DataFrame:
    """Per engine: right, wrong, unmatched and the clips missed. matches: engine, clip, callsign (null
    if none); expected: clip, expected."""
    rows = expected.join(matches, "clip")
    right = F.col("callsign") == F.col("expected")
    return rows.groupBy("engine").agg(
        F.count_if(F.coalesce(right, F.lit(False))).alias("right"), F.count_if(~right).alias("wrong"), F.count_if(F.col("callsign").isNull()).alias("unmatched"), F.count_if(~F.coalesce(right, F.lit(False))).alias("missed")
    )


def misses(matches: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.join(matches, "clip").where("callsign is null or callsign <> expected").select("engine", "clip", "expected", "callsign")


def realtime(runs: DataFrame, clips: DataFrame) -> DataFrame:
    """Per engine: median load and compute over its runs, and compute over seconds of audio."""
    audio = clips.agg(F.sum("seconds").alias("audio_s"))
    per = runs.groupBy("engine").agg(F.median("load_s").alias("load_s"), F.median("compute_s").alias("compute_s"))
    return per.crossJoin(F.broadcast(audio)).withColumn("factor", F.when(F.col("audio_s") > 0, F.col("compute_s") / F.col("audio_s")))


def clip_confidence(segments: DataFrame) -> DataFrame:
    """(clip, confidence): mean of exp(avg_logprob), weighted by duration; clips without segments are absent."""
    w = F.greatest(F.col("duration"), F.lit(0.001))
    value = F.sum(F.exp("avg_logprob") * w) / F.sum(w)
    return segments.groupBy("clip").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("confidence"))


def token_confidence(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("clip").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("p"))).alias("confidence"))
