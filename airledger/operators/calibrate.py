"""Thresholds from labelled history, settings from sweeps."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .voice import pair_numbers, rank_and_reach

#: Steps of the confidence grid: 0.2 + i * STEP for i below 70, as a float range makes them.
FIRST, STEP, POINTS = 0.2, 0.010000000000000009, 70


def calibrate_confidence(state: DataFrame, fallback: float = 0.55) -> DataFrame:
    """One row: threshold, separation, share_below, matched_n, unmatched_n, note. Refuses with the
    fallback if there are too few lines or the two kinds do not differ."""
    rows = state.where("confidence is not null").select("confidence", F.when(F.col("matched") & ~F.coalesce("corrected", F.lit(False)), "good").when(~F.col("matched"), "bad").alias("kind"))
    good, bad = F.col("kind") == "good", F.col("kind") == "bad"
    facts = rows.agg(
        F.count_if(good).alias("matched_n"), F.count_if(bad).alias("unmatched_n"), F.percentile(F.when(good, F.col("confidence")), 0.5).alias("good_median"), F.percentile(F.when(bad, F.col("confidence")), 0.5).alias("bad_median")
    ).withColumn("separation", F.col("good_median") - F.col("bad_median"))
    # The lines fold to one row per confidence first, so the grid meets distinct values only.
    counts = rows.groupBy("confidence").agg(F.count_if(good).alias("g"), F.count_if(bad).alias("b"), F.count("*").alias("n"))
    grid = state.sparkSession.range(POINTS).select(F.col("id").alias("i"), (F.lit(FIRST) + F.col("id") * F.lit(STEP)).alias("t"))
    under = F.col("confidence") < F.col("t")
    scored = counts.crossJoin(F.broadcast(grid)).groupBy("i", "t").agg(
        (F.sum(F.when(under, F.col("b")).otherwise(0)) / F.sum("b") - F.sum(F.when(under, F.col("g")).otherwise(0)) / F.sum("g")).alias("gain"), (F.sum(F.when(under, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_below")
    )
    top = scored.agg(F.max("gain").alias("best"))
    ties = scored.crossJoin(F.broadcast(top)).where(F.col("gain") >= F.col("best") - 1e-9)
    ties = ties.withColumn("k", F.row_number().over(Window.orderBy("i")) - 1).withColumn("m", F.count("*").over(Window.partitionBy(F.lit(1))))
    winner = ties.where(F.col("k") == F.floor(F.col("m") / 2)).select("t", "share_below")
    out = facts.join(winner, F.lit(True), "left")
    note = F.when((F.col("matched_n") < 5) | (F.col("unmatched_n") < 3), "too few lines").when(F.col("separation") <= 0.05, "no separation")
    out = out.withColumn("note", note)
    return out.select(F.when(F.col("note").isNull(), F.round("t", 2)).otherwise(fallback).alias("threshold"), "separation", F.when(F.col("note").isNull(), F.col("share_below")).alias("share_below"), "matched_n", "unmatched_n", "note")


def calibrate_voice(samples: DataFrame, target: float = 0.01, fallback: tuple[float, float] = (0.82, 0.06)) -> DataFrame:
    """One row: threshold, margin, recall, false_accepts, same_n, different_n, note. samples: callsign,
    ordinal, vector.

    All pairs of samples are compared, but none becomes a row: blocks of samples yield counts, moments
    and histograms, of which a few numbers reach the driver.
    """
    n = pair_numbers(samples)
    shape = "threshold double, margin double, recall double, false_accepts double, same_n long, different_n long, note string"
    if min(n.values()) < 5:
        return samples.sparkSession.createDataFrame([(*fallback, None, None, n[True], n[False], "too few pairs")], shape)
    value, reach, moments = rank_and_reach(samples, min(n[False] - 1, floor(n[False] * target)), step=0.005)
    shares = {same: hit / size for same, (size, hit) in reach.items()}
    row = (min(0.98, max(0.5, value + 0.005)), max(0.03, moments.first().spread), shares[True], shares[False], n[True], n[False], "few same voices reach it" if shares[True] < 0.15 else None)
    return samples.sparkSession.createDataFrame([row], shape).withColumn("threshold", F.round("threshold", 3)).withColumn("margin", F.round("margin", 3))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int = 34) -> DataFrame:
    """(bin, n) of equal bins from 0; the last includes its upper edge, values outside are dropped."""
    at = F.least(F.floor((F.col(col) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return df.where(F.col(col).between(lo, hi)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def recommend_gain(levels: DataFrame) -> DataFrame:
    """(source, peak, gain, note) from sample peaks between -1 and 1."""
    rows = levels.groupBy("source").agg(F.max(F.abs("peak")).alias("peak"))
    gain = F.lit(0.6) / F.col("peak")
    silent = F.col("peak") < 1e-4
    return rows.select("source", "peak", F.when(silent, 1.0).when(gain.between(0.8, 1.25), 1.0).otherwise(F.round(gain, 2)).alias("gain"), F.when(silent, "no signal").when(F.col("peak") > 0.98, "clipping").otherwise("").alias("note"))


def score_settings(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """Per setting: clips, clean, merged, empty, stations, value. segments: setting, clip, seg_no,
    text; matches: setting, clip, seg_no, callsign, one row per station of a segment."""
    per = matches.groupBy("setting", "clip", "seg_no").agg(F.countDistinct("callsign").alias("stations"))
    rows = segments.join(per, ["setting", "clip", "seg_no"], "left").withColumn("stations", F.coalesce("stations", F.lit(0)))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    clip = rows.groupBy("setting", "clip").agg(F.count("*").alias("segs"), F.count_if(~blank & (F.col("stations") > 0)).alias("clean"), F.count_if(blank | (F.col("stations") == 0)).alias("empty"), F.max("stations").alias("most"))
    merged = (F.col("segs") == 1) & (F.col("most") > 1)
    total = clip.groupBy("setting").agg(F.count("*").alias("clips"), (F.sum("clean") - F.count_if(merged)).alias("clean"), F.count_if(merged).alias("merged"), F.sum("empty").alias("empty"))
    heard = matches.groupBy("setting").agg(F.countDistinct("callsign").alias("stations"))
    out = total.join(heard, "setting", "left").withColumn("stations", F.coalesce("stations", F.lit(0)))
    return out.withColumn("value", F.col("clean") + F.lit(0.5) * F.col("stations") - F.lit(1.5) * F.col("merged") - F.lit(0.2) * F.col("empty"))


def best_setting(scores: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(setting, value, best): the highest value, the smaller setting among equals, and near ties."""
    top = scores.agg(F.max(F.struct("value", (-F.col("setting")).alias("m"))).alias("t"))
    rows = scores.select("setting", "value").crossJoin(F.broadcast(top))
    return rows.where(F.col("value") >= F.col("t.value") - tolerance).select("setting", "value", (F.col("setting") == -F.col("t.m")).alias("best"))
