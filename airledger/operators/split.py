"""Cutting a clip that holds several transmissions at the pauses between their stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_transmissions(clips: DataFrame, words: DataFrame, matches: DataFrame, min_gap_ms: int = 500, min_segment_ms: int = 400) -> DataFrame:
    """(clip, seg_no, text, start_offset_ms, duration_ms).

    clips: clip, text, duration_ms, suspect; words: clip, word_no, start, end (seconds), offset;
    matches: clip, callsign, start, end (characters), one row per station. Between two stations
    the longest pause among the words from the end of one to the start of the next is a cut, if it
    is long enough. If any piece is blank or too short the clip stays whole; so do suspect clips
    and those of fewer than two stations.
    """
    return split_settings(clips, words, matches, [min_gap_ms], min_segment_ms).drop("setting")


def split_settings(clips: DataFrame, words: DataFrame, matches: DataFrame, settings: list[int], min_segment_ms: int = 400) -> DataFrame:
    """(setting, clip, seg_no, text, start_offset_ms, duration_ms): split_transmissions for several values of
    min_gap_ms. Words and stations of a clip are put together once, as lists; the longest pauses are found
    once for all settings."""
    stations = matches.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_m"))
    spoken = words.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("word_no", "start", "end", F.col("offset").alias("at")))).alias("_w"))
    rows = clips.select("clip", "text", F.col("duration_ms").cast("long").alias("all_ms"), F.coalesce("suspect", F.lit(False)).alias("_echo")).join(stations, "clip", "left").join(spoken, "clip", "left")

    def longest(lo: Column, hi: Column) -> Column:
        """The longest pause, the first of equal ones, before a word from lo to hi and after another one."""
        inside = F.filter("_w", lambda w: w["at"].between(lo, hi))
        pauses = F.zip_with(F.slice(inside, F.lit(2), F.greatest(F.size(inside) - 1, F.lit(0))), inside, lambda w, before: F.struct((w["start"] - before["end"]).alias("gap"), (-w["word_no"]).alias("w"), w["at"].cast("int").alias("at"), w["start"].alias("t")))
        return F.array_max(F.filter(pauses, lambda p: p["gap"].isNotNull()))

    after = F.slice("_m", F.lit(2), F.greatest(F.size("_m") - 1, F.lit(0)))
    best = F.transform(F.arrays_zip(F.slice("_m", F.lit(1), F.greatest(F.size("_m") - 1, F.lit(0))).alias("a"), after.alias("b")), lambda p: longest(p["a"]["end"], p["b"]["start"]))
    none = F.filter(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("ms"))), lambda _: F.lit(False))
    rows = rows.withColumn("_best", F.when(~F.col("_echo") & (F.size("_m") > 1) & F.col("_w").isNotNull(), F.filter(best, lambda b: b.isNotNull()))).drop("_m", "_w")
    rows = rows.withColumn("setting", F.explode(F.array(*[F.lit(x) for x in settings])))
    cuts = F.transform(F.filter("_best", lambda b: F.round(b["gap"] * 1000, 6) >= F.col("setting")), lambda b: F.struct(b["at"].alias("at"), F.round(b["t"] * 1000).cast("long").alias("ms")))
    rows = rows.withColumn("_cuts", F.array_distinct(F.coalesce(cuts, none)))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("ms"))
    rows = rows.withColumn("_heads", F.array_sort(F.concat(F.array(start), "_cuts")))

    def piece(head: Column, i: Column) -> Column:
        follows = F.get("_heads", i + 1)
        text = F.trim(F.substring("text", head["at"] + 1, F.coalesce(follows["at"], F.length("text")) - head["at"]))
        return F.struct((i + 1).alias("seg_no"), text.alias("text"), head["ms"].alias("start_offset_ms"), (F.coalesce(follows["ms"], F.col("all_ms")) - head["ms"]).alias("duration_ms"))

    rows = rows.withColumn("_pieces", F.when(F.size("_cuts") > 0, F.transform("_heads", piece)))
    fine = F.forall("_pieces", lambda p: F.coalesce((p["text"] != "") & (p["duration_ms"] >= min_segment_ms), F.lit(True)))
    whole = F.array(F.struct(F.lit(1).alias("seg_no"), F.col("text").alias("text"), F.lit(0).cast("long").alias("start_offset_ms"), F.col("all_ms").alias("duration_ms")))
    rows = rows.withColumn("_p", F.explode(F.when(F.col("text").isNotNull() & F.coalesce(fine, F.lit(False)), F.col("_pieces")).otherwise(whole)))
    return rows.select("setting", "clip", "_p.*")
