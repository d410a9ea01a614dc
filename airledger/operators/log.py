"""Current state of session logs: folds, corrections, merges and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import keep_last, latest_per_key

CHANGES = ("entry", "correction", "traffic")


def fold_log(records: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Per (session, id) the last change record, whole. Id 0 is dropped unless keep_zero."""
    rows = records.where(F.col("type").isin(*CHANGES))
    rows = rows if keep_zero else rows.where("id <> 0")
    return latest_per_key(rows, ["session", "id"], "line_no")


def order_log(df: DataFrame) -> DataFrame:
    return df.orderBy("session", "timestamp", "id")


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Lines of several receivers as one log, in order of time."""
    return order_log(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs))


def append_transmissions(state: DataFrame, new: DataFrame) -> DataFrame:
    """New lines with ids that go on from their session's highest, and rounded measurements."""
    top = state.groupBy("session").agg(F.max("id").alias("_top"))
    n = F.row_number().over(Window.partitionBy("session").orderBy("timestamp", "arrival"))
    rows = new.withColumn("_n", n).join(top, "session", "left").withColumn("id", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long")).drop("_n", "_top")
    for name, digits in (("confidence", 3), ("match_score", 1), ("clip_duration", 2)):
        rows = rows.withColumn(name, F.round(name, digits))
    return rows


def apply_corrections(state: DataFrame, corrections: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, rejected). The latest correction of a line counts, if its callsign is on the roster;
    the first correction keeps what the machine had concluded."""
    wanted = corrections.withColumn("to_callsign", F.upper(F.trim("to_callsign")))
    known = roster.groupBy(F.col("callsign").alias("to_callsign")).agg(F.min_by(F.struct("name", "position"), "ordinal").alias("_r"))
    lines = state.select("session", "id").distinct().withColumn("_line", F.lit(True))
    checked = wanted.join(known, "to_callsign", "left").join(lines, ["session", "id"], "left")
    reason = F.when(F.col("_line").isNull(), "no such line").when(F.col("_r").isNull(), "not on the roster")
    checked = checked.withColumn("reason", reason)
    rejected = checked.where("reason is not null").select(*corrections.columns, "reason")
    last = latest_per_key(checked.where("reason is null").select("session", "id", "line_no", F.col("to_callsign").alias("_to"), "_r"), ["session", "id"], "line_no").drop("line_no")
    rows = state.join(last, ["session", "id"], "left")
    hit = F.col("_to").isNotNull()
    rows = rows.withColumn("original_callsign", F.when(hit & ~F.coalesce("corrected", F.lit(False)), F.col("matched_callsign")).otherwise(F.col("original_callsign")))
    rows = rows.withColumn("matched_callsign", F.coalesce("_to", "matched_callsign")).withColumn("matched", F.when(hit, True).otherwise(F.col("matched")))
    rows = rows.withColumn("operator_name", F.when(hit, F.col("_r.name")).otherwise(F.col("operator_name"))).withColumn("position", F.when(hit, F.col("_r.position")).otherwise(F.col("position")))
    rows = rows.withColumn("corrected", F.when(hit, True).otherwise(F.col("corrected"))).withColumn("unmatched_reason", F.when(~hit, F.col("unmatched_reason")))
    return rows.select(state.columns), rejected


def attach_suggestions(state: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Voice suggestions on lines that are neither matched nor corrected."""
    rows = state.join(suggestions.select("session", "id", F.col("callsign").alias("_c"), F.col("score").alias("_s")), ["session", "id"], "left")
    open_ = F.col("_c").isNotNull() & ~F.coalesce("matched", F.lit(False)) & ~F.coalesce("corrected", F.lit(False))
    rows = rows.withColumn("suggested_callsign", F.when(open_, F.col("_c")).otherwise(F.col("suggested_callsign")))
    return rows.withColumn("suggestion_score", F.when(open_, F.round("_s", 3)).otherwise(F.col("suggestion_score"))).select(state.columns)


#: What a second pass may replace.
MERGED = ("raw_text", "matched", "matched_callsign", "operator_name", "position", "match_score", "candidate", "unmatched_reason", "confidence")


def merge_second_pass(state: DataFrame, second: DataFrame) -> DataFrame:
    """A second reading wins if it matched and the first did not or scored strictly less; corrected
    lines stay. The pending flag goes in every case that was read again."""
    fields = [c for c in MERGED if c in second.columns]
    rows = state.join(second.select("session", "id", F.struct(*fields).alias("_new")), ["session", "id"], "left")
    new = F.col("_new")
    better = F.coalesce(new["matched"], F.lit(False)) & (~F.coalesce("matched", F.lit(False)) | (new["match_score"] > F.col("match_score"))) & ~F.coalesce("corrected", F.lit(False))
    rows = rows.withColumn("_better", better).withColumn("_again", new.isNotNull())
    out = [F.when(F.col("_better"), new[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in state.columns if c not in ("escalated", "escalation_pending")]
    out += [(F.coalesce("escalated", F.lit(False)) | F.col("_better")).alias("escalated"), (F.coalesce("escalation_pending", F.lit(False)) & ~F.col("_again")).alias("escalation_pending")]
    return rows.select(out).select(state.columns)


def set_traffic_cleared(state: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, rejected): the latest request per line sets the flag, on lines that declare traffic."""
    last = latest_per_key(requests, ["session", "id"], "line_no")
    declared = state.where("traffic = 'yes'").select("session", "id").distinct()
    rejected = last.join(declared, ["session", "id"], "left_anti")
    rows = state.join(last.join(declared, ["session", "id"], "left_semi").select("session", "id", F.col("cleared").alias("_c")), ["session", "id"], "left")
    return rows.withColumn("traffic_cleared", F.coalesce("_c", "traffic_cleared")).select(state.columns), rejected


def view(state: DataFrame, source: str | None = None, callsign: str | None = None, traffic_only: bool = False) -> DataFrame:
    rows = state if source is None else state.where(F.col("source") == source)
    rows = rows if callsign is None else rows.where(F.col("matched_callsign") == callsign)
    return rows.where("traffic = 'yes'") if traffic_only else rows


def aliases(corrections: DataFrame, roster: DataFrame, strict: bool = False) -> DataFrame:
    """(candidate, callsign): what operators said a heard token means, the last label first.
    strict adds the checks of live learning: three characters, and not the callsign itself."""
    rows = corrections.where("candidate is not null and candidate <> ''").withColumn("candidate", F.upper("candidate"))
    rows = rows.where((F.length("candidate") >= 3) & (F.col("candidate") != F.col("to_callsign"))) if strict else rows
    last = rows.groupBy("candidate").agg(F.max_by("to_callsign", F.struct("session", "line_no")).alias("callsign"))
    return last.join(roster.select("callsign").distinct(), "callsign", "left_semi").select("candidate", "callsign")


def select_second_pass(state: DataFrame, min_confidence: float = 0.55, on_unmatched: bool = True, max_pending: int = 50) -> DataFrame:
    """Lines to read again per session: the newest of those not yet escalated that are unmatched or unsure."""
    wanted = (~F.col("matched") & F.lit(on_unmatched)) | (F.col("matched") & (F.col("confidence") < min_confidence))
    return keep_last(state.where(~F.coalesce("escalated", F.lit(False)) & wanted), "session", ["timestamp", "id"], max_pending)


def select_enrolments(state: DataFrame, min_score: float = 95, per_station: int = 6) -> DataFrame:
    """The most recent lines of each station that name it surely: high scores and corrected lines."""
    sure = (F.col("matched") & (F.col("match_score") >= min_score)) | F.coalesce("corrected", F.lit(False))
    return keep_last(state.where(sure & F.col("matched_callsign").isNotNull()), "matched_callsign", ["session", "timestamp", "id"], per_station)
