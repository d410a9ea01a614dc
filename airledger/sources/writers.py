"""Writers of change records, exports, rosters, profiles and corrections, all through Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.boards import check_ins, holding_traffic, passed_traffic


def append_records(df: DataFrame, path: str) -> None:
    """Change records carry the whole state of their line; history is never rewritten."""
    df.write.mode("append").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    names = [f.name for f in schemas.TRANSMISSION.fields if f.name in df.columns]
    df.orderBy("timestamp", "id").select(names).write.option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def render_log(state: DataFrame) -> DataFrame:
    """(session, line_no, line) of each session's readable log: a title with the numbers of lines and
    stations, the lines, then check-ins, outstanding and passed traffic. A session without check-ins
    keeps that line, the last two are there only if they name a station.

    A line tells its receiver only where the session has several, the station's place and name only
    where it is matched, and the callsign that a correction replaced.
    """
    text = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    corrected, traffic = F.coalesce("corrected", F.lit(False)), F.col("traffic") == "yes"
    detail = F.concat_ws(" / ", text("position"), text("operator_name"))
    who = F.when(F.col("matched"), F.concat_ws(" ", "matched_callsign", F.when(detail != "", F.concat(F.lit("("), detail, F.lit(")"))))).otherwise(F.lit("UNMATCHED"))
    was = F.when(corrected, F.concat(F.lit(" [corrected from "), F.coalesce(text("original_callsign"), F.lit("unmatched")), F.lit("]"))).otherwise("")
    flag = F.when(traffic & F.coalesce("traffic_cleared", F.lit(False)), " [TRAFFIC PASSED]").when(traffic, " [TRAFFIC]").otherwise("")
    facts = state.groupBy("session").agg(F.count("*").alias("n"), F.countDistinct(text("source")).alias("srcs"))
    heard, waiting, passed = check_ins(state), holding_traffic(state), passed_traffic(state).withColumn("ordinal", F.lit(0))
    facts = facts.join(heard.groupBy("session").agg(F.count("*").alias("stations")), "session", "left")
    where = F.when((F.col("srcs") > 1) & text("source").isNotNull(), F.concat(F.lit(" ("), F.col("source"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("["), F.coalesce("timestamp", F.lit("")), F.lit("]"), where, F.lit(" "), who, was, F.lit(":"), flag, F.lit(" "), F.coalesce("raw_text", F.lit("")))
    blank = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("i"))
    one = lambda part, said: facts.select("session", F.lit(part).alias("part"), blank.alias("o"), said.alias("line"))
    body = state.join(facts.select("session", "srcs"), "session").select("session", F.lit(2).alias("part"), F.struct(F.col("timestamp").alias("t"), F.col("id").cast("long").alias("i")).alias("o"), line.alias("line"))
    out = one(0, F.concat(F.lit("Net session log -- "), F.col("n"), F.lit(" transmissions, "), F.coalesce("stations", F.lit(0)), F.lit(" stations"))).union(one(1, F.lit(""))).union(body).union(one(3, F.lit("")))
    for part, name, found in ((4, "Check-ins", heard), (5, "Traffic outstanding", waiting), (6, "Traffic passed", passed)):
        listed = found.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "callsign"))), lambda x: x.callsign), ", ").alias("names"))
        rows = facts.select("session").join(listed, "session", "left" if part == 4 else "inner")
        out = out.union(rows.select("session", F.lit(part).alias("part"), blank.alias("o"), F.concat(F.lit(f"{name}: "), F.coalesce("names", F.lit(""))).alias("line")))
    return out.select("session", (F.row_number().over(Window.partitionBy("session").orderBy("part", "o")) - 1).alias("line_no"), "line")


def write_profiles(df: DataFrame, path: str) -> None:
    six = lambda v: F.transform(v, lambda x: F.round(x, 6))
    df.select("callsign", six("centroid").alias("centroid"), F.col("n").alias("count"), F.transform("samples", lambda v: six(v)).alias("samples")).write.json(path)


def write_roster(df: DataFrame, path: str) -> None:
    df.select("callsign", "name", "sources", "position").write.option("header", True).csv(path)


def write_draft(lines: DataFrame, path: str) -> None:
    """Rows of `draft_lines` as one file, a report of a few hundred lines."""
    lines.repartition(1).sortWithinPartitions("part", "place").select("line").write.text(path)


def append_corrections(df: DataFrame, path: str) -> None:
    """Add rows of `record_corrections` to the correction log; keys without a value are written too."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def record_corrections(labels: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of the correction log: what was heard, what was concluded, what it is. labels: session,
    id, timestamp, to_callsign."""
    heard = state.select("session", "id", "candidate", F.col("matched_callsign").alias("from_callsign"), "raw_text", "confidence", "clip_duration")
    rows = labels.join(heard, ["session", "id"])
    return rows.select("session", "timestamp", F.col("id").alias("entry_id"), F.coalesce("candidate", F.lit("")).alias("candidate"), "from_callsign", F.upper(F.trim("to_callsign")).alias("to_callsign"), "raw_text", "confidence", "clip_duration")
