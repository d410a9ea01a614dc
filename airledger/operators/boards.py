"""Who checked in, who holds traffic, who is where."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _first_lines(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("session", F.col("matched_callsign").alias("callsign")).agg(F.min(F.struct("timestamp", "id")).alias("f"))
    ordinal = F.row_number().over(Window.partitionBy("session").orderBy("f", "callsign"))
    return first.select("session", "callsign", F.col("f.timestamp").alias("first_seen"), ordinal.alias("ordinal"))


def check_ins(state: DataFrame) -> DataFrame:
    """(session, callsign, first_seen, ordinal): matched stations in order of their first line."""
    return _first_lines(state.where("matched and matched_callsign is not null"))


def holding_traffic(state: DataFrame, need_match: bool = True) -> DataFrame:
    """Stations with traffic declared and not passed, oldest first. The dashboard's variant needs a
    callsign but no match."""
    return _first_lines(state.where("traffic = 'yes' and not coalesce(traffic_cleared, false) and matched_callsign is not null" + " and matched" * need_match))


def passed_traffic(state: DataFrame) -> DataFrame:
    """(session, callsign) with traffic declared and passed; a match is not needed."""
    return state.where("traffic = 'yes' and traffic_cleared and matched_callsign is not null").select("session", F.col("matched_callsign").alias("callsign")).distinct()


def stations(state: DataFrame) -> DataFrame:
    """Per session and callsign: lines, matched lines, first line of a match, and whether any line has
    traffic that is open, or that was passed."""
    open_, passed = (F.col("traffic") == "yes") & ~F.coalesce("traffic_cleared", F.lit(False)), (F.col("traffic") == "yes") & F.coalesce("traffic_cleared", F.lit(False))
    rows = state.where("matched_callsign is not null").groupBy("session", F.col("matched_callsign").alias("callsign"))
    return rows.agg(
        F.count("*").alias("lines"), F.count_if("matched").alias("matched_lines"), F.min(F.when(F.col("matched"), F.struct("timestamp", "id"))).alias("_f"), F.coalesce(F.bool_or(open_), F.lit(False)).alias("holding"), F.coalesce(F.bool_or(passed), F.lit(False)).alias("passed")
    ).select("session", "callsign", "lines", "matched_lines", F.col("_f.timestamp").alias("first_seen"), "holding", "passed")


def traffic_summary(state: DataFrame) -> DataFrame:
    """Per session: stations that declared traffic (passed or not), and lines that said yes and no."""
    return state.groupBy("session").agg(
        F.array_sort(F.collect_set(F.when(F.col("traffic") == "yes", F.col("matched_callsign")))).alias("holding"), F.count_if(F.col("traffic") == "yes").alias("yes_lines"), F.count_if(F.col("traffic") == "no").alias("no_lines")
    )


def log_stats(state: DataFrame) -> DataFrame:
    """Per session and source, and over all sources (source null, total true)."""
    holding = F.when((F.col("traffic") == "yes") & ~F.coalesce("traffic_cleared", F.lit(False)), F.col("matched_callsign"))
    return state.rollup("session", "source").agg(
        F.count("*").alias("lines"), F.countDistinct(F.when(F.col("matched"), F.col("matched_callsign"))).alias("stations"),
        F.countDistinct(holding).alias("outstanding"), F.count_if(F.coalesce("escalation_pending", F.lit(False))).alias("awaiting"), (F.grouping("source") == 1).alias("total"),
    ).where("session is not null")


def board(roster: DataFrame, state: DataFrame) -> DataFrame:
    """Every roster entry with its number of lines, whether it was heard and holds traffic, and its place."""
    lines = state.where("matched_callsign is not null").groupBy(F.col("matched_callsign").alias("callsign")).agg(
        F.count("*").alias("lines"), F.bool_or((F.col("traffic") == "yes") & ~F.coalesce("traffic_cleared", F.lit(False))).alias("holding")
    )
    return place_stations(roster, lines)


def place_stations(roster: DataFrame, lines: DataFrame) -> DataFrame:
    """The board of a roster, given (callsign, lines, holding) of the stations heard."""
    place = F.coalesce(F.nullif("position", F.lit("")), F.nullif("name", F.lit("")), F.lit(""))
    return roster.join(lines, "callsign", "left").select("ordinal", "callsign", F.coalesce("lines", F.lit(0)).alias("lines"), F.col("lines").isNotNull().alias("heard"), F.coalesce("holding", F.lit(False)).alias("holding"), place.alias("place"))
