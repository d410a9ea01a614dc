"""Across sessions: attendance, unknown stations, recurring callsigns, hints for the next session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_km, grid_latitude, grid_longitude, is_non_us
from .windows import budget_prefix, session_age

STRICT = r"^[A-Z]{1,2}[0-9][A-Z]{1,3}$"


def attendance(state: DataFrame, roster: DataFrame, decay: float = 0.85) -> DataFrame:
    """Per roster callsign heard: sessions, transmissions, decayed score, last session and sources.

    One weight decay ** age per session attended; the newest session with any line has age 0.
    """
    ages = session_age(state)
    per = state.where("matched and matched_callsign is not null").groupBy("session", F.col("matched_callsign").alias("callsign")).agg(F.count("*").alias("n"), F.collect_set(F.nullif("source", F.lit(""))).alias("src"))
    per = per.join(roster.select("callsign").distinct(), "callsign", "left_semi").join(F.broadcast(ages), "session")
    # Sums of doubles depend on their order, which would rank equal histories at random: decimals add up exactly.
    weight = F.pow(F.lit(float(decay)), F.col("age")).cast("decimal(38,28)")
    return per.groupBy("callsign").agg(
        F.count("*").alias("sessions"), F.sum("n").alias("transmissions"), F.sum(weight).cast("double").alias("score"), F.max("session").alias("last_seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("src")))).alias("sources")
    )


def expected(att: DataFrame, k: int | None = None) -> DataFrame:
    rows = att.orderBy(F.desc("score"), "callsign")
    return rows if k is None else rows.limit(k)


def for_source(att: DataFrame, source: str) -> DataFrame:
    """Stations never tagged with a source, or heard on this one."""
    return att.where((F.size("sources") == 0) | F.array_contains("sources", source))


def unknown_callsigns(state: DataFrame, roster: DataFrame) -> DataFrame:
    heard = state.where("matched and matched_callsign is not null").select(F.col("matched_callsign").alias("callsign")).distinct()
    return heard.join(roster.select("callsign"), "callsign", "left_anti").orderBy("callsign")


def mine_callsigns(mentions: DataFrame, min_sessions: int = 2) -> DataFrame:
    """Strict callsign shapes of unfolded entry and correction records: sessions, mentions, the first
    example, and whether they recur. mentions: session, line_no, type, raw_text, candidate."""
    rows = mentions.where(F.col("type").isin("entry", "correction") & F.col("candidate").rlike(STRICT))
    per = rows.groupBy("candidate", "session").agg(F.count("*").alias("n"), F.min(F.struct("session", "line_no", "raw_text")).alias("first"))
    out = per.groupBy(F.col("candidate").alias("callsign")).agg(F.count("*").alias("sessions"), F.sum("n").alias("mentions"), F.min("first").alias("first"))
    return out.select("callsign", "sessions", "mentions", F.col("first.raw_text").alias("example"), (F.col("sessions") >= min_sessions).alias("likely"))


def ranked_mined(mined: DataFrame) -> DataFrame:
    return mined.orderBy(F.desc("sessions"), F.desc("mentions"), "callsign")


def check_licences(mined: DataFrame, licences: DataFrame, near: str | None = None) -> DataFrame:
    """Licence status, state and distance from the home grid; nothing is filtered by distance.

    The home grid is `near`, or the most common four-character grid of the candidates (the smallest
    among equals). Prefixes of other countries are answered without a look-up.
    """
    foreign = is_non_us(F.col("callsign"))
    rows = mined.join(licences.select("callsign", F.col("status").alias("_s"), F.col("state").alias("_t"), F.col("grid").alias("_g")), "callsign", "left")
    rows = rows.withColumn("status", F.when(foreign, "non-us").otherwise(F.coalesce("_s", F.lit("unchecked"))))
    rows = rows.withColumn("state", F.when(~foreign, F.col("_t"))).withColumn("grid", F.when(~foreign, F.col("_g"))).drop("_s", "_t", "_g")
    if near is None:
        grids = rows.where("grid is not null").groupBy(F.substring("grid", 1, 4).alias("home")).agg(F.count("*").alias("n"))
        home = grids.agg(F.min_by("home", F.struct(-F.col("n"), "home")).alias("home"))
    else:
        home = rows.sparkSession.range(1).select(F.lit(near).alias("home"))
    rows = rows.crossJoin(F.broadcast(home))
    km = distance_km(grid_latitude(F.col("grid")), grid_longitude(F.col("grid")), grid_latitude(F.col("home")), grid_longitude(F.col("home")))
    return rows.withColumn("distance_km", km)


def draft_roster(mined: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """Roster columns for recurring callsigns, without those known not to be issued."""
    rows = mined.where("likely")
    if checked is not None:
        rows = rows.join(checked.where("status = 'not issued'").select("callsign"), "callsign", "left_anti")
    blank = F.lit("")
    return rows.select("callsign", blank.alias("name"), blank.alias("sources"), blank.alias("position"))


def draft_lines(mined: DataFrame, records: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """(part, place, line) of the draft as a file: comments that say what it is, the header, and a row
    per callsign. records: the change records that were mined."""
    rows = draft_roster(mined, checked)
    facts = records.agg(F.countDistinct("session").cast("string").alias("sessions")).crossJoin(mined.agg(F.count_if("likely").alias("likely"))).crossJoin(rows.agg(F.count("*").alias("kept")))
    head = F.array(
        F.concat(F.lit("# Draft roster from "), F.col("sessions"), F.lit(" sessions. Nobody has checked it.")),
        F.concat(F.lit("# Callsigns left out because nobody holds them: "), (F.col("likely") - F.col("kept")).cast("string")),
        F.lit("# Strike what you do not know and fill in names and positions before use."),
        F.lit("callsign,name,sources,position"),
    )
    comments = facts.select(F.posexplode(head).alias("place", "line")).select(F.lit(0).alias("part"), F.col("place").cast("string").alias("place"), "line")
    return comments.union(rows.select(F.lit(1), "callsign", F.concat_ws(",", "callsign", "name", "sources", "position")))


def hint_terms(roster: DataFrame, heard: DataFrame, att: DataFrame | None, source: str, vocabulary: DataFrame, limit: int | None = None) -> DataFrame:
    """(term, grp, place) in the order in which hints should be given: the vocabulary table (term, grp
    0 or 1, place), then this source's stations not yet heard, those heard, and everyone else; inside
    a group the frequent first if there is a history, else in roster order."""
    mine = (F.size("sources") == 0) | F.array_contains("sources", source)
    rows = roster.join(heard.select("callsign").distinct().withColumn("_heard", F.lit(True)), "callsign", "left")
    rows = rows.join(att.select("callsign", F.col("score").alias("_score")), "callsign", "left") if att is not None else rows.withColumn("_score", F.lit(None).cast("double"))
    grp = F.when(mine & F.col("_heard").isNull(), 2).when(mine, 3).otherwise(4)
    first: Column = -F.coalesce("_score", F.lit(0.0)) if att is not None else F.col("ordinal").cast("double")
    stations = rows.select(F.col("callsign").alias("term"), grp.alias("grp"), first.alias("place"))
    out = vocabulary.select("term", "grp", F.col("place").cast("double").alias("place")).unionByName(stations).orderBy("grp", "place", "term")
    return out if limit is None else out.limit(limit)


def fit_terms(terms: DataFrame, cost_col: str, budget: float = 200, shapes_only: bool = False) -> DataFrame:
    """Terms in order (column seq) while they fit; the short variant keeps callsign shapes only."""
    rows = terms.where(F.col("term").rlike(STRICT)) if shapes_only else terms
    return budget_prefix(rows, "seq", cost_col, budget)
