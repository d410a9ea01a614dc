"""Radio-log views over the given tables: one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def call(k: str) -> str:
    """SQL for a callsign-shaped name of an integer key: two letters, a digit, three letters."""
    return (
        f"(chr(cast(65 + {k} % 26 AS int)) || chr(cast(65 + floor({k} / 26) % 26 AS int)) || cast({k} % 10 AS string) || chr(cast(65 + ({k} * 3) % 26 AS int))"
        f" || chr(cast(65 + ({k} * 5) % 26 AS int)) || chr(cast(65 + floor({k} / 676) % 26 AS int)))"
    )


PHRASE = """CASE event_id % 8 WHEN 0 THEN 'no traffic' WHEN 1 THEN 'I have traffic for control' WHEN 2 THEN 'any traffic tonight'
 WHEN 3 THEN 'nothing to pass' WHEN 4 THEN 'good morning' WHEN 5 THEN 'message for the captain' WHEN 6 THEN 'checking in with traffic' ELSE 'standing by' END"""
SESSION = "cast(cast(ts AS date) AS string)"
CALL = call("user_id")
TIME = "cast(date_trunc('second', ts) AS string)"

VIEWS = {
    "net_roster": f"""SELECT cast(s_suppkey AS int) AS ordinal, {call("s_suppkey")} AS callsign, s_name AS name, n_name AS position,
        CASE WHEN s_suppkey % 3 = 0 THEN 'east' WHEN s_suppkey % 3 = 1 THEN 'west' ELSE '' END AS src
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "net_log": f"""SELECT {SESSION} AS session, event_id AS id, {TIME} AS timestamp, event_type <> 'error' AS matched,
        CASE WHEN event_type <> 'error' THEN {CALL} END AS matched_callsign, cast(NULL AS string) AS operator_name,
        {CALL} || ' ' || {PHRASE} AS raw_text, value / (value + 50) AS confidence, cast(78 + event_id % 23 AS double) AS match_score,
        cast(1 + event_id % 9 AS double) AS clip_duration, {CALL} AS candidate, CASE WHEN event_type = 'error' THEN 'below_threshold' END AS unmatched_reason,
        event_id % 17 = 0 AS corrected, cast(NULL AS string) AS original_callsign, false AS via_alias, false AS late,
        CASE user_id % 3 WHEN 0 THEN 'east' WHEN 1 THEN 'west' ELSE '' END AS source, event_id % 29 = 0 AS escalated, event_id % 31 = 0 AS escalation_pending,
        '' AS position, CASE event_type WHEN 'purchase' THEN 'yes' WHEN 'signup' THEN 'no' ELSE '' END AS traffic,
        event_type = 'purchase' AND event_id % 3 = 0 AS traffic_cleared, cast(NULL AS string) AS suggested_callsign, cast(NULL AS double) AS suggestion_score
        FROM events""",
    "net_records": f"""SELECT {SESSION} AS session, event_id AS line_no, CASE event_type WHEN 'click' THEN 'correction' WHEN 'view' THEN 'traffic' WHEN 'error' THEN 'resumed' ELSE 'entry' END AS type,
        user_id AS id, {TIME} AS timestamp, {CALL} || ' ' || {PHRASE} AS raw_text, value AS confidence FROM events""",
    "net_corrections": f"""SELECT {SESSION} AS session, event_id AS line_no, event_id - event_id % 5 AS id, {TIME} AS timestamp,
        substr({CALL}, 1, 5) || 'Q' AS candidate, {CALL} AS to_callsign FROM events WHERE event_type = 'click'""",
    "net_mentions": f"""SELECT {SESSION} AS session, event_id AS id, CASE WHEN event_id % 5 = 0 THEN substr({CALL}, 1, 5) || 'Q' ELSE {CALL} END AS candidate FROM events""",
    "net_frames": "SELECT cast(user_id % 4 AS string) AS source, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS frame_no, value * 10 AS rms, value > 60 AS is_speech FROM events",
    "net_signals": """SELECT cast(user_id % 4 AS string) AS source, cast(event_id AS double) * 0.75 AS clock, CASE WHEN event_id % 50 = 7 THEN 'finished' WHEN event_type = 'signup' THEN 'started'
        WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed' WHEN event_type = 'purchase' THEN 'spill' ELSE 'frame' END AS kind,
        CASE WHEN event_type = 'purchase' THEN cast(event_id % 2 AS double) ELSE value END AS value FROM events""",
    "net_voice": "SELECT chr(cast(65 + label AS int)) AS callsign, vec_id AS ordinal, embedding AS vector FROM embeddings",
    "net_licences": f"""SELECT {call("c_custkey")} AS callsign, CASE WHEN c_custkey % 7 = 0 THEN 'not issued' ELSE 'active' END AS status, 'WA' AS state,
        chr(cast(65 + c_custkey % 18 AS int)) || chr(cast(65 + floor(c_custkey / 18) % 18 AS int)) || cast(c_custkey % 10 AS string) || cast(floor(c_custkey / 10) % 10 AS int) AS grid FROM customer""",
    "net_customers": "SELECT c_custkey AS id, c_name AS name FROM customer",
    "net_words": f"""SELECT event_id AS clip, w.word_no, w.text, w.word_no * 0.3 + CASE WHEN w.word_no >= 2 AND event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS start,
        w.word_no * 0.3 + 0.3 + CASE WHEN w.word_no >= 2 AND event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS end, w.at AS offset FROM events,
        (SELECT 0 AS word_no, 'AB1CDE' AS text, 0 AS at UNION ALL SELECT 1, 'over', 7 UNION ALL SELECT 2, 'FG2HIJ', 12 UNION ALL SELECT 3, 'here', 19) w""",
    # Words of clips in which one to three stations speak, with pauses of several lengths before the
    # second and third; clips of 11 have no timings, some stations say their name only.
    "net_talk": f"""SELECT clip, k, w, text, row_number() OVER (PARTITION BY clip ORDER BY k, w) - 1 AS word_no, cast(sum(length(text) + 1) OVER (PARTITION BY clip ORDER BY k, w) - length(text) - 1 AS int) AS place,
        cast(sum(pause + ms) OVER (PARTITION BY clip ORDER BY k, w) - ms AS bigint) AS start_ms, cast(sum(pause + ms) OVER (PARTITION BY clip ORDER BY k, w) AS bigint) AS end_ms FROM
        (SELECT event_id AS clip, k, w, CASE w WHEN 0 THEN {call("(user_id + k * 31)")} WHEN 1 THEN 'over' ELSE 'standing' END AS text, CASE w WHEN 0 THEN CASE WHEN (event_id + k) % 4 = 1 THEN 200 ELSE 600 END WHEN 1 THEN 100 ELSE 300 END AS ms,
         CASE WHEN w > 0 OR k = 0 THEN 50 ELSE CASE (event_id * 5 + event_id % 7 + k * 3) % 5 WHEN 0 THEN 0 WHEN 1 THEN 200 WHEN 2 THEN 450 WHEN 3 THEN 600 ELSE 1700 END END AS pause
         FROM events, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks, (SELECT 0 AS w UNION ALL SELECT 1 UNION ALL SELECT 2) ws
         WHERE k <= event_id % 3 AND (w = 0 OR (event_id + k) % 5 <> 0) AND (w < 2 OR (event_id + k) % 4 <> 1)) said""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's DataFrame; net_roster gets its sources as an array."""
    import re

    sql = VIEWS[name]
    for table in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 parquet.`{sf_dir}/{table}.parquet`", sql)
    df = spark.sql(sql)
    if name == "net_roster":
        from pyspark.sql import functions as F

        df = df.withColumn("sources", F.when(F.col("src") == "", F.array().cast("array<string>")).otherwise(F.array("src"))).drop("src")
    return df


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions."""
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in sql)
    if not views:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().startswith(start):
            return f"{start}{views},\n{sql.lstrip().removeprefix(start)}"
    return f"WITH {views}\n{sql}"
