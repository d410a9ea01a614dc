"""Registered queries over the given tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, vocabulary
from ..operators import boards, calibrate, frames, history, log, match, scoring, split, text, voice, windows
from ..sources import readers, writers
from ..streaming import live
from .folders import new_folder, written
from .views import view, with_views

Query = Callable[[Callable[[str], DataFrame]], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _FOUND[name or f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(lambda v: view(spark, sf_dir, v))) for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _FOUND.items() if sql}


def _list(col: str) -> F.Column:
    return F.concat_ws(",", col)


# Log state

FOLD = "fold AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, id ORDER BY line_no DESC) AS n FROM net_records WHERE type IN ('entry', 'correction', 'traffic')) WHERE n = 1)"


@_query(f"WITH {FOLD} SELECT session, line_no, type, id, timestamp, raw_text, round(confidence, 6) AS confidence FROM fold WHERE id <> 0")
def fold_log(v):
    return log.fold_log(v("net_records")).withColumn("confidence", F.round("confidence", 6))


@_query("SELECT session, id, max_by(raw_text, line_no) AS raw_text, max(line_no) AS line_no FROM net_records GROUP BY session, id")
def latest_per_key(v):
    return windows.latest_per_key(v("net_records").select("session", "id", "raw_text", "line_no"), ["session", "id"], "line_no")


@_query("SELECT session, timestamp, id FROM net_log ORDER BY 1, 2, 3")
def order_log(v):
    return log.order_log(v("net_log").select("session", "timestamp", "id"))


@_query("SELECT session, timestamp, id, source FROM net_log WHERE source IN ('east', 'west')")
def union_sources(v):
    rows = v("net_log").select("session", "timestamp", "id", "source")
    return log.union_sources(rows.where("source = 'east'"), rows.where("source = 'west'"))


@_query("""WITH top AS (SELECT session, max(id) AS top FROM net_log WHERE id % 2 = 0 GROUP BY session)
 SELECT session, timestamp, coalesce(top, 0) + row_number() OVER (PARTITION BY session ORDER BY timestamp, l.id) AS id, round(confidence, 3) AS confidence
 FROM net_log l LEFT JOIN top USING (session) WHERE l.id % 2 = 1""")
def append_transmissions(v):
    rows = v("net_log")
    new = rows.where("id % 2 = 1").withColumn("arrival", F.col("id")).drop("id")
    return log.append_transmissions(rows.where("id % 2 = 0"), new).select("session", "timestamp", "id", "confidence")


@_query("""WITH known AS (SELECT c.* FROM net_corrections c JOIN (SELECT DISTINCT callsign FROM net_roster) ON callsign = to_callsign),
 last AS (SELECT session, id, max_by(to_callsign, line_no) AS t FROM known GROUP BY session, id)
 SELECT l.session, l.id, coalesce(t, matched_callsign) AS matched_callsign, matched OR t IS NOT NULL AS matched, corrected OR t IS NOT NULL AS corrected,
 CASE WHEN t IS NOT NULL AND NOT corrected THEN matched_callsign END AS original_callsign, coalesce(r.position, l.position) AS position
 FROM net_log l LEFT JOIN last USING (session, id) LEFT JOIN net_roster r ON r.callsign = t""")
def apply_corrections(v):
    state, _ = log.apply_corrections(v("net_log"), v("net_corrections"), v("net_roster"))
    return state.select("session", "id", "matched_callsign", "matched", "corrected", "original_callsign", "position")


@_query("""SELECT c.session, c.line_no, CASE WHEN l.id IS NULL THEN 'no such line' ELSE 'not on the roster' END AS reason FROM net_corrections c
 LEFT JOIN net_log l ON l.session = c.session AND l.id = c.id LEFT JOIN net_roster r ON r.callsign = to_callsign WHERE l.id IS NULL OR r.callsign IS NULL""")
def rejected_corrections(v):
    _, rejected = log.apply_corrections(v("net_log"), v("net_corrections"), v("net_roster"))
    return rejected.select("session", "line_no", "reason")


@_query("""SELECT session, id, CASE WHEN NOT matched AND NOT corrected AND id % 2 = 0 THEN candidate END AS suggested_callsign,
 CASE WHEN NOT matched AND NOT corrected AND id % 2 = 0 THEN round(confidence, 3) END AS suggestion_score FROM net_log""")
def attach_suggestions(v):
    rows = v("net_log")
    found = rows.where("id % 2 = 0").select("session", "id", F.col("candidate").alias("callsign"), F.col("confidence").alias("score"))
    return log.attach_suggestions(rows, found).select("session", "id", "suggested_callsign", "suggestion_score")


@_query("""WITH second AS (SELECT session, id, id % 4 = 0 AS m2, cast(80 + id % 11 AS double) AS s2 FROM net_log WHERE id % 2 = 0)
 SELECT session, id, CASE WHEN b THEN 'again' ELSE raw_text END AS raw_text, CASE WHEN b THEN s2 ELSE match_score END AS match_score, escalated OR b AS escalated, escalation_pending AND s2 IS NULL AS escalation_pending
 FROM (SELECT l.*, s2, coalesce(m2, false) AND (NOT matched OR s2 > match_score) AND NOT corrected AS b FROM net_log l LEFT JOIN second USING (session, id))""")
def merge_second_pass(v):
    rows = v("net_log")
    second = rows.where("id % 2 = 0").select("session", "id", F.lit("again").alias("raw_text"), (F.col("id") % 4 == 0).alias("matched"), (80 + F.col("id") % 11).cast("double").alias("match_score"))
    return log.merge_second_pass(rows, second).select("session", "id", "raw_text", "match_score", "escalated", "escalation_pending")


@_query("""SELECT session, id, CASE WHEN traffic = 'yes' AND id % 2 = 0 THEN id % 4 = 0 ELSE traffic_cleared END AS traffic_cleared FROM net_log""")
def set_traffic_cleared(v):
    rows = v("net_log")
    asked = rows.where("id % 2 = 0").select("session", "id", F.lit(1).alias("line_no"), (F.col("id") % 4 == 0).alias("cleared"))
    return log.set_traffic_cleared(rows, asked)[0].select("session", "id", "traffic_cleared")


@_query("SELECT session, id, matched_callsign FROM net_log WHERE source = 'east' AND traffic = 'yes'", name="view")
def view_(v):
    return log.view(v("net_log"), source="east", traffic_only=True).select("session", "id", "matched_callsign")


@_query("""WITH a AS (SELECT candidate, max_by(to_callsign, (session, line_no)) AS callsign FROM net_corrections GROUP BY candidate)
 SELECT candidate, callsign FROM a WHERE callsign IN (SELECT callsign FROM net_roster)""")
def aliases(v):
    return log.aliases(v("net_corrections"), v("net_roster"))


@_query("""SELECT session, id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY timestamp DESC, id DESC) AS n FROM net_log
 WHERE NOT escalated AND (NOT matched OR confidence < 0.55)) WHERE n <= 50""")
def select_second_pass(v):
    return log.select_second_pass(v("net_log")).select("session", "id")


@_query("""SELECT session, id, matched_callsign FROM (SELECT *, row_number() OVER (PARTITION BY matched_callsign ORDER BY session DESC, timestamp DESC, id DESC) AS n FROM net_log
 WHERE ((matched AND match_score >= 95) OR corrected) AND matched_callsign IS NOT NULL) WHERE n <= 6""")
def select_enrolments(v):
    return log.select_enrolments(v("net_log")).select("session", "id", "matched_callsign")


@_query("SELECT session, id FROM (SELECT *, row_number() OVER (PARTITION BY matched_callsign ORDER BY session DESC, id DESC) AS n FROM net_log WHERE matched) WHERE n <= 12")
def keep_last(v):
    return windows.keep_last(v("net_log").where("matched"), "matched_callsign", ["session", "id"], 12).select("session", "id")


@_query("""SELECT l.session, l.id, l.candidate, l.matched_callsign AS from_callsign, c.to_callsign FROM net_corrections c JOIN net_log l ON l.session = c.session AND l.id = c.id""")
def record_corrections(v):
    out = writers.record_corrections(v("net_corrections").select("session", "id", "timestamp", "to_callsign"), v("net_log"))
    return out.select("session", F.col("entry_id").alias("id"), "candidate", "from_callsign", "to_callsign")


@_query("""SELECT session, id, coalesce(max(timestamp) OVER (PARTITION BY session ORDER BY id % 100, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > timestamp, false) AS late FROM net_log""")
def mark_late(v):
    rows = v("net_log").select("session", "id", "timestamp", F.struct(F.col("id") % 100, "id").alias("arrival"))
    return live.mark_late(rows).select("session", "id", "late")


# Boards

FIRSTS = """SELECT session, callsign, first_seen, row_number() OVER (PARTITION BY session ORDER BY first_seen, first_id, callsign) AS ordinal FROM
 (SELECT session, matched_callsign AS callsign, min(timestamp) AS first_seen, arg_min(id, (timestamp, id)) AS first_id FROM net_log WHERE {} GROUP BY 1, 2)"""


@_query(FIRSTS.format("matched AND matched_callsign IS NOT NULL"))
def check_ins(v):
    return boards.check_ins(v("net_log"))


@_query(FIRSTS.format("traffic = 'yes' AND NOT traffic_cleared AND matched AND matched_callsign IS NOT NULL"))
def holding_traffic(v):
    return boards.holding_traffic(v("net_log"))


@_query("SELECT DISTINCT session, matched_callsign AS callsign FROM net_log WHERE traffic = 'yes' AND traffic_cleared AND matched_callsign IS NOT NULL")
def passed_traffic(v):
    return boards.passed_traffic(v("net_log"))


@_query("""SELECT session, coalesce(string_agg(DISTINCT CASE WHEN traffic = 'yes' THEN matched_callsign END, ',' ORDER BY CASE WHEN traffic = 'yes' THEN matched_callsign END), '') AS holding,
 count(*) FILTER (traffic = 'yes') AS yes_lines, count(*) FILTER (traffic = 'no') AS no_lines FROM net_log GROUP BY session""")
def traffic_summary(v):
    return boards.traffic_summary(v("net_log")).withColumn("holding", _list("holding"))


@_query("""SELECT session, source, count(*) AS lines, count(DISTINCT CASE WHEN matched THEN matched_callsign END) AS stations,
 count(DISTINCT CASE WHEN traffic = 'yes' AND NOT traffic_cleared THEN matched_callsign END) AS outstanding, count(*) FILTER (escalation_pending) AS awaiting, grouping(source) = 1 AS total
 FROM net_log GROUP BY GROUPING SETS ((session, source), (session))""")
def log_stats(v):
    return boards.log_stats(v("net_log"))


@_query("""SELECT ordinal, r.callsign, coalesce(lines, 0) AS lines, lines IS NOT NULL AS heard, coalesce(holding, false) AS holding, position AS place FROM net_roster r LEFT JOIN
 (SELECT matched_callsign AS callsign, count(*) AS lines, bool_or(traffic = 'yes' AND NOT traffic_cleared) AS holding FROM net_log WHERE matched_callsign IS NOT NULL GROUP BY 1) l ON l.callsign = r.callsign""")
def board(v):
    return boards.board(v("net_roster"), v("net_log"))


LOG_PARTS = f"""said AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN candidate END AS original_callsign, CASE WHEN id % 3 = 0 THEN 'Op ' || id END AS operator_name, CASE WHEN id % 5 = 0 THEN 'gate' ELSE '' END AS position) FROM net_log),
 f AS (SELECT session, count(*) AS n, count(DISTINCT nullif(source, '')) AS srcs, count(DISTINCT CASE WHEN matched THEN matched_callsign END) AS stations FROM said GROUP BY session),
 detailed AS (SELECT *, concat_ws(' / ', nullif(position, ''), operator_name) AS detail FROM said),
 lines AS (SELECT session, 0 AS part, '' AS t, 0 AS i, 'Net session log -- ' || n || ' transmissions, ' || stations || ' stations' AS line FROM f
 UNION ALL SELECT session, 1, '', 0, '' FROM f UNION ALL SELECT session, 3, '', 0, '' FROM f
 UNION ALL SELECT session, 2, timestamp, id, '[' || timestamp || ']' || CASE WHEN srcs > 1 AND source <> '' THEN ' (' || source || ')' ELSE '' END || ' ' ||
  CASE WHEN NOT matched THEN 'UNMATCHED' WHEN detail <> '' THEN matched_callsign || ' (' || detail || ')' ELSE matched_callsign END || CASE WHEN corrected THEN ' [corrected from ' || coalesce(original_callsign, 'unmatched') || ']' ELSE '' END || ':' ||
  CASE WHEN traffic = 'yes' AND traffic_cleared THEN ' [TRAFFIC PASSED]' WHEN traffic = 'yes' THEN ' [TRAFFIC]' ELSE '' END || ' ' || raw_text FROM detailed JOIN f USING (session)
 UNION ALL SELECT f.session, 4, '', 0, 'Check-ins: ' || coalesce(string_agg(callsign, ', ' ORDER BY ordinal), '') FROM f LEFT JOIN ({FIRSTS.format("matched AND matched_callsign IS NOT NULL")}) c ON c.session = f.session GROUP BY f.session
 UNION ALL SELECT session, 5, '', 0, 'Traffic outstanding: ' || string_agg(callsign, ', ' ORDER BY ordinal) FROM ({FIRSTS.format("traffic = 'yes' AND NOT traffic_cleared AND matched AND matched_callsign IS NOT NULL")}) GROUP BY session
 UNION ALL SELECT session, 6, '', 0, 'Traffic passed: ' || string_agg(DISTINCT matched_callsign, ', ' ORDER BY matched_callsign) FROM net_log WHERE traffic = 'yes' AND traffic_cleared AND matched_callsign IS NOT NULL GROUP BY session)"""


@_query(f"WITH {LOG_PARTS} SELECT session, row_number() OVER (PARTITION BY session ORDER BY part, t, i) - 1 AS line_no, line FROM lines")
def render_log(v):
    """The log of lines of which some were corrected, and some stations have a name or a place."""
    k = F.col("id")
    rows = v("net_log").withColumn("original_callsign", F.when(k % 2 == 0, F.col("candidate"))).withColumn("operator_name", F.when(k % 3 == 0, F.concat(F.lit("Op "), k))).withColumn("position", F.when(k % 5 == 0, "gate").otherwise(""))
    return writers.render_log(rows)


# History

ATT = """att AS (SELECT callsign, count(*) AS sessions, cast(sum(n) AS bigint) AS transmissions, sum(pow(0.85, age)) AS score, max(session) AS last_seen FROM
 (SELECT session, matched_callsign AS callsign, count(*) AS n FROM net_log WHERE matched AND matched_callsign IN (SELECT callsign FROM net_roster) GROUP BY 1, 2)
 JOIN (SELECT session, dense_rank() OVER (ORDER BY session DESC) - 1 AS age FROM (SELECT DISTINCT session FROM net_log)) USING (session) GROUP BY callsign)"""
SRC = "srcs AS (SELECT matched_callsign AS callsign, string_agg(DISTINCT source, ',' ORDER BY source) FILTER (source <> '') AS sources FROM net_log WHERE matched GROUP BY 1)"


@_query(f"WITH {ATT}, {SRC} SELECT callsign, sessions, transmissions, round(score, 6) AS score, last_seen, coalesce(sources, '') AS sources FROM att LEFT JOIN srcs USING (callsign)")
def attendance(v):
    return history.attendance(v("net_log"), v("net_roster")).withColumn("score", F.round("score", 6)).withColumn("sources", _list("sources"))


@_query(f"WITH {ATT} SELECT callsign, round(score, 6) AS score FROM att ORDER BY att.score DESC, callsign LIMIT 5")
def expected(v):
    return history.expected(history.attendance(v("net_log"), v("net_roster")), 5).select("callsign", F.round("score", 6).alias("score"))


@_query(f"WITH {ATT}, {SRC} SELECT callsign, sessions FROM att LEFT JOIN srcs USING (callsign) WHERE sources IS NULL OR sources LIKE '%east%'")
def for_source(v):
    return history.for_source(history.attendance(v("net_log"), v("net_roster")), "east").select("callsign", "sessions")


@_query("SELECT session, dense_rank() OVER (ORDER BY session DESC) - 1 AS age FROM (SELECT DISTINCT session FROM net_log)")
def session_age(v):
    return windows.session_age(v("net_log"))


@_query("SELECT DISTINCT matched_callsign AS callsign FROM net_log WHERE matched AND matched_callsign NOT IN (SELECT callsign FROM net_roster)")
def unknown_callsigns(v):
    return history.unknown_callsigns(v("net_log"), v("net_roster"))


MINED = """mined AS (SELECT callsign, count(DISTINCT session) AS sessions, count(*) AS mentions, arg_min(raw_text, (session, line_no)) AS example FROM
 (SELECT *, regexp_extract(raw_text, '^[A-Z0-9]+') AS callsign FROM net_records WHERE type IN ('entry', 'correction')) WHERE regexp_full_match(callsign, '[A-Z]{1,2}[0-9][A-Z]{1,3}') GROUP BY callsign)"""


def _mined(v):
    rows = text.normalise(v("net_records"), "raw_text")
    found = rows.select("session", "line_no", "type", "raw_text", F.explode(F.transform("tokens", lambda x: x.text)).alias("candidate"))
    return history.mine_callsigns(found)


@_query(f"WITH {MINED} SELECT callsign, sessions, mentions, example, sessions >= 2 AS likely FROM mined")
def mine_callsigns(v):
    return _mined(v)


LIC = f"""WITH {MINED}, l AS (SELECT m.callsign, regexp_matches(m.callsign, '{geo.FOREIGN}') AS far, status, grid FROM mined m LEFT JOIN net_licences c ON c.callsign = m.callsign),
 g AS (SELECT callsign, CASE WHEN far THEN 'non-us' ELSE coalesce(status, 'unchecked') END AS status, CASE WHEN NOT far THEN grid END AS grid FROM l),
 h AS (SELECT grid AS home FROM g WHERE grid IS NOT NULL GROUP BY grid ORDER BY count(*) DESC, grid LIMIT 1),
 p AS (SELECT callsign, status, grid, radians((ascii(substr(grid, 2, 1)) - 65) * 10 - 90 + (ascii(substr(grid, 4, 1)) - 48) + 0.5) AS a, radians((ascii(grid) - 65) * 20 - 180 + (ascii(substr(grid, 3, 1)) - 48) * 2 + 1.0) AS o,
 radians((ascii(substr(home, 2, 1)) - 65) * 10 - 90 + (ascii(substr(home, 4, 1)) - 48) + 0.5) AS b, radians((ascii(home) - 65) * 20 - 180 + (ascii(substr(home, 3, 1)) - 48) * 2 + 1.0) AS q FROM g, h)
 SELECT callsign, status, grid, round(2 * 6371 * asin(sqrt(least(1.0, pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin((q - o) / 2), 2)))), 3) AS distance_km FROM p"""


@_query(LIC)
def check_licences(v):
    return history.check_licences(_mined(v), v("net_licences")).select("callsign", "status", "grid", F.round("distance_km", 3).alias("distance_km"))


@_query(f"WITH {MINED} SELECT callsign FROM mined WHERE sessions >= 2 AND callsign NOT IN (SELECT callsign FROM net_licences WHERE status = 'not issued' AND NOT regexp_matches(callsign, '{geo.FOREIGN}'))")
def draft_roster(v):
    mined = _mined(v)
    return history.draft_roster(mined, history.check_licences(mined, v("net_licences"), "CN87")).select("callsign")


@_query(f"""WITH {MINED}, d AS (SELECT callsign FROM mined WHERE sessions >= 2 AND callsign NOT IN (SELECT callsign FROM net_licences WHERE status = 'not issued' AND NOT regexp_matches(callsign, '{geo.FOREIGN}'))),
 t AS (SELECT (SELECT count(DISTINCT session) FROM net_records) AS n, (SELECT count(*) FROM mined WHERE sessions >= 2) - (SELECT count(*) FROM d) AS k)
 SELECT 0 AS part, '0' AS place, '# Draft roster from ' || n || ' sessions. Nobody has checked it.' AS line FROM t UNION ALL SELECT 0, '1', '# Callsigns left out because nobody holds them: ' || k FROM t
 UNION ALL SELECT 0, '2', '# Strike what you do not know and fill in names and positions before use.' UNION ALL SELECT 0, '3', 'callsign,name,sources,position' UNION ALL SELECT 1, callsign, callsign || ',,,' FROM d""")
def draft_lines(v):
    mined = _mined(v)
    return history.draft_lines(mined, v("net_records"), history.check_licences(mined, v("net_licences"), "CN87"))


HINTS = f"""{ATT}, hints AS (SELECT callsign AS term, CASE WHEN mine AND NOT heard THEN 2 WHEN mine THEN 3 ELSE 4 END AS grp, -coalesce(score, 0) AS place FROM
 (SELECT r.callsign, r.src IN ('', 'east') AS mine, r.callsign IN (SELECT matched_callsign FROM net_log WHERE matched AND session = '2024-01-30') AS heard, score FROM net_roster r LEFT JOIN att USING (callsign)))"""


def _hints(v):
    roster, rows = v("net_roster"), v("net_log")
    heard = rows.where("matched and session = '2024-01-30'").select(F.col("matched_callsign").alias("callsign"))
    none = heard.select(F.col("callsign").alias("term"), F.lit(0).alias("grp"), F.lit(0).alias("place")).where("false")
    return history.hint_terms(roster, heard, history.attendance(rows, roster), "east", none)


@_query(f"WITH {HINTS} SELECT term, grp, round(place, 6) AS place FROM hints")
def hint_terms(v):
    return _hints(v).withColumn("place", F.round("place", 6))


BUDGET = "SELECT term, running_cost FROM (SELECT term, sum(length(term) + 1) OVER (ORDER BY term ROWS UNBOUNDED PRECEDING) AS running_cost FROM (SELECT callsign AS term FROM net_roster)) WHERE running_cost <= 200"


@_query(BUDGET)
def fit_terms(v):
    terms = v("net_roster").select(F.col("callsign").alias("term"), F.col("callsign").alias("seq"), (F.length("callsign") + 1).alias("cost"))
    return history.fit_terms(terms, "cost").select("term", "running_cost")


@_query("SELECT source, term, running_cost FROM (SELECT src AS source, callsign AS term, sum(length(name)) OVER (PARTITION BY src ORDER BY ordinal) AS running_cost FROM net_roster) WHERE running_cost <= 100")
def budget_prefix(v):
    rows = v("net_roster").select(F.concat_ws(",", "sources").alias("source"), F.col("callsign").alias("term"), "ordinal", F.length("name").alias("cost"))
    return windows.budget_prefix(rows, "ordinal", "cost", 100, ["source"]).select("source", "term", "running_cost")


@_query("SELECT matched_callsign AS callsign, count(*) AS n FROM net_log WHERE matched GROUP BY 1 ORDER BY n DESC, callsign LIMIT 10")
def top_k(v):
    rows = v("net_log").where("matched").groupBy(F.col("matched_callsign").alias("callsign")).agg(F.count("*").alias("n"))
    return windows.top_k(rows, [F.desc("n"), F.asc("callsign")], 10)


# Text

DECLARED = f"""CASE WHEN contains(raw_text, 'nothing to pass') THEN 'no' WHEN NOT contains(raw_text, 'traffic') THEN CASE WHEN contains(raw_text, 'message for') THEN 'yes' ELSE '' END
 WHEN regexp_matches(raw_text, '\\b({'|'.join(text.NEGATORS)})( [a-z]+){{0,2}} traffic') THEN 'no' WHEN regexp_matches(raw_text, '\\b({'|'.join(text.ASKING)})( [a-z]+)? traffic') THEN ''
 WHEN regexp_matches(raw_text, '\\b({'|'.join(text.DECLARING)})( [a-z]+){{0,2}} traffic|traffic for') THEN 'yes' ELSE '' END"""


@_query(f"SELECT session, id, {DECLARED} AS declared FROM net_log")
def detect_traffic(v):
    return text.detect_traffic(v("net_log"), "raw_text").select("session", "id", "declared")


@_query("SELECT session, id, candidate FROM net_log")
def normalise(v):
    """Spelled-out lines come back as the callsign they were made of."""
    spoken = text.spell(v("net_log").select("session", "id", "candidate"), "candidate")
    return text.normalise(spoken, "spelled").select("session", "id", F.col("normalised").alias("candidate"))


@_query("SELECT session, id, 0 AS pos, candidate, true AS strict, 0 AS best_rank FROM net_log WHERE regexp_full_match(candidate, '[A-Z]{1,2}[0-9][A-Z]{1,3}')")
def mentions(v):
    rows = text.normalise(v("net_log").select("session", "id", F.concat("candidate", F.lit(" good morning")).alias("t")), "t")
    return text.mentions(rows).select("session", "id", "pos", "candidate", "strict", "best_rank")


SPOKEN = ", ".join(f"'{c}': '{w}'" for c, w in [*[(w[0].upper(), w) for w in vocabulary.ALPHABET], *[(str(i), w) for i, w in enumerate(vocabulary.DIGIT_WORDS)]])


@_query(f"SELECT callsign, array_to_string(list_transform(string_split(callsign, ''), lambda c: MAP {{{SPOKEN}}}[c]), ' ') AS spelled FROM net_roster")
def spell(v):
    return text.spell(v("net_roster").select("callsign"), "callsign")


@_query("""SELECT session, id, id % 7 = 0 OR id % 7 = 1 AS suspect FROM net_log""")
def flag_echo(v):
    """A seventh of the lines names three stations, a seventh one station three times, the others one."""
    rows = v("net_log").select("session", "id", "candidate", F.concat("raw_text", F.lit(" here at the gate now")).alias("raw_text"))
    many = F.when(F.col("id") % 7 == 0, F.array("candidate", F.lit("K7AAA"), F.lit("K7BBB"))).when(F.col("id") % 7 == 1, F.array("candidate", "candidate", "candidate")).otherwise(F.array("candidate"))
    named = rows.select("session", "id", F.posexplode(many).alias("pos", "callsign"))
    return text.flag_echo(rows, named).select("session", "id", "suspect")


@_query("SELECT conv_id, turn, round(rms, 6) AS rms FROM (SELECT conv_id, turn, sqrt(list_sum(list_transform(range(0, 5), lambda i: pow(turn + i, 2))) / 5) AS rms FROM (SELECT id AS conv_id, id % 13 AS turn FROM net_log))")
def frame_rms(v):
    from ..functions.text import rms

    rows = v("net_log").select(F.col("id").alias("conv_id"), (F.col("id") % 13).alias("turn"))
    return rows.withColumn("rms", F.round(rms(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("turn") + i)), 6))


@_query("SELECT source, frame_no, round(CASE WHEN rms > 1 THEN least(1.0, log10(rms) / log10(8000)) ELSE 0 END, 6) AS level FROM net_frames")
def frame_level(v):
    from ..functions.text import level

    return v("net_frames").select("source", "frame_no", F.round(level(F.col("rms")), 6).alias("level"))


@_query("""SELECT session, id, strftime(cast(timestamp AS timestamp) + to_milliseconds(cast(round(confidence * 60000) AS bigint)), '%Y-%m-%dT%H:%M:%S.%g') AS started_at FROM net_log""")
def line_times(v):
    from ..functions.text import after_ms

    return v("net_log").select("session", "id", after_ms(F.col("timestamp"), F.round(F.col("confidence") * 60000)).alias("started_at"))


@_query("SELECT clip, word_no, text, start, \"end\" FROM (SELECT id AS clip, w AS word_no, CASE w WHEN 1 THEN 'over' ELSE 'there' END AS text, CASE w WHEN 1 THEN 0.0 ELSE 0.2 END AS start, CASE w WHEN 1 THEN 0.2 ELSE 0.4 END AS \"end\" FROM net_log, (SELECT 1 AS w UNION ALL SELECT 2))")
def assemble_words(v):
    rows = v("net_log").select(F.col("id").alias("clip"))
    parts = [("ov", True), ("er", False), ("the", True), ("re", False)]
    tokens = rows.select("clip", F.posexplode(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(s).alias("starts_word")) for t, s in parts])).alias("token_no", "x"))
    tokens = tokens.select("clip", "token_no", "x.text", "x.starts_word", (F.col("token_no") * 10).alias("t0_cs"), (F.col("token_no") * 10 + 10).alias("t1_cs"))
    return text.assemble_words(tokens, rows.select("clip", F.lit("over there").alias("text"))).drop("offset")


# Matching

LCS = """list_last(list_reduce(list_transform(string_split({a}, ''), lambda x: [ascii(x)]), lambda row, xs: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [cast(j AS int)]),
 lambda out, js: list_append(out, CASE WHEN ascii({b}[js[1]]) = xs[1] THEN row[js[1]] + 1 ELSE greatest(row[js[1] + 1], out[js[1]]) END), [0]), list_transform(range(0, length({b}) + 1), lambda z: 0)))"""
RATIO = f"200.0 * {LCS.format(a='candidate', b='callsign')} / (length(candidate) + length(callsign))"
SCORED = f"scored AS (SELECT candidate, callsign, ordinal, cast({RATIO} AS double) AS score FROM (SELECT DISTINCT candidate FROM net_mentions), net_roster)"
JUDGED = """ranked AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM scored WINDOW w AS (PARTITION BY candidate ORDER BY score DESC, ordinal)),
 judged AS (SELECT candidate, callsign, score, second, CASE WHEN score < 78 THEN 'below_threshold' WHEN candidate <> callsign AND score - second < 5 THEN 'ambiguous' END AS reason FROM ranked WHERE n = 1)"""


@_query(f"WITH {SCORED}, {JUDGED} SELECT candidate, reason IS NULL AS matched, CASE WHEN reason IS NULL THEN callsign END AS callsign, round(score, 6) AS score, round(second, 6) AS runner_up_score, reason FROM judged")
def match_candidates(v):
    out = match.match_candidates(v("net_mentions"), v("net_roster"))
    return out.select("candidate", "matched", "callsign", F.round("score", 6).alias("score"), F.round("runner_up_score", 6).alias("runner_up_score"), "reason")


@_query(f"WITH {SCORED}, {JUDGED} SELECT session, id, reason IS NULL AS matched, CASE WHEN reason IS NULL THEN callsign END AS callsign, reason FROM net_mentions JOIN judged USING (candidate)")
def match_lines(v):
    rows = v("net_mentions").select("session", "id", F.concat("candidate", F.lit(" good morning")).alias("raw_text"))
    return match.match_lines(rows, v("net_roster")).select("session", "id", "matched", "callsign", "reason")


@_query(f"WITH {SCORED}, {JUDGED} SELECT session, id, callsign FROM net_mentions JOIN judged USING (candidate) WHERE reason IS NULL")
def match_all(v):
    rows = v("net_mentions").select("session", "id", F.concat("candidate", F.lit(" and again "), "candidate").alias("raw_text"))
    return match.match_all(rows, v("net_roster")).select("session", "id", "callsign")


@_query(f"WITH {SCORED} SELECT candidate, rank, callsign, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, ordinal) AS rank FROM scored) WHERE rank <= 8")
def nearest(v):
    return match.nearest(v("net_mentions"), v("net_roster")).withColumn("score", F.round("score", 6))


@_query(f"""SELECT candidate AS first, callsign AS second, round(score, 6) AS score FROM (SELECT candidate, callsign, cast({RATIO} AS double) AS score FROM (SELECT callsign AS candidate, ordinal AS o FROM net_roster) JOIN net_roster ON o < ordinal) WHERE score >= 50""")
def roster_conflicts(v):
    return match.roster_conflicts(v("net_roster"), 50).withColumn("score", F.round("score", 6))


WAYS = ["spoken", "hyphenated", "glued", "numeral", "ordinal", "numeric ordinal", "roman", "half a niner", "split niner", "welded", "collapsed suffix", "in a sentence", "shouted", "title", "letter names", "half letter names", "hyphen joined"]


@_query(f"SELECT callsign, rendering, true AS matched, callsign AS found FROM net_roster, (SELECT unnest({WAYS}) AS rendering)")
def renderings(v):
    """Every station of the roster, written in every way that loses nothing, is matched as itself."""
    written_ = text.renderings(v("net_roster").select("callsign")).select(F.col("callsign").alias("session"), F.col("rendering").alias("id"), F.col("written").alias("raw_text"))
    found = match.match_lines(written_, v("net_roster"))
    return found.select(F.col("session").alias("callsign"), F.col("id").alias("rendering"), "matched", F.col("callsign").alias("found"))


CROSS = f"""pairs AS (SELECT l.id AS clip, l.candidate AS callsign, m.candidate AS candidate FROM net_log l JOIN net_mentions m ON m.session = l.session AND m.id = l.id),
 checked AS (SELECT clip, callsign, cast({RATIO} AS double) >= 78 AS supported FROM pairs WHERE regexp_full_match(callsign, '[A-Z]{{1,2}}[0-9][A-Z]{{1,3}}'))"""


def _cross(v):
    others = v("net_mentions").select(F.lit("other").alias("engine"), F.col("id").alias("clip"), F.when(F.col("id") % 2 == 0, F.concat("candidate", F.lit(" good morning"))).otherwise(F.lit("good morning")).alias("text"))
    return match.cross_check(v("net_log").select(F.col("id").alias("clip"), F.col("raw_text").alias("text")), others)


@_query(f"WITH {CROSS} SELECT clip, callsign, supported AND clip % 2 = 0 AS supported FROM checked")
def cross_check(v):
    return _cross(v)


@_query(f"""WITH {CROSS}, c AS (SELECT callsign, supported AND clip % 2 = 0 AS supported FROM checked), t AS (SELECT count(*) AS n, count(*) FILTER (supported) AS y FROM c)
 SELECT 'total' AS section, 'claims' AS key, cast(n AS double) AS value FROM t UNION ALL SELECT 'total', 'supported', y FROM t UNION ALL SELECT 'total', 'unsupported', n - y FROM t
 UNION ALL SELECT 'total', 'supported_percent', round(100.0 * y / n, 6) FROM t UNION ALL SELECT 'total', 'unsupported_percent', round(100.0 * (n - y) / n, 6) FROM t
 UNION ALL (SELECT 'unsupported', callsign, count(*) FROM c WHERE NOT supported GROUP BY callsign ORDER BY count(*) DESC, callsign LIMIT 10)""")
def cross_check_report(v):
    return match.cross_check_report(_cross(v))


def _clips(v):
    return v("net_log").select(F.col("id").alias("clip"), F.lit("AB1CDE over FG2HIJ here").alias("text"), F.lit(4000).cast("long").alias("duration_ms"), F.lit(False).alias("suspect"))


def _stations(v):
    return v("net_log").select(F.col("id").alias("clip"), F.explode(F.array(F.struct(F.lit("AB1CDE").alias("callsign"), F.lit(0).alias("start"), F.lit(6).alias("end")), F.struct(F.lit("FG2HIJ").alias("callsign"), F.lit(12).alias("start"), F.lit(18).alias("end")))).alias("x")).select("clip", "x.*")


@_query("""SELECT id AS clip, 1 AS seg_no, 'AB1CDE over' AS text, 0 AS start_offset_ms, 1600 AS duration_ms FROM net_log WHERE id % 3 = 0
 UNION ALL SELECT id, 2, 'FG2HIJ here', 1600, 2400 FROM net_log WHERE id % 3 = 0 UNION ALL SELECT id, 1, 'AB1CDE over FG2HIJ here', 0, 4000 FROM net_log WHERE id % 3 <> 0""")
def split_transmissions(v):
    return split.split_transmissions(_clips(v), v("net_words"), _stations(v))


def _scores(v):
    cuts = split.split_settings(_clips(v), v("net_words"), _stations(v), [300, 500, 1500])
    found = cuts.select("setting", "clip", "seg_no", F.explode(F.regexp_extract_all("text", F.lit("([A-Z]{2}[0-9][A-Z]{3})"), F.lit(1))).alias("callsign"))
    return calibrate.score_settings(cuts, found)


SWEEP = """s AS (SELECT setting, count(*) AS clips, cast(sum(CASE WHEN cut THEN 2 ELSE 0 END) AS bigint) AS clean, count(*) FILTER (NOT cut) AS merged, cast(0 AS bigint) AS empty, cast(2 AS bigint) AS stations FROM
 (SELECT setting, id % 3 = 0 AND setting <= 1000 AS cut FROM net_log, (SELECT 300 AS setting UNION ALL SELECT 500 UNION ALL SELECT 1500)) GROUP BY setting),
 scores AS (SELECT *, round(clean + 0.5 * stations - 1.5 * merged - 0.2 * empty, 6) AS value FROM s)"""


@_query(f"WITH {SWEEP} SELECT setting, clips, clean, merged, empty, stations, cast(value AS double) AS value FROM scores")
def score_settings(v):
    return _scores(v).withColumn("value", F.round(F.col("value").cast("double"), 6))


@_query(f"WITH {SWEEP} SELECT setting, cast(value AS double) AS value, setting = 300 AS best FROM scores WHERE value >= (SELECT max(value) FROM scores) - 0.5")
def best_setting(v):
    return calibrate.best_setting(_scores(v)).withColumn("value", F.round(F.col("value").cast("double"), 6))


def _cut_sql(gap: int) -> str:
    """Segments of net_talk, cut at pauses of `gap` ms, by the rules of W3."""
    return f"""(WITH clips AS (SELECT clip, string_agg(text, ' ' ORDER BY word_no) AS said, max(end_ms) + 500 AS dur FROM net_talk GROUP BY clip), st AS (SELECT clip, k, place AS begins, place + length(text) AS ends FROM net_talk WHERE w = 0),
 prs AS (SELECT a.clip, a.k, a.ends AS lo, b.begins AS hi FROM st a JOIN st b ON b.clip = a.clip AND b.k = a.k + 1 WHERE a.clip % 13 <> 0),
 ins AS (SELECT p.clip, p.k, t.word_no, t.place, t.start_ms, t.start_ms - lag(t.end_ms) OVER (PARTITION BY p.clip, p.k ORDER BY t.word_no) AS pause FROM prs p JOIN net_talk t ON t.clip = p.clip AND t.place BETWEEN p.lo AND p.hi WHERE t.clip % 11 <> 0),
 longest AS (SELECT *, row_number() OVER (PARTITION BY clip, k ORDER BY pause DESC, word_no) AS r FROM ins WHERE pause IS NOT NULL), cuts AS (SELECT clip, place, start_ms FROM longest WHERE r = 1 AND pause >= {gap}),
 heads AS (SELECT * FROM cuts UNION ALL SELECT DISTINCT clip, 0, 0 FROM cuts),
 pcs AS (SELECT h.clip, row_number() OVER o AS seg_no, trim(substr(said, place + 1, coalesce(lead(place) OVER o, length(said)) - place)) AS text, start_ms AS start_offset_ms, coalesce(lead(start_ms) OVER o, dur) - start_ms AS duration_ms
  FROM heads h JOIN clips c ON c.clip = h.clip WINDOW o AS (PARTITION BY h.clip ORDER BY place)),
 bad AS (SELECT DISTINCT clip FROM pcs WHERE text = '' OR duration_ms < 400)
 SELECT * FROM pcs WHERE clip NOT IN (SELECT clip FROM bad) UNION ALL SELECT clip, 1, said, 0, dur FROM clips WHERE clip NOT IN (SELECT clip FROM pcs) OR clip IN (SELECT clip FROM bad))"""


def _cuts(talk: DataFrame, gaps: tuple[int, ...]) -> DataFrame:
    clips = talk.groupBy("clip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x.text), " ").alias("text"), (F.max("end_ms") + 500).alias("duration_ms")).withColumn("suspect", F.col("clip") % 13 == 0)
    words = talk.where("clip % 11 <> 0").select("clip", "word_no", "text", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("place").alias("offset"))
    named = talk.where("w = 0").select("clip", F.col("text").alias("callsign"), F.col("place").alias("start"), (F.col("place") + F.length("text")).alias("end"))
    return split.split_settings(clips, words, named, list(gaps))


@_query(f"SELECT clip, cast(seg_no AS int) AS seg_no, text, cast(start_offset_ms AS bigint) AS start_offset_ms, cast(duration_ms AS bigint) AS duration_ms FROM {_cut_sql(500)}")
def split_talk(v):
    """Clips of one to three stations: pauses that are too short or lie nowhere between, slivers, clips
    without timings and echoes."""
    return _cuts(v("net_talk"), (500,)).drop("setting")


SETTINGS = (150, 500, 1500)
TALK_SCORES = f"""segs AS ({" UNION ALL ".join(f"SELECT {g} AS setting, * FROM {_cut_sql(g)}" for g in SETTINGS)}), heard AS (SELECT DISTINCT setting, clip, seg_no, unnest(regexp_extract_all(text, '[A-Z]{{2}}[0-9][A-Z]{{3}}')) AS callsign FROM segs),
 per AS (SELECT s.setting, s.clip, s.seg_no, count(callsign) AS stations FROM segs s LEFT JOIN heard h ON h.setting = s.setting AND h.clip = s.clip AND h.seg_no = s.seg_no GROUP BY 1, 2, 3),
 whole AS (SELECT setting, clip, count(*) AS n, count(*) FILTER (stations > 0) AS clean, count(*) FILTER (stations = 0) AS empty, max(stations) AS most FROM per GROUP BY 1, 2),
 scores AS (SELECT setting, count(*) AS clips, cast(sum(clean) AS bigint) - count(*) FILTER (n = 1 AND most > 1) AS clean, count(*) FILTER (n = 1 AND most > 1) AS merged, cast(sum(empty) AS bigint) AS empty, (SELECT count(DISTINCT callsign) FROM heard h WHERE h.setting = w.setting) AS stations FROM whole w GROUP BY setting),
 valued AS (SELECT *, cast(clean + 0.5 * stations - 1.5 * merged - 0.2 * empty AS double) AS value FROM scores)"""


def _talk_scores(v) -> DataFrame:
    cuts = written(_cuts(written(v("net_talk")), SETTINGS))
    found = cuts.select("setting", "clip", "seg_no", F.explode(F.regexp_extract_all("text", F.lit("([A-Z]{2}[0-9][A-Z]{3})"), F.lit(1))).alias("callsign"))
    return calibrate.score_settings(cuts, found)


@_query(f"WITH {TALK_SCORES} SELECT setting, clips, clean, merged, empty, stations, round(value, 6) AS value FROM valued")
def talk_settings(v):
    """How well each shortest pause cuts the same clips."""
    return _talk_scores(v).withColumn("value", F.round(F.col("value").cast("double"), 6))


@_query(f"WITH {TALK_SCORES} SELECT setting, round(value, 6) AS value, setting = (SELECT setting FROM valued ORDER BY value DESC, setting LIMIT 1) AS best FROM valued WHERE value >= (SELECT max(value) FROM valued) - 200")
def best_talk_setting(v):
    return calibrate.best_setting(written(_talk_scores(v)), 200).withColumn("value", F.round(F.col("value").cast("double"), 6))


@_query("""WITH t AS (SELECT clip, count(DISTINCT text) FILTER (w = 0) AS stations, count(*) FILTER (w > 0) AS others FROM net_talk GROUP BY clip)
 SELECT clip, stations > 2 OR (stations = 2 AND others < 3) AS suspect FROM t""")
def echo_talk(v):
    """Clips of three stations, and of two with hardly a word besides, look like the prompt coming back."""
    talk = v("net_talk")
    lines = talk.groupBy(F.col("clip").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x.text), " ").alias("raw_text")).withColumn("session", F.lit("talk"))
    named = talk.where("w = 0").select(F.lit("talk").alias("session"), F.col("clip").alias("id"), F.col("k").alias("pos"), F.col("text").alias("callsign"))
    return text.flag_echo(lines, named).select(F.col("id").alias("clip"), "suspect")


# Voice

PAIRS = "pairs AS (SELECT a.callsign = b.callsign AS same, greatest(0.0, least(1.0, list_inner_product(cast(a.vector AS double[]), cast(b.vector AS double[])))) AS similarity FROM net_voice a JOIN net_voice b ON a.ordinal < b.ordinal)"


@_query(f"WITH {PAIRS} SELECT same, round(similarity, 6) AS similarity FROM pairs")
def voice_pairs(v):
    return voice.voice_pairs(v("net_voice"), digits=6)


@_query(f"WITH {PAIRS} SELECT same, count(*) AS n, round(avg(similarity), 6) AS mean_similarity FROM pairs GROUP BY same")
def separation(v):
    return voice.separation(v("net_voice")).withColumn("mean_similarity", F.round("mean_similarity", 6))


@_query(f"""WITH {PAIRS}, n AS (SELECT count(*) FILTER (same) AS s, count(*) FILTER (NOT same) AS d, stddev_pop(similarity) FILTER (same) AS spread FROM pairs),
 r AS (SELECT similarity, row_number() OVER (ORDER BY similarity DESC) - 1 AS k FROM pairs WHERE NOT same), c AS (SELECT similarity + 0.005 AS raw FROM r, n WHERE k = least(d - 1, cast(floor(d * 0.01) AS bigint)))
 SELECT round(least(0.98, greatest(0.5, raw)), 3) AS threshold, round(greatest(0.03, spread), 3) AS margin, (SELECT round(avg(CASE WHEN similarity >= raw THEN 1.0 ELSE 0 END), 6) FROM pairs WHERE same) AS recall, s AS same_n, d AS different_n FROM c, n""")
def calibrate_voice(v):
    return calibrate.calibrate_voice(v("net_voice")).select("threshold", "margin", F.round("recall", 6).alias("recall"), "same_n", "different_n")


@_query()
def build_profiles(v):
    return voice.build_profiles(v("net_voice"))


PROFILES = """WITH RECURSIVE s AS MATERIALIZED (SELECT callsign, row_number() OVER (PARTITION BY callsign ORDER BY ordinal) AS k, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u
 FROM (SELECT callsign, ordinal, cast(vector AS double[]) AS v FROM net_voice)), p AS (SELECT callsign, k, u AS c FROM s WHERE k = 1 UNION ALL
 SELECT callsign, k, list_transform(moved, lambda x: x / sqrt(list_inner_product(moved, moved))) FROM
 (SELECT s.callsign, s.k, list_transform(list_zip(c, u), lambda z: (z[1] * p.k + z[2]) / (p.k + 1)) AS moved FROM p JOIN s ON s.callsign = p.callsign AND s.k = p.k + 1))
 SELECT callsign, k AS n, i, round(c[i + 1], 6) AS value FROM (SELECT callsign, k, c, unnest(range(0, len(c))) AS i FROM p WHERE (callsign, k) IN (SELECT (callsign, max(k)) FROM p GROUP BY callsign))"""


@_query(PROFILES)
def profile_values(v):
    """Centroids of the profiles, a row per component."""
    rows = voice.build_profiles(v("net_voice")).select("callsign", F.col("n").cast("long").alias("n"), F.posexplode("centroid").alias("i", "value"))
    return rows.withColumn("i", F.col("i").cast("long")).withColumn("value", F.round("value", 6))


@_query(PROFILES)
def extended_profiles(v):
    """The same from profiles of the first samples, written down, that the later ones are added to."""
    rows = v("net_voice")
    half = rows.agg((F.max("ordinal") / 2).alias("half"))
    told = rows.crossJoin(F.broadcast(half))
    stored = written(voice.build_profiles(told.where("ordinal <= half").drop("half")))
    profiles, _ = voice.extend_profiles(stored, told.where("ordinal > half").drop("half"))
    parts = profiles.select("callsign", "n", F.posexplode("centroid").alias("i", "value"))
    return parts.withColumn("i", F.col("i").cast("long")).withColumn("value", F.round("value", 6))


@_query("SELECT callsign, count(*) AS n FROM net_voice WHERE callsign NOT IN ('A') GROUP BY callsign HAVING count(*) >= 2")
def known(v):
    return voice.known(voice.forget(voice.build_profiles(v("net_voice")), ["A"])).select("callsign", F.col("n").cast("long").alias("n"))


@_query("""WITH c AS (SELECT callsign, vector AS centroid FROM net_voice QUALIFY row_number() OVER (PARTITION BY callsign ORDER BY ordinal) = 1),
 s AS (SELECT v.ordinal AS clip, c.callsign, greatest(0.0, least(1.0, list_inner_product(cast(v.vector AS double[]), cast(c.centroid AS double[])))) AS score FROM net_voice v, c),
 r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY clip ORDER BY score DESC, callsign DESC))
 SELECT clip, CASE WHEN score >= 0.82 AND score - second >= 0.06 THEN callsign END AS callsign, CASE WHEN score < 0.82 THEN 'too far' WHEN score - second < 0.06 THEN 'too close' END AS reason FROM r WHERE n = 1""")
def identify(v):
    firsts = v("net_voice").groupBy("callsign").agg(F.min_by(F.col("vector"), "ordinal").alias("centroid")).withColumn("n", F.lit(2))
    return voice.identify(v("net_voice").withColumn("clip", F.col("ordinal")), firsts).select("clip", "callsign", "reason")


# Calibration and scoring


@_query("""WITH r AS (SELECT confidence, matched AND NOT corrected AS good, NOT matched AS bad FROM net_log), g AS (SELECT i, 0.2::DOUBLE + i * 0.010000000000000009::DOUBLE AS t FROM range(0, 70) x(i)),
 s AS (SELECT i, t, sum(CASE WHEN bad AND confidence < t THEN 1 ELSE 0 END) / sum(CASE WHEN bad THEN 1 ELSE 0 END) - sum(CASE WHEN good AND confidence < t THEN 1 ELSE 0 END) / sum(CASE WHEN good THEN 1 ELSE 0 END) AS gain,
 sum(CASE WHEN confidence < t THEN 1 ELSE 0 END) / count(*) AS share FROM r, g GROUP BY i, t),
 k AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS m FROM s WHERE gain >= (SELECT max(gain) FROM s) - 1e-9), f AS (SELECT count(*) FILTER (good) AS matched_n, count(*) FILTER (bad) AS unmatched_n,
 quantile_cont(confidence, 0.5) FILTER (good) - quantile_cont(confidence, 0.5) FILTER (bad) AS separation FROM r)
 SELECT CASE WHEN separation > 0.05 THEN round(t, 2) ELSE 0.55 END AS threshold, round(separation, 6) AS separation, CASE WHEN separation > 0.05 THEN round(share, 6) END AS share_below, matched_n, unmatched_n,
 CASE WHEN separation <= 0.05 THEN 'no separation' END AS note FROM f, k WHERE k = m // 2""")
def calibrate_confidence(v):
    return calibrate.calibrate_confidence(v("net_log")).withColumn("separation", F.round("separation", 6)).withColumn("share_below", F.round("share_below", 6))


@_query("SELECT cast(least(floor(confidence / (1.0 / 34)), 33) AS int) AS bin, count(*) AS n FROM net_log WHERE confidence BETWEEN 0 AND 1 GROUP BY 1")
def histogram(v):
    return calibrate.histogram(v("net_log"), "confidence", 0, 1)


@_query("""SELECT source, round(p, 6) AS peak, CASE WHEN p < 1e-4 THEN 1.0 WHEN 0.6 / p BETWEEN 0.8 AND 1.25 THEN 1.0 ELSE round(0.6 / p, 2) END AS gain, CASE WHEN p < 1e-4 THEN 'no signal' WHEN p > 0.98 THEN 'clipping' ELSE '' END AS note
 FROM (SELECT source, max(abs(rms / 5000)) AS p FROM net_frames GROUP BY source)""")
def recommend_gain(v):
    return calibrate.recommend_gain(v("net_frames").withColumn("peak", F.col("rms") / 5000)).withColumn("peak", F.round("peak", 6))


EXPECTED = "x AS (SELECT l.id AS clip, 'engine ' || (l.id % 3) AS engine, l.candidate AS expected, CASE WHEN l.matched THEN m.candidate END AS callsign FROM net_log l JOIN net_mentions m ON m.session = l.session AND m.id = l.id)"


def _answers(v):
    rows = v("net_log").select("session", "id", "matched", F.col("candidate").alias("expected")).join(v("net_mentions"), ["session", "id"])
    return rows.select(F.concat(F.lit("engine "), (F.col("id") % 3).cast("string")).alias("engine"), F.col("id").alias("clip"), F.when(F.col("matched"), F.col("candidate")).alias("callsign")), rows.select(F.col("id").alias("clip"), "expected")


@_query(f"WITH {EXPECTED} SELECT engine, count(*) FILTER (callsign = expected) AS right, count(*) FILTER (callsign <> expected) AS wrong, count(*) FILTER (callsign IS NULL) AS unmatched, count(*) FILTER (callsign IS NULL OR callsign <> expected) AS missed FROM x GROUP BY engine")
def score_matches(v):
    return scoring.score_matches(*_answers(v))


@_query(f"WITH {EXPECTED} SELECT engine, clip, expected, callsign FROM x WHERE callsign IS NULL OR callsign <> expected")
def misses(v):
    return scoring.misses(*_answers(v))


@_query("""SELECT engine, median(load_s) AS load_s, median(compute_s) AS compute_s, round(median(compute_s) / (SELECT sum(clip_duration) FROM net_log), 9) AS factor FROM
 (SELECT source AS engine, session, cast(count(*) AS double) AS load_s, sum(clip_duration) AS compute_s FROM net_log GROUP BY 1, 2) GROUP BY engine""")
def realtime(v):
    runs = v("net_log").groupBy(F.col("source").alias("engine"), "session").agg(F.count("*").cast("double").alias("load_s"), F.sum("clip_duration").alias("compute_s"))
    return scoring.realtime(runs, v("net_log").select(F.col("clip_duration").alias("seconds"))).select("engine", "load_s", "compute_s", F.round("factor", 9).alias("factor"))


@_query("SELECT session AS clip, round(sum(exp(-confidence) * greatest(clip_duration, 0.001)) / sum(greatest(clip_duration, 0.001)), 6) AS confidence FROM net_log GROUP BY 1")
def clip_confidence(v):
    rows = v("net_log").select(F.col("session").alias("clip"), (-F.col("confidence")).alias("avg_logprob"), F.col("clip_duration").alias("duration"))
    return scoring.clip_confidence(rows).withColumn("confidence", F.round("confidence", 6))


@_query("SELECT session AS clip, round(avg(confidence), 6) AS confidence FROM net_log GROUP BY 1")
def token_confidence(v):
    return scoring.token_confidence(v("net_log").select(F.col("session").alias("clip"), F.col("confidence").alias("p"))).withColumn("confidence", F.round("confidence", 6))


# Frames and health

GATE = """gated AS (SELECT source, frame_no, is_speech, f, n < 10 OR f < 300 OR rms >= 1.5 * f AS open FROM (SELECT *, quantile_cont(rms, 0.1) OVER (PARTITION BY source ORDER BY frame_no ROWS BETWEEN 332 PRECEDING AND CURRENT ROW) AS f,
 row_number() OVER (PARTITION BY source ORDER BY frame_no) AS n FROM net_frames))"""


@_query(f"WITH {GATE} SELECT source, frame_no, round(f, 6) AS floor, open FROM gated")
def noise_gate(v):
    return frames.noise_gate(v("net_frames")).select("source", "frame_no", F.round("floor", 6).alias("floor"), "open")


@_query(f"WITH {GATE} SELECT source, frame_no, is_speech AND open AS is_speech FROM gated")
def gate(v):
    return frames.gate(v("net_frames")).select("source", "frame_no", "is_speech")


BURSTS = """WITH RECURSIVE f AS MATERIALIZED (SELECT source, row_number() OVER (PARTITION BY source ORDER BY frame_no) AS n, is_speech AS s FROM net_frames),
 m AS (SELECT source, cast(0 AS bigint) AS n, '' AS ring, cast(-1 AS bigint) AS start, 0 AS frames, 0 AS quiet, cast(-1 AS bigint) AS first, 0 AS len FROM (SELECT DISTINCT source FROM f) UNION ALL
 SELECT source, k, CASE WHEN start < 0 AND NOT up THEN more ELSE '' END, CASE WHEN start < 0 AND up THEN k - 10 WHEN start < 0 OR over THEN -1 ELSE start END,
 CASE WHEN start < 0 AND up THEN 10 WHEN start < 0 OR over THEN 0 ELSE frames + 1 END, CASE WHEN start < 0 OR over THEN 0 ELSE still END,
 CASE WHEN start >= 0 AND over THEN start ELSE -1 END, CASE WHEN start >= 0 AND over THEN frames + 1 - still ELSE 0 END FROM
 (SELECT *, length(more) = 10 AND length(replace(more, '.', '')) > 4 AS up, still >= 26 OR frames + 1 >= 4000 AS over FROM (SELECT m.*, f.n AS k, right(ring || CASE WHEN s THEN 'S' ELSE '.' END, 10) AS more,
 CASE WHEN s THEN 0 ELSE quiet + 1 END AS still FROM m JOIN f ON f.source = m.source AND f.n = m.n + 1))),
 found AS (SELECT source, first, len FROM m WHERE first >= 0 UNION ALL SELECT source, start, frames - quiet FROM m WHERE start >= 0 AND n = (SELECT max(n) FROM f WHERE f.source = m.source))
 SELECT source, '' AS session, row_number() OVER (PARTITION BY source ORDER BY first) - 1 AS seq, first * 30 AS start_offset_ms, cast(len * 30 AS bigint) AS duration_ms FROM found WHERE len * 30 >= 400"""


@_query(BURSTS)
def bursts(v):
    return frames.bursts(v("net_frames"), trigger_ratio=0.4)


@_query("""SELECT source, burst, min(frame_no) AS first_frame, max(frame_no) AS last_frame, count(*) AS speech_frames FROM (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY frame_no) AS burst FROM
 (SELECT *, CASE WHEN (frame_no - lag(frame_no) OVER (PARTITION BY source ORDER BY frame_no)) * 30 <= 60 THEN 0 ELSE 1 END AS new FROM net_frames WHERE is_speech)) GROUP BY source, burst""")
def islands(v):
    return frames.islands(v("net_frames"), silence_ms=60)


def _snapshots(v):
    return v("net_frames").select(
        "source", F.col("frame_no").alias("clock"), (F.col("frame_no") % 11 != 0).alias("capturing"), F.lit(False).alias("finished"), (F.col("frame_no") - F.col("frame_no") % 9).alias("last_frame"),
        (F.col("frame_no") - F.col("frame_no") % 400).alias("last_loud"), (F.col("frame_no") % 13 == 0).cast("int").alias("spill"), (F.col("frame_no") % 10 / 10).alias("buffer_fill"), F.lit(0).alias("overflows"),
    )


HEALTH = """health AS (SELECT source, frame_no AS clock, frame_no % 11 <> 0 AS capturing, CASE WHEN frame_no % 13 = 0 THEN 1 ELSE 0 END AS spill, frame_no % 10 / 10 AS fill, CASE WHEN frame_no % 11 = 0 OR frame_no % 9 > 5 THEN 2
 WHEN frame_no % 400 > 300 OR frame_no % 13 = 0 OR frame_no % 10 > 5 THEN 1 ELSE 0 END AS severity FROM net_frames)"""


@_query(f"WITH {HEALTH} SELECT source, clock, CASE severity WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'ok' END AS state FROM health")
def health(v):
    return frames.health(_snapshots(v)).select("source", "clock", "state")


@_query(f"""WITH {HEALTH}, s AS (SELECT source, clock, CASE severity WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'ok' END AS state FROM health)
 SELECT source, clock, state, previous FROM (SELECT *, lag(state, 1, 'ok') OVER (PARTITION BY source ORDER BY clock) AS previous FROM s) WHERE state <> previous""")
def state_changes(v):
    return windows.state_changes(frames.health(_snapshots(v)).select("source", "clock", "state"), ["source"], "clock")


SIGNALS = """w AS (SELECT *, CASE WHEN kind IN ('started', 'frame') THEN clock END AS heard, CASE WHEN kind = 'started' OR (kind = 'frame' AND value >= 60) THEN clock END AS loud,
 CASE WHEN kind IN ('started', 'failed', 'finished') THEN kind = 'started' END AS up, CASE WHEN kind IN ('started', 'finished') THEN kind = 'finished' END AS done, CASE WHEN kind = 'spill' THEN value END AS waiting FROM net_signals),
 e AS (SELECT source, clock, coalesce(last_value(up IGNORE NULLS) OVER o, false) AS capturing, coalesce(last_value(done IGNORE NULLS) OVER o, false) AS finished, last_value(heard IGNORE NULLS) OVER o AS f,
 last_value(loud IGNORE NULLS) OVER o AS l, coalesce(last_value(waiting IGNORE NULLS) OVER o, 0) AS spill, lead(clock) OVER (PARTITION BY source ORDER BY clock) AS nxt
 FROM w WINDOW o AS (PARTITION BY source ORDER BY clock ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT * FROM e UNION SELECT * REPLACE (f + 5 + 0.001 AS clock) FROM e WHERE capturing AND f + 5 + 0.001 > clock AND f + 5 + 0.001 < nxt
 UNION SELECT * REPLACE (l + 10 + 0.001 AS clock) FROM e WHERE capturing AND l + 10 + 0.001 > clock AND l + 10 + 0.001 < nxt),
 verdicts AS (SELECT source, clock, CASE WHEN NOT capturing AND NOT finished OR capturing AND clock - f > 5 THEN 'error' WHEN capturing AND clock - l > 10 OR spill > 0 THEN 'warning' ELSE 'ok' END AS state FROM r)"""


def _signals(v):
    return frames.health(frames.snapshots(v("net_signals"), silence_s=10, silence_rms=60), silence_s=10).select("source", "clock", "state", "part")


@_query(f"WITH {SIGNALS} SELECT source, round(clock, 3) AS clock, state FROM verdicts")
def health_signals(v):
    """Health after every signal, and where a source's silence sets off an alarm."""
    return _signals(v).select("source", F.round("clock", 3).alias("clock"), "state")


@_query(f"""WITH {SIGNALS} SELECT source, round(clock, 3) AS clock, state, previous FROM (SELECT *, lag(state, 1, 'ok') OVER (PARTITION BY source ORDER BY clock) AS previous FROM verdicts) WHERE state <> previous""")
def signal_changes(v):
    return windows.state_changes(_signals(v), ["source"], "clock", part="part").select("source", F.round("clock", 3).alias("clock"), "state", "previous")


# The fleet at an instant: the last verdict of each source up to it, by an as-of join.
FLEET = """up AS (SELECT *, sum(CASE WHEN kind = 'frame' THEN 1 ELSE 0 END) OVER o AS frames, sum(CASE WHEN kind = 'failed' THEN 1 ELSE 0 END) OVER o AS errors, coalesce(last_value(CASE WHEN kind = 'frame' THEN value END IGNORE NULLS) OVER o, 0) AS level,
 coalesce(last_value(CASE WHEN kind = 'spill' THEN value END IGNORE NULLS) OVER o, 0) AS spill, coalesce(last_value(CASE WHEN kind IN ('started', 'failed', 'finished') THEN kind = 'started' END IGNORE NULLS) OVER o, false) AS capturing,
 coalesce(last_value(CASE WHEN kind IN ('started', 'finished') THEN kind = 'finished' END IGNORE NULLS) OVER o, false) AS finished, last_value(CASE WHEN kind IN ('started', 'frame') THEN clock END IGNORE NULLS) OVER o AS heard,
 last_value(CASE WHEN kind = 'started' OR (kind = 'frame' AND value >= 60) THEN clock END IGNORE NULLS) OVER o AS loud, lead(clock) OVER (PARTITION BY source ORDER BY clock) AS until
 FROM net_signals WINDOW o AS (PARTITION BY source ORDER BY clock ROWS UNBOUNDED PRECEDING)),
 due AS (SELECT * FROM up UNION ALL SELECT * EXCLUDE (ring) REPLACE (ring AS clock) FROM (SELECT *, unnest([heard + 5 + 0.001, loud + 10 + 0.001]) AS ring FROM up) WHERE capturing AND ring > clock AND ring < until),
 told AS (SELECT *, CASE WHEN NOT capturing AND NOT finished THEN 'not capturing' WHEN capturing AND clock - heard > 5 THEN 'no audio frames' WHEN capturing AND clock - loud > 10 THEN 'silent' END AS trouble FROM due),
 judged AS (SELECT *, CASE WHEN trouble IN ('not capturing', 'no audio frames') THEN 2 WHEN trouble IS NOT NULL OR spill > 0 THEN 1 ELSE 0 END AS severity FROM told),
 held AS (SELECT t.clock AS instant, j.* FROM (SELECT * FROM (SELECT DISTINCT clock FROM judged), (SELECT DISTINCT source FROM judged)) t ASOF JOIN judged j ON j.source = t.source AND t.clock >= j.clock),
 named AS (SELECT *, count(*) OVER (PARTITION BY instant) AS sources, concat_ws('; ', CASE WHEN severity = 2 THEN trouble END, CASE WHEN spill > 0 THEN 'clips waiting on disk' END, CASE WHEN severity < 2 THEN trouble END) AS said FROM held),
 fleet AS (SELECT instant, max(severity) AS severity, bool_or(capturing) AS capturing, max(spill) AS spill, sum(frames) AS frames, sum(errors) AS errors, max(level) AS level, max(sources) AS sources,
 coalesce(string_agg(CASE WHEN sources > 1 THEN source || ': ' || replace(said, '; ', '; ' || source || ': ') ELSE said END, '; ' ORDER BY source) FILTER (said <> ''), '') AS issues FROM named GROUP BY instant)"""
STATE = "CASE severity WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'ok' END AS state"


def _fleet(v, **told):
    return frames.fleet(frames.health(frames.snapshots(v("net_signals"), silence_s=10, silence_rms=60), silence_s=10), **told)


@_query(f"WITH {FLEET} SELECT round(instant, 3) AS clock, {STATE}, capturing, spill, cast(frames AS bigint) AS frames, cast(errors AS bigint) AS errors, round(level, 6) AS level, cast(sources AS int) AS sources, issues FROM fleet")
def fleet(v):
    """The fleet at every report of a source, of sources that report at different times."""
    return _fleet(v).select(F.round("clock", 3).alias("clock"), "state", "capturing", "spill", "frames", "errors", F.round("level", 6).alias("level"), "sources", F.array_join("issues", "; ").alias("issues"))


@_query(f"WITH {FLEET}, s AS (SELECT instant, {STATE} FROM fleet) SELECT round(instant, 3) AS clock, state, previous FROM (SELECT *, lag(state, 1, 'ok') OVER (ORDER BY instant) AS previous FROM s) WHERE state <> previous")
def fleet_changes(v):
    rows = _fleet(v, previous=True).where("state <> previous")
    return rows.select(F.round("clock", 3).alias("clock"), "state", "previous")


@_query(f"""WITH {FLEET}, span AS (SELECT cast(ceil(min(instant) / 60) AS bigint) AS low, cast(ceil(max(instant) / 60) AS bigint) AS high FROM fleet), beats AS (SELECT unnest(range(low, high + 1)) * 60.0::DOUBLE AS beat FROM span)
 SELECT beat, {STATE}, cast(frames AS bigint) AS frames, cast(errors AS bigint) AS errors, round(level, 6) AS level FROM beats ASOF JOIN fleet ON beat >= instant""")
def fleet_heartbeat(v):
    """The fleet's state and totals every minute, also of minutes in which nothing reports."""
    return frames.heartbeat(_fleet(v), 60).select("beat", "state", "frames", "errors", F.round("level", 6).alias("level"))


@_query("SELECT callsign, round(s, 6) AS score, round(second, 6) AS runner_up_score FROM (SELECT matched_callsign AS callsign, confidence AS s, lead(confidence) OVER w AS second, row_number() OVER w AS n FROM net_log WHERE matched WINDOW w AS (PARTITION BY matched_callsign ORDER BY confidence DESC, id)) WHERE n = 1")
def top_two(v):
    out = windows.top_two(v("net_log").where("matched"), ["matched_callsign"], "confidence", F.col("id"))
    return out.select(F.col("matched_callsign").alias("callsign"), F.round("confidence", 6).alias("score"), F.round("runner_up_score", 6).alias("runner_up_score"))


@_query("SELECT c_custkey AS id, regexp_extract(line, '\\b([A-Z]{2})(?:\\s+[0-9]{5})?\\s*$', 1) AS state FROM (SELECT callsign AS c_custkey, 'SEATTLE, ' || state || ' 98' || (100 + ascii(grid)) AS line FROM net_licences)")
def address_state(v):
    rows = v("net_licences").select(F.col("callsign").alias("id"), F.concat(F.lit("SEATTLE, "), F.col("state"), F.lit(" 98"), (100 + F.ascii("grid")).cast("string")).alias("line"))
    return rows.select("id", geo.address_state(F.col("line")).alias("state"))


@_query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'WA' WHEN 1 THEN 'OR' WHEN 2 THEN substr(upper(c_name), 1, 2) WHEN 3 THEN NULL ELSE 'ID' END AS state FROM customer""")
def address_states(v):
    """Lines with a long code, a short one, none, no state at all, and blanks at the end."""
    rows = v("net_customers")
    k = F.col("id") % 5
    line = F.when(k == 0, F.concat("name", F.lit(" WA 98101-2233"))).when(k == 1, F.concat("name", F.lit(", OR  97201"))).when(k == 2, F.concat("name", F.lit(" "), F.substring(F.upper("name"), 1, 2)))
    line = line.when(k == 3, F.concat("name", F.lit(" wa 98101"))).otherwise(F.concat("name", F.lit(" ID 83701  ")))
    return rows.select("id", geo.address_state(line).alias("state"))


@_query("""WITH t AS (SELECT id AS clip, string_split(raw_text, ' ') AS parts FROM net_log), w AS (SELECT clip, parts, unnest(range(1, len(parts) + 1)) AS i FROM t)
 SELECT clip, i AS word_no, parts[i] AS text, (i - 1) * 0.2 AS start, (i - 1) * 0.2 + CASE WHEN length(parts[i]) > 2 THEN 0.2 ELSE 0.1 END AS "end",
 cast(coalesce(list_sum(list_transform(parts[1 : i - 1], lambda p: length(p) + 1)), 0) AS int) AS "offset" FROM w""")
def assemble_lines(v):
    """The lines' words, each cut after its second letter, put together and found again in the line."""
    rows = v("net_log").select(F.col("id").alias("clip"), F.col("raw_text").alias("text"))
    words = rows.select("clip", F.posexplode(F.split("text", " ")).alias("n", "w"))
    parts = words.select("clip", "n", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.substring("w", 1, 2).alias("text")), F.struct(F.lit(1).alias("k"), F.substring("w", 3, 99).alias("text")))).alias("x")).where("x.text <> ''")
    no = 2 * F.col("n") + F.col("x.k")
    tokens = parts.select("clip", no.alias("token_no"), "x.text", (no * 10).alias("t0_cs"), (no * 10 + 10).alias("t1_cs"), (F.col("x.k") == 0).alias("starts_word"))
    return text.assemble_words(tokens, rows)


# Round trips through writers and readers, and streaming jobs in batch form


@_query("SELECT type, id, timestamp, raw_text, round(confidence, 6) AS confidence FROM net_records")
def read_sessions(v):
    """Change records appended in two writes and read back."""
    rows = v("net_records").select("type", "id", "timestamp", "raw_text", "confidence")
    folder = new_folder(rows.sparkSession)
    for rest in (0, 1):
        writers.append_records(rows.where(F.col("id") % 2 == rest), folder)
    return readers.read_sessions(rows.sparkSession, folder, "*.json").select("type", "id", "timestamp", "raw_text", F.round("confidence", 6).alias("confidence"))


@_query("SELECT type, id, timestamp, raw_text, round(confidence, 6) AS confidence FROM net_records")
def split_log(v):
    """The same read in splits of 10,000 bytes, dealt to tasks."""
    rows = v("net_records").select("type", "id", "timestamp", "raw_text", "confidence")
    folder = new_folder(rows.sparkSession)
    writers.append_records(rows, folder)
    return readers.split_log(rows.sparkSession, folder, "*.json", 10_000).select("type", "id", "timestamp", "raw_text", F.round("confidence", 6).alias("confidence"))


@_query("SELECT id, timestamp, matched, matched_callsign, raw_text, round(confidence, 6) AS confidence, traffic FROM net_log")
def export_csv(v):
    rows = v("net_log")
    folder = new_folder(rows.sparkSession)
    writers.export_csv(rows, folder)
    back = rows.sparkSession.read.option("header", True).csv(folder)
    return back.select(F.col("id").cast("long").alias("id"), "timestamp", F.col("matched").cast("boolean").alias("matched"), "matched_callsign", "raw_text", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), F.coalesce("traffic", F.lit("")).alias("traffic"))


@_query("SELECT session, id, matched_callsign, traffic_cleared, round(match_score, 6) AS match_score FROM net_log")
def export_json(v):
    rows = v("net_log")
    folder = new_folder(rows.sparkSession)
    writers.export_json(rows, folder)
    back = rows.sparkSession.read.schema(rows.select("session", "id", "matched_callsign", "traffic_cleared", "match_score").schema).json(folder)
    return back.withColumn("match_score", F.round("match_score", 6))


@_query("SELECT callsign, name, position, src AS sources FROM net_roster")
def read_roster(v):
    rows = v("net_roster")
    folder = new_folder(rows.sparkSession)
    writers.write_roster(rows.withColumn("sources", F.concat_ws(";", "sources")), folder)
    return readers.read_roster(rows.sparkSession, folder).select("callsign", "name", "position", F.concat_ws(";", "sources").alias("sources"))


@_query("""SELECT timestamp, id AS entry_id, l.candidate AS candidate, matched_callsign AS from_callsign, to_callsign FROM
 (SELECT session, id, timestamp AS said, to_callsign FROM net_corrections) c JOIN net_log l USING (session, id)""".replace("SELECT timestamp,", "SELECT said AS timestamp,"))
def read_corrections(v):
    """Corrections appended to their log and read back."""
    labels = writers.record_corrections(v("net_corrections").select("session", "id", "timestamp", "to_callsign"), v("net_log"))
    folder = new_folder(labels.sparkSession)
    writers.append_corrections(labels.drop("session"), folder)
    return readers.read_corrections(labels.sparkSession, folder, "*.json").select("timestamp", "entry_id", "candidate", "from_callsign", "to_callsign")


@_query("SELECT session AS file, seconds FROM (SELECT session, sum(clip_duration) AS seconds, count(*) AS n FROM net_log GROUP BY session) WHERE seconds >= 60 AND n % 3 <> 0")
def new_recordings(v):
    """Sessions as recordings, of which the manifest lists every one with a multiple of three lines."""
    files = v("net_log").groupBy(F.col("session").alias("file")).agg(F.sum("clip_duration").alias("seconds"), F.count("*").alias("n"))
    return readers.new_recordings(files, files.where("n % 3 = 0")).select("file", "seconds")


@_query("""WITH f AS (SELECT session || '.wav' AS file, sum(clip_duration) AS seconds, count(*) AS n FROM net_log GROUP BY session)
 SELECT file, 'net-' || replace(file, '.wav', '.jsonl') AS session, round_even(seconds / 60, 1) AS minutes, round_even(seconds / 8, 1) AS took_seconds FROM f WHERE n % 3 <> 0""")
def manifest_rows(v):
    """The same sessions as recordings, the new ones finished at eight times their length."""
    files = v("net_log").groupBy(F.concat("session", F.lit(".wav")).alias("file")).agg(F.sum("clip_duration").alias("seconds"), F.count("*").alias("n"))
    return readers.manifest_rows(files, files.where("n % 3 <> 0").select("file", (F.col("seconds") / 8).alias("took_seconds")))


@_query("SELECT substr(timestamp, 1, 16) AS minute, source, count(*) AS lines, count(*) FILTER (matched) AS matched FROM net_log GROUP BY 1, 2")
def heartbeat(v):
    rows = v("net_log").withColumn("ts", F.to_timestamp("timestamp"))
    return live.heartbeat(rows).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("minute"), "source", "lines", "matched")


@_query("""WITH l AS (SELECT *, traffic = 'yes' AND NOT traffic_cleared AS open, traffic = 'yes' AND traffic_cleared AS done FROM net_log WHERE matched_callsign IS NOT NULL)
 SELECT session, matched_callsign AS callsign, count(*) AS lines, count(*) FILTER (matched) AS matched_lines, min(timestamp) FILTER (matched) AS first_seen, count(*) FILTER (open) > 0 AS holding, count(*) FILTER (done) > 0 AS passed FROM l GROUP BY 1, 2""")
def live_boards(v):
    """What the live boards show of each station; tests/test_streams.py holds the stream to it."""
    return boards.stations(v("net_log"))


@_query("SELECT session, id, cast(least(id % 7 + 1, 26 - id % 20) AS bigint) AS run FROM net_log")
def alphabet_run(v):
    """Each line says a stretch of the alphabet whose place and length follow from its id, after two other words."""
    said = F.concat(F.array(F.lit("zulu"), F.lit("the")), F.slice(vocabulary.literal_array(vocabulary.ALPHABET), (F.col("id") % 20 + 1).cast("int"), (F.col("id") % 7 + 1).cast("int")))
    return text.alphabet_run(v("net_log").select("session", "id", F.posexplode(said).alias("pos", "word")))


ALIASES = """al AS (SELECT a.candidate AS candidate, a.callsign AS alias FROM (SELECT candidate, max_by(to_callsign, (session, line_no)) AS callsign FROM net_corrections GROUP BY candidate) a WHERE a.callsign IN (SELECT callsign FROM net_roster))"""


@_query(f"""WITH {SCORED}, {JUDGED}, {ALIASES} SELECT j.candidate AS candidate, alias IS NOT NULL OR reason IS NULL AS matched, coalesce(alias, CASE WHEN reason IS NULL THEN callsign END) AS callsign,
 CASE WHEN alias IS NOT NULL THEN 100.0 ELSE round(score, 6) END AS score, CASE WHEN alias IS NULL THEN reason END AS reason, alias IS NOT NULL AS via_alias FROM judged j LEFT JOIN al ON al.candidate = j.candidate""")
def match_aliases(v):
    """Candidates matched with what corrections have taught."""
    known = log.aliases(v("net_corrections"), v("net_roster"))
    return match.match_candidates(v("net_mentions"), v("net_roster"), known).select("candidate", "matched", "callsign", F.round("score", 6).alias("score"), "reason", "via_alias")


@_query(f"WITH {HINTS} SELECT term, grp, round(place, 6) AS place FROM hints UNION ALL SELECT s_name, CAST(s_suppkey % 2 AS int), CAST(s_suppkey AS double) FROM supplier")
def hint_vocabulary(v):
    """Hints that begin with a vocabulary of two groups, the names on the roster."""
    roster, rows = v("net_roster"), v("net_log")
    heard = rows.where("matched and session = '2024-01-30'").select(F.col("matched_callsign").alias("callsign"))
    words = roster.select(F.col("name").alias("term"), (F.col("ordinal") % 2).alias("grp"), F.col("ordinal").alias("place"))
    return history.hint_terms(roster, heard, history.attendance(rows, roster), "east", words).withColumn("place", F.round("place", 6))


@_query(f"""WITH {CROSS}, bad AS (SELECT clip, callsign FROM checked WHERE NOT (supported AND clip % 2 = 0) ORDER BY clip LIMIT 6)
 SELECT clip, bad.callsign AS callsign, 'main' AS engine, raw_text AS text FROM bad JOIN net_log ON id = clip""")
def unsupported_clips(v):
    texts = v("net_log").select(F.lit("main").alias("engine"), F.col("id").alias("clip"), F.col("raw_text").alias("text"))
    return match.unsupported_clips(_cross(v), texts)
