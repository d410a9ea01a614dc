"""Licence scan by canonical digests, in DataFrame functions only (operator 2).

A text is reduced to a canonical form (case, copyright lines, punctuation, equivalent spellings)
whose digest is joined to the digests of known licences; its lines are looked up in the same way,
each as a text of its own. Null, empty and word-free texts have a null digest and match nothing.
Rows are independent: repeated rows, and rows with repeated or null ids, are each judged by their own
text and come out as often as they came in. Very long texts are rewritten whole. An empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import FULL_TEXTS, LICENCES
from .shared import settle

#: Rewriting rules in order, as (pattern, replacement); a replacement names groups as {1}. Spelling
#: rules need not give real words, only the same word for equivalent spellings. They keep line ends.
RULES = [
    (r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[)|\(c\)[ \t]*(copyright|[0-9]{4})|©)[^\n]*", "{1}"),  # copyright lines, not wrapped prose
    (r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*", "{1}"),
    (r"https://", "http://"),
    (r"[^a-z0-9\n]+", " "),  # punctuation, quotes, dashes, white space
    (r"licenc", "licens"),
    (r"([a-z]{2})is(e|ed|es|ing|ation|ations)\b", "{1}iz{2}"),
    (r"([a-z]{2})our(s|ed|able|ite|ites)?\b", "{1}or{2}"),
    (r"ogue(s?)\b", "og{1}"),
    (r"dgement(s?)\b", "dgment{1}"),
    (r"centre(s?)\b", "center{1}"),
    (r"programme(s?)\b", "program{1}"),
    (r"artefact", "artifact"),
    (r"\bwhilst\b", "while"),
    (r"ll", "l"),  # fulfil, wilful, labelled
]
#: Rules of several words, for a whole text or a line once its white space is single blanks.
PHRASES = [
    (r"[ \n]+", " "),
    (r"\b(sub|non) ", "{1}"),  # sub-license, non-commercial
    (r"\bper cent\b", "percent"),
    (r"copyright (owner|author)", "copyright holder"),
]


#: Known digests up to which they are broadcast (about 150 bytes each).
BROADCAST_ROWS = 100_000


def _apply(out: str, rules: list[tuple[str, str]], duckdb: bool) -> str:
    for pattern, new in rules:
        for k in "12":
            new = new.replace("{%s}" % k, f"\\{k}" if duckdb else f"${k}")
        out = f"regexp_replace({out}, {_quoted(pattern, duckdb)}, {_quoted(new, duckdb)}{', ' + _quoted('g', True) if duckdb else ''})"
    return out


def words_sql(text: str, duckdb: bool = False) -> str:
    """SQL for a text with its words rewritten and its line ends kept, for Spark or DuckDB."""
    return _apply(f"translate(coalesce({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}')", RULES, duckdb)


def digest_sql(words: str, duckdb: bool = False) -> str:
    """SQL for the digest of rewritten words; null if there are none."""
    text = f"nullif(trim({_apply(words, PHRASES, duckdb)}), '')"
    return f"sha256({text})" if duckdb else f"sha2(cast({text} AS binary), 256)"


def _quoted(text: str, duckdb: bool) -> str:
    return "'" + text.replace("'", "''") + "'" if duckdb else "r'" + text + "'"


def known_digests(spark) -> DataFrame:
    """(known, licence): digests of the known texts, as many as the list has."""
    listed = spark.createDataFrame(LICENCES, "licence string, text string")
    listed = listed.select("licence", F.expr(digest_sql(words_sql("text"))).alias("known"))
    return listed.union(spark.createDataFrame(FULL_TEXTS, "licence string, known string")).groupBy("known").agg(F.min("licence").alias("licence"))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(id_col, digest, licence, line_licences) of each row: the digest of the canonical whole text,
    the licence that it is, and the sorted licences that lines of it are, each line taken as an
    entire text.

    known: (known, licence), by default the built-in list; it is broadcast if it has at most
    BROADCAST_ROWS rows. Words are rewritten once for the text and its lines; only whole texts' digests and
    lines that matched go on.
    """
    table = known if known is not None else known_digests(documents.sparkSession)
    table = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    # The row numbers are used only behind the checkpoint that they are written to.
    texts = documents.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.expr(words_sql(f"cast(`{text_col}` AS string)")).alias("words"))
    part = lambda whole, text: F.struct(F.lit(whole).alias("whole"), text.alias("text"))
    parts = F.concat(F.array(part(True, F.col("words"))), F.transform(F.split("words", "\n"), lambda x: part(False, x)))
    looked = texts.select("id", "row", F.explode(parts).alias("p")).select("id", "row", "p.whole", F.expr(digest_sql("p.text")).alias("digest"))
    looked = settle(looked.join(table, F.col("digest") == F.col("known"), "left").where("whole or licence is not null").select("id", "row", "whole", "digest", "licence"))
    lines = looked.where("not whole").groupBy("row").agg(F.array_sort(F.collect_set("licence")).alias("line_licences"))
    empty = F.array().cast("array<string>")
    whole = looked.where("whole").select("id", "row", "digest", "licence")
    return whole.join(lines, "row", "left").select(F.col("id").alias(id_col), "digest", "licence", F.coalesce("line_licences", empty).alias("line_licences"))


def oracle_sql() -> str:
    """DuckDB SQL for `scan` over documents, with line_licences joined by commas."""
    known = ", ".join(f"({_quoted(name, True)}, {_quoted(text, True)})" for name, text in LICENCES)
    full = ", ".join(f"('{name}', '{known}')" for name, known in FULL_TEXTS)
    words, digest = words_sql("text", True), digest_sql("words", True)
    return f"""
        WITH listed(licence, text) AS (VALUES {known}), full_text(licence, known) AS (VALUES {full}),
        known AS (SELECT known, min(licence) AS licence FROM (SELECT licence, {digest} AS known FROM (SELECT licence, {words} AS words FROM listed) UNION ALL SELECT licence, known FROM full_text) GROUP BY known),
        rewritten AS (SELECT doc_id, {words} AS words FROM documents),
        line AS (SELECT doc_id, unnest(string_split(words, chr(10))) AS words FROM rewritten),
        by_line AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences
                    FROM (SELECT doc_id, {digest} AS known FROM line) JOIN known USING (known) GROUP BY doc_id),
        whole AS (SELECT doc_id, {digest} AS digest FROM rewritten)
        SELECT doc_id, digest, licence, coalesce(line_licences, '') AS line_licences
        FROM whole LEFT JOIN known ON digest = known LEFT JOIN by_line USING (doc_id)"""
