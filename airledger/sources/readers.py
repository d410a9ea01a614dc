"""Readers of session logs, rosters, corrections, transcripts and profiles: fixed schemas, tolerant of bad lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from .lines import SPLIT_BYTES, LogSource

#: A roster's header is known by its first cell.
HEADER = ("callsign", "call", "call_sign")


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, session, line_no, line) of non-blank lines. Files are read whole, as their line order
    is part of the data; they are small and many, and spread over tasks by file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select("value", F.col("_metadata.file_name").alias("file"))
    rows = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return rows.select("file", F.regexp_replace("file", r"\.[^.]*$", "").alias("session"), "line_no", "line")


def read_sessions(spark: SparkSession, path: str, pattern: str = "net-*.jsonl") -> DataFrame:
    """(session, line_no, type, ...) of all change records; blank and torn lines are skipped."""
    rows = _lines(spark, path, pattern).withColumn("r", F.from_json("line", schemas.RECORD, {"mode": "PERMISSIVE"}))
    return rows.where("r.type is not null").select("session", "line_no", "r.*")


def split_log(spark: SparkSession, path: str, pattern: str = "net-*.jsonl", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """read_sessions of logs of any size: (session, line_no, type, ...), where line_no is the byte at
    which the record's line starts. Each file is read in splits by many tasks."""
    return _log_records(_log_lines(spark.read, spark, path, pattern, split_bytes))


def follow_log(spark: SparkSession, path: str, pattern: str = "net-*.jsonl", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same as a stream over logs that are appended to: each line comes once it is whole."""
    return _log_records(_log_lines(spark.readStream, spark, path, pattern, split_bytes))


def _log_lines(reader, spark: SparkSession, path: str, pattern: str, split_bytes: int) -> DataFrame:
    spark.dataSource.register(LogSource)
    return reader.format(LogSource.name()).option("path", path).option("pattern", pattern).option("splitBytes", split_bytes).load()


def _log_records(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("session"), F.col("offset").alias("line_no"), F.from_json("line", schemas.RECORD, {"mode": "PERMISSIVE"}).alias("r"))
    return rows.where("r.type is not null").select("session", "line_no", "r.*")


def read_corrections(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Labels in order; a line without one of the keys is skipped, a key that is null is fine."""
    keys = F.json_object_keys("line")
    whole = reduce(lambda a, b: a & b, [F.array_contains(keys, k) for k in schemas.CORRECTION_KEYS])
    rows = _lines(spark, path, pattern).where(F.coalesce(whole, F.lit(False)))
    return rows.select("session", "line_no", F.from_json("line", schemas.CORRECTION).alias("r")).select("session", "line_no", "r.*")


#: Columns of a roster file that are looked at.
ROSTER_COLUMNS = 64


def read_roster(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(ordinal, callsign, name, position, sources): columns by header name in any order, or by place
    without a header; comments, blank first cells and repeats are skipped, the first of a callsign
    stays. Files follow each other by name."""
    parsed = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(ROSTER_COLUMNS))), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = _lines(spark, path, pattern).withColumn("r", parsed).withColumn("c", F.array(*[F.col(f"r.c{i}") for i in range(ROSTER_COLUMNS)]))
    first = F.lower(F.trim(F.coalesce(F.get("c", F.lit(0)), F.lit(""))))
    rows = rows.withColumn("_first", first).where(~F.col("_first").startswith("#") & (F.col("_first") != ""))
    heads = rows.where(F.col("_first").isin(*HEADER)).groupBy("file").agg(F.min_by(F.transform("c", lambda x: F.lower(F.trim(x))), "line_no").alias("head"), F.min("line_no").alias("head_line"))
    lowest = rows.groupBy("file").agg(F.min("line_no").alias("top_line"))
    rows = rows.where(~F.col("_first").isin(*HEADER)).join(heads, "file", "left").join(lowest, "file")
    named = F.col("head").isNotNull() & (F.col("head_line") == F.col("top_line"))

    def cell(place: int, *names: str):
        at = F.greatest(*[F.coalesce(F.array_position("head", n), F.lit(0)) for n in (*names, names[0])])
        return F.trim(F.coalesce(F.when(named, F.when(at > 0, F.get("c", (at - 1).cast("int")))).otherwise(F.get("c", F.lit(place))), F.lit("")))

    out = rows.select("file", "line_no", F.upper(cell(0, *HEADER)).alias("callsign"), cell(1, "name").alias("name"), cell(3, "position").alias("position"), F.filter(F.transform(F.split(cell(2, "sources"), r"[;|]"), F.trim), lambda x: x != "").alias("sources"))
    out = out.where("callsign <> ''").groupBy("callsign").agg(F.min_by(F.struct("file", "line_no", "name", "position", "sources"), F.struct("file", "line_no")).alias("f"))
    ordinal = F.row_number().over(Window.orderBy("f.file", "f.line_no")) - 1
    return out.select(ordinal.alias("ordinal"), "callsign", "f.name", "f.position", "f.sources")


def read_clip_texts(spark: SparkSession, engines: dict[str, str]) -> DataFrame:
    """(engine, clip, text): a text file per clip and engine; a clip that an engine lacks is empty."""
    one = lambda name, path: spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.lit(name).alias("engine"), F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("clip"), F.trim("value").alias("text"))
    found = reduce(DataFrame.unionByName, [one(name, path) for name, path in engines.items()])
    names = spark.createDataFrame([(name,) for name in engines], "engine string")
    return found.select("clip").distinct().crossJoin(F.broadcast(names)).join(found, ["engine", "clip"], "left").select("engine", "clip", F.coalesce("text", F.lit("")).alias("text"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(callsign, centroid, n, samples) of a profile file; empty centroids are dropped."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<profiles:map<string,struct<centroid:array<double>,count:bigint,samples:array<array<double>>>>>").alias("r"))
    rows = files.select(F.explode("r.profiles").alias("callsign", "p")).where(F.size("p.centroid") > 0)
    return rows.select("callsign", F.col("p.centroid").alias("centroid"), F.coalesce("p.count", F.lit(1)).alias("n"), F.coalesce("p.samples", F.array().cast("array<array<double>>")).alias("samples"))


def new_recordings(files: DataFrame, manifest: DataFrame, min_seconds: float = 60) -> DataFrame:
    """Recordings that the manifest does not list and that are long enough. files: file, seconds."""
    return files.where(F.col("seconds") >= min_seconds).join(manifest.select("file"), "file", "left_anti")


def manifest_rows(files: DataFrame, finished: DataFrame) -> DataFrame:
    """(file, session, minutes, took_seconds) of the recordings that were finished, for the manifest.
    files: file, seconds; finished: file, took_seconds. The session is named after the recording."""
    done = files.join(finished.select("file", "took_seconds"), "file")
    session = F.concat(F.lit("net-"), F.regexp_replace("file", r"\.[^.]*$", ""), F.lit(".jsonl"))
    return done.select("file", session.alias("session"), F.bround(F.col("seconds") / 60, 1).alias("minutes"), F.bround("took_seconds", 1).alias("took_seconds"))


def latest_session(spark: SparkSession, path: str, pattern: str = "net-*.jsonl") -> DataFrame:
    """(session, modified) of the log that was written last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("session"), F.col("modificationTime").alias("modified"))
    return files.agg(F.max(F.struct("modified", "session")).alias("l")).select("l.session", "l.modified")


def stream_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Change records as a stream of files landing in a folder; each record needs session and seq,
    the writer's own count, as a stream has no line numbers."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("session", T.StringType()), T.StructField("seq", T.LongType()), *schemas.RECORD.fields])
    return spark.readStream.schema(schema).json(path)
