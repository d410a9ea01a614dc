"""Roster matching: a similarity join that refuses rather than guesses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Names, indel_ratio, indel_ratios
from .blocks import met, packed
from .text import mentions, normalise

#: Rosters up to this many entries are broadcast against all distinct candidates; larger ones meet them
#: block by block. Both give the same rows.
BROADCAST_ROSTER = 2000
#: Candidates and roster entries of a block.
CANDIDATE_BLOCK, ROSTER_BLOCK = 1024, 1 << 16
#: Pairs of alike entries that a batch has at least, but for the last one.
CONFLICT_ROWS = 1 << 16


def _best(cands: DataFrame, roster: DataFrame, k: int) -> DataFrame:
    """(candidate, callsign, name, position, ordinal, score) of distinct candidates and entries: all
    pairs, or those among which the k best of each candidate are (by score, then ordinal)."""
    entries = roster.select("callsign", "name", "position", "ordinal").where("callsign is not null")
    if roster.count() <= BROADCAST_ROSTER:
        return cands.repartition(_tasks(cands), "candidate").crossJoin(F.broadcast(entries)).withColumn("score", indel_ratios("candidate", "callsign"))

    def told(i: int, left: pa.StructArray, j: int, right: pa.StructArray) -> Iterator[pa.RecordBatch]:
        ordinals, names = right.field("ordinal").to_numpy(), Names(right.field("callsign").to_pylist(), right.field("ordinal").to_numpy())
        texts = left.field("candidate").to_pylist()
        found = [names.best(x, k) for x in texts]
        at, score = (np.concatenate([f[n] for f in found]) for n in (0, 1))
        rows = right.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([left.field("candidate").take(pa.array(np.repeat(np.arange(len(texts)), [len(f[0]) for f in found]))), rows.field("callsign"), rows.field("name"), rows.field("position"), pa.array(ordinals[at]), pa.array(score)], names=["candidate", "callsign", "name", "position", "ordinal", "score"])

    schema = f"candidate string, callsign string, name string, position string, ordinal {entries.schema['ordinal'].dataType.simpleString()}, score double"
    return met(packed(cands, CANDIDATE_BLOCK), packed(entries, ROSTER_BLOCK), told, schema)


def _tasks(df: DataFrame) -> int:
    """Partitions by number, where there are few bytes and much work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def match_candidates(cands: DataFrame, roster: DataFrame, aliases: DataFrame | None = None, threshold: float = 78, margin: float = 5) -> DataFrame:
    """Per distinct candidate: matched, callsign, name, position, score, runner_up, runner_up_score,
    reason and via_alias. Refused candidates keep their nearest entry's score.

    An alias beats everything. Below the threshold there is no match; nor is there one if another
    entry comes within the margin, unless the candidate is the callsign. Ties go to roster order.
    """
    distinct = cands.select("candidate").where("candidate is not null and candidate <> ''").distinct()
    w = Window.partitionBy("candidate").orderBy(F.desc("score"), "ordinal")
    ranked = _best(distinct, roster, 2).withColumn("_n", F.row_number().over(w)).where("_n <= 2").withColumn("runner_up", F.lead("callsign").over(w)).withColumn("runner_up_score", F.lead("score").over(w))
    best = distinct.join(ranked.where("_n = 1"), "candidate", "left")
    if aliases is not None:
        known = aliases.select("candidate", F.col("callsign").alias("_alias")).join(roster.select(F.col("callsign").alias("_alias"), F.col("name").alias("_an"), F.col("position").alias("_ap")).dropDuplicates(["_alias"]), "_alias")
        best = best.join(known, "candidate", "left")
    else:
        best = best.withColumn("_alias", F.lit(None).cast("string")).withColumn("_an", F.lit(None).cast("string")).withColumn("_ap", F.lit(None).cast("string"))
    via = F.col("_alias").isNotNull()
    close = (F.col("candidate") != F.col("callsign")) & (F.col("score") - F.col("runner_up_score") < margin)
    reason = F.when(via, None).when(F.col("callsign").isNull(), "no_candidate").when(F.col("score") < threshold, "below_threshold").when(F.coalesce(close, F.lit(False)), "ambiguous")
    best = best.withColumn("reason", reason).withColumn("matched", F.col("reason").isNull()).withColumn("via_alias", via)
    return best.select(
        "candidate", "matched", F.when(via, F.col("_alias")).when(F.col("matched"), F.col("callsign")).alias("callsign"), F.when(via, F.col("_an")).when(F.col("matched"), F.col("name")).alias("name"),
        F.when(via, F.col("_ap")).when(F.col("matched"), F.col("position")).alias("position"), F.when(via, 100.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.when(~via, F.col("runner_up")).alias("runner_up"), F.when(~via, F.col("runner_up_score")).alias("runner_up_score"), "reason", "via_alias",
    )


def line_mentions(lines: DataFrame) -> DataFrame:
    return mentions(normalise(lines, "raw_text"))


def match_lines(lines: DataFrame, roster: DataFrame, aliases: DataFrame | None = None, found: DataFrame | None = None, **limits: float) -> DataFrame:
    """One station per line: the first matched candidate, best first; else the nearest refusal."""
    found = (line_mentions(lines) if found is None else found).where("best_rank is not null")
    scored = found.join(match_candidates(found, roster, aliases, **limits), "candidate")
    order = F.struct(F.col("matched").cast("int").alias("m"), F.when(F.col("matched"), -F.col("best_rank").cast("double")).otherwise(F.col("score")).alias("s"), (-F.col("best_rank")).alias("r"))
    fields = ["candidate", "matched", "callsign", "name", "position", "score", "runner_up", "runner_up_score", "reason", "via_alias"]
    best = scored.groupBy("session", "id").agg(F.max_by(F.struct(*fields), order).alias("_b"))
    rows = lines.select("session", "id").join(best, ["session", "id"], "left")
    none = F.col("_b").isNull()
    value = {"matched": F.coalesce("_b.matched", F.lit(False)), "reason": F.when(none, "no_candidate").otherwise(F.col("_b.reason")), "via_alias": F.coalesce("_b.via_alias", F.lit(False)), "score": F.coalesce("_b.score", F.lit(0.0))}
    return rows.select("session", "id", *[value.get(f, F.col(f"_b.{f}")).alias(f) for f in fields])


def match_all(lines: DataFrame, roster: DataFrame, aliases: DataFrame | None = None, found: DataFrame | None = None, **limits: float) -> DataFrame:
    """All stations of a line in spoken order, each where it is first named."""
    found = line_mentions(lines) if found is None else found
    scored = found.join(match_candidates(found, roster, aliases, **limits).where("matched"), "candidate")
    first = F.row_number().over(Window.partitionBy("session", "id", "callsign").orderBy("pos"))
    return scored.withColumn("_n", first).where("_n = 1").select("session", "id", "pos", "callsign", "candidate", "score", "start", "end")


def nearest(cands: DataFrame, roster: DataFrame, k: int = 8) -> DataFrame:
    """The k closest roster entries of each candidate; nothing for an empty one."""
    distinct = cands.select("candidate").where("candidate is not null and candidate <> ''").distinct()
    w = Window.partitionBy("candidate").orderBy(F.desc("score"), "ordinal")
    return _best(distinct, roster, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("candidate", "rank", "callsign", "score")


def roster_conflicts(roster: DataFrame, min_score: float = 70) -> DataFrame:
    """Pairs of roster entries so alike that lines naming one may be refused."""

    def told(i: int, left: pa.StructArray, j: int, right: pa.StructArray) -> Iterator[pa.RecordBatch]:
        firsts, ordinals = left.field("ordinal").to_numpy(), right.field("ordinal").to_numpy()
        names, found = Names(right.field("callsign").to_pylist(), ordinals), []
        for n, text in enumerate(left.field("callsign").to_pylist()):
            at, score = names.above(text, min_score)
            after = ordinals[at] > firsts[n]
            found.append((np.full(int(after.sum()), n), at[after], score[after]))
            if n == len(firsts) - 1 or sum(len(f[0]) for f in found) >= CONFLICT_ROWS:
                of, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
                found = []
                yield pa.RecordBatch.from_arrays([left.field("callsign").take(pa.array(of)), right.field("callsign").take(pa.array(at)), pa.array(score)], names=["first", "second", "score"])

    entries = roster.select("callsign", "ordinal").where("callsign is not null").distinct()
    return met(packed(entries, CANDIDATE_BLOCK), packed(entries, ROSTER_BLOCK), told, "first string, second string, score double")


def cross_check(suspect: DataFrame, others: DataFrame, threshold: float = 78) -> DataFrame:
    """(clip, callsign, supported): claims of one engine's texts, and whether another engine's text of
    the same clip has a mention that matches. suspect: clip, text; others: engine, clip, text.

    The other texts of a clip are put together by lines, so single letters may glue across them.
    """
    claims = suspect.select("clip", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"\b([A-Z]{1,2}[0-9][A-Z]{1,3})\b"), F.lit(1)))).alias("callsign"))
    joined = others.groupBy("clip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("engine", "text"))), lambda x: x.text), "\n").alias("raw_text"))
    found = line_mentions(joined.select(F.lit("x").alias("session"), F.col("clip").alias("id"), "raw_text")).select(F.col("id").alias("clip"), "candidate").distinct()
    scored = claims.join(found, "clip", "left").withColumn("_s", F.coalesce(indel_ratio(F.col("candidate"), F.col("callsign")), F.lit(0.0)))
    return scored.groupBy("clip", "callsign").agg(F.max(F.col("_s") >= threshold).alias("supported"))


def unsupported_clips(rows: DataFrame, texts: DataFrame, n: int = 6) -> DataFrame:
    """(clip, callsign, engine, text): the first n clips with an unsupported claim, and what every engine
    made of them. rows: of cross_check; texts: engine, clip, text."""
    first = rows.where(~F.col("supported")).groupBy("clip").agg(F.array_join(F.array_sort(F.collect_set("callsign")), ", ").alias("callsign")).orderBy("clip").limit(n)
    return texts.join(F.broadcast(first), "clip").select("clip", "callsign", "engine", "text")


def cross_check_report(rows: DataFrame, n: int = 10) -> DataFrame:
    """(section, key, value): totals, percentages, and the n most frequent unsupported claims."""
    total = rows.agg(F.count("*").alias("claims"), F.count_if("supported").alias("supported"), F.count_if(~F.col("supported")).alias("unsupported"))
    share = lambda c: F.round(100.0 * F.col(c) / F.greatest(F.col("claims"), F.lit(1)), 6)
    facts = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in (("claims", F.col("claims")), ("supported", F.col("supported")), ("unsupported", F.col("unsupported")), ("supported_percent", share("supported")), ("unsupported_percent", share("unsupported")))])).alias("x")).select("x.*")
    top = rows.where(~F.col("supported")).groupBy("callsign").agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "callsign").limit(n)
    return facts.union(top.select(F.lit("unsupported"), F.col("callsign"), "value"))
