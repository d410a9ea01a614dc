"""Window patterns that the other operators share."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a table is cut into at most.
MOST_RANGES = 4096


def in_ranges(df: DataFrame, by: str, rows: int, name: str) -> tuple[DataFrame, int]:
    """df with the number of the range of a number that each row falls into, and the highest number.
    Ranges hold about so many rows, however the values lie, and rise with them; equal values share one.
    A null is in range -1. Only the bounds, at most MOST_RANGES, reach the driver."""
    shares = [k / MOST_RANGES for k in range(1, MOST_RANGES)]
    found = df.agg(F.count(by).alias("n"), F.percentile_approx(F.col(by).cast("double"), shares, 8 * MOST_RANGES).alias("at")).first()
    n = max(1, min(found.n // rows, MOST_RANGES))
    bounds = sorted({x for x in (found.at[k * MOST_RANGES // n - 1] for k in range(1, n)) if math.isfinite(x)})
    if not bounds:
        return df.withColumn(name, F.when(F.col(by).isNull(), -1).otherwise(0).cast("long")), 0
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=by, outputCol=name, handleInvalid="keep").transform(df)
    return cut.withColumn(name, F.when(F.col(by).isNull(), -1).otherwise(F.col(name)).cast("long")), len(bounds) + 1


def latest_per_key(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """The last row in order of each key, whole. A maximum of structs, so it combines map-side."""
    order = [order] if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*keys, *[F.col("last")[c].alias(c) for c in rest]).select(df.columns)


def keep_last(df: DataFrame, key: str, order: str | list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    order = [order] if isinstance(order, str) else order
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def top_two(df: DataFrame, keys: list[str], score: str, tiebreak: Column | None = None) -> DataFrame:
    """The best row of each key, with the second best score as runner_up_score."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *([tiebreak] if tiebreak is not None else []))
    ranked = df.withColumn("_n", F.row_number().over(w)).withColumn("runner_up_score", F.lead(score).over(w))
    return ranked.where("_n = 1").drop("_n")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in order."""
    return df.orderBy(*order).limit(k)


def budget_prefix(df: DataFrame, order: str, cost: str, budget: float, keys: list[str] | None = None) -> DataFrame:
    """Rows in order while their running cost stays within the budget; the first that does not fit ends it.

    Costs are positive, so the running sum only grows and one comparison is enough.
    """
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_cost", F.sum(cost).over(w)).where(F.col("running_cost") <= budget)


def state_changes(df: DataFrame, keys: list[str], order: str, state: str = "state", initial: str = "ok", part: str | None = None) -> DataFrame:
    """Rows whose state differs from the one before, which is `initial` at first.

    part: a column that rises with the order, by which a key's rows are cut into windows of their own.
    """
    if part is None:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumn("previous", F.lag(state, 1, initial).over(w)).where(F.col(state) != F.col("previous"))
    ends = df.groupBy(*keys, part).agg(F.max_by(F.struct(F.col(state).alias("state")), F.struct(order)).alias("_end"))
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in (*keys, part)], F.lag("_end").over(Window.partitionBy(*keys).orderBy(part)).alias("_end"))
    met = df.join(ends, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, part)]))
    w = Window.partitionBy(*keys, part).orderBy(order)
    before = F.when(F.col("_end").isNull(), F.lit(initial)).otherwise(F.col("_end.state"))
    previous = F.when(F.row_number().over(w) == 1, before).otherwise(F.lag(state).over(w))
    return met.withColumn("previous", previous).where(F.col(state) != F.col("previous")).select(*df.columns, "previous")


def session_age(sessions: DataFrame) -> DataFrame:
    """(session, age): the newest session by name has age 0, the one before 1, and so on."""
    return sessions.select("session").distinct().withColumn("age", F.dense_rank().over(Window.orderBy(F.col("session").desc())) - 1)
