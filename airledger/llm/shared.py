"""Bounded batches, cutting lineage, and connected components by alternating stars."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of rows that an Arrow batch carries to a Python worker (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Return freed memory to the system. Python workers outlive their tasks, and what an allocator
    keeps for itself in each of them is missing to the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(function: Callable) -> Callable:
    """function, of one group, that gives its memory back when it is done."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return function(group)
        finally:
            give_back()

    return run


def giving_back_pair(function: Callable) -> Callable:
    """The same for a function of two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(left, right)
        finally:
            give_back()

    return run


def map_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches bounded by bytes, so that long rows do not fill a worker's memory.
    The bound is the session's, which is lowered if it is above BATCH_BYTES; no result depends on it."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH_CONF).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a session without one (tests)
    gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark))
    return sc._jsc.sc().getCheckpointDir().get()


def _own_folder(spark: SparkSession) -> str:
    """A folder for a session of one process; a cluster has to name a shared one."""
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="airledger-checkpoint-")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the session's checkpoint folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    # Shuffle files of what was computed on the way go when the driver's JVM collects its garbage,
    # which an iterative job cannot wait for.
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to a new folder in the shared one, and read back: what was computed, and
    how its rows were numbered, then holds whichever executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id on an edge; component_id is the smallest id of its component.

    Alternating large-star and small-star steps, each a map-side combined minimum and an equi-join
    on the node, until the edges no longer change. No neighbour list is gathered, so a hub with
    many edges is split by the skew-join rule like any other hot key. Self loops give one-node
    components; null ends are ignored; an empty input gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("id"))
    now = settle(pairs.where("u <> v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).first()
        if state == seen or not state.n:
            break
        seen = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = settle(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).union(loops.select("id", F.col("id").alias("component_id")))
    return out.groupBy("id").agg(F.min("component_id").alias("component_id"))
