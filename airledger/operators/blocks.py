"""Blocks of rows that meet each other without a shuffle, for jobs on pairs.

Rows are packed once, a block as one row of a written table. Every two blocks then meet in a Cartesian
product, which reads the written blocks where it needs them: what is shuffled and written grows with the
rows, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.folders import written

#: Bytes of rows that an Arrow batch carries to a Python worker (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
#: Files of a table of blocks at most.
FILES = 1024
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded(spark: SparkSession) -> None:
    """Lower the session's bound of a batch if it is above BATCH_BYTES; no result depends on it."""
    now = spark.conf.get(_BATCH_CONF).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(block, rows): the rows, dealt to blocks of about `size`, written down in as many files as there
    are blocks, FILES at most: few bytes may be much work, which is shared out by file. The rows of a
    block are one value, an Arrow stream, as every block is sent to Python as often as there are blocks."""
    blocks = max(1, -(-rows.count() // size))
    _bounded(rows.sparkSession)
    of = F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).cast("int")
    dealt = rows.groupBy(of.alias("block")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).repartition(min(blocks, FILES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, each in zip(batch.column("block"), batch.column("rows"), strict=True):
                sink = pa.BufferOutputStream()
                part = pa.RecordBatch.from_struct_array(each.values)
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return written(dealt.mapInArrow(run, "block int, rows binary"))


def met(left: DataFrame, right: DataFrame, told: Callable[[int, pa.StructArray, int, pa.StructArray], Iterator[pa.RecordBatch]], schema: str, once: bool = False) -> DataFrame:
    """told(number and rows of a block of left, number and rows of one of right) of all pairs of blocks;
    with `once` of a table with itself, each pair once."""
    _bounded(left.sparkSession)
    a, b = (df.select(F.col("block").alias(k), F.col("rows").alias(f"rows_{k}")) for df, k in ((left, "i"), (right, "j")))
    pairs = a.hint("shuffle_replicate_nl").join(b, F.col("i") <= F.col("j") if once else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = lambda value: pa.ipc.open_stream(value.as_buffer()).read_next_batch().to_struct_array()
        for batch in batches:
            i, j, x, y = (batch.column(c) for c in ("i", "j", "rows_i", "rows_j"))
            for k in range(batch.num_rows):
                yield from told(i[k].as_py(), opened(x[k]), j[k].as_py(), opened(y[k]))

    return pairs.select("i", "j", "rows_i", "rows_j").mapInArrow(run, schema)
