"""A folder of its own for what a query writes and reads back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, which all executors share. A session without one has to
    run in one process, and gets a local folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="airledger-")
    return f"{shared}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to a new folder and read back: steps that follow each other start from short plans, and
    from what is there whichever executors are lost."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
