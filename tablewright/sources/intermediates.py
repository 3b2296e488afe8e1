"""Frames written once to the shared folder and read from there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewright.session import run_folder, shared_folder


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as written: computed once, whoever reads it, and safe from the loss of executors."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def stored_and_counted(frame: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The frame as written, and how many rows were, counted on the way."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    rows = stored(frame.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return rows, seen.get["rows"]


def remove_intermediates(spark: SparkSession) -> None:
    """Drop everything this application has written to its shared folder; results read later are gone with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
