"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def root_of(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:  # a session on one machine without the setting, as in tests
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own[0]


def written(frame: DataFrame) -> DataFrame:
    """The frame, computed once and read back."""
    spark = frame.sparkSession
    path = f"{root_of(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
