"""Frames that several branches of a plan read: written once in the folder that driver and executors share, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemark.streaming.streams import shared_dir


def staged(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
