"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker; long texts stay within a worker's memory.
ARROW_ROWS = 512
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only in plain local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


#: Makes Spark remove the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, in a folder for each value of its last column `by`, and read it back: lineage is cut, a lost executor costs nothing, and the shuffle files behind it go."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    written(df, lambda w: w.option("compression", codec).partitionBy(*[by] if by else []).parquet(path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def written(df: DataFrame, write) -> None:
    """Call write with df's writer, and let the shuffle files go."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        write(df.write)
    finally:
        spark.conf.set(CLEANUP, before)


def bucketed(parts: Iterable[DataFrame], tag: str, key: str) -> DataFrame:
    """Stage parts (of one schema) together in buckets of key, one for a shuffle partition, so that groupings by key read them without a shuffle."""
    name, path = f"tidemark_{tag}_{uuid.uuid4().hex}", None
    for df in parts:
        spark = df.sparkSession
        if path is None:
            path = new_path(spark, tag)
            spark.createDataFrame([], df.schema).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(partitions(spark), key).saveAsTable(name)
        written(df, lambda w: w.insertInto(name))
    out = spark.table(name)
    out.staged_path, out.staged_table = path, name
    return out


def forgotten(*tables: DataFrame, folder: str = "") -> None:
    """Remove staged tables, or their folder, that no later query reads."""
    for df in tables:
        if name := getattr(df, "staged_table", None):
            df.sparkSession.sql(f"DROP TABLE {name}")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{df.staged_path}/{folder}")
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def python_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Bound what one Arrow batch holds, so that a worker's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, row: str = "__row") -> DataFrame:
    """All columns in one struct, so that columns of operators cannot clash with those of the input."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row))


def unpacked(df: DataFrame, columns: list[str], row: str = "__row") -> DataFrame:
    return df.select(*[F.col(row).getField(c).alias(c) for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
