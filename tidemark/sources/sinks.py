"""Sinks: day partitions that replace themselves, JSON and CSV, insert-if-absent, compaction, fan-out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_days(lots: DataFrame, path: str) -> None:
    """One folder per day below year=/month=; a day written again replaces that day only."""
    day = lots.withColumns({"year": F.year("trade_date"), "month": F.date_format("trade_date", "MM")})
    day.repartition("year", "month", "trade_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "trade_date").parquet(path)


def write_json_days(lots: DataFrame, path: str) -> None:
    """One JSON document per day: date, crawled_at, record_count and the records."""
    records = F.array_sort(F.collect_list(F.struct(*[c for c in lots.columns if c != "trade_date"])))
    days = lots.groupBy("trade_date").agg(F.count("*").alias("record_count"), records.alias("records")).withColumn("crawled_at", F.current_timestamp())
    days.write.mode("overwrite").json(path)


def append_csv(lots: DataFrame, path: str) -> None:
    lots.fillna({"state": ""}).write.mode("append").option("header", True).csv(path)


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys existing doesn't hold, one for each key."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def compact(df: DataFrame, path: str, by: str | None = None, block: int = 4 << 20) -> None:
    """Rewrite months sorted by day and species, a file for each value of `by`, in row groups of `block` bytes."""
    dealt = df.coalesce(1) if by is None else df.repartition(by)
    rows = dealt.sortWithinPartitions(*([by] if by else []), "trade_date", "species").write.mode("overwrite").option("parquet.block.size", block)
    (rows.partitionBy(by) if by else rows).parquet(path)


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> bool:
    """Every sink gets the frame, which is computed once; true if all took it."""
    done, kept = [], df.persist(StorageLevel.MEMORY_AND_DISK)
    for sink in sinks:
        try:
            sink(kept)
            done.append(True)
        except Exception:
            done.append(False)
    kept.unpersist()
    return all(done)


class Memory:
    """Lots held in memory by day: a day written again replaces the day; `total` counts all rows that were written."""

    def __init__(self):
        self.days: list[DataFrame] = []
        self.total = 0

    def write(self, lots: DataFrame) -> None:
        self.total += lots.count()
        again = lots.select("trade_date").distinct()
        self.days = [*(old.join(again, "trade_date", "left_anti") for old in self.days), lots]

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.days)


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Change a stored table: the new rows go to a folder beside it, which then takes its place."""
    new, old = f"{path}-new", f"{path}-old"
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(new)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    system = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.rename(folder(path), folder(old))
    system.rename(folder(new), folder(path))
    system.delete(folder(old), True)
    spark.catalog.refreshByPath(path)


def write_inventory(counts: DataFrame, path: str) -> None:
    """A vocabulary (species, n) as one JSON document: totals, and the counts sorted by key. The vocabulary must fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("species").alias("key"), F.col("n").alias("value"))))
    meta = F.struct(F.count("*").alias("total_species"), F.sum("n").alias("total_records")).alias("_meta")
    counts.agg(meta, F.map_from_entries(ordered).alias("species")).coalesce(1).write.mode("overwrite").json(path)


def broken_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat a key, and how many lack a part of it."""
    missing = sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) > 0
    counts = table.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(missing).alias("m"))
    return counts.agg(F.sum(F.when(F.col("m") > 0, F.lit(0)).otherwise(F.col("n") - 1)).alias("repeated"), F.sum("m").alias("missing"))


def append_audit(events: DataFrame, path: str) -> None:
    """Append events with an audit id that no other row has."""
    events.withColumn("audit_id", F.expr("uuid()")).write.mode("append").parquet(path)


def writer(kind: str) -> Callable[[DataFrame, str], None]:
    kinds: dict[str, Callable[[DataFrame, str], None]] = {"parquet": write_days, "json": write_json_days, "csv": append_csv, "none": lambda df, path: None}
    kinds["both"] = lambda df, path: (write_days(df, f"{path}/parquet"), write_json_days(df, f"{path}/json"))[0]
    return kinds[kind]
