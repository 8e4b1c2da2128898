"""Structured Streaming: incremental ingest, windows over events, duplicates, new vocabulary and request limits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in plain local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def delivered(rows: list[DataFrame]) -> DataFrame:
    """A stream of these frames, one file and so one batch for each, in this order."""
    spark = rows[0].sparkSession
    path = f"{shared_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    for frame in rows:
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_slices(events: DataFrame, parts: int, late: str = "false") -> list[DataFrame]:
    """Slices of equal time; what is late comes with the last one instead of its own."""
    ends = events.agg(F.min(F.unix_micros("ts")).alias("a"), (F.max(F.unix_micros("ts")) + 1).alias("b"))
    at = F.floor((F.unix_micros("ts") - F.col("a")) * parts / (F.col("b") - F.col("a")))
    dealt = events.join(F.broadcast(ends)).withColumn("__slice", F.when(F.expr(late), parts - 1).otherwise(at)).drop("a", "b")  # one row
    return [dealt.where(F.col("__slice") == i).drop("__slice") for i in range(parts)]


def event_stream(spark: SparkSession, sf_dir: str, parts: int = 3) -> DataFrame:
    """All events in batches of successive times."""
    return delivered(in_slices(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"), parts))


def settled(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a bounded stream to its end and give the table it leaves: of a complete stream the last batch, else all of them.

    Batches are Parquet folders, written over when a batch runs again.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/tidemark-settled-{uuid.uuid4().hex}"
    done: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(f"{path}/{number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(done[-1:] if mode == "complete" else dict.fromkeys(done)))


def tumbling(events: DataFrame) -> DataFrame:
    """Events and their values by hour and type; a state closes two hours behind the latest event."""
    out = events.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame) -> DataFrame:
    out = events.withWatermark("ts", "2 hours").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    out = events.withWatermark("ts", "1 day").groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), "n")


def unique(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each key; keys are forgotten a day behind the latest event."""
    return events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(keys)


def insert_if_absent(batches: DataFrame, path: str, keys: list[str], checkpoint: str) -> None:
    """Append rows whose keys the table doesn't hold yet, batch by batch; a batch that runs again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        have = spark.read.schema(batch.schema).option("ignoreMissingFiles", "true").parquet(path) if _exists(spark, path) else None
        (fresh if have is None else fresh.join(have.select(*keys), keys, "left_anti")).write.mode("append").parquet(path)

    batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_days(batches: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("year", "month", "trade_date")) -> None:
    """Write each day's rows over that day's partition, so a day that is delivered again, or late, replaces itself."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def alerts(stream: DataFrame, word: str, known: DataFrame) -> DataFrame:
    """Words that the vocabulary doesn't hold, each told once; a word is forgotten a day behind the latest event."""
    new = stream.withWatermark("ts", "30 days").join(known.select(F.col(known.columns[0]).alias(word)), word, "left_anti")
    return new.dropDuplicatesWithinWatermark([word]).select(word)


def prior_days(days: DataFrame, most: int = 30) -> DataFrame:
    """Of each series and day (species, trade_date, p, in the order of days) the number and mean of the prior days, from a state of `most` values."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("trade_date")
        n, mean = [], []
        for p in rows["p"]:
            n.append(len(held))
            mean.append(sum(held) / len(held) if held else float("nan"))
            held = [*held, p][-most:]
        state.update((held,))
        yield pd.DataFrame({"species": key[0], "trade_date": rows["trade_date"], "n_prior": n, "mean_prior": mean})

    return days.groupBy("species").applyInPandasWithState(
        work, "species string, trade_date date, n_prior long, mean_prior double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def new_words(stream: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Values that the vocabulary doesn't hold, with their count."""
    return stream.join(known.select(F.col(known.columns[0]).alias(column)), column, "left_anti").groupBy(column).agg(F.count("*").alias("n"))


#: Requests allowed within so many seconds, and for how long one is blocked beyond them.
LIMITS = ((60, 30, 60), (3600, 300, 3600), (86400, 1000, 86400))


def limited(events: DataFrame, limits=LIMITS) -> DataFrame:
    """Requests (user_id, ts) with the verdict allowed or blocked: sliding limits with a block that expires.

    A state holds the times of allowed requests of the longest window (so no more than its limit) and the end of a block; it
    goes when the watermark is that far behind its last request.
    """
    from bisect import bisect_right

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    longest = max(max(w, b) for w, _, b in limits)

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, until = state.get if state.exists else ([], 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        times, verdicts, now = list(times), [], 0.0
        for now in rows["ts"].astype("datetime64[us]").astype("int64") / 1e6:
            times = times[bisect_right(times, now - longest) :]
            blocked = now < until
            for window, most, block in () if blocked else limits:
                if len(times) - bisect_right(times, now - window) >= most:
                    blocked, until = True, now + block
                    break
            if not blocked:
                times.append(now)
            verdicts.append("blocked" if blocked else "allowed")
        state.update((times, until))
        state.setTimeoutTimestamp(max(int((now + longest) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "ts": rows["ts"], "verdict": verdicts})

    return events.select("user_id", "ts").withWatermark("ts", "1 hour").groupBy("user_id").applyInPandasWithState(
        work, "user_id long, ts timestamp, verdict string", "times array<double>, until double", "append", GroupStateTimeout.EventTimeTimeout)


#: What a client may do: sequential dates in an hour, requests in ten minutes, species in an hour.
MOST_DATES, MOST_REQUESTS, MOST_SPECIES = 5, 50, 20


def bursts(requests: DataFrame, most: int = MOST_REQUESTS) -> DataFrame:
    """Clients with more requests in ten minutes than `most`: kind, client, start, n."""
    w = requests.withWatermark("ts", "1 hour").groupBy("client", F.window("ts", "10 minutes")).agg(F.count("*").alias("n"))
    return w.where(F.col("n") > most).select(F.lit("burst").alias("kind"), "client", F.col("window.start").alias("start"), "n")


def sweeps(requests: DataFrame, dates: int = MOST_DATES, species: int = MOST_SPECIES) -> DataFrame:
    """Clients that ask for more successive dates, or for more species, within an hour: kind, client, start, n."""
    w = requests.withWatermark("ts", "1 hour").groupBy("client", F.window("ts", "1 hour")).agg(F.array_sort(F.collect_set(F.datediff("day", F.lit("1990-01-01")))).alias("days"), F.size(F.collect_set("species")).cast("long").alias("kinds"))
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"), F.lit(-9).alias("last"))

    def step(acc, day):
        run = F.when(day == acc["last"] + 1, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"), day.alias("last"))

    longest = F.aggregate("days", start, step, lambda acc: acc["best"])
    found = F.array(F.struct(F.lit("dates").alias("kind"), longest.alias("n"), F.lit(dates).alias("most")), F.struct(F.lit("species").alias("kind"), F.col("kinds").alias("n"), F.lit(species).alias("most")))
    return w.select("client", F.col("window.start").alias("start"), F.inline(found)).where("n > most").select("kind", "client", "start", "n")


def detectors(events: DataFrame) -> DataFrame:
    """Users with more than three requests in ten minutes, and their number of such windows."""
    w = events.withWatermark("ts", "1 hour").groupBy("user_id", F.window("ts", "10 minutes")).agg(F.count("*").alias("n"))
    return w.where("n > 3").select("user_id", F.col("window.start").alias("start"), "n")


def on_events(make: Callable[[DataFrame], DataFrame], mode: str = "complete") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: settled(make(event_stream(spark, sf_dir)), mode)
