"""Streams in several batches, with late and repeated deliveries, and the SQL of what must be left at their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.dialect import oracle
from tidemark.plans.studies import daily
from tidemark.sources.lots import star_lots
from tidemark.streaming import streams

#: Limits of the detectors for the supplied events, of which there are few in an hour.
DATES, REQUESTS, SPECIES = 2, 5, 6


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of two clients for a day and a species."""
    e = streams.event_stream(spark, sf_dir)
    return e.select("ts", (F.col("user_id") % 2).alias("client"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") % 40).cast("int")).alias("day"), (F.col("event_id") % 25).alias("species"))


def scraping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.settled(streams.bursts(requests(spark, sf_dir), REQUESTS))
    return found.unionByName(streams.settled(streams.sweeps(requests(spark, sf_dir), DATES, SPECIES)))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts in append mode; every 50th event of the first third comes with the last batch, behind the watermark, and is left out.

    Told are the hours that closed before the last batch.
    """
    events = spark.read.schema(streams.EVENTS).parquet(f"{sf_dir}/events.parquet")
    slices = streams.in_slices(events, 3)
    end = F.broadcast(slices[0].agg((F.max("ts") - F.expr("interval 4 hours")).alias("end")))  # one row
    first = slices[0].join(end).withColumn("late", F.expr("event_id % 50 = 0 and ts <= end")).drop("end")
    late = first.where("late").drop("late")
    out = streams.settled(streams.tumbling(streams.delivered([first.where("not late").drop("late"), slices[1], slices[2].unionByName(late)])), "append")
    last = F.broadcast(slices[1].agg(F.max("ts").alias("last")))  # one row
    return out.join(last).where(F.col("hour") + F.expr("interval 4 hours") <= F.col("last")).select("hour", "event_type", "n")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = streams.event_stream(spark, sf_dir).withColumn("word", F.concat_ws("-", "event_type", (F.col("event_id") % 10).cast("string")))
    known = spark.createDataFrame([(f"click-{i}",) for i in range(5)], "word string")
    return streams.settled(streams.alerts(words, "word", known), "append")


def rolling_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = daily(star_lots(spark, sf_dir)).select("species", "trade_date", "p")
    parts = [day.where(x) for x in ("trade_date < '1994-06-01'", "trade_date between '1994-06-01' and '1996-12-31'", "trade_date > '1996-12-31'")]
    out = streams.settled(streams.prior_days(streams.delivered(parts)), "append")
    return out.select("species", "trade_date", "n_prior", F.round(F.nullif(F.when(~F.isnan("mean_prior"), F.col("mean_prior")), F.lit(-1.0)), 6).alias("mean_prior"))


def replaced_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lots, then one month again with other prices, then an early month that comes late: each stands as it came last."""
    lots = star_lots(spark, sf_dir).withColumns({"year": F.year("trade_date"), "month": F.month("trade_date")})
    again = lots.where("year = 1996 and month = 3").withColumn("price_avg", F.col("price_avg") + 1)
    late = lots.where("year = 1993 and month = 2").withColumn("price_avg", F.col("price_avg") + 5)
    path = f"{streams.shared_dir(spark)}/tidemark-days-{uuid.uuid4().hex}"
    streams.replace_days(streams.delivered([lots, again, late]), path, f"{path}-state", ("year", "month"))
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("price_avg").alias("price"))


def inserted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and type, of which the first that comes stays, over three batches."""
    events = streams.event_stream(spark, sf_dir).select("user_id", "event_type")
    path = f"{streams.shared_dir(spark)}/tidemark-inserted-{uuid.uuid4().hex}"
    streams.insert_if_absent(events, path, ["user_id", "event_type"], f"{path}-state")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {"str_scraping": scraping, "str_late": late_rows, "str_alerts": alerts, "str_prior_days": rolling_state, "str_replaced_days": replaced_days, "str_inserted": inserted_batches}
_REQ = "q AS (SELECT ts, user_id % 2 AS client, event_id % 40 AS day, event_id % 25 AS species FROM events)"
SQL = {
    "str_scraping": f"""WITH {_REQ}, h AS (SELECT DISTINCT client, date_trunc('hour', ts) AS start, day FROM q), g AS (SELECT client, start, day - row_number() OVER (PARTITION BY client, start ORDER BY day) AS island FROM h),
d AS (SELECT client, start, max(n) AS n FROM (SELECT client, start, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY client, start)
SELECT 'burst' AS kind, client, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n FROM q GROUP BY ALL HAVING count(*) > {REQUESTS} UNION ALL SELECT 'dates', client, start, n FROM d WHERE n > {DATES}
UNION ALL SELECT 'species', client, date_trunc('hour', ts), count(DISTINCT species) FROM q GROUP BY ALL HAVING count(DISTINCT species) > {SPECIES}""",
    "str_late": """WITH b AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) + 1 AS b FROM events), s AS (SELECT e.*, floor((epoch_us(ts) - a) * 3 / (b - a)) AS slice FROM events e CROSS JOIN b)
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM s WHERE NOT (slice = 0 AND event_id % 50 = 0 AND ts <= (SELECT max(ts) FROM s WHERE slice = 0) - INTERVAL 4 HOUR) AND date_trunc('hour', ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM s WHERE slice = 1) GROUP BY ALL""",
    "str_alerts": "SELECT DISTINCT event_type || '-' || (event_id % 10) AS word FROM events WHERE NOT (event_type = 'click' AND event_id % 10 < 5)",
    "str_prior_days": "WITH d AS (SELECT species, trade_date, avg(price_avg) AS p FROM lots GROUP BY ALL) SELECT species, trade_date, count(*) OVER w AS n_prior, round(avg(p) OVER w, 6) AS mean_prior FROM d WINDOW w AS (PARTITION BY species ORDER BY trade_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)",
    "str_replaced_days": "SELECT CAST(year(trade_date) AS INT) AS year, CAST(month(trade_date) AS INT) AS month, count(*) AS n, CAST(sum(price_avg + CASE WHEN year(trade_date) = 1996 AND month(trade_date) = 3 THEN 1 WHEN year(trade_date) = 1993 AND month(trade_date) = 2 THEN 5 ELSE 0 END) AS BIGINT) AS price FROM lots GROUP BY ALL",
    "str_inserted": "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY event_type",
}
ORACLES = {name: oracle(text) for name, text in SQL.items()}
