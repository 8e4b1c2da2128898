"""The restartable daily run as a stream over a checkpoint, request limits with timers, and alerts that expire; with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cleaning
from tidemark.plans import ingest
from tidemark.plans.dialect import oracle
from tidemark.sources import html as pages_html
from tidemark.sources.day_stream import DayStream
from tidemark.sources.lots import star_lots
from tidemark.streaming import stateful, streams

#: The first day of the history, and the last days of the runs; the last run has no new day.
FIRST, RUNS = "1995-01-01", ("1996-12-31", "1998-12-31", "2001-12-31", "2001-12-31")
RESULTS = "run int, date string, asked int, status string, records long"
#: Limits under which the supplied events, some two a user and day, are refused: seconds, requests, seconds of the block.
EVENT_LIMITS = ((3600, 1, 7200), (21600, 3, 21600), (86400, 4, 86400))


def state_of(spark: SparkSession, folder: str) -> dict:
    """The state of the run as stored after the last one: JSON, a folder for each run."""
    if not streams._exists(spark, f"{folder}/state"):
        return {"last_updated": None, "status": "idle", "last_completed_date": None, "runs": 0, "statistics": {"total_days_crawled": 0, "total_records": 0, "failed_dates": []}}
    stored = spark.read.schema("run int, value string").option("wholetext", False).json(f"{folder}/state")
    return json.loads(stored.orderBy(F.desc("run")).first()["value"])


def saved(spark: SparkSession, folder: str, run: int, until: str) -> None:
    """The state after a run, from the results of all batches: a day counts as it went last."""
    results = spark.read.schema(RESULTS).parquet(f"{folder}/results")
    last = results.groupBy("date").agg(F.max_by(F.struct("status", "records", "asked"), "run").alias("x")).select("date", "x.*")
    totals = last.agg(F.count_if(F.col("status") != "failed").alias("days"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).first()
    failed = [r.date for r in last.where("status = 'failed'").select("date").orderBy("date").collect()]  # days of the calendar
    asked = {r.date: r.asked + 1 for r in last.where("status = 'failed'").select("date", "asked").collect()}
    state = {"status": "completed", "last_completed_date": until.replace("-", "."), "runs": run, "asked": asked, "statistics": {"total_days_crawled": totals.days, "total_records": totals.records, "failed_dates": failed}}
    spark.createDataFrame([(run, json.dumps(state))], "run int, value string").coalesce(1).write.mode("overwrite").json(f"{folder}/state/of={run}")


def written(lots: DataFrame, folder: str, number: int) -> None:
    """A batch's lots in its own folder, in order of days, so that a day's row groups are found by its date."""
    lots.sortWithinPartitions("trade_date").write.mode("overwrite").parquet(f"{folder}/lots/batch={number}")


def kept_lots(spark: SparkSession, folder: str) -> DataFrame:
    """The lots of all days, each from the last batch that had the day: a day fetched again replaces itself."""
    results = spark.read.schema(f"{RESULTS}, batch long").parquet(f"{folder}/results").where("status <> 'failed'")
    last = results.groupBy(F.to_date("date", "yyyy.MM.dd").alias("trade_date")).agg(F.max("batch").alias("batch"))  # days of the calendar
    return spark.read.parquet(f"{folder}/lots").withColumn("batch", F.col("batch").cast("long")).join(F.broadcast(last), ["trade_date", "batch"]).drop("batch")


def run_once(spark: SparkSession, store: str, folder: str, start: str, until: str) -> None:
    """Fetch the days that no run has fetched, up to `until`, and the failed ones again; days replace themselves in the table.

    A batch writes its lots and results under its number, over what an earlier attempt left, so it may be run again after a fault.
    """
    state = state_of(spark, folder)
    run = state["runs"] + 1
    spark.dataSource.register(DayStream)
    options = {"path": store, "start": start, "until": until, "again": json.dumps(state.get("asked", {})), "run": str(run)}
    pages = spark.readStream.format("stored_days").options(**options).load()
    asked = F.create_map([F.lit(x) for pair in state.get("asked", {}).items() for x in pair]) if state.get("asked") else F.create_map().cast("map<string,int>")

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        lots = pages_html.parse_pages(batch.where("ok")).withColumn("trade_date", F.to_date("trade_date", "yyyy.MM.dd"))
        written(cleaning.normalised(lots.drop("page", "line")), folder, number)
        records = lots.groupBy(F.date_format("trade_date", "yyyy.MM.dd").alias("date")).agg(F.count("*").alias("records"))
        days = batch.groupBy("date").agg(F.max(F.when((F.col("page") == 1) & F.col("ok"), 1)).alias("first")).join(records, "date", "left").fillna(0, ["records"])
        status = F.when(F.col("first").isNull(), "failed").when(F.col("records") == 0, "empty").otherwise("ok")
        out = days.select(F.lit(run).alias("run"), "date", F.coalesce(F.try_element_at(asked, F.col("date")), F.lit(0)).alias("asked"), status.alias("status"), "records")
        out.coalesce(1).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
        batch.unpersist()

    pages.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    saved(spark, folder, run, until)


def store_twice(lots: DataFrame, path: str) -> None:
    """The responses of every day; where the first page fails, also those of the second asking, when all pages come."""
    pages = ingest.shown_pages(lots, FIRST, RUNS[-1])
    failing = pages.where((F.col("page") == 1) & ingest.case_of(F.to_date("date", "yyyy.MM.dd"), F.col("page")).between(8, 10)).select("date")
    again = pages.join(failing, "date", "left_semi").withColumns({"attempt": F.lit(0), "status": F.lit(200), "month": F.substring("date", 1, 7), "asked": F.lit(1)})
    rows = ingest.answers_of(pages).withColumn("asked", F.lit(0)).unionByName(again)
    rows.repartition("month").sortWithinPartitions("month", "date", "page", "attempt").write.mode("overwrite").partitionBy("month").parquet(path)


def daily_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All years in runs over one checkpoint: what each run asked for and got, and what the table and the state hold after it."""
    store, folder = ingest.scratch(spark, "store"), ingest.scratch(spark, "run")
    store_twice(star_lots(spark, sf_dir), store)
    states = []
    for until in RUNS:
        run_once(spark, store, folder, FIRST, until)
        state = state_of(spark, folder)
        states.append((state["runs"], state["last_completed_date"], state["statistics"]["total_days_crawled"], state["statistics"]["total_records"], len(state["statistics"]["failed_dates"])))
    after = spark.createDataFrame(states, "run int, last_completed string, days_done long, total_records long, failed_left int")
    of = lambda status: F.count_if(F.col("status") == status)
    runs = spark.read.schema(RESULTS).parquet(f"{folder}/results").groupBy("run").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count_if(F.col("asked") == 0).alias("new_days"), F.count_if(F.col("asked") > 0).alias("again"), of("ok").alias("ok"), of("empty").alias("empty"), of("failed").alias("failed"), F.sum("records").alias("records"))
    table = kept_lots(spark, folder).agg(F.count("*").alias("table_rows"))
    return runs.join(F.broadcast(after), "run").join(F.broadcast(table))  # a row a run, and one row


def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every event under EVENT_LIMITS, and where blocks ended."""
    events = streams.event_stream(stateful.session_of(spark), sf_dir)
    out = streams.settled(stateful.limited(events, EVENT_LIMITS), "append")
    return out.select("user_id", F.timestamp_millis("at").alias("moment"), "verdict")


def session_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events (type and last digit of the id) that the vocabulary lacks, told once a user."""
    own = stateful.session_of(spark, by_clock=True)
    words = streams.event_stream(own, sf_dir).select(F.col("user_id").alias("session"), F.concat_ws("-", "event_type", (F.col("event_id") % 10).cast("string")).alias("word"))
    known = own.createDataFrame([(f"click-{i}",) for i in range(5)], "word string")
    return streams.settled(stateful.session_alerts(words, known), "append")


QUERIES = {"str_daily_ingest": daily_ingest, "str_request_limits": request_limits, "str_session_alerts": session_alerts}

_STEP = ", ".join(f"len(list_filter(r.times, lambda t: e.ms - t < {w * 1000})) >= {n} AS over{k}" for k, (w, n, _) in enumerate(EVENT_LIMITS))
_ENDS = "CASE " + " ".join(f"WHEN over{k} THEN ms + {b * 1000}" for k, (_, _, b) in enumerate(EVENT_LIMITS)) + " ELSE until END"
_WORDS = "CASE WHEN ms < until THEN 'blocked' " + " ".join(f"WHEN over{k} THEN 'limit {w}'" for k, (w, _, _) in enumerate(EVENT_LIMITS)) + " ELSE 'allowed' END"
SQL = {
    "str_daily_ingest": f"""WITH {ingest.lines_sql(FIRST, RUNS[-1])}, tried AS (SELECT strftime(trade_date, '%Y.%m.%d') AS date, sum(n) AS n FROM allp GROUP BY ALL),
done AS (SELECT CASE WHEN date <= '1996.12.31' THEN 1 WHEN date <= '1998.12.31' THEN 2 ELSE 3 END AS run, date, 0 AS asked, status, records FROM res),
more AS (SELECT run + 1 AS run, date, 1 AS asked, CASE WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status, CAST(n AS BIGINT) AS records FROM done JOIN tried USING (date) WHERE status = 'failed'),
every AS (SELECT * FROM done UNION ALL SELECT * FROM more), per AS (SELECT run, min(date) AS first, max(date) AS last, count(*) FILTER (asked = 0) AS new_days, count(*) FILTER (asked > 0) AS again,
  count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'failed') AS failed, CAST(sum(records) AS BIGINT) AS records FROM every GROUP BY run)
SELECT CAST(run AS INT) AS run, first, last, new_days, again, ok, empty, failed, records, CASE run WHEN 1 THEN '1996.12.31' WHEN 2 THEN '1998.12.31' ELSE '2001.12.31' END AS last_completed,
  CAST(sum(ok + empty) OVER w AS BIGINT) AS days_done, CAST(sum(records) OVER w AS BIGINT) AS total_records, CAST(failed AS INT) AS failed_left, CAST((SELECT sum(records) FROM every) AS BIGINT) AS table_rows FROM per WINDOW w AS (ORDER BY run)""",
    "str_request_limits": f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS ms, [0::BIGINT][:0] AS times, 0::BIGINT AS until, '' AS verdict FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, i, ms, CASE WHEN {_WORDS} = 'allowed' THEN list_append(times, ms) ELSE times END, CASE WHEN ms < until THEN until ELSE {_ENDS} END, {_WORDS}
  FROM (SELECT e.user_id, e.i, e.ms, r.times, r.until, {_STEP} FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) x)
SELECT user_id, make_timestamp(ms * 1000) AS moment, verdict FROM r WHERE i > 0
UNION ALL SELECT user_id, make_timestamp(until * 1000), 'freed' FROM r WHERE verdict LIKE 'limit%' AND until <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)""",
    "str_session_alerts": "SELECT DISTINCT user_id AS session, event_type || '-' || (event_id % 10) AS word FROM events WHERE NOT (event_type = 'click' AND event_id % 10 < 5)",
}
ORACLES = {name: oracle(text) for name, text in SQL.items()}
