"""Side tables: weather and ocean JSON, station readings, retail prices, inventories, calendars, run state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas


def dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from start to end, both included, also written yyyy.MM.dd."""
    day = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("day")
    return spark.range(1).select(day).select("day", F.date_format("day", "yyyy.MM.dd").alias("trade_date"))


def day_count(start: str, end: str) -> Column:
    return F.datediff(F.to_date(F.lit(end)), F.to_date(F.lit(start))) + 1


def read_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COASTAL_WEATHER).option("header", True).option("nullValue", "").csv(path)


def read_retail_csv(spark: SparkSession, path: str) -> DataFrame:
    """Prices with thousands separators as numbers, dates as dates; "-" is no price."""
    df = spark.read.schema(schemas.RETAIL).option("header", True).csv(path)
    return df.withColumns({"price": F.regexp_replace("price", ",", "").try_cast("double"), "date": F.to_date("date")}).where(F.col("price").isNotNull())


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary, a row per species, from a JSON document {_meta, species: {name: count}}."""
    df = spark.read.schema("species map<string,bigint>").option("multiLine", True).json(path)
    return df.select(F.explode("species").alias("species", "n"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """species, packaging and n of result documents {species, counts: {packaging: n}}; no rows where there is no file."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "species string, packaging string, n long")
    df = spark.read.schema("species string, counts map<string,bigint>").json(path)
    return df.select("species", F.explode("counts").alias("packaging", "n"))


def daily_from_parallel(responses: DataFrame, values: list[str]) -> DataFrame:
    """Rows of JSON responses (location, body) whose "daily" object holds an array for each value, zipped with time."""
    inner = ", ".join(f"{v}: array<double>" for v in values)
    parsed = responses.select("location", F.from_json("body", f"daily struct<time: array<string>, {inner}>").alias("j"))
    rows = parsed.select("location", F.inline(F.arrays_zip(F.col("j.daily.time").alias("time"), *[F.col(f"j.daily.{v}").alias(v) for v in values])))
    out = rows.withColumn("date", F.replace("time", F.lit("-"), F.lit("."))).drop("time")
    if "sunshine_duration" in values:
        out = out.withColumn("sunshine_hours", F.round(F.col("sunshine_duration") / 3600, 2)).drop("sunshine_duration")
    return out


def joined_sources(marine: DataFrame, weather: DataFrame) -> DataFrame:
    """Two daily sources by location and date (not by position); a day that only one has stays."""
    return marine.join(weather, ["location", "date"], "full")


def station_daily(readings: DataFrame) -> DataFrame:
    """Daily means and maxima of hourly station readings (station_code, ts, water_temp, wind_speed, wind_dir).

    The wind's direction is averaged on the circle; wind_dir_plain is the arithmetic mean.
    """
    x, y = F.avg(F.cos(F.radians("wind_dir"))), F.avg(F.sin(F.radians("wind_dir")))
    return readings.groupBy("station_code", F.to_date("ts").alias("date")).agg(
        F.round(F.avg("water_temp"), 2).alias("water_temp_avg"), F.round(F.max("water_temp"), 2).alias("water_temp_max"),
        F.round(F.avg("wind_speed"), 2).alias("wind_speed_avg"), F.round(F.max("wind_speed"), 2).alias("wind_speed_max"),
        F.round(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), 1).alias("wind_dir_avg"), F.round(F.avg("wind_dir"), 1).alias("wind_dir_plain"))


def retail_rows(items: DataFrame) -> DataFrame:
    """Nationwide averages with a price, from items (yyyy, regday, countyname, item_name, type, price)."""
    kept = items.where((F.col("countyname") == "평균") & (F.col("price") != "-"))
    return kept.select(F.to_date(F.concat_ws("/", "yyyy", "regday"), "yyyy/MM/dd").alias("date"), "item_name", "type", F.regexp_replace("price", ",", "").try_cast("double").alias("price"))


def price_chain(retail: DataFrame) -> DataFrame:
    """Retail and wholesale by item: means, markup in per cent, days with a retail price."""
    mean = lambda kind: F.avg(F.when(F.col("type") == kind, F.col("price")))
    return retail.groupBy("item_name").agg(
        mean("retail").alias("retail"), mean("wholesale").alias("wholesale"), ((mean("retail") / mean("wholesale") - 1) * 100).alias("markup_pct"),
        F.count_distinct(F.when(F.col("type") == "retail", F.col("date"))).alias("retail_days"))


def filled(values: DataFrame, columns: list[str], key: str = "location", order: str = "date") -> DataFrame:
    """Gaps take the last known value of their series, then the column's mean, then 0."""
    from pyspark.sql import Window as W

    upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    means = values.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    out = values.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns}).join(F.broadcast(means))  # one row
    return out.withColumns({c: F.coalesce(c, f"mean_{c}", F.lit(0.0)) for c in columns}).drop(*[f"mean_{c}" for c in columns])


# Fixed value: the first day of the history.
HISTORY = "2004-01-02"


def run_range(kind: str, today: str, last_completed: str | None = None, start: str | None = None, end: str | None = None) -> tuple[str, str]:
    """First and last day of a run: of the whole history, of yesterday, of one day, of a range, or from where the last run ended."""
    from datetime import date, timedelta

    yesterday = str(date.fromisoformat(today) - timedelta(days=1))
    if kind == "history":
        return HISTORY, yesterday
    if kind == "yesterday":
        return yesterday, yesterday
    if kind == "date":
        return start, start
    resumed = str(date.fromisoformat(last_completed) + timedelta(days=1)) if last_completed else HISTORY
    return start or resumed, end or today


def resume_date(state: DataFrame) -> DataFrame:
    """Where the next run starts: the day after the last completed one; the start of history if there is none."""
    last = F.max(F.to_date("last_completed_date", "yyyy.MM.dd"))
    return state.agg(F.coalesce(F.date_add(last, 1), F.to_date(F.lit("2004-01-02"))).alias("start"))


def marked(state: DataFrame, day: str, records: int, failed: bool = False) -> DataFrame:
    """The run state after one more day: totals grow, a failed day joins the failed once and doesn't advance."""
    s = F.col("statistics")
    done = F.lit(0 if failed else 1)
    days = F.array_distinct(F.concat(s["failed_dates"], F.array(F.lit(day)))) if failed else F.array_except(s["failed_dates"], F.array(F.lit(day)))
    return state.select(
        F.current_timestamp().cast("string").alias("last_updated"), F.lit("running").alias("status"), (F.col("last_completed_date") if failed else F.lit(day)).alias("last_completed_date"),
        F.struct((s["total_days_crawled"] + done).alias("total_days_crawled"), (s["total_records"] + records).alias("total_records"), days.alias("failed_dates")).alias("statistics"))


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schemas.HOLIDAYS, "year int, name string, day string").withColumn("day", F.to_date("day"))


def holiday_distance(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Signed days to the nearest of each holiday in the year before, of and after; 999 if there is none; the earlier on ties."""
    near = days.join(F.broadcast(calendar), F.abs(F.year("trade_date") - F.col("year")) <= 1)  # a holiday calendar: a few rows a year
    gap = F.datediff("day", "trade_date")
    best = near.groupBy("trade_date", "name").agg(F.min_by(gap, F.struct(F.abs(gap), F.col("day"))).alias("gap"))
    wide = best.groupBy("trade_date").pivot("name", ["seollal", "chuseok"]).agg(F.first("gap"))
    return days.join(wide, "trade_date", "left").fillna(999, ["seollal", "chuseok"])
