"""The daily run over stored pages, sinks and side tables, each written and read back, with the SQL of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import cleaning
from tidemark.plans.dialect import oracle
from tidemark.sources import html as pages_html
from tidemark.sources import side_tables, sinks
from tidemark.sources.lots import read_lots, star_lots
from tidemark.sources.pages import BROKEN, UNEXPECTED, PageSource
from tidemark.sources.writers import DayFiles, read_day_files
from tidemark.streaming import streams

EMPTY = "<table><tbody><tr><td>" + schemas.NO_DATA + "</td></tr></tbody></table>"
FIRST, LAST = "1992-01-01", "1998-12-31"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share."""
    return f"{streams.shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"


# Pages and the daily run


def case_of(day, page):
    """Which way a page's answers go: 0 to 4 wait and come, 5 to 7 break twice and come, 8 and 9 never come, 10 stops at once, others come."""
    return F.pmod(F.datediff(day, F.lit("1990-01-01")) * 31 + page * 7, F.lit(97))


def shown_pages(lots: DataFrame, first: str = FIRST, last: str = LAST) -> DataFrame:
    """date, page and html of every day from first to last as the source would show it."""
    line = F.row_number().over(W.partitionBy("trade_date").orderBy(*[c for c in sorted(lots.columns) if c != "trade_date"])) - 1
    shown = pages_html.render_pages(lots.withColumns({"date": F.date_format("trade_date", "yyyy.MM.dd"), "line": line}))
    count = F.max("page").over(W.partitionBy("date"))
    shown = shown.withColumn("html", F.concat(F.col("html"), F.lit('<a class="arr last" href="#" onclick="fnList('), count.cast("string"), F.lit(')">last</a>')))
    days = lots.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("day"))
    empty = days.withColumn("date", F.date_format("day", "yyyy.MM.dd")).join(shown.select("date").distinct(), "date", "left_anti")
    return shown.select("date", "page", "html").unionByName(empty.select("date", F.lit(1).alias("page"), F.lit(EMPTY).alias("html")))


def answers_of(rows: DataFrame) -> DataFrame:
    """The responses to each page in order: month, date, page, attempt, status, html."""
    case = case_of(F.to_date("date", "yyyy.MM.dd"), F.col("page"))
    status = F.when(case < 5, F.array(F.lit(429), F.lit(200))).when(case < 8, F.array(F.lit(BROKEN), F.lit(BROKEN), F.lit(200))).when(case < 10, F.array(F.lit(500), F.lit(429), F.lit(BROKEN))).when(case == 10, F.array(F.lit(UNEXPECTED), F.lit(200))).otherwise(F.array(F.lit(200)))
    answers = rows.select("date", "page", "html", F.posexplode(status).alias("attempt", "status"))
    return answers.withColumns({"html": F.when(F.col("status") == 200, F.col("html")).otherwise(""), "month": F.substring("date", 1, 7)})


def store_pages(lots: DataFrame, path: str) -> None:
    """Every day's pages with their answers, as the page readers expect them."""
    answers_of(shown_pages(lots)).repartition("month").sortWithinPartitions("month", "date", "page", "attempt").write.mode("overwrite").partitionBy("month").parquet(path)


def crawled(spark: SparkSession, sf_dir: str, start: str = FIRST, end: str = LAST) -> DataFrame:
    """The answers of all pages from start to end."""
    path = scratch(spark, "pages")
    store_pages(star_lots(spark, sf_dir).where(F.col("trade_date").between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))), path)
    spark.dataSource.register(PageSource)
    return spark.read.format("stored_pages").option("path", path).option("start", start).option("end", end).load()


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Of each page that came: whether it is empty, how many pages it names, and its records."""
    found = pages_html.parse_pages(pages.where("ok")).withColumnRenamed("trade_date", "date")
    records = found.groupBy("date", "page").agg(F.count("*").alias("records"))
    return pages.where("ok").select("date", "page", pages_html.is_empty(F.col("html")).alias("is_empty"), pages_html.page_count(F.col("html")).alias("total_pages")).join(records, ["date", "page"], "left").fillna(0, ["records"])


def day_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day how it went: failed without its first page, empty, or done with the records of the pages that came."""
    pages = crawled(spark, sf_dir)
    out = pages.groupBy("date").agg(F.count_if("ok").alias("pages_ok"), F.count_if(~F.col("ok")).alias("pages_failed"), F.round(F.sum("waited"), 1).alias("waited"), F.max(F.when((F.col("page") == 1) & F.col("ok"), 1)).alias("first"))
    records = parsed_pages(pages).groupBy("date").agg(F.sum("records").alias("records"))
    joined = out.join(records, "date", "left").fillna(0, ["records"])
    status = F.when(F.col("first").isNull(), "failed").when(F.col("records") == 0, "empty").otherwise("ok")
    return joined.select("date", status.alias("status"), "pages_ok", "pages_failed", "waited", "records")


def crawl_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_results(spark, sf_dir).groupBy("status").agg(F.count("*").alias("days"), F.sum("records").alias("records"), F.sum(F.col("pages_ok") + F.col("pages_failed")).alias("pages"))


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one store, the second from where the first ended: the state after each, and what the table holds at last."""
    path, table = scratch(spark, "pages"), scratch(spark, "days")
    store_pages(star_lots(spark, sf_dir).where(F.col("trade_date").between(F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date"))), path)
    spark.dataSource.register(PageSource)
    state = spark.createDataFrame([("", "idle", "1994.12.31", (0, 0, []))], schemas.CHECKPOINT)
    rows = []
    for end in ("1995-05-20", "1995-12-31"):
        start = str(side_tables.resume_date(state).first()[0])
        pages = spark.read.format("stored_pages").option("path", path).option("start", start).option("end", end).load()
        lots = pages_html.parse_pages(pages.where("ok")).withColumn("trade_date", F.to_date("trade_date", "yyyy.MM.dd"))
        sinks.write_days(cleaning.normalised(lots.drop("page", "line")), table)
        failed = [r["date"] for r in pages.where("page = 1 and not ok").select("date").orderBy("date").collect()]  # days of a run
        written = spark.read.parquet(table).where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).count()
        for day in failed:
            state = side_tables.marked(state, day, 0, failed=True)
        state = side_tables.marked(state, end.replace("-", "."), written)
        state = spark.createDataFrame(state.collect(), schemas.CHECKPOINT)  # one row
        s = state.first()
        rows.append((start, s.last_completed_date, int(s.statistics.total_records), len(s.statistics.failed_dates)))
    return spark.createDataFrame(rows, "started string, last_completed string, total_records long, failed_days int")


def lines_sql(first: str, last: str) -> str:
    """CTEs that end in `days` and `res`: how each day of the calendar goes, from the lots and the rule of case_of."""
    return f"""ln AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY origin NULLS FIRST, packaging NULLS FIRST, price_avg, price_high, price_low, quantity, spec, species, state NULLS FIRST) - 1 AS line FROM lots),
pg AS (SELECT trade_date, line // 10 + 1 AS page, count(*) AS n FROM ln GROUP BY ALL),
cal AS (SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS trade_date), allp AS (SELECT c.trade_date, coalesce(page, 1) AS page, coalesce(n, 0) AS n FROM cal c LEFT JOIN pg USING (trade_date)),
k AS (SELECT *, (date_diff('day', DATE '1990-01-01', trade_date) * 31 + page * 7) % 97 AS c FROM allp), r AS (SELECT *, c NOT BETWEEN 8 AND 10 AS ok, CASE WHEN c < 5 THEN 63.0 WHEN c < 8 THEN 7.5 WHEN c < 10 THEN 124.5 ELSE 1.5 END AS waited FROM k),
f AS (SELECT trade_date, bool_or(page = 1 AND ok) AS first FROM r GROUP BY trade_date), asked AS (SELECT r.* FROM r JOIN f USING (trade_date) WHERE first OR page = 1),
days AS (SELECT strftime(trade_date, '%Y.%m.%d') AS date, count(*) FILTER (ok) AS pages_ok, count(*) FILTER (NOT ok) AS pages_failed, round(sum(waited), 1) AS waited, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS records, bool_or(page = 1 AND ok) AS first FROM asked GROUP BY trade_date),
res AS (SELECT date, CASE WHEN NOT first THEN 'failed' WHEN records = 0 THEN 'empty' ELSE 'ok' END AS status, pages_ok, pages_failed, waited, records FROM days)"""


_LINES = lines_sql(FIRST, LAST)


# Sinks


def lot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_lots(spark, sf_dir)


def written_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lots as day folders, then one month again with its prices raised, and an empty batch: each day stands once."""
    path, lots = scratch(spark, "days"), lot_rows(spark, sf_dir)
    sinks.write_days(lots, path)
    sinks.write_days(lots.where("year(trade_date) = 1996 and month(trade_date) = 3").withColumn("price_avg", F.col("price_avg") + 1), path)
    sinks.write_days(lots.where("false"), path)
    return spark.read.parquet(path).groupBy(F.year("trade_date").alias("year"), F.month("trade_date").alias("month")).agg(F.count("*").alias("n"), F.sum("price_avg").alias("price"))


def written_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "json")
    sinks.writer("json")(lot_rows(spark, sf_dir), path)
    back = spark.read.schema("trade_date date, crawled_at timestamp, record_count long, records array<struct<species:string,price_avg:bigint>>").json(path)
    return back.where("crawled_at is not null").select("trade_date", "record_count", F.size("records").cast("long").alias("n"), F.aggregate("records", F.lit(0).cast("long"), lambda a, r: a + r["price_avg"]).alias("price"))


def appended_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends: every row comes back, headers don't, and a null state is an empty text."""
    path, lots = scratch(spark, "csv"), lot_rows(spark, sf_dir)
    for odd in (0, 1):
        sinks.append_csv(lots.where(f"year(trade_date) % 2 = {odd}"), path)
    back = spark.read.schema(lots.schema).option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)
    return back.groupBy("species", F.coalesce("state", F.lit("")).alias("state")).agg(F.count("*").alias("n"), F.sum("price_avg").alias("price"))


def in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days held in memory: a day written again replaces the day, while the running total counts both."""
    held, lots = sinks.Memory(), lot_rows(spark, sf_dir)
    held.write(lots.where("year(trade_date) < 1996"))
    held.write(lots.where("year(trade_date) >= 1995"))
    return held.table().groupBy(F.year("trade_date").alias("year")).agg(F.count("*").alias("n")).withColumn("written", F.lit(held.total))


def fanned_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame, computed once, to three sinks, then to one that fails."""
    lots, paths = lot_rows(spark, sf_dir), {k: scratch(spark, k) for k in ("parquet", "json", "csv")}
    kinds = {"parquet": lambda df, path: df.write.parquet(path), "json": sinks.writer("json"), "csv": sinks.writer("csv")}
    done = sinks.fan_out(lots, [lambda df, k=k: kinds[k](df, paths[k]) for k in paths])
    failed = sinks.fan_out(lots, [lambda df: None, lambda df: df.select("none")])
    read = {"parquet": spark.read.parquet(paths["parquet"]), "json": spark.read.json(paths["json"]).select(F.explode("records")), "csv": spark.read.option("header", True).csv(paths["csv"])}
    counts = [df.agg(F.lit(k).alias("sink"), F.count("*").alias("n")) for k, df in read.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).withColumns({"all_done": F.lit(done), "with_failing": F.lit(failed)})


def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a table holds aren't inserted again (which is also how vocabularies are seeded)."""
    keys = ["species", "packaging"]
    lots = lot_rows(spark, sf_dir)
    have = lots.where("state = 'A' and year(trade_date) = 1994").select(*keys, F.lit("old").alias("from_")).distinct()
    new = sinks.insert_absent(lots.select(*keys, F.lit("new").alias("from_")), have, keys)
    return have.unionByName(new)


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lots cleaned in place: a dry run tells the changes, the real run swaps the folder, and a second run finds none."""
    path = scratch(spark, "dirty")
    lots = lot_rows(spark, sf_dir).withColumn("spec", F.when(F.length("spec") == 2, F.concat(F.lit("0"), "spec")).otherwise(F.col("spec"))).withColumn("state", F.coalesce("state", F.lit("")))
    lots.write.parquet(path)
    out = []
    for step, apply in (("dry", False), ("real", True), ("again", True)):
        counts = cleaning.change_counts(spark.read.parquet(path)).first()
        if apply:
            sinks.rewrite(spark, path, cleaning.normalised)
        out.append((step, counts["rows"], counts["state"], counts["spec"]))
    return spark.createDataFrame(out, "step string, rows_ long, state long, spec long")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary as a JSON document sorted by key, with totals, and read back."""
    path = scratch(spark, "inventory")
    sinks.write_inventory(lot_rows(spark, sf_dir).groupBy("species").agg(F.count("*").alias("n")), path)
    return side_tables.read_inventory(spark, path)


def results_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as nested JSON, one document for each species, and as rows again; a file that is missing gives no rows."""
    path = scratch(spark, "results")
    frame = lot_rows(spark, sf_dir).groupBy("species", "packaging").agg(F.count("*").alias("n"))
    frame.groupBy("species").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("packaging", "n")))).alias("counts")).write.json(path)
    return side_tables.read_results(spark, path).unionByName(side_tables.read_results(spark, scratch(spark, "nowhere")))


def appended_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days appended to month folders, then each month compacted: sorted, in row groups of bounded size."""
    path, small = scratch(spark, "months"), scratch(spark, "compact")
    lots = lot_rows(spark, sf_dir).withColumn("month", F.date_format("trade_date", "'m'yyyyMM"))
    for half in ("dayofmonth(trade_date) <= 15", "dayofmonth(trade_date) > 15"):
        lots.where(half).repartition("month").write.mode("append").partitionBy("month").parquet(path)
    sinks.compact(spark.read.parquet(path), small, "month")
    files = spark.read.parquet(small).select(F.col("month").cast("string").alias("month"), "trade_date", "species", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return files.groupBy("month").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), (F.min("size") > 0).alias("sized"))


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that must be unique or present, as counts of rows that break them."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = [sinks.broken_keys(read(t), keys).select(F.lit(t).alias("table_"), "*") for t, keys in (("customer", ["c_custkey"]), ("part", ["p_partkey"]), ("lineitem", ["l_orderkey"]), ("orders", ["o_custkey"]))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests appended to an audit log under new ids, and those of busy users flagged afterwards."""
    log = scratch(spark, "audit")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.lit(False).alias("flagged"))
    for kind in ("click", "view"):
        sinks.append_audit(events.where(F.col("event_type") == kind), log)
    sinks.rewrite(spark, log, lambda df: df.withColumn("flagged", F.count("*").over(W.partitionBy("user_id")) > 2))
    return spark.read.parquet(log).groupBy("event_type", "flagged").agg(F.count("*").alias("n"), F.count_distinct("audit_id").alias("ids"))


def data_source_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices through a writer of one's own, and back from the files of its manifest."""
    path = scratch(spark, "files").removeprefix("file:").replace("///", "/")
    spark.dataSource.register(DayFiles)
    day = lot_rows(spark, sf_dir).groupBy("species", "trade_date").agg(F.count("*").alias("n"), F.sum("price_avg").alias("price"))
    day.write.format("day_files").option("path", path).mode("append").save()
    back = read_day_files(spark, path, day.schema)
    return back.groupBy("species").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.sum("price").alias("price"))


# Sources


def run_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of run covers, on 2024-03-10, with its inclusive number of days."""
    asked = {"history": {}, "yesterday": {}, "date": {"start": "2024-02-29"}, "range": {"start": "2024-02-01", "end": "2024-03-01"}, "resume": {"last_completed": "2024-02-28"}, "first": {}}
    rows = [(kind, *side_tables.run_range(kind, "2024-03-10", **own)) for kind, own in asked.items()]
    out = spark.createDataFrame(rows, "kind string, start string, end string")
    return out.withColumn("days", F.datediff(F.to_date("end"), F.to_date("start")) + 1)


def pruned_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of stored lots through the projected, pruned scan and through the view over all files."""
    path = scratch(spark, "lots")
    lots = lot_rows(spark, sf_dir).withColumns({"species_raw": F.col("species"), "year": F.year("trade_date"), "month": F.month("trade_date"), "trade_date": F.date_format("trade_date", "yyyy.MM.dd"), "quantity": F.col("quantity").cast("double")})
    lots.select(*schemas.LOTS.fieldNames(), "year", "month").repartition("year").write.partitionBy("year", "month").parquet(path)
    scan = read_lots(spark, path, "1995-03-10", "1996-02-05", ["trade_date", "species", "price_avg"]).groupBy(F.lit("scan").alias("way"), "species").agg(F.count("*").alias("n"), F.sum("price_avg").alias("price"))
    spark.read.parquet(path).createOrReplaceTempView("v_prices")
    view = spark.sql("SELECT 'view' AS way, species, count(*) AS n, sum(price_avg) AS price FROM v_prices WHERE trade_date BETWEEN '1995.03.10' AND '1996.02.05' AND year BETWEEN 1995 AND 1996 GROUP BY species")
    return scan.unionByName(view)


def config_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which slice a:b of the ordered configurations each belongs to, in slices of 40."""
    configs = lot_rows(spark, sf_dir).select("species", "packaging").distinct()
    return configs.withColumn("at", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("species", "packaging")) - 1).select("species", "packaging", F.floor(F.col("at") / 40).alias("slice"))  # configurations, not lots


def weather_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather as CSV with blanks: numbers where there are any, null elsewhere, and inclusive day counts of the range."""
    path = scratch(spark, "weather")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    names = [x.split()[0] for x in schemas.COASTAL_WEATHER.split(", ")]
    blank = {"date": F.date_format("d", "yyyy.MM.dd"), "location": F.lit("busan"), "location_name": F.lit("Busan"), "temperature_2m_max": F.when(F.col("n") % 2 == 0, F.col("n") * 1.5)}
    orders.select(*[blank.get(n, F.lit(None)).cast("string").alias(n) for n in names]).write.option("header", True).option("nullValue", "").csv(path)
    rows = side_tables.read_weather_csv(spark, path)
    days = side_tables.day_count("1992-01-01", "1998-12-31")
    return rows.groupBy(F.substring("date", 1, 4).alias("year")).agg(F.count("*").alias("n"), F.count("temperature_2m_max").alias("known"), F.round(F.sum("temperature_2m_max"), 1).alias("total"), F.count("pressure_msl_mean").alias("pressure")).withColumn("days", days)


def retail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail prices as CSV with thousands separators and dashes, and the price chain made of them."""
    path = scratch(spark, "retail")
    item = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("item_name"), "p_partkey", F.col("p_retailprice").cast("long").alias("v"))
    text = F.when(F.col("p_partkey") % 11 == 0, "-").otherwise(F.format_number("v", 0))
    item.select(F.lit("2024-01-02").alias("date"), "item_name", F.lit("1").alias("item_code"), F.lit("2").alias("kind_code"), F.when(F.col("p_partkey") % 2 == 0, "retail").otherwise("wholesale").alias("type"), text.alias("price")).write.option("header", True).csv(path)
    chain = side_tables.price_chain(side_tables.read_retail_csv(spark, path))
    return chain.select("item_name", F.round("retail", 4).alias("retail"), F.round("wholesale", 4).alias("wholesale"), F.round("markup_pct", 4).alias("markup_pct"), "retail_days")


def parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two JSON sources of parallel arrays, by location and year, as rows, joined by location and day."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    bodies = lambda rows, value, name: rows.groupBy(F.lit("busan").alias("location"), F.year("d").alias("y")).agg(F.array_sort(F.collect_list(F.struct(F.date_format("d", "yyyy-MM-dd").alias("t"), value.cast("double").alias("v")))).alias("a")).select("location", F.to_json(F.struct(F.struct(F.col("a.t").alias("time"), F.col("a.v").alias(name)).alias("daily"))).alias("body"))
    marine = side_tables.daily_from_parallel(bodies(days.where("n % 3 <> 0"), F.col("n"), "wave"), ["wave"])
    weather = side_tables.daily_from_parallel(bodies(days.where("n % 2 = 0"), F.col("n") * 1800, "sunshine_duration"), ["sunshine_duration"])
    both = side_tables.joined_sources(marine, weather)
    return both.groupBy(F.substring("date", 1, 4).alias("year")).agg(F.count("*").alias("n"), F.count("wave").alias("waves"), F.round(F.sum("wave"), 2).alias("wave"), F.round(F.sum("sunshine_hours"), 2).alias("sunshine"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings from events: daily means and maxima of each station."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select((F.col("user_id") % 5).cast("string").alias("station_code"), "ts", F.floor("value").cast("double").alias("water_temp"), (F.col("event_id") % 17).cast("double").alias("wind_speed"), (F.col("event_id") % 360).cast("double").alias("wind_dir"))
    return side_tables.station_daily(rows).select("station_code", "date", "water_temp_max", "wind_speed_max", "wind_dir_plain")


def retail_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by class as the retail service answers: nationwide averages with a price, dates put together."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    items = p.select(F.lit("2024").alias("yyyy"), F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("p_partkey") % 300).cast("int")), "MM/dd").alias("regday"), F.when(F.col("p_partkey") % 3 == 0, "평균").otherwise("서울").alias("countyname"), F.col("p_brand").alias("item_name"), F.lit("retail").alias("type"), F.when(F.col("p_partkey") % 7 == 0, "-").otherwise(F.format_number(F.col("p_retailprice").cast("long"), 0)).alias("price"))
    return side_tables.retail_rows(items).groupBy("date", "item_name").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


QUERIES = {
    "src_pages": day_results, "agg_crawl_statistics": crawl_statistics, "str_resumed_run": resumed_run, "snk_days": written_days, "snk_json": written_json, "snk_csv": appended_csv, "snk_memory": in_memory, "snk_fan_out": fanned_out,
    "snk_insert_absent": inserted, "snk_rewrite": rewritten, "snk_inventory": inventory, "snk_results": results_document, "snk_compact": appended_months, "snk_constraints": constraints, "snk_audit": audited,
    "snk_data_source": data_source_writer, "src_run_ranges": run_ranges,
    "src_pruned_view": pruned_view, "src_slices": config_slices, "src_weather_csv": weather_files, "src_retail_csv": retail_files, "src_parallel_json": parallel_arrays, "src_stations": stations, "src_retail_rest": retail_rest,
}
_OD = "od AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)"
SQL = {
    "src_pages": f"WITH {_LINES} SELECT date, status, pages_ok, pages_failed, waited, records FROM res",
    "agg_crawl_statistics": f"WITH {_LINES} SELECT status, count(*) AS days, CAST(sum(records) AS BIGINT) AS records, CAST(sum(pages_ok + pages_failed) AS BIGINT) AS pages FROM res GROUP BY status",
    "str_resumed_run": f"""WITH {_LINES}, y AS (SELECT * FROM res WHERE date BETWEEN '1995.01.01' AND '1995.12.31') SELECT '1995-01-01' AS started, '1995.05.20' AS last_completed, CAST(sum(records) AS BIGINT) AS total_records, CAST(count(*) FILTER (status = 'failed') AS INT) AS failed_days FROM y WHERE date <= '1995.05.20'
UNION ALL SELECT '1995-05-21', '1995.12.31', CAST(sum(records) AS BIGINT), CAST(count(*) FILTER (status = 'failed') AS INT) FROM y""",
    "snk_days": "SELECT year(trade_date) AS year, month(trade_date) AS month, count(*) AS n, CAST(sum(price_avg + CASE WHEN year(trade_date) = 1996 AND month(trade_date) = 3 THEN 1 ELSE 0 END) AS BIGINT) AS price FROM lots GROUP BY ALL",
    "snk_json": "SELECT trade_date, count(*) AS record_count, count(*) AS n, CAST(sum(price_avg) AS BIGINT) AS price FROM lots GROUP BY trade_date",
    "snk_csv": "SELECT species, coalesce(state, '') AS state, count(*) AS n, CAST(sum(price_avg) AS BIGINT) AS price FROM lots GROUP BY ALL",
    "snk_memory": "SELECT year(trade_date) AS year, count(*) AS n, (SELECT count(*) + count(*) FILTER (year(trade_date) = 1995) FROM lots) AS written FROM lots GROUP BY 1",
    "snk_fan_out": "SELECT sink, (SELECT count(*) FROM lots) AS n, TRUE AS all_done, FALSE AS with_failing FROM (VALUES ('parquet'), ('json'), ('csv')) v(sink)",
    "snk_insert_absent": "WITH h AS (SELECT DISTINCT species, packaging FROM lots WHERE state = 'A' AND year(trade_date) = 1994) SELECT DISTINCT species, packaging, CASE WHEN (species, packaging) IN (SELECT (species, packaging) FROM h) THEN 'old' ELSE 'new' END AS from_ FROM lots",
    "snk_rewrite": "SELECT step, (SELECT count(*) FROM lots) AS rows_, CASE WHEN step = 'again' THEN 0 ELSE (SELECT count(*) FROM lots WHERE state IS NULL) END AS state, CASE WHEN step = 'again' THEN 0 ELSE (SELECT count(*) FROM lots WHERE length(spec) = 2) END AS spec FROM (VALUES ('dry'), ('real'), ('again')) v(step)",
    "snk_inventory": "SELECT species, count(*) AS n FROM lots GROUP BY species",
    "snk_results": "SELECT species, packaging, count(*) AS n FROM lots GROUP BY ALL",
    "snk_compact": "SELECT strftime(trade_date, 'm%Y%m') AS month, count(*) AS n, CAST(1 AS BIGINT) AS files, TRUE AS sized FROM lots GROUP BY 1",
    "snk_constraints": """SELECT 'customer' AS table_, count(*) - count(DISTINCT c_custkey) AS repeated, count(*) FILTER (c_custkey IS NULL) AS missing FROM customer UNION ALL SELECT 'part', count(*) - count(DISTINCT p_partkey), count(*) FILTER (p_partkey IS NULL) FROM part
UNION ALL SELECT 'lineitem', count(*) - count(DISTINCT l_orderkey), count(*) FILTER (l_orderkey IS NULL) FROM lineitem UNION ALL SELECT 'orders', count(*) - count(DISTINCT o_custkey), count(*) FILTER (o_custkey IS NULL) FROM orders""",
    "snk_audit": "WITH e AS (SELECT *, count(*) OVER (PARTITION BY user_id) > 2 AS flagged FROM events WHERE event_type IN ('click', 'view')) SELECT event_type, flagged, count(*) AS n, count(*) AS ids FROM e GROUP BY ALL",
    "snk_data_source": "SELECT species, count(DISTINCT trade_date) AS days, count(*) AS n, CAST(sum(price_avg) AS BIGINT) AS price FROM lots GROUP BY species",
    "src_run_ranges": """SELECT kind, start, "end", CAST("end" AS DATE) - CAST(start AS DATE) + 1 AS days FROM (VALUES ('history', '2004-01-02', '2024-03-09'), ('yesterday', '2024-03-09', '2024-03-09'), ('date', '2024-02-29', '2024-02-29'), ('range', '2024-02-01', '2024-03-01'), ('resume', '2024-02-29', '2024-03-10'), ('first', '2004-01-02', '2024-03-10')) v(kind, start, "end")""",
    "src_pruned_view": "SELECT way, species, count(*) AS n, CAST(sum(price_avg) AS BIGINT) AS price FROM lots CROSS JOIN (VALUES ('scan'), ('view')) v(way) WHERE trade_date BETWEEN DATE '1995-03-10' AND DATE '1996-02-05' GROUP BY ALL",
    "src_slices": "SELECT species, packaging, (row_number() OVER (ORDER BY species, packaging) - 1) // 40 AS slice FROM (SELECT DISTINCT species, packaging FROM lots)",
    "src_weather_csv": f"WITH {_OD} SELECT strftime(d, '%Y') AS year, count(*) AS n, count(*) FILTER (n % 2 = 0) AS known, round(CAST(sum(n * 1.5) FILTER (n % 2 = 0) AS DOUBLE), 1) AS total, CAST(0 AS BIGINT) AS pressure, 2557 AS days FROM od GROUP BY 1",
    "src_retail_csv": """WITH i AS (SELECT p_brand AS item_name, p_partkey % 2 = 0 AS r, CAST(trunc(p_retailprice) AS BIGINT) AS v FROM part WHERE p_partkey % 11 <> 0) SELECT item_name, round(avg(v) FILTER (r), 4) AS retail, round(avg(v) FILTER (NOT r), 4) AS wholesale, round((avg(v) FILTER (r) / avg(v) FILTER (NOT r) - 1) * 100, 4) AS markup_pct, CAST(bool_or(r) AS BIGINT) AS retail_days FROM i GROUP BY item_name""",
    "src_parallel_json": f"WITH {_OD} SELECT strftime(d, '%Y') AS year, count(*) AS n, count(*) FILTER (n % 3 <> 0) AS waves, round(CAST(sum(n) FILTER (n % 3 <> 0) AS DOUBLE), 2) AS wave, round(sum(round(n * 1800 / 3600, 2)) FILTER (n % 2 = 0), 2) AS sunshine FROM od WHERE n % 3 <> 0 OR n % 2 = 0 GROUP BY 1",
    "src_stations": "SELECT CAST(user_id % 5 AS VARCHAR) AS station_code, CAST(ts AS DATE) AS date, CAST(max(floor(value)) AS DOUBLE) AS water_temp_max, CAST(max(event_id % 17) AS DOUBLE) AS wind_speed_max, round(avg(event_id % 360), 1) AS wind_dir_plain FROM events GROUP BY ALL",
    "src_retail_rest": "SELECT CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS DATE) AS date, p_brand AS item_name, count(*) AS n, round(CAST(sum(trunc(p_retailprice)) AS DOUBLE), 2) AS price FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 <> 0 GROUP BY ALL",
}
ORACLES = {name: oracle(text) for name, text in SQL.items()}
