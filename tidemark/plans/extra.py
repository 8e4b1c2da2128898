"""Queries that plain SQL text doesn't hold: parsing round trips, indicators, streams, grouped models, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import recursive
from tidemark.operators import cleaning
from tidemark.plans.dialect import oracle
from tidemark.sources import html, side_tables
from tidemark.sources.lots import star_lots
from tidemark.streaming import streams

_DAILY = "SELECT species, trade_date, avg(price_avg) AS p FROM lots GROUP BY species, trade_date"


def daily(spark, sf_dir: str) -> DataFrame:
    return star_lots(spark, sf_dir).groupBy("species", "trade_date").agg(F.avg("price_avg").alias("p"))


def page_round_trip(spark, sf_dir: str) -> DataFrame:
    """All lots written as pages and parsed back."""
    lots = star_lots(spark, sf_dir)
    day = F.date_format("trade_date", "yyyy.MM.dd")
    line = F.xxhash64(*lots.columns)
    pages = html.render_pages(lots.withColumns({"date": day, "line": F.pmod(line, F.lit(1000))}))
    back = html.parse_pages(pages)
    return back.groupBy("trade_date", "state").agg(F.count("*").alias("n"), F.sum("price_avg").alias("price"), F.sum("price_high").alias("high"), F.round(F.sum("quantity"), 2).alias("qty"))


def cleaned(spark, sf_dir: str) -> DataFrame:
    """Change counts of lots that were made dirty on purpose."""
    lots = star_lots(spark, sf_dir)
    dirty = lots.withColumns({
        "species": F.when(F.col("species") == "Brand#1", "쭈구미").otherwise(F.col("species")), "spec": F.when(F.length("spec") == 2, F.concat(F.lit("0"), "spec")).otherwise(F.col("spec")),
        "state": F.coalesce("state", F.lit("")), "price_avg": F.when(F.col("packaging") == "PROMO", 0).otherwise(F.col("price_avg")).cast("long")})
    return cleaning.change_counts(dirty)


def domestic_daily(spark, sf_dir: str) -> DataFrame:
    """Daily aggregates of configurations, with and without foreign origins."""
    configs = spark.createDataFrame([("b1", "Brand#1", None, None, None, False), ("b1_A", "Brand#1", "A", None, None, False), ("b2_E_dom", "Brand#2", None, "ECONOMY", None, True)], "config_id string, species string, state string, packaging string, spec string, domestic boolean")
    rows = cleaning.for_configs(star_lots(spark, sf_dir), F.broadcast(configs))  # three rows
    return rows.groupBy("config_id", "trade_date").agg(F.round(F.avg("price_avg"), 6).alias("price"), F.count("*").alias("n_lots"), F.count_distinct("origin").alias("n_origins"))


def holiday_distance(spark, sf_dir: str) -> DataFrame:
    days = star_lots(spark, sf_dir).select(F.date_add("trade_date", 365 * 22).alias("trade_date")).distinct()
    return side_tables.holiday_distance(days, side_tables.holidays(spark))


def indicators(spark, sf_dir: str) -> DataFrame:
    out = recursive.indicators(daily(spark, sf_dir), order="trade_date")
    return out.select("species", "trade_date", *[F.round(c, 4).alias(c) for c in ("ema7", "ema30", "macd", "signal", "rsi14")], F.round(F.col("macd") - F.col("signal"), 4).alias("hist"))


def boosted_trees(spark, sf_dir: str) -> DataFrame:
    """Importance of lags, trailing windows and calendar for the price seven days ahead, and the error on the last fifth."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.sql import Window as W

    daily = star_lots(spark, sf_dir).groupBy("species", "trade_date").agg(F.avg("price_avg").alias("p"), F.sum("quantity").alias("q"))
    w = W.partitionBy("species").orderBy("trade_date")
    names = ["p", "lag1", "lag7", "a7", "a30", "q7", "month", "dow"]
    rows = daily.select(
        "species", "p", F.lag("p", 1).over(w).alias("lag1"), F.lag("p", 7).over(w).alias("lag7"), F.avg("p").over(w.rowsBetween(-7, -1)).alias("a7"), F.avg("p").over(w.rowsBetween(-30, -1)).alias("a30"),
        F.sum("q").over(w.rowsBetween(-6, 0)).alias("q7"), F.month("trade_date").alias("month"), F.weekday("trade_date").alias("dow"), F.ln(F.greatest(F.lead("p", 7).over(w), F.lit(1.0))).alias("y"), F.percent_rank().over(w).alias("place")).dropna()
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(rows).withColumn("weight", F.exp(2 * F.col("place")))
    model = GBTRegressor(featuresCol="x", labelCol="y", weightCol="weight", maxIter=8, maxDepth=4, seed=1).fit(rows.where("place < 0.8"))
    late = model.transform(rows.where("place >= 0.8"))
    error = late.agg(F.round(F.avg(F.abs(F.exp("prediction") - F.exp("y")) / F.exp("y")) * 100, 4).alias("mape"))
    gains = [(n, round(100 * float(g), 2)) for n, g in zip(names, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(gains, "feature string, gain_pct double").join(F.broadcast(error)).orderBy(F.desc("gain_pct"), "feature")  # one row


def audit_verdicts(spark, sf_dir: str) -> DataFrame:
    out = streams.settled(streams.limited(streams.event_stream(spark, sf_dir)), "append")
    return out.groupBy("verdict").agg(F.count("*").alias("n"))


def unique_events(spark, sf_dir: str) -> DataFrame:
    out = streams.settled(streams.unique(streams.event_stream(spark, sf_dir), ["event_id"]), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def new_event_types(spark, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("click",), ("view",)], "event_type string")
    return streams.settled(streams.new_words(streams.event_stream(spark, sf_dir), "event_type", known))


QUERIES = {
    "prs_round_trip": page_round_trip,
    "prj_change_counts": cleaned,
    "prj_configs": domestic_daily,
    "ts_holidays": holiday_distance,
    "ts_indicators": indicators,
    "ts_indicators_daily": indicators,
    "src_calendar": lambda spark, sf_dir: side_tables.dates(spark, "2004-01-02", "2004-03-15"),
    "ml_forecasts": lambda spark, sf_dir: recursive.forecasts(daily(spark, sf_dir), order="trade_date"),
    "ml_boosted_trees": boosted_trees,
    "ml_decomposition": lambda spark, sf_dir: recursive.decomposed(daily(spark, sf_dir), order="trade_date"),
    "ml_vmd_search": lambda spark, sf_dir: recursive.searched(recursive.decomposed(daily(spark, sf_dir), order="trade_date"), (3, 5, 8), (500, 2000, 5000), 100, order="trade_date"),
    "str_tumbling": streams.on_events(streams.tumbling),
    "str_sliding": streams.on_events(streams.sliding),
    "str_sessions": streams.on_events(streams.sessions),
    "str_detectors": streams.on_events(streams.detectors),
    "str_unique": unique_events,
    "str_new_vocabulary": new_event_types,
    "str_rate_limit": audit_verdicts,
}

ORACLES = {
    "prs_round_trip": oracle("SELECT strftime(trade_date, '%Y.%m.%d') AS trade_date, state, count(*) AS n, CAST(sum(price_avg) AS BIGINT) AS price, CAST(sum(price_high) AS BIGINT) AS high, round(sum(quantity), 2) AS qty FROM lots GROUP BY 1, 2"),
    "prj_change_counts": oracle("SELECT count(*) AS rows, count(CASE WHEN species = 'Brand#1' THEN 1 END) AS alias, count(CASE WHEN state IS NULL THEN 1 END) AS state, count(CASE WHEN length(spec) = 2 THEN 1 END) AS spec, CAST(0 AS BIGINT) AS empty, count(CASE WHEN packaging = 'PROMO' AND price_high > 0 AND price_low > 0 AND (price_high + price_low) // 2 <> 0 THEN 1 END) AS avg FROM lots"),
    "prj_configs": oracle("SELECT c.config_id, trade_date, round(avg(price_avg), 6) AS price, count(*) AS n_lots, count(DISTINCT origin) AS n_origins FROM lots JOIN (VALUES ('b1', 'Brand#1', NULL, NULL), ('b1_A', 'Brand#1', 'A', NULL), ('b2_E_dom', 'Brand#2', NULL, 'ECONOMY')) c(config_id, sp, st, pk) ON species = sp AND (st IS NULL OR state = st) AND (pk IS NULL OR packaging = pk) GROUP BY 1, 2"),
    "ts_holidays": oracle("""WITH h AS (SELECT year, name, CAST(day AS DATE) AS day FROM (VALUES (2018, 'seollal', '2018-02-16'), (2018, 'chuseok', '2018-09-24'), (2019, 'seollal', '2019-02-05'), (2019, 'chuseok', '2019-09-13'), (2020, 'seollal', '2020-01-25'), (2020, 'chuseok', '2020-10-01'), (2021, 'seollal', '2021-02-12'), (2021, 'chuseok', '2021-09-21'), (2022, 'seollal', '2022-02-01'), (2022, 'chuseok', '2022-09-10'), (2023, 'seollal', '2023-01-22'), (2023, 'chuseok', '2023-09-29'), (2024, 'seollal', '2024-02-10'), (2024, 'chuseok', '2024-09-17'), (2025, 'seollal', '2025-01-29'), (2025, 'chuseok', '2025-10-06')) v(year, name, day)),
d AS (SELECT DISTINCT CAST(trade_date + 365 * 22 AS DATE) AS trade_date FROM lots), g AS (SELECT d.trade_date, name, date_diff('day', d.trade_date, day) AS gap, row_number() OVER (PARTITION BY d.trade_date, name ORDER BY abs(date_diff('day', d.trade_date, day)), day) AS rn FROM d JOIN h ON abs(year(d.trade_date) - year) <= 1)
SELECT d.trade_date, CAST(coalesce(max(CASE WHEN name = 'seollal' THEN gap END), 999) AS INT) AS seollal, CAST(coalesce(max(CASE WHEN name = 'chuseok' THEN gap END), 999) AS INT) AS chuseok FROM d LEFT JOIN (SELECT * FROM g WHERE rn = 1) g ON g.trade_date = d.trade_date GROUP BY d.trade_date"""),
    "ts_indicators": oracle(f"""WITH RECURSIVE m AS ({_DAILY}), d AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY trade_date) AS i FROM m),
e AS (SELECT species, i, trade_date, p, p AS e7, p AS e30, p AS e12, p AS e26, CAST(0 AS DOUBLE) AS sig, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down FROM d WHERE i = 1
UNION ALL SELECT d.species, d.i, d.trade_date, d.p, CAST(d.p AS DOUBLE) / 4 + e.e7 * 3 / 4, d.p * 2 / 31 + e.e30 * 29 / 31, d.p * 2 / 13 + e.e12 * 11 / 13, d.p * 2 / 27 + e.e26 * 25 / 27,
(d.p * 2 / 13 + e.e12 * 11 / 13 - d.p * 2 / 27 - e.e26 * 25 / 27) / 5 + e.sig * 4 / 5,
CASE WHEN d.i <= 15 THEN e.up + greatest(d.p - e.p, 0) / 14 ELSE (e.up * 13 + greatest(d.p - e.p, 0)) / 14 END, CASE WHEN d.i <= 15 THEN e.down + greatest(e.p - d.p, 0) / 14 ELSE (e.down * 13 + greatest(e.p - d.p, 0)) / 14 END
FROM e JOIN d ON d.species = e.species AND d.i = e.i + 1)
SELECT species, trade_date, round(e7, 4) AS ema7, round(e30, 4) AS ema30, round(e12 - e26, 4) AS macd, round(sig, 4) AS signal, round(e12 - e26 - sig, 4) AS hist, round(CASE WHEN i <= 15 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 4) AS rsi14 FROM e"""),
    "src_calendar": "SELECT CAST(d AS DATE) AS day, strftime(d, '%Y.%m.%d') AS trade_date FROM generate_series(DATE '2004-01-02', DATE '2004-03-15', INTERVAL 1 DAY) t(d)",
    "str_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "str_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) x GROUP BY start",
    "str_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new_ FROM events) a) b GROUP BY user_id, s",
    "str_detectors": "SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 3",
    "str_unique": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "str_new_vocabulary": "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type",
}
ORACLES["ts_indicators_daily"] = ORACLES["ts_indicators"]
