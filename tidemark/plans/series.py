"""Daily series with the DataFrame API: robust daily prices, distributions, supply, ocean conditions and samples.

Windows of a series hold its daily rows, so their size follows the calendar and not the number of lots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.dialect import oracle
from tidemark.plans.studies import daily
from tidemark.sources.lots import star_lots


def by_day():
    return W.partitionBy("species").orderBy("trade_date")


def prior(n: int, keys: tuple[str, ...] = ("species",)):
    return W.partitionBy(*keys).orderBy("trade_date").rowsBetween(-n, -1)


def at_half_up(c: Column, digits: int = 6) -> Column:
    """Rounded by the same operations in every engine, also where the decimal text of the number would be a tie."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def quantile(sorted_values: Column, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    place = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return a + (b - a) * (place - low)


def winsorised_days(lots: DataFrame, days: int = 30, least: int = 10) -> DataFrame:
    """species, packaging, trade_date, the prices and origins of the day's lots, and the bounds from the lots of the prior days."""
    key = ("species", "packaging")
    day = lots.groupBy(*key, "trade_date").agg(F.collect_list(F.struct("price_avg", "origin")).alias("lots"), F.sort_array(F.collect_list(F.col("price_avg").cast("double"))).alias("prices"))
    before = day.withColumn("before", F.array_sort(F.flatten(F.collect_list("prices").over(prior(days, key)))))
    enough = F.size("before") >= least
    return before.select(*key, "trade_date", "lots", F.when(enough, quantile(F.col("before"), 0.1)).alias("lo"), F.when(enough, quantile(F.col("before"), 0.9)).alias("hi"))


def clipped() -> Column:
    price = F.col("lot.price_avg").cast("double")
    return F.when(F.col("lo").isNull(), price).otherwise(F.least(F.greatest(price, "lo"), "hi"))


def winsor_bounds(lots: DataFrame) -> DataFrame:
    rows = winsorised_days(lots).select("species", "packaging", "trade_date", "lo", "hi", F.explode("lots").alias("lot"))
    return rows.groupBy("species", "packaging", "trade_date").agg(F.count("*").alias("lots"), F.round(F.avg(clipped()), 6).alias("winsorised"), F.round(F.avg("lot.price_avg"), 6).alias("plain"))


def origin_shares(lots: DataFrame, key: tuple[str, ...], days: int = 30) -> DataFrame:
    """key, trade_date, origin and its weight: on how many of the prior days it was seen, against the origin seen most.

    A grid of the series' days and origins (calendar by origins, not lots); an origin that wasn't seen counts as seen once.
    """
    seen = lots.select(*key, "trade_date", "origin").distinct()
    grid = seen.select(*key, "trade_date").distinct().join(seen.select(*key, "origin").distinct(), list(key))
    marked = grid.join(seen.withColumn("there", F.lit(1)), [*key, "trade_date", "origin"], "left")
    counts = marked.withColumn("seen", F.count("there").over(prior(days, (*key, "origin"))))
    most = F.max("seen").over(W.partitionBy(*key, "trade_date"))
    weight = F.when(F.col("seen") > 0, F.col("seen")).otherwise(1) / F.when(F.col("most") > 0, F.col("most")).otherwise(1)
    return counts.withColumn("most", most).where("there = 1").select(*key, "trade_date", "origin", weight.alias("weight"))


def origin_weights(lots: DataFrame) -> DataFrame:
    sums = lots.groupBy("species", "trade_date", "origin").agg(F.sum("price_avg").alias("s"), F.count("*").alias("n"))
    rows = sums.join(origin_shares(lots, ("species",)), ["species", "trade_date", "origin"])
    total = F.sum(F.col("weight") * F.col("n"))
    plain = F.sum("s") / F.sum("n")
    return rows.groupBy("species", "trade_date").agg(F.round(F.when(total > 0, F.sum(F.col("weight") * F.col("s")) / total).otherwise(plain), 6).alias("weighted"), F.round(plain, 6).alias("plain"))


def robust_prices(lots: DataFrame) -> DataFrame:
    """Of each species and packaging the daily price from winsorised lots weighted by origin."""
    key = ("species", "packaging")
    rows = winsorised_days(lots).select(*key, "trade_date", "lo", "hi", F.explode("lots").alias("lot")).select(*key, "trade_date", F.col("lot.origin").alias("origin"), clipped().alias("p"))
    sums = rows.groupBy(*key, "trade_date", "origin").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    both = sums.join(origin_shares(lots, key), [*key, "trade_date", "origin"])
    return both.groupBy(*key, "trade_date").agg((F.sum(F.col("weight") * F.col("s")) / F.sum(F.col("weight") * F.col("n"))).alias("price"), F.sum("n").alias("n_lots"))


def robust_price_rows(lots: DataFrame) -> DataFrame:
    return robust_prices(lots).withColumn("price", F.round("price", 6))


def trailing(lots: DataFrame) -> DataFrame:
    over = lambda f, n: F.round(f("p").over(prior(n)), 6)
    return daily(lots).select("species", "trade_date", *[over(f, n).alias(f"{name}{n}") for n in (7, 30) for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))])


def skew_kurtosis(lots: DataFrame) -> DataFrame:
    """Population skewness and excess kurtosis of the prior 30 days, 0 for fewer than three or equal values."""
    w = prior(30)
    enough = (F.count("x").over(w) >= 3) & (F.stddev_pop("x").over(w) > 0)
    rows = daily(lots).withColumn("x", F.col("p") / 1000)
    return rows.select("species", "trade_date", *[F.when(enough, F.round(f("x").over(w), 4)).otherwise(0.0).alias(name) for f, name in ((F.skewness, "skew"), (F.kurtosis, "kurtosis"))])


def percentile_rank(lots: DataFrame) -> DataFrame:
    """Rank of a day's price among the prior 90, ties in the middle; 0.5 for fewer than three."""
    rows = daily(lots).select("species", "trade_date", "p", F.collect_list("p").over(prior(90)).alias("before"))
    less, upto = F.size(F.filter("before", lambda x: x < F.col("p"))), F.size(F.filter("before", lambda x: x <= F.col("p")))
    pct = F.when(F.size("before") >= 3, (less + upto + (less < upto).cast("int")) * 0.5 / F.size("before")).otherwise(0.5)
    return rows.select("species", "trade_date", F.size("before").cast("long").alias("n"), F.round(pct, 6).alias("pct"))


def market(lots: DataFrame) -> DataFrame:
    """A row for each species and market day (calendar by species): own and market quantity and lots, 0 where it wasn't traded."""
    days = lots.groupBy("trade_date").agg(F.count("*").alias("ml"), F.sum("quantity").alias("mq"))
    own = lots.groupBy("species", "trade_date").agg(F.sum("quantity").alias("q"), F.count("*").alias("n"))
    grid = days.crossJoin(F.broadcast(lots.select("species").distinct()))  # species of the vocabulary
    return grid.join(own, ["species", "trade_date"], "left").fillna({"q": 0, "n": 0}).withColumn("di", F.row_number().over(by_day()) - 1)


def centred(c: str) -> Column:
    return F.sum(c).over(by_day().rowsBetween(-3, 3))


def before(c: Column | str, n: int) -> Column:
    """The value n market days earlier; the first one where the series is younger."""
    return F.coalesce(F.lag(c, n).over(by_day()), F.first(c).over(by_day()))


def supply_cross(lots: DataFrame) -> DataFrame:
    rows = market(lots).withColumns({"q7": centred("q"), "mq7": centred("mq"), "ml7": centred("ml")})
    rows = rows.withColumns({"mq7b": before("mq7", 7), "ml7b": before("ml7", 7)})
    change = lambda a, b: at_half_up((F.col(a) - F.col(b)) / F.greatest(F.col(b), F.lit(7)))
    return rows.select(
        "species", "trade_date", at_half_up((F.col("mq7") - F.col("q7")) / 7).alias("others"), at_half_up(F.col("ml7") / 7).alias("market_lots_7d"),
        at_half_up(F.when(F.col("mq") > 0, F.col("q") / F.col("mq")).otherwise(0.0)).alias("concentration"), change("mq7", "mq7b").alias("total_change"), change("ml7", "ml7b").alias("market_change"))


def supply_lags(lots: DataFrame) -> DataFrame:
    """Sums of the 3, 5 and 7 market days before, values 3 and 5 days earlier (the first where younger), 7 against 14 days, market lots."""
    rows, total = market(lots), lambda c, n: F.coalesce(F.sum(c).over(prior(n)), F.lit(0))
    seven, fourteen = F.avg("q").over(prior(7)), F.avg("q").over(prior(14))
    return rows.select(
        "species", "trade_date", *[total("q", n).cast("double").alias(f"cum_qty_{n}d") for n in (3, 5, 7)], *[before(c, n).cast("double").alias(f"{name}_lag{n}") for c, name in (("q", "qty"), ("n", "lots")) for n in (3, 5)],
        F.when(fourteen > 0, at_half_up((seven - fourteen) / fourteen)).otherwise(0.0).alias("supply_trend_7d"), *[total("ml", n).cast("double").alias(f"cum_market_lots_{n}d") for n in (3, 5)])


def market_lags(lots: DataFrame) -> DataFrame:
    """Lots against their mean over the seven trading days before, and the market's lots on the day before and over the seven before."""
    days = lots.groupBy("trade_date").agg(F.count("*").alias("ml"))
    rows = daily(lots).join(days, "trade_date")
    mean = F.avg("n").over(prior(7))
    return rows.select(
        "species", "trade_date", at_half_up(F.when(mean > 0, (F.col("n") - mean) / mean).otherwise(0.0)).alias("lots_change"),
        F.coalesce(F.lag("ml").over(by_day()), F.lit(0)).alias("market_lag1"), at_half_up(F.coalesce(F.avg("ml").over(prior(7)), F.lit(0.0))).alias("market_7d"))


def supply_shocks(lots: DataFrame) -> DataFrame:
    """Of each trading day whether seven-day lots halved against 14 market days earlier, quantity against 30 days, and their sum with a gap of more than 3 days."""
    rows = market(lots).withColumns({"q7": centred("q") / 7, "n7": centred("n") / 7, "q30": F.avg("q").over(prior(30))})
    lots_drop = F.when((F.col("di") >= 14) & (F.col("n7") < F.lag("n7", 14).over(by_day()) * 0.5), 1).otherwise(0)
    qty_drop = F.when((F.col("q30") > 0) & (F.col("q7") < F.col("q30") * 0.5), 1).otherwise(0)
    traded = rows.select("species", "trade_date", "n", lots_drop.alias("lots_drop"), qty_drop.alias("qty_drop")).where("n > 0")
    gap = F.coalesce(F.datediff("trade_date", F.lag("trade_date").over(by_day())), F.lit(0))
    return traded.select("species", "trade_date", "lots_drop", "qty_drop", gap.alias("gap"), (F.col("lots_drop") + F.col("qty_drop") + (gap > 3).cast("int")).alias("shock"))


def yoy_supply(lots: DataFrame) -> DataFrame:
    """Seven-day quantity against the mean price of the days 301 to 365 back that lie in the same ISO week; 1 where there are none."""
    q7 = market(lots).select("species", "trade_date", "n", (centred("q") / 7).alias("q7")).where("n > 0").drop("n")
    w = by_day().rowsBetween(-365, -301)
    rows = daily(lots).withColumn("i", F.row_number().over(by_day()) - 1).withColumn("week", F.weekofyear("trade_date"))
    same = F.transform(F.filter(F.collect_list(F.struct("week", "p")).over(w), lambda x: x["week"] == F.col("week")), lambda x: x["p"])
    mean = F.aggregate("same", F.lit(0.0), lambda a, x: a + x) / F.size("same")
    rows = rows.withColumn("same", F.when(F.col("i") >= 300, same).otherwise(F.array().cast("array<double>"))).join(q7, ["species", "trade_date"])
    return rows.select("species", "trade_date", F.round(F.when((F.size("same") > 0) & (mean > 0), F.col("q7") / mean).otherwise(1.0), 6).alias("ratio"))


def calendar_flags(lots: DataFrame) -> DataFrame:
    day = F.weekday("trade_date")
    return lots.select("trade_date").distinct().select("trade_date", (day == 0).cast("int").alias("monday"), (day == 4).cast("int").alias("friday"), (day >= 5).cast("int").alias("weekend"))


OCEAN = ["wave_height_max", "swell_height_max", "wind_speed_max", "wind_gust_max", "temp_mean", "pressure_msl", "precipitation", "sunshine_hours"]


def ocean(spark, sf_dir: str) -> DataFrame:
    """A station's days from the orders of a day: values with gaps, as stations have them, and days without any."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day"), "o_custkey", "o_totalprice")
    days = o.groupBy("day").agg(F.count("*").alias("n"), F.max("o_totalprice").cast("double").alias("m"), (F.sum("o_custkey") % 101).alias("k")).where("k % 7 <> 0")
    value = {"wave_height_max": F.floor(F.col("m") / 1000) / 8, "swell_height_max": F.floor(F.col("m") / 1000) / 16, "wind_speed_max": F.col("k") * 0.5, "wind_gust_max": F.when(F.col("k") % 5 != 0, F.col("k")), "temp_mean": F.when(F.col("k") % 3 != 0, F.col("k") / 4), "pressure_msl": 1000 + F.col("k"), "precipitation": F.col("k") % 10, "sunshine_hours": F.col("k") % 13}
    return days.select("day", *[value[c].cast("double").alias(c) for c in OCEAN])


def ocean_features(spark, sf_dir: str) -> DataFrame:
    """Of each trading day the conditions of the day before, means over the seven calendar days before, and whether gusts passed 50; null where unknown."""
    days, sea = star_lots(spark, sf_dir).select("trade_date").distinct(), ocean(spark, sf_dir)
    number = lambda c: F.datediff(c, F.lit("1990-01-01"))
    rows = days.withColumnRenamed("trade_date", "day").withColumn("asked", F.lit(True)).join(sea, "day", "full").withColumn("at", number("day"))
    w = W.partitionBy(F.lit("station")).orderBy("at")  # the days of one station
    out = rows.withColumns(
        {f"{c}_lag1": F.max(c).over(w.rangeBetween(-1, -1)) for c in OCEAN} | {name: F.avg(c).over(w.rangeBetween(-7, -1)) for name, c in (("wave_height_7d_avg", "wave_height_max"), ("wind_speed_7d_avg", "wind_speed_max"), ("temp_7d_avg", "temp_mean"))})
    out = out.where("asked").withColumn("is_storm", (F.col("wind_gust_max_lag1") > 50).cast("int"))
    return out.select(F.col("day").alias("trade_date"), *[at_half_up(F.col(c)).alias(c) for c in out.columns if c.endswith(("_lag1", "_avg"))], "is_storm")


def complete_since(features: DataFrame, cutoff: str) -> DataFrame:
    """Rows from the cut-off on in which no ocean feature is missing."""
    return features.where(F.col("trade_date") >= F.lit(cutoff).cast("date")).dropna("any")


def sequences(lots: DataFrame, back: int = 30, ahead: int = 7) -> DataFrame:
    """Samples for sequence models: the last `back` prices and the next `ahead`, of every day that has both."""
    rows = daily(lots).select("species", "trade_date", F.collect_list("p").over(by_day().rowsBetween(1 - back, 0)).alias("inputs"), F.collect_list("p").over(by_day().rowsBetween(1, ahead)).alias("targets"))
    return rows.where((F.size("inputs") == back) & (F.size("targets") == ahead))


def sequence_rows(lots: DataFrame) -> DataFrame:
    """The samples, told by position-weighted sums of inputs and targets and the next day's value."""
    dot = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return sequences(lots).select("species", "trade_date", F.round(dot("inputs"), 3).alias("inputs"), F.round(dot("targets"), 3).alias("targets"), F.round(F.get("targets", F.lit(0)), 6).alias("next"))


def cross_correlation(lots: DataFrame) -> DataFrame:
    rows = daily(lots).select("species", F.lag("q", 1).over(by_day()).alias("q1"), F.lag("q", 3).over(by_day()).alias("q3"), F.sum("q").over(prior(7)).alias("c7"), F.count("q").over(prior(7)).alias("k"), F.lead("p", 7).over(by_day()).alias("y")).where("k = 7 and y is not null")
    return rows.groupBy("species").agg(F.count("*").alias("n"), *[F.round(F.corr(c, "y"), 4).alias(name) for c, name in (("q1", "lag1"), ("q3", "lag3"), ("c7", "cumulative7"))])


def substitution(lots: DataFrame) -> DataFrame:
    """Correlation of daily quantities of every two species, over the days on which both were traded."""
    day = daily(lots)
    a, b = day.select("trade_date", F.col("species").alias("species"), F.col("q").alias("x")), day.select("trade_date", F.col("species").alias("other"), F.col("q").alias("y"))
    return a.join(b, "trade_date").where("species < other").groupBy("species", "other").agg(F.count("*").alias("days"), F.round(F.corr("x", "y"), 4).alias("corr")).where("days >= 30")


def calendar_filled(lots: DataFrame, key: tuple[str, ...] = ("species",)) -> DataFrame:
    """Every day between a series' first and last, with the price of the day or the last known one."""
    day = lots.groupBy(*key, "trade_date").agg(F.avg("price_avg").alias("p"))
    ends = day.groupBy(*key).agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = ends.select(*key, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("trade_date"))
    rows = days.join(day, [*key, "trade_date"], "left")
    last = F.last("p", ignorenulls=True).over(W.partitionBy(*key).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0))
    return rows.select(*key, F.col("trade_date").alias("day"), F.round(last, 6).alias("price"), F.col("p").isNull().alias("filled"))


FRAMES = {
    "ts_winsor_bounds": winsor_bounds, "ts_origin_weights": origin_weights, "ts_winsor_weighted": robust_price_rows, "ts_trailing": trailing, "ts_skew_kurtosis": skew_kurtosis, "ts_percentile_rank": percentile_rank,
    "ts_supply_cross": supply_cross, "ts_supply_lags": supply_lags, "ts_market_lags": market_lags, "ts_supply_shocks": supply_shocks, "ts_yoy_supply": yoy_supply, "ts_calendar_flags": calendar_flags, "ts_sequences": sequence_rows,
    "ts_cross_correlation": cross_correlation, "ts_supply_substitution": substitution, "ts_calendar_filled": lambda lots: calendar_filled(lots).drop("filled"), "jn_asof_fill": lambda lots: calendar_filled(lots, ("species", "packaging")),
}
#: What a model is trained on: features by species and trading day, and those of the day alone.
JOINED = ["ts_lags", "ts_momentum", "ts_trailing", "ts_bollinger_zscore", "ts_skew_kurtosis", "ts_percentile_rank", "ts_supply_own", "ts_supply_cross", "ts_supply_shocks", "ts_yoy_supply", "ts_diversity", "ts_seasonal", "ts_target"]
JOINED_DAYS = ["ts_calendar", "ts_calendar_flags", "ts_fourier"]


def features(spark, sf_dir: str) -> DataFrame:
    """One frame of all features and targets; columns that two parts name alike keep the part's name before them."""
    from tidemark import catalog

    part = lambda n, keys: (lambda df: df.select(*keys, *[F.col(c).alias(f"{n[3:]}_{c}") for c in df.columns if c not in keys]))(catalog.QUERIES[n](spark, sf_dir))
    own = reduce(lambda a, b: a.join(b, ["species", "trade_date"]), [part(n, ["species", "trade_date"]) for n in JOINED])
    return reduce(lambda a, b: a.join(b, "trade_date"), [own, *[part(n, ["trade_date"]) for n in JOINED_DAYS]])


QUERIES = {name: (lambda spark, sf_dir, f=f: f(star_lots(spark, sf_dir))) for name, f in FRAMES.items()} | {
    "ts_ocean": ocean_features, "ts_ocean_complete": lambda spark, sf_dir: complete_since(ocean_features(spark, sf_dir), "1995-01-01"), "ts_features": features,
}

_DAY = "day AS (SELECT species, trade_date, avg(price_avg) AS p, sum(quantity) AS q, count(*) AS n FROM lots GROUP BY ALL)"
_GRID = """cal AS (SELECT trade_date, count(*) AS ml, sum(quantity) AS mq FROM lots GROUP BY trade_date), own AS (SELECT species, trade_date, sum(quantity) AS q, count(*) AS n FROM lots GROUP BY ALL),
grid AS (SELECT s.species, cal.*, coalesce(q, 0) AS q, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY s.species ORDER BY cal.trade_date) - 1 AS di FROM cal CROSS JOIN (SELECT DISTINCT species FROM lots) s LEFT JOIN own ON own.species = s.species AND own.trade_date = cal.trade_date)"""
_W = "WINDOW w AS (PARTITION BY species ORDER BY trade_date), c AS (PARTITION BY species ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_HALF = "floor(({0}) * 1000000.0 + 0.5) / 1000000.0"
_ROWS = "OVER (PARTITION BY species ORDER BY trade_date ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING)"
_SEA = "sea AS (SELECT day, floor(m / 1000) / 8 AS wave_height_max, floor(m / 1000) / 16 AS swell_height_max, k * 0.5 AS wind_speed_max, CASE WHEN k % 5 <> 0 THEN k END AS wind_gust_max, CASE WHEN k % 3 <> 0 THEN k / 4.0 END AS temp_mean, 1000 + k AS pressure_msl, k % 10 AS precipitation, k % 13 AS sunshine_hours FROM (SELECT CAST(o_orderdate AS DATE) AS day, CAST(max(o_totalprice) AS DOUBLE) AS m, sum(o_custkey) % 101 AS k FROM orders GROUP BY 1) WHERE k % 7 <> 0)"
_OCEAN = f"""WITH {_SEA}, d AS (SELECT DISTINCT trade_date FROM lots), m AS (SELECT d.trade_date, avg(wave_height_max) AS wv, avg(wind_speed_max) AS wi, avg(temp_mean) AS te FROM d LEFT JOIN sea ON sea.day < d.trade_date AND sea.day >= d.trade_date - 7 GROUP BY d.trade_date)
SELECT m.trade_date, {", ".join(f"{_HALF.format(c)} AS {c}_lag1" for c in OCEAN)}, {_HALF.format("wv")} AS wave_height_7d_avg, {_HALF.format("wi")} AS wind_speed_7d_avg, {_HALF.format("te")} AS temp_7d_avg, CAST(wind_gust_max > 50 AS INT) AS is_storm FROM m LEFT JOIN sea ON sea.day = m.trade_date - 1"""
_ROBUST = """x AS (SELECT *, dense_rank() OVER (PARTITION BY species, packaging ORDER BY trade_date) AS i FROM lots), bnd AS (SELECT a.species, a.packaging, a.i, quantile_cont(CAST(b.price_avg AS DOUBLE), 0.1) AS lo, quantile_cont(CAST(b.price_avg AS DOUBLE), 0.9) AS hi, count(*) AS k
  FROM (SELECT DISTINCT species, packaging, i FROM x) a JOIN x b ON b.species = a.species AND b.packaging = a.packaging AND b.i BETWEEN a.i - 30 AND a.i - 1 GROUP BY ALL),
o AS (SELECT DISTINCT species, packaging, origin, i FROM x), f AS (SELECT a.species, a.packaging, a.i, b.origin, count(*) AS seen FROM (SELECT DISTINCT species, packaging, i FROM x) a JOIN o b ON b.species = a.species AND b.packaging = a.packaging AND b.i BETWEEN a.i - 30 AND a.i - 1 GROUP BY ALL),
mx AS (SELECT species, packaging, i, max(seen) AS most FROM f GROUP BY ALL)"""

SQL = {
    "ts_winsor_weighted": f"""WITH {_ROBUST}, l AS (SELECT x.species, x.packaging, x.trade_date, CASE WHEN k >= 10 THEN greatest(lo, least(hi, x.price_avg)) ELSE x.price_avg END AS p, coalesce(seen, 1) / coalesce(most, 1) AS w
FROM x LEFT JOIN bnd USING (species, packaging, i) LEFT JOIN f USING (species, packaging, i, origin) LEFT JOIN mx USING (species, packaging, i)) SELECT species, packaging, trade_date, round(sum(p * w) / sum(w), 6) AS price, count(*) AS n_lots FROM l GROUP BY ALL""",
    "ts_trailing": f"WITH {_DAY} SELECT species, trade_date, " + ", ".join(f"round({f}(p) {_ROWS.format(n)}, 6) AS {a}{n}" for n in (7, 30) for f, a in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))) + " FROM day",
    "ts_skew_kurtosis": f"""WITH {_DAY}, y AS (SELECT species, trade_date, count(*) {_ROWS.format(30)} AS n, list(p / 1000) {_ROWS.format(30)} AS v FROM day), u AS (SELECT species, trade_date, n, list_avg(v) AS m, v FROM y),
z AS (SELECT species, trade_date, n, list_avg(list_transform(v, lambda a: (a - m) * (a - m))) AS m2, list_avg(list_transform(v, lambda a: (a - m) * (a - m) * (a - m))) AS m3, list_avg(list_transform(v, lambda a: (a - m) * (a - m) * (a - m) * (a - m))) AS m4 FROM u)
SELECT species, trade_date, round(CASE WHEN n >= 3 AND m2 > 0 THEN m3 / power(m2, 1.5) ELSE 0 END, 4) AS skew, round(CASE WHEN n >= 3 AND m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END, 4) AS kurtosis FROM z""",
    "ts_percentile_rank": f"""WITH {_DAY}, i AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY trade_date) AS i FROM day)
SELECT a.species, a.trade_date, count(b.p) AS n, round(CASE WHEN count(b.p) < 3 THEN 0.5 ELSE (count(*) FILTER (b.p < a.p) + count(*) FILTER (b.p <= a.p) + CASE WHEN bool_or(b.p = a.p) THEN 1 ELSE 0 END) * 0.5 / count(b.p) END, 6) AS pct FROM i a LEFT JOIN i b ON a.species = b.species AND b.i BETWEEN a.i - 90 AND a.i - 1 GROUP BY a.species, a.trade_date, a.p""",
    "ts_supply_cross": f"""WITH {_GRID}, s AS (SELECT *, sum(q) OVER c AS q7, sum(mq) OVER c AS mq7, sum(ml) OVER c AS ml7 FROM grid {_W}), l AS (SELECT *, coalesce(lag(mq7, 7) OVER w, first_value(mq7) OVER w) AS mqb, coalesce(lag(ml7, 7) OVER w, first_value(ml7) OVER w) AS mlb FROM s WINDOW w AS (PARTITION BY species ORDER BY trade_date))
SELECT species, trade_date, {_HALF.format("(mq7 - q7) / 7")} AS others, {_HALF.format("ml7 / 7")} AS market_lots_7d, {_HALF.format("CASE WHEN mq > 0 THEN q / mq ELSE 0 END")} AS concentration, {_HALF.format("(mq7 - mqb) / greatest(mqb, 7)")} AS total_change, {_HALF.format("(ml7 - mlb) / greatest(mlb, 7)")} AS market_change FROM l""",
    "ts_supply_lags": f"""WITH {_GRID} SELECT species, trade_date, {", ".join(f"CAST(coalesce(sum(q) {_ROWS.format(n)}, 0) AS DOUBLE) AS cum_qty_{n}d" for n in (3, 5, 7))}, {", ".join(f"CAST(coalesce(lag({c}, {n}) OVER w, first_value({c}) OVER w) AS DOUBLE) AS {a}_lag{n}" for c, a in (("q", "qty"), ("n", "lots")) for n in (3, 5))},
CASE WHEN avg(q) {_ROWS.format(14)} > 0 THEN {_HALF.format(f"(avg(q) {_ROWS.format(7)} - avg(q) {_ROWS.format(14)}) / avg(q) {_ROWS.format(14)}")} ELSE 0 END AS supply_trend_7d, {", ".join(f"CAST(coalesce(sum(ml) {_ROWS.format(n)}, 0) AS DOUBLE) AS cum_market_lots_{n}d" for n in (3, 5))} FROM grid {_W}""",
    "ts_market_lags": f"""WITH {_DAY}, m AS (SELECT trade_date, count(*) AS ml FROM lots GROUP BY trade_date), b AS (SELECT species, trade_date, n, avg(n) {_ROWS.format(7)} AS a, coalesce(lag(ml) OVER (PARTITION BY species ORDER BY trade_date), 0) AS m1, coalesce(avg(ml) {_ROWS.format(7)}, 0) AS m7 FROM day JOIN m USING (trade_date))
SELECT species, trade_date, {_HALF.format("CASE WHEN a > 0 THEN (n - a) / a ELSE 0 END")} AS lots_change, m1 AS market_lag1, {_HALF.format("m7")} AS market_7d FROM b""",
    "ts_supply_shocks": f"""WITH {_GRID}, s AS (SELECT *, sum(q) OVER c / 7 AS q7, sum(n) OVER c / 7 AS n7, avg(q) {_ROWS.format(30)} AS q30 FROM grid {_W}), l AS (SELECT *, lag(n7, 14) OVER (PARTITION BY species ORDER BY trade_date) AS n14 FROM s),
t AS (SELECT species, trade_date, CAST(coalesce(di >= 14 AND n7 < n14 * 0.5, FALSE) AS INT) AS lots_drop, CAST(coalesce(q30 > 0 AND q7 < q30 * 0.5, FALSE) AS INT) AS qty_drop, coalesce(trade_date - lag(trade_date) OVER (PARTITION BY species ORDER BY trade_date), 0) AS gap FROM l WHERE n > 0)
SELECT species, trade_date, lots_drop, qty_drop, gap, lots_drop + qty_drop + CASE WHEN gap > 3 THEN 1 ELSE 0 END AS shock FROM t""",
    "ts_yoy_supply": f"""WITH {_GRID}, s AS (SELECT species, trade_date, n, sum(q) OVER c / 7 AS q7 FROM grid {_W}), d AS (SELECT species, trade_date, p, weekofyear(trade_date) AS wk, row_number() OVER (PARTITION BY species ORDER BY trade_date) - 1 AS i FROM (SELECT species, trade_date, avg(price_avg) AS p FROM lots GROUP BY ALL)),
m AS (SELECT a.species, a.trade_date, avg(b.p) AS m FROM d a JOIN d b ON b.species = a.species AND b.wk = a.wk AND b.i BETWEEN a.i - 365 AND a.i - 301 WHERE a.i >= 300 GROUP BY ALL)
SELECT d.species, d.trade_date, round(CASE WHEN m > 0 THEN q7 / m ELSE 1 END, 6) AS ratio FROM d JOIN s ON s.species = d.species AND s.trade_date = d.trade_date LEFT JOIN m ON m.species = d.species AND m.trade_date = d.trade_date""",
    "ts_calendar_flags": "SELECT DISTINCT trade_date, CAST(isodow(trade_date) = 1 AS INT) AS monday, CAST(isodow(trade_date) = 5 AS INT) AS friday, CAST(isodow(trade_date) > 5 AS INT) AS weekend FROM lots",
    "ts_sequences": f"""WITH {_DAY}, i AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY trade_date) AS i, count(*) OVER (PARTITION BY species) AS k FROM day)
SELECT a.species, a.trade_date, round(sum(CASE WHEN b.i <= a.i THEN b.p * (b.i - a.i + 30) END), 3) AS inputs, round(sum(CASE WHEN b.i > a.i THEN b.p * (b.i - a.i) END), 3) AS targets, round(max(CASE WHEN b.i = a.i + 1 THEN b.p END), 6) AS next FROM i a JOIN i b ON b.species = a.species AND b.i BETWEEN a.i - 29 AND a.i + 7 WHERE a.i >= 30 AND a.i + 7 <= a.k GROUP BY ALL""",
    "ts_cross_correlation": f"WITH {_DAY}, x AS (SELECT species, lag(q) OVER w AS q1, lag(q, 3) OVER w AS q3, sum(q) {_ROWS.format(7)} AS c7, lag(q, 7) OVER w AS q7, lead(p, 7) OVER w AS y FROM day WINDOW w AS (PARTITION BY species ORDER BY trade_date)) SELECT species, count(*) AS n, round(corr(q1, y), 4) AS lag1, round(corr(q3, y), 4) AS lag3, round(corr(c7, y), 4) AS cumulative7 FROM x WHERE q7 IS NOT NULL AND y IS NOT NULL GROUP BY species",
    "ts_supply_substitution": f"WITH {_DAY} SELECT a.species, b.species AS other, count(*) AS days, round(corr(a.q, b.q), 4) AS corr FROM day a JOIN day b ON a.trade_date = b.trade_date AND a.species < b.species GROUP BY ALL HAVING count(*) >= 30",
    "ts_calendar_filled": f"WITH {_DAY}, c AS (SELECT species, CAST(unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY)) AS DATE) AS d FROM day GROUP BY species) SELECT c.species, c.d AS day, round(day.p, 6) AS price FROM c ASOF JOIN day ON day.species = c.species AND c.d >= day.trade_date",
    "jn_asof_fill": "WITH e AS (SELECT species, packaging, trade_date, avg(price_avg) AS p FROM lots GROUP BY ALL), c AS (SELECT species, packaging, CAST(unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY)) AS DATE) AS d FROM e GROUP BY species, packaging) SELECT c.species, c.packaging, c.d AS day, round(e.p, 6) AS price, e.trade_date <> c.d AS filled FROM c ASOF JOIN e ON e.species = c.species AND e.packaging = c.packaging AND c.d >= e.trade_date",
    "ts_ocean": _OCEAN,
    "ts_ocean_complete": f"SELECT * FROM ({_OCEAN}) x WHERE trade_date >= DATE '1995-01-01' AND " + " AND ".join(f"{c} IS NOT NULL" for c in [*(f"{c}_lag1" for c in OCEAN), "wave_height_7d_avg", "wind_speed_7d_avg", "temp_7d_avg", "is_storm"]),
}
ORACLES = {name: oracle(text) for name, text in SQL.items()}


def features_sql(oracles: dict[str, str]) -> str:
    """SQL of `features`: the parts' own SQL joined, with the parts' names before their columns."""
    names = [*JOINED, *JOINED_DAYS]
    parts = [f"(SELECT COLUMNS('.*') AS '{n[3:]}_\\0' FROM ({oracles[n]}) AS raw) AS part{i}" for i, n in enumerate(names)]
    first = names[0][3:]
    on = [f"{first}_trade_date = {n[3:]}_trade_date" + (f" AND {first}_species = {n[3:]}_species" if n in JOINED else "") for n in names[1:]]
    gone = ", ".join([f"{n[3:]}_trade_date" for n in names] + [f"{n[3:]}_species" for n in JOINED])
    joins = " ".join(f"JOIN {p} ON {c}" for p, c in zip(parts[1:], on, strict=True))
    return f"SELECT {first}_species AS species, {first}_trade_date AS trade_date, * EXCLUDE ({gone}) FROM {parts[0]} {joins}"
