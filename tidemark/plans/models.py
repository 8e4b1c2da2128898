"""Forecast studies with the DataFrame API: averages, ensembles, search, folds, quantiles, losses, insight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.dialect import oracle
from tidemark.plans.series import by_day, prior
from tidemark.plans.studies import daily
from tidemark.sources.lots import star_lots

HORIZON = 7
#: Weights of the ensembles: of three forecasts and of two.
THREE, TWO = (0.5, 0.3, 0.2), (0.6, 0.4)
#: Candidates of the search: how many days are averaged, and the share of the last value in the forecast.
WINDOWS, SHARES = (3, 5, 7, 14, 30), (0.0, 0.5, 1.0)


def forecasts(lots: DataFrame) -> DataFrame:
    """species, i, p, the forecasts of the price HORIZON days ahead (naive, averages with and without today's), and the actual a."""
    upto = lambda n: F.avg("p").over(by_day().rowsBetween(1 - n, 0))
    return daily(lots).select(
        "species", "trade_date", (F.row_number().over(by_day()) - 1).alias("i"), F.count("*").over(W.partitionBy("species")).alias("days"), "p", F.col("p").alias("naive"), upto(7).alias("sma7"), upto(30).alias("sma30"),
        F.avg("p").over(prior(7)).alias("prior7"), F.avg("p").over(prior(30)).alias("prior30"), F.stddev_pop("p").over(prior(30)).alias("sd"), F.lead("p", HORIZON).over(by_day()).alias("a"))


def mape(forecast: str | Column) -> Column:
    f = F.col(forecast) if isinstance(forecast, str) else forecast
    return F.avg(F.when(F.col("a") > 0, F.abs(f - F.col("a")) / F.col("a"))) * 100


def averages(lots: DataFrame) -> DataFrame:
    """Errors of the averages of 7 and 30 days, with today's value (30 days at least) and without it."""
    rows = forecasts(lots).where("a is not null and i >= 30")
    return rows.groupBy("species").agg(F.count("*").alias("n"), *[F.round(mape(c), 6).alias(c) for c in ("sma7", "sma30", "prior7", "prior30")])


def ensembles(lots: DataFrame) -> DataFrame:
    rows = forecasts(lots).where("a is not null and i >= 30")
    three = sum((F.col(c) * w for c, w in zip(("naive", "sma7", "sma30"), THREE, strict=True)), F.lit(0.0))
    two = F.col("naive") * TWO[0] + F.col("sma7") * TWO[1]
    return rows.groupBy("species").agg(F.round(mape("naive"), 6).alias("naive"), F.round(mape(three), 6).alias("three"), F.round(mape(two), 6).alias("two"))


def search(lots: DataFrame) -> DataFrame:
    """Of 15 candidates the best on the last quarter of the training days (the first 80 %), and its error on the days held out."""
    rows = forecasts(lots).where("a is not null and i >= 30")
    grid = [(n, s) for n in WINDOWS for s in SHARES]
    over = {n: F.avg("p").over(by_day().rowsBetween(1 - n, 0)) for n in WINDOWS}
    values = daily(lots).select("species", "trade_date", *[v.alias(f"m{n}") for n, v in over.items()])
    rows = rows.join(values, ["species", "trade_date"])
    candidates = F.array(*[F.struct(F.lit(n).alias("days_"), F.lit(s).alias("share"), (F.col("p") * s + F.col(f"m{n}") * (1 - s)).alias("f")) for n, s in grid])
    wide = rows.select("species", "i", "days", "a", F.inline(candidates))
    part = F.when(F.col("i") < F.floor(F.col("days") * 0.6), "fit").when(F.col("i") < F.floor(F.col("days") * 0.8), "tune").otherwise("test")
    scores = wide.groupBy("species", "days_", "share").agg(*[F.round(F.avg(F.when((part == x) & (F.col("a") > 0), F.abs(F.col("f") - F.col("a")) / F.col("a"))) * 100, 6).alias(x) for x in ("tune", "test")])
    rank = F.row_number().over(W.partitionBy("species").orderBy("tune", "days_", "share"))
    return scores.withColumn("r", rank).where("r = 1").select("species", "days_", "share", "tune", "test")


def quantiles(lots: DataFrame) -> DataFrame:
    """Forecast quantiles 0.1 and 0.9: the naive forecast times quantiles of past ratios (first 80 %), and their pinball loss and coverage after."""
    rows = forecasts(lots).where("a is not null").withColumns({"r": F.col("a") / F.col("p"), "late": F.col("i") >= F.floor(F.col("days") * 0.8)})
    q = rows.where("not late").groupBy("species").agg(*[F.percentile("r", a).alias(f"q{int(10 * a)}") for a in (0.1, 0.9)])
    late = rows.where("late").join(q, "species")
    lo, hi = F.col("p") * F.col("q1"), F.col("p") * F.col("q9")
    pinball = lambda f, a: F.avg(F.greatest(a * (F.col("a") - f), (a - 1) * (F.col("a") - f)))
    return late.groupBy("species").agg(
        F.round(F.first("q1"), 6).alias("q1"), F.round(F.first("q9"), 6).alias("q9"), F.round(pinball(lo, 0.1), 4).alias("loss1"), F.round(pinball(hi, 0.9), 4).alias("loss9"),
        F.round(F.avg(F.col("a").between(lo, hi).cast("int")), 6).alias("coverage"))


def folds(lots: DataFrame) -> DataFrame:
    """Five expanding folds: training days without those 3 deviations off their prior 30 (unless fewer than 50 are left), test days, and the naive error on them."""
    rows = forecasts(lots).withColumn("outlier", (F.col("i") >= 30) & (F.col("sd") > 0) & (F.abs(F.col("p") - F.col("prior30")) > 3 * F.col("sd")))
    base, fold = F.floor(F.col("days") / 2), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")
    wide = rows.select("*", base.alias("base"), F.floor((F.col("days") - base) / 5).alias("step"), fold).where("step >= 10 and base >= 100")
    start = F.col("base") + F.col("fold") * F.col("step")
    train, test = F.col("i") < start, (F.col("i") >= start) & (F.col("i") < start + F.col("step"))
    out = wide.groupBy("species", "fold").agg(F.count_if(train).alias("all_"), F.count_if(train & ~F.col("outlier")).alias("clean"), F.count_if(test).alias("test"), F.round(F.avg(F.when(test & (F.col("a") > 0), F.abs(F.col("p") - F.col("a")) / F.col("a"))) * 100, 6).alias("mape"))
    return out.select("species", "fold", F.when(F.col("clean") < 50, F.col("all_")).otherwise(F.col("clean")).alias("train"), "test", "mape")


def rolling(lots: DataFrame) -> DataFrame:
    """Origins from day 180 on in steps of 7 (of 14 for the last model): the mean errors of each forecast."""
    rows = forecasts(lots).where(f"i >= 180 and i < days - {HORIZON} and (i - 180) % 7 = 0")
    sparse = F.when((F.col("i") - 180) % 14 == 0, F.col("sma30"))
    return rows.groupBy("species").agg(F.count("*").alias("origins"), *[F.round(mape(c), 6).alias(c) for c in ("naive", "sma7")], F.round(mape(sparse), 6).alias("sma30"))


def losses(lots: DataFrame) -> DataFrame:
    """Losses of the naive forecast in thousands: squared, absolute, per cent, symmetric, Huber, log-cosh, smoothed per cent; what isn't finite counts as the actual."""
    rows = forecasts(lots).where("a is not null")
    forecast = F.col("p") / F.when(F.col("i") % 50 != 0, F.lit(1.0)).otherwise(F.nullif(F.lit(0.0), F.lit(0.0)))
    finite = F.when(forecast.isNull() | F.isnan(forecast) | F.abs(forecast).isin(float("inf")), F.col("a")).otherwise(forecast)
    rows = rows.select("species", (finite / 1000).alias("f"), (F.col("a") / 1000).alias("y"))
    d = F.abs(F.col("f") - F.col("y"))
    each = {"mse": d * d, "mae": d, "mape": d / F.abs("y") * 100, "smape": 2 * d / (F.abs("f") + F.abs("y")) * 100, "huber": F.when(d <= 1, 0.5 * d * d).otherwise(d - 0.5), "logcosh": F.log(F.cosh(d)), "smoothed": d / (F.abs("y") + 1)}
    return rows.groupBy("species").agg(*[F.round(F.avg(v), 6).alias(k) for k, v in each.items()])


def top_models(lots: DataFrame) -> DataFrame:
    """The three best of five forecasts of each species, with their places, and the mean of their errors."""
    names = ["naive", "sma7", "sma30", "prior7", "prior30"]
    rows = forecasts(lots).where("a is not null and i >= 30").groupBy("species").agg(*[mape(c).alias(c) for c in names]).unpivot("species", names, "model", "mape")
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy("species").orderBy("mape", "model"))).where("place <= 3")
    return ranked.select("species", "model", "place", F.round("mape", 6).alias("mape"), F.round(F.avg("mape").over(W.partitionBy("species")), 6).alias("ensemble_metric"))


def regression_lines(lots: DataFrame) -> DataFrame:
    rows = forecasts(lots).where("a is not null").groupBy("species").agg(F.regr_slope("a", "p").alias("slope"), F.regr_intercept("a", "p").alias("intercept"), F.regr_r2("a", "p").alias("r2"))
    return rows.select("species", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 4).alias("r2"))


def insight(lots: DataFrame) -> DataFrame:
    """Advice of each species from the season of its last month (index below 0.9 or above 1.1), the trend and the volatility.

    The trend is the slope of the last 30 days against a tenth of their deviation. Volatility is high where the deviation
    of the last 30 days is at least 0.66 of the largest that any 30 days had.
    """
    day = daily(lots).withColumn("back", F.row_number().over(W.partitionBy("species").orderBy(F.desc("trade_date"))))
    last = day.where("back = 1").select("species", F.month("trade_date").alias("m"))
    season = day.join(last, "species").groupBy("species").agg((F.avg(F.when(F.month("trade_date") == F.col("m"), F.col("p"))) / F.avg("p")).alias("index"))
    trend = day.where("back <= 30").groupBy("species").agg(F.regr_slope("p", -F.col("back")).alias("slope"), F.stddev_pop("p").alias("sd"))
    month = by_day().rowsBetween(-29, 0)
    rolling = day.withColumn("s", F.when(F.count("p").over(month) == 30, F.stddev_samp("p").over(month)))
    volatility = rolling.groupBy("species").agg((F.max(F.when(F.col("back") == 1, F.col("s"))) / F.nullif(F.max("s"), F.lit(0.0))).alias("vol"))
    rows = season.join(trend, "species").join(volatility, "species")
    direction = F.when(F.col("slope") > 0.1 * F.col("sd"), "rising").when(F.col("slope") < -0.1 * F.col("sd"), "falling").otherwise("stable")
    rows = rows.withColumn("direction", direction).withColumn("high", F.coalesce(F.col("vol") >= 0.66, F.lit(False)))
    score = F.when(F.col("index") < 0.9, 2).when(F.col("index") > 1.1, -2).otherwise(0) + F.when(F.col("direction") == "falling", 1).when(F.col("direction") == "rising", -1).otherwise(0) - F.col("high").cast("int")
    reasons = F.array_compact(F.array(F.when(F.col("index") < 0.9, "low season").when(F.col("index") > 1.1, "high season"), F.when(F.col("direction") != "stable", F.concat(F.lit("prices "), "direction")), F.when(F.col("high"), "volatile")))
    action = F.when(F.col("score") >= 2, "buy").when(F.col("score") <= -2, "wait").otherwise("hold")
    sure = F.when(action == "hold", 0.5).otherwise(F.least(F.lit(0.9), 0.5 + 0.1 * F.abs("score")))
    return rows.withColumn("score", score).select("species", "score", action.alias("action"), F.round(sure, 2).alias("confidence"), F.array_join(reasons, "; ").alias("reasons"))


def predicted(lots: DataFrame) -> DataFrame:
    """The forecast of each species for the week after its last day, with the band of its past errors (80 %)."""
    rows = forecasts(lots)
    bands = rows.where("a is not null").groupBy("species").agg(F.percentile(F.abs(F.col("a") - F.col("sma7")), 0.8).alias("half"))
    last = rows.where("i = days - 1").join(bands, "species")
    return last.select("species", F.date_add("trade_date", HORIZON).alias("day"), F.round("sma7", 4).alias("forecast"), F.round(F.col("sma7") - F.col("half"), 4).alias("low"), F.round(F.col("sma7") + F.col("half"), 4).alias("high"))


FRAMES = {
    "ml_averages": averages, "ml_ensembles": ensembles, "ml_search": search, "ml_quantiles": quantiles, "ml_folds": folds, "ml_rolling": rolling, "ev_all_losses": losses, "ev_top_models": top_models,
    "ev_regression_line": regression_lines, "ml_insight": insight, "tl_predict_price": predicted,
}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(star_lots(spark, sf_dir))) for name, f in FRAMES.items()}

_F = """d AS (SELECT species, trade_date, avg(price_avg) AS p FROM lots GROUP BY ALL), f AS (SELECT species, trade_date, p, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY species) AS days, p AS naive,
  avg(p) OVER (PARTITION BY species ORDER BY trade_date ROWS 6 PRECEDING) AS sma7, avg(p) OVER (PARTITION BY species ORDER BY trade_date ROWS 29 PRECEDING) AS sma30,
  avg(p) OVER (PARTITION BY species ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS prior7, avg(p) OVER (PARTITION BY species ORDER BY trade_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS prior30,
  stddev_pop(p) OVER (PARTITION BY species ORDER BY trade_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS sd, lead(p, 7) OVER w AS a FROM d WINDOW w AS (PARTITION BY species ORDER BY trade_date))"""
_M = "round(avg(abs({0} - a) / a) FILTER (a > 0) * 100, 6)"
_NAMES = ["naive", "sma7", "sma30", "prior7", "prior30"]
SQL = {
    "ml_averages": f"WITH {_F} SELECT species, count(*) AS n, " + ", ".join(f"{_M.format(c)} AS {c}" for c in _NAMES[1:]) + " FROM f WHERE a IS NOT NULL AND i >= 30 GROUP BY species",
    "ml_ensembles": f"WITH {_F} SELECT species, {_M.format('naive')} AS naive, {_M.format('(0.5 * naive + 0.3 * sma7 + 0.2 * sma30)')} AS three, {_M.format('(0.6 * naive + 0.4 * sma7)')} AS two FROM f WHERE a IS NOT NULL AND i >= 30 GROUP BY species",
    "ml_search": f"""WITH {_F}, k AS ({" UNION ALL ".join(f"SELECT species, trade_date, {n} AS days_, avg(p) OVER (PARTITION BY species ORDER BY trade_date ROWS {n - 1} PRECEDING) AS m FROM d" for n in WINDOWS)}),
c AS (SELECT f.species, i, days, a, days_, share, p * share + m * (1 - share) AS f FROM f JOIN k USING (species, trade_date) CROSS JOIN (VALUES (0.0::DOUBLE), (0.5), (1.0)) v(share) WHERE a IS NOT NULL AND i >= 30),
s AS (SELECT species, days_, share, round(avg(abs(f - a) / a) FILTER (a > 0 AND i >= floor(days * 0.6) AND i < floor(days * 0.8)) * 100, 6) AS tune, round(avg(abs(f - a) / a) FILTER (a > 0 AND i >= floor(days * 0.8)) * 100, 6) AS test FROM c GROUP BY ALL)
SELECT species, days_, share, tune, test FROM s QUALIFY row_number() OVER (PARTITION BY species ORDER BY tune, days_, share) = 1""",
    "ml_quantiles": f"""WITH {_F}, r AS (SELECT *, a / p AS r, i >= floor(days * 0.8) AS late FROM f WHERE a IS NOT NULL), q AS (SELECT species, quantile_cont(r, 0.1) AS q1, quantile_cont(r, 0.9) AS q9 FROM r WHERE NOT late GROUP BY species)
SELECT species, round(any_value(q1), 6) AS q1, round(any_value(q9), 6) AS q9, round(avg(CASE WHEN a >= p * q1 THEN 0.1 * (a - p * q1) ELSE 0.9 * (p * q1 - a) END), 4) AS loss1, round(avg(CASE WHEN a >= p * q9 THEN 0.9 * (a - p * q9) ELSE 0.1 * (p * q9 - a) END), 4) AS loss9, round(avg(CASE WHEN a BETWEEN p * q1 AND p * q9 THEN 1 ELSE 0 END), 6) AS coverage FROM r JOIN q USING (species) WHERE late GROUP BY species""",
    "ml_folds": f"""WITH {_F}, o AS (SELECT *, coalesce(i >= 30 AND sd > 0 AND abs(p - prior30) > 3 * sd, FALSE) AS odd, days // 2 AS base, (days - days // 2) // 5 AS step FROM f), c AS (SELECT * FROM o CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(fold) WHERE step >= 10 AND base >= 100)
SELECT species, fold, CASE WHEN count(*) FILTER (i < base + fold * step AND NOT odd) < 50 THEN count(*) FILTER (i < base + fold * step) ELSE count(*) FILTER (i < base + fold * step AND NOT odd) END AS train,
count(*) FILTER (i >= base + fold * step AND i < base + (fold + 1) * step) AS test, round(avg(abs(p - a) / a) FILTER (a > 0 AND i >= base + fold * step AND i < base + (fold + 1) * step) * 100, 6) AS mape FROM c GROUP BY species, fold""",
    "ml_rolling": f"WITH {_F} SELECT species, count(*) AS origins, {_M.format('naive')} AS naive, {_M.format('sma7')} AS sma7, round(avg(abs(sma30 - a) / a) FILTER (a > 0 AND (i - 180) % 14 = 0) * 100, 6) AS sma30 FROM f WHERE i >= 180 AND i < days - 7 AND (i - 180) % 7 = 0 GROUP BY species",
    "ev_all_losses": f"""WITH {_F}, e AS (SELECT species, CASE WHEN i % 50 = 0 THEN a ELSE p END / 1000 AS f, a / 1000 AS y FROM f WHERE a IS NOT NULL), g AS (SELECT *, abs(f - y) AS d FROM e)
SELECT species, round(avg(d * d), 6) AS mse, round(avg(d), 6) AS mae, round(avg(d / abs(y)) * 100, 6) AS mape, round(avg(2 * d / (abs(f) + abs(y))) * 100, 6) AS smape, round(avg(CASE WHEN d <= 1 THEN d * d / 2 ELSE d - 0.5 END), 6) AS huber, round(avg(ln((exp(d) + exp(-d)) / 2)), 6) AS logcosh, round(avg(d / (abs(y) + 1)), 6) AS smoothed FROM g GROUP BY species""",
    "ev_top_models": f"""WITH {_F}, m AS ({" UNION ALL ".join(f"SELECT species, '{c}' AS model, avg(abs({c} - a) / a) FILTER (a > 0) * 100 AS m FROM f WHERE a IS NOT NULL AND i >= 30 GROUP BY species" for c in _NAMES)}), r AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY m, model) AS place FROM m)
SELECT species, model, place, round(m, 6) AS mape, round(avg(m) OVER (PARTITION BY species), 6) AS ensemble_metric FROM r WHERE place <= 3""",
    "ev_regression_line": f"WITH {_F} SELECT species, round(covar_pop(a, p) / var_pop(p), 4) AS slope, round(avg(a) - covar_pop(a, p) / var_pop(p) * avg(p), 3) AS intercept, round(power(corr(a, p), 2), 4) AS r2 FROM f WHERE a IS NOT NULL GROUP BY species",
    "ml_insight": f"""WITH {_F}, l AS (SELECT species, month(max(trade_date)) AS m FROM d GROUP BY species), s AS (SELECT species, avg(p) FILTER (month(trade_date) = m) / avg(p) AS ix FROM d JOIN l USING (species) GROUP BY species),
t AS (SELECT species, covar_pop(p, i) / var_pop(i) AS slope, stddev_pop(p) AS sd FROM f WHERE i >= days - 30 GROUP BY species),
v AS (SELECT species, i, CASE WHEN i >= 29 THEN stddev_samp(p) OVER (PARTITION BY species ORDER BY i ROWS 29 PRECEDING) END AS roll FROM f), vol AS (SELECT species, arg_max(roll, i) / nullif(max(roll), 0) AS ratio FROM v GROUP BY species),
x AS (SELECT species, ix, CASE WHEN abs(slope) <= sd / 10 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS dir, coalesce(ratio >= 0.66, FALSE) AS high FROM s JOIN t USING (species) JOIN vol USING (species)),
y AS (SELECT *, CASE WHEN ix < 0.9 THEN 2 WHEN ix > 1.1 THEN -2 ELSE 0 END + CASE dir WHEN 'falling' THEN 1 WHEN 'rising' THEN -1 ELSE 0 END - CASE WHEN high THEN 1 ELSE 0 END AS score FROM x)
SELECT species, score, CASE WHEN score >= 2 THEN 'buy' WHEN score <= -2 THEN 'wait' ELSE 'hold' END AS action, round(CASE WHEN abs(score) >= 2 THEN least(0.9, 0.5 + 0.1 * abs(score)) ELSE 0.5 END, 2) AS confidence,
concat_ws('; ', CASE WHEN ix < 0.9 THEN 'low season' WHEN ix > 1.1 THEN 'high season' END, CASE WHEN dir <> 'stable' THEN 'prices ' || dir END, CASE WHEN high THEN 'volatile' END) AS reasons FROM y""",
    "tl_predict_price": f"WITH {_F}, b AS (SELECT species, quantile_cont(abs(a - sma7), 0.8) AS h FROM f WHERE a IS NOT NULL GROUP BY species) SELECT species, CAST(trade_date + 7 AS DATE) AS day, round(sma7, 4) AS forecast, round(sma7 - h, 4) AS low, round(sma7 + h, 4) AS high FROM f JOIN b USING (species) WHERE i = days - 1",
}
ORACLES = {name: oracle(text) for name, text in SQL.items()}
