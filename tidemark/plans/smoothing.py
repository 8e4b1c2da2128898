"""Exponential smoothing with fitted constants: every candidate runs over a species' days as a fold, the least squared one-step error stays.

A species' days are one array, so its length follows the calendar and not the lots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.dialect import oracle
from tidemark.plans.studies import daily
from tidemark.sources.lots import star_lots

#: Candidates for the constants of level, trend and season.
LEVELS, TRENDS, SEASONS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), (0.01, 0.05, 0.1, 0.2, 0.4), (0.05, 0.2, 0.5)
#: The constants that aren't fitted, for comparison.
GIVEN = (0.3, 0.1)
PERIOD, LAST, HORIZON, BAND = 7, 90, 7, 1.28


def series(lots: DataFrame, last: int | None = None) -> DataFrame:
    """species and its daily prices in order, of the last days only where told."""
    day = daily(lots)
    if last:
        day = day.withColumn("back", F.row_number().over(W.partitionBy("species").orderBy(F.desc("trade_date")))).where(F.col("back") <= last)
    return day.groupBy("species").agg(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "p"))), lambda x: x["p"]).alias("y"))


def _best(scored: DataFrame, constants: list[str]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("species").orderBy(F.round("mse", 4), *constants))
    return scored.withColumn("r", rank).where("r = 1").drop("r")


def holt(lots: DataFrame) -> DataFrame:
    """Additive trend: fitted constants, the root of their mean squared one-step error and of the given constants', and the forecast of a week ahead."""
    def step(acc: Column, y: Column) -> Column:
        level = F.col("a") * y + (1 - F.col("a")) * (acc["level"] + acc["trend"])
        error = y - acc["level"] - acc["trend"]
        return F.struct(level.alias("level"), (F.col("b") * (level - acc["level"]) + (1 - F.col("b")) * acc["trend"]).alias("trend"), (acc["sse"] + error * error).alias("sse"))

    candidates = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in LEVELS for b in TRENDS])
    rows = series(lots).where("size(y) >= 10").select("species", "y", F.inline(candidates))
    start = F.struct(F.get("y", F.lit(0)).alias("level"), (F.get("y", F.lit(1)) - F.get("y", F.lit(0))).alias("trend"), F.lit(0.0).alias("sse"))
    ran = rows.select("species", "a", "b", F.size("y").alias("n"), F.aggregate(F.slice("y", 2, F.size("y") - 1), start, step).alias("end"))
    scored = ran.select("species", "a", "b", "n", (F.col("end.sse") / (F.col("n") - 1)).alias("mse"), (F.col("end.level") + HORIZON * F.col("end.trend")).alias("f"))
    given = scored.where(f"a = {GIVEN[0]} and b = {GIVEN[1]}").select("species", F.col("mse").alias("given"))
    return _best(scored, ["a", "b"]).join(given, "species").select(
        "species", F.col("n").cast("long").alias("n"), F.col("a").alias("level_constant"), F.col("b").alias("trend_constant"), F.round(F.sqrt("mse"), 4).alias("rmse"), F.round(F.sqrt("given"), 4).alias("rmse_given"), F.round("f", 4).alias("forecast"))


def holt_winters(lots: DataFrame) -> DataFrame:
    """Additive trend and weekly season on the last 90 days: fitted constants and the week ahead with its 80 % band."""
    a, b, g = F.col("a"), F.col("b"), F.col("g")

    def step(acc: Column, y: Column) -> Column:
        season = F.get(acc["s"], F.lit(0))
        level = a * (y - season) + (1 - a) * (acc["level"] + acc["trend"])
        error = y - acc["level"] - acc["trend"] - season
        later = F.concat(F.slice(acc["s"], 2, PERIOD - 1), F.array(g * (y - level) + (1 - g) * season))
        return F.struct(level.alias("level"), (b * (level - acc["level"]) + (1 - b) * acc["trend"]).alias("trend"), later.alias("s"), (acc["sse"] + error * error).alias("sse"))

    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    first, second = F.slice("y", 1, PERIOD), F.slice("y", PERIOD + 1, PERIOD)
    rows = series(lots, LAST).where(f"size(y) >= {3 * PERIOD}").withColumn("m", total(first) / PERIOD).withColumn("t", (total(second) / PERIOD - F.col("m")) / PERIOD)
    start = F.struct(F.col("m").alias("level"), F.col("t").alias("trend"), F.transform(first, lambda v: v - F.col("m")).alias("s"), F.lit(0.0).alias("sse"))
    candidates = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.lit(z).alias("g")) for x in LEVELS[::2] for y in TRENDS[::2] for z in SEASONS])
    rows = rows.select("species", "y", "m", "t", F.inline(candidates))
    ran = rows.select("species", "a", "b", "g", (F.size("y") - PERIOD).alias("n"), F.aggregate(F.slice("y", PERIOD + 1, F.size("y") - PERIOD), start, step).alias("end"))
    best = _best(ran.select("*", (F.col("end.sse") / F.col("n")).alias("mse")), ["a", "b", "g"])
    ahead = best.select("*", F.posexplode("end.s").alias("k", "season")).withColumn("h", F.col("k") + 1)
    f, half = F.col("end.level") + F.col("h") * F.col("end.trend") + F.col("season"), BAND * F.sqrt("mse") * F.sqrt("h")
    return ahead.select("species", "a", "b", "g", "h", F.round(f, 4).alias("forecast"), F.round(f - half, 4).alias("low"), F.round(f + half, 4).alias("high"))


FRAMES = {"ml_holt_fitted": holt, "ml_holt_winters_fitted": holt_winters}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(star_lots(spark, sf_dir))) for name, f in FRAMES.items()}

_values = lambda xs: ", ".join(f"({x}::DOUBLE)" for x in xs)
SQL = {
    "ml_holt_fitted": f"""WITH RECURSIVE d AS (SELECT species, trade_date, avg(price_avg) AS p FROM lots GROUP BY ALL), y AS (SELECT species, p, row_number() OVER (PARTITION BY species ORDER BY trade_date) AS i, count(*) OVER (PARTITION BY species) AS n FROM d),
w AS (SELECT f.species, f.n, a, b, 1::BIGINT AS i, f.p AS level, s.p - f.p AS trend, 0.0::DOUBLE AS sse FROM y f JOIN y s ON s.species = f.species AND s.i = 2 CROSS JOIN (VALUES {_values(LEVELS)}) x(a) CROSS JOIN (VALUES {_values(TRENDS)}) z(b) WHERE f.i = 1 AND f.n >= 10
  UNION ALL SELECT species, n, a, b, i, up, b * (up - level) + (1 - b) * trend, sse + (p - level - trend) * (p - level - trend)
  FROM (SELECT w.species, w.n, a, b, y.i, y.p, level, trend, sse, a * y.p + (1 - a) * (level + trend) AS up FROM w JOIN y ON y.species = w.species AND y.i = w.i + 1) q),
e AS (SELECT *, sse / (n - 1) AS mse FROM w WHERE i = n)
SELECT e.species, e.n, e.a AS level_constant, e.b AS trend_constant, round(sqrt(e.mse), 4) AS rmse, round(sqrt(o.mse), 4) AS rmse_given, round(e.level + 7 * e.trend, 4) AS forecast FROM e JOIN e o ON o.species = e.species AND o.a = {GIVEN[0]} AND o.b = {GIVEN[1]}
QUALIFY row_number() OVER (PARTITION BY e.species ORDER BY round(e.mse, 4), e.a, e.b) = 1""",
    "ml_holt_winters_fitted": f"""WITH RECURSIVE d AS (SELECT species, trade_date, avg(price_avg) AS p FROM lots GROUP BY ALL), l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY species ORDER BY trade_date DESC) <= {LAST}),
y AS (SELECT species, p, row_number() OVER (PARTITION BY species ORDER BY trade_date) AS i, count(*) OVER (PARTITION BY species) AS n FROM l),
m AS (SELECT species, max(n) AS n, avg(p) FILTER (i <= 7) AS m, (avg(p) FILTER (i BETWEEN 8 AND 14) - avg(p) FILTER (i <= 7)) / 7 AS t, list(p ORDER BY i) FILTER (i <= 7) AS first FROM y GROUP BY species HAVING max(n) >= 21),
w AS (SELECT species, n, a, b, g, 7::BIGINT AS i, m AS level, t AS trend, list_transform(first, lambda v: v - m) AS s, 0.0::DOUBLE AS sse FROM m CROSS JOIN (VALUES {_values(LEVELS[::2])}) x(a) CROSS JOIN (VALUES {_values(TRENDS[::2])}) z(b) CROSS JOIN (VALUES {_values(SEASONS)}) u(g)
  UNION ALL SELECT species, n, a, b, g, i, up, b * (up - level) + (1 - b) * trend, list_append(s[2:], g * (p - up) + (1 - g) * s[1]), sse + (p - level - trend - s[1]) * (p - level - trend - s[1])
  FROM (SELECT w.species, w.n, a, b, g, y.i, y.p, level, trend, s, sse, a * (y.p - s[1]) + (1 - a) * (level + trend) AS up FROM w JOIN y ON y.species = w.species AND y.i = w.i + 1) q),
e AS (SELECT *, sse / (n - 7) AS mse FROM w WHERE i = n QUALIFY row_number() OVER (PARTITION BY species ORDER BY round(sse / (n - 7), 4), a, b, g) = 1),
f AS (SELECT species, a, b, g, h, level + h * trend + s[h] AS f, 1.28 * sqrt(mse) * sqrt(h) AS half FROM e CROSS JOIN generate_series(1, 7) t(h))
SELECT species, a, b, g, CAST(h AS INT) AS h, round(f, 4) AS forecast, round(f - half, 4) AS low, round(f + half, 4) AS high FROM f""",
}
ORACLES = {name: oracle(text) for name, text in SQL.items()}
