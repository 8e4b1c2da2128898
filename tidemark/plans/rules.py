"""Studies whose rule has several parts: packaging pairs with halves, viability with domestic shares, conformal bands that may be none, filled weather, stored sketches, a row store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import cleaning
from tidemark.plans.dialect import oracle
from tidemark.plans.models import forecasts
from tidemark.plans.studies import ORIGINS, sourced
from tidemark.sources import row_store, side_tables
from tidemark.sources.lots import star_lots
from tidemark.streaming.streams import shared_dir

#: A packaging's least number of days, common days of two, and how far the halves' correlations may be apart.
DAYS, COMMON, APART = 100, 30, 0.15
PORTS = ("busan", "yeosu", "sokcho")


def packaging_pairs(lots: DataFrame) -> DataFrame:
    """The two packagings of a species with most days: correlations on common days, price ratio, both halves' correlations and whether they agree."""
    mean = F.sum(F.col("price_avg") * F.col("quantity")) / F.nullif(F.sum("quantity"), F.lit(0.0))
    day = lots.where("packaging <> ''").groupBy("species", "packaging", "trade_date").agg(F.avg("price_avg").alias("s"), mean.alias("w"))
    rank = F.row_number().over(W.partitionBy("species").orderBy(F.desc("days"), "packaging"))
    top = day.groupBy("species", "packaging").agg(F.count("*").alias("days")).where(F.col("days") >= DAYS).withColumn("rank", rank)
    of = lambda k: day.join(top.where(F.col("rank") == k).select("species", "packaging"), ["species", "packaging"]).select("species", "trade_date", F.col("packaging").alias(f"p{k}"), F.col("s").alias(f"s{k}"), F.col("w").alias(f"w{k}"))
    both = of(1).join(of(2), ["species", "trade_date"])
    both = both.withColumns({"i": F.row_number().over(W.partitionBy("species").orderBy("trade_date")), "n": F.count("*").over(W.partitionBy("species"))}).where(F.col("n") >= COMMON)
    half = lambda c: F.corr(F.when(c, F.col("w1")), F.when(c, F.col("w2")))
    early = F.col("i") <= F.floor(F.col("n") / 2)
    out = both.groupBy("species", F.col("p1").alias("first"), F.col("p2").alias("second")).agg(
        F.count("*").alias("days"), F.corr("w1", "w2").alias("corr_weighted"), F.corr("s1", "s2").alias("corr_simple"),
        (F.greatest(F.avg("w1"), F.avg("w2")) / F.nullif(F.least(F.avg("w1"), F.avg("w2")), F.lit(0.0))).alias("ratio"), half(early).alias("early"), half(~early).alias("late"))
    verdict = F.when((F.col("corr_weighted") > 0.85) & (F.col("ratio") < 1.5), "blend").when(F.col("corr_weighted") > 0.85, "dominant").otherwise("separate")
    rounded = [F.round(c, 6).alias(c) for c in ("corr_weighted", "corr_simple", "early", "late")]
    return out.select("species", "first", "second", "days", *rounded, F.round(F.coalesce("ratio", F.lit(0.0)), 4).alias("ratio"), (F.abs(F.col("early") - F.col("late")) <= APART).alias("stable"), verdict.alias("verdict"))


def config_viability(lots: DataFrame) -> DataFrame:
    """Each configuration's days, lots, grade and domestic share: 100 % needs no filter, 80 % may do without, 50 % should be split, less needs a model of its own."""
    g = sourced(lots).groupBy("species", "state", "packaging", "spec").agg(
        F.count_distinct("trade_date").alias("days"), F.count("*").alias("n"), F.count_if(~cleaning.is_foreign(F.col("origin"))).alias("own"))
    each, share = F.col("n") / F.col("days"), F.col("own") / F.col("n")
    grade = F.when((F.col("days") >= 1000) & (each >= 2), "A").when((F.col("days") >= 500) & (each >= 1.5), "B").when((F.col("days") >= 300) & (each >= 1), "C").otherwise("D")
    band = F.when(F.col("own") == F.col("n"), "no filter").when(share >= 0.8, "whole").when(share >= 0.5, "split").otherwise("own model")
    return g.select("species", "state", "packaging", "spec", "days", "n", F.round(each, 4).alias("lots_per_day"), ((F.col("days") >= 300) & (F.col("n") >= 500) & (each >= 1)).alias("viable"), grade.alias("grade"), F.round(share, 4).alias("domestic_share"), band.alias("band"))


def config_series(lots: DataFrame) -> DataFrame:
    """The dashboard's daily series: of each species its commonest configuration (state, packaging, spec), once with its packaging and all
    origins, once with any packaging ("S/P") and domestic origins only: mean price, highest and lowest, quantity and lots."""
    known = sourced(lots).where("state is not null and spec is not null and packaging <> ''")
    rank = F.row_number().over(W.partitionBy("species").orderBy(F.desc("n"), "state", "packaging", "spec"))
    top = known.groupBy("species", "state", "packaging", "spec").agg(F.count("*").alias("n")).withColumn("r", rank).where("r = 1")
    ways = F.array(F.struct(F.lit("own").alias("way"), F.lit(False).alias("domestic")), F.struct(F.lit("shared").alias("way"), F.lit(True).alias("domestic")))
    configs = top.select("species", "state", "spec", "packaging", F.inline(ways)).select(
        F.concat_ws("/", "species", "way").alias("config_id"), "species", "state", F.when(F.col("domestic"), "S/P").otherwise(F.col("packaging")).alias("packaging"), "spec", "domestic")
    rows = cleaning.for_configs(known, configs, shared_packaging=True)
    return rows.groupBy("config_id", "trade_date").agg(
        F.round(F.avg("price_avg"), 6).alias("price"), F.max("price_high").alias("high"), F.min("price_low").alias("low"), F.sum("quantity").alias("quantity"), F.count("price_avg").alias("lots"))


def conformal_first(lots: DataFrame) -> DataFrame:
    """Bands widened by the scores of the first 80 % of the days, judged on the rest; with fewer than ten days to learn from there is no widening and no coverage."""
    rows = forecasts(lots).where("a is not null and i >= 30").withColumns({"lo": F.col("prior7") - F.col("sd"), "hi": F.col("prior7") + F.col("sd")})
    own = W.partitionBy("species")
    rows = rows.withColumns({"k": F.row_number().over(own.orderBy("i")), "cal": F.floor(0.8 * F.count("*").over(own)), "score": F.greatest(F.col("lo") - F.col("a"), F.col("a") - F.col("hi"))})
    learnt = rows.where("k <= cal").groupBy("species").agg(F.percentile("score", 0.9).alias("q"))
    late = rows.where("k > cal").join(learnt, "species", "left")
    q = F.when(F.col("cal") >= 10, F.col("q"))
    inside = F.when(F.col("cal") >= 10, F.col("a").between(F.col("lo") - q, F.col("hi") + q).cast("double")).otherwise(0.0)
    return late.groupBy("species").agg(F.round(F.max(q), 4).alias("qhat"), F.round(F.avg(inside), 6).alias("held_out_coverage"), F.round(F.coalesce(F.avg(F.col("hi") - F.col("lo") + 2 * q), F.lit(0.0)), 4).alias("width"), F.max("cal").alias("calibrated"))


def weather_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each port's weather on all days of its lots, left-joined: gaps take the last known value, days before the first one the column's mean, a column without values 0."""
    lots = star_lots(spark, sf_dir)
    days = lots.select("trade_date").distinct().select(F.explode(F.array(*map(F.lit, PORTS))).alias("location"), F.col("trade_date").alias("date"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    ports = F.explode(F.array(*[F.struct(F.lit(p).alias("location"), F.lit(k).alias("k")) for k, p in enumerate(PORTS)])).alias("x")
    known = orders.where("n % 3 = 0 and month(date) > 2").select("date", "n", ports).select("date", F.col("x.location").alias("location"), (F.col("n") * (F.col("x.k") + 1)).cast("double").alias("temperature"), F.when(F.col("n") % 2 == 0, F.col("n") * 0.5).alias("wind"), F.lit(None).cast("double").alias("pressure"))
    rows = side_tables.filled(days.join(known, ["location", "date"], "left"), ["temperature", "wind", "pressure"])
    return rows.select("location", "date", *[F.round(c, 6).alias(c) for c in ("temperature", "wind", "pressure")])


def stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each species and day kept as binary columns; months and years follow by merging them, without the lots.

    Beside the merged estimates of distinct origins with specs and of the median price stand the exact ones and the errors
    (of the median: in ranks).
    """
    lots = star_lots(spark, sf_dir).withColumn("item", F.concat_ws("|", "origin", "spec"))
    path = f"{shared_dir(spark)}/tidemark-sketches-{uuid.uuid4().hex}"
    day = lots.groupBy("species", "trade_date").agg(F.hll_sketch_agg("item", 12).alias("items"), F.expr("kll_sketch_agg_bigint(price_avg, 200)").alias("prices"), F.count("*").alias("n"))
    day.write.mode("overwrite").parquet(path)
    kept = spark.read.parquet(path)
    month, year = F.trunc("trade_date", "month"), F.trunc("trade_date", "year")
    out = []
    for name, start in (("month", month), ("year", year)):
        merged = kept.groupBy("species", start.alias("start")).agg(F.hll_union_agg("items").alias("items"), F.expr("kll_merge_agg_bigint(prices)").alias("prices"), F.sum("n").alias("n"))
        merged = merged.select("species", "start", "n", F.hll_sketch_estimate("items").alias("distinct_about"), F.expr("kll_sketch_get_quantile_bigint(prices, 0.5D)").alias("median_about"))
        exact = lots.withColumn("start", start).join(merged.select("species", "start", "median_about"), ["species", "start"]).groupBy("species", "start").agg(
            F.count_distinct("item").alias("distinct"), F.expr("percentile_disc(0.5) within group (order by price_avg)").cast("long").alias("median"), F.avg((F.col("price_avg") < F.col("median_about")).cast("int")).alias("below"), F.avg((F.col("price_avg") <= F.col("median_about")).cast("int")).alias("upto"))
        rank_error = F.greatest(F.col("below") - 0.5, 0.5 - F.col("upto"), F.lit(0.0))
        out.append(merged.join(exact, ["species", "start"]).select(F.lit(name).alias("span"), "species", "start", "n", "distinct", "distinct_about", F.round(F.abs(F.col("distinct_about") - F.col("distinct")) / F.col("distinct"), 6).alias("distinct_error"), "median", "median_about", F.round(rank_error, 6).alias("rank_error")))
    return out[0].unionByName(out[1])


def from_row_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star tables copied to a row store and read back in ranges of the order key, with the filters pushed down."""
    url = f"jdbc:derby:memory:tidemark-{uuid.uuid4().hex};create=true"
    row_store.copy_star(spark, sf_dir, url)
    rows = row_store.joined(spark, url).where("quantity >= 10")
    return rows.groupBy("species", F.year("trade_date").alias("year")).agg(F.count("*").alias("n"), F.sum("price_avg").alias("price"), F.count_distinct("origin").alias("origins"))


FRAMES = {"agg_packaging_pairs": packaging_pairs, "agg_config_viability": config_viability, "agg_config_series": config_series, "ev_cqr_first": conformal_first}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(star_lots(spark, sf_dir))) for name, f in FRAMES.items()} | {"jn_weather_fill": weather_filled, "agg_stored_sketches": stored_sketches, "src_row_store": from_row_store}

_FOREIGN = ", ".join(f"'{nation}'" for nation in ORIGINS)
SQL = {
    "agg_packaging_pairs": f"""WITH d AS (SELECT species, packaging, trade_date, avg(price_avg) AS s, sum(price_avg * quantity) / nullif(sum(quantity), 0) AS w FROM lots WHERE packaging <> '' GROUP BY ALL),
k AS (SELECT species, packaging, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, packaging) AS r FROM d GROUP BY species, packaging HAVING count(*) >= {DAYS}),
c AS (SELECT a.species, a.packaging AS first, b.packaging AS second, a.w AS x, b.w AS y, a.s AS sx, b.s AS sy, ntile(2) OVER (PARTITION BY a.species ORDER BY a.trade_date DESC) AS part, count(*) OVER (PARTITION BY a.species) AS n
  FROM d a JOIN k ka ON ka.species = a.species AND ka.packaging = a.packaging AND ka.r = 1 JOIN k kb ON kb.species = a.species AND kb.r = 2 JOIN d b ON b.species = a.species AND b.packaging = kb.packaging AND b.trade_date = a.trade_date),
e AS (SELECT species, first, second, count(*) AS days, corr(x, y) AS cw, corr(sx, sy) AS cs, greatest(avg(x), avg(y)) / nullif(least(avg(x), avg(y)), 0) AS ratio, corr(x, y) FILTER (part = 2) AS early, corr(x, y) FILTER (part = 1) AS late FROM c WHERE n >= {COMMON} GROUP BY ALL)
SELECT species, first, second, days, round(cw, 6) AS corr_weighted, round(cs, 6) AS corr_simple, round(early, 6) AS early, round(late, 6) AS late, round(coalesce(ratio, 0), 4) AS ratio, abs(early - late) <= {APART} AS stable,
  CASE WHEN cw <= 0.85 THEN 'separate' WHEN ratio < 1.5 THEN 'blend' ELSE 'dominant' END AS verdict FROM e""",
    "agg_config_viability": f"""WITH s AS (SELECT species, state, packaging, nullif(CASE spec WHEN '1미' THEN '특대' WHEN '2미' THEN '10/11미' WHEN '3미' THEN '300/400' WHEN '4미' THEN '바라' ELSE spec END, '5미') AS spec, trade_date, origin IN ({_FOREIGN}) AS abroad FROM lots),
g AS (SELECT species, state, packaging, spec, count(DISTINCT trade_date) AS days, count(*) AS n, count(*) FILTER (NOT abroad) AS own FROM s GROUP BY ALL)
SELECT species, state, packaging, spec, days, n, round(n / days, 4) AS lots_per_day, days >= 300 AND n >= 500 AND n >= days AS viable, CASE WHEN days >= 1000 AND n >= 2 * days THEN 'A' WHEN days >= 500 AND 2 * n >= 3 * days THEN 'B' WHEN days >= 300 AND n >= days THEN 'C' ELSE 'D' END AS grade,
  round(own / n, 4) AS domestic_share, CASE WHEN own = n THEN 'no filter' WHEN 10 * own >= 8 * n THEN 'whole' WHEN 2 * own >= n THEN 'split' ELSE 'own model' END AS band FROM g""",
    "agg_config_series": f"""WITH s AS (SELECT species, state, packaging, nullif(CASE spec WHEN '1미' THEN '특대' WHEN '2미' THEN '10/11미' WHEN '3미' THEN '300/400' WHEN '4미' THEN '바라' ELSE spec END, '5미') AS spec, trade_date, origin IN ({_FOREIGN}) AS abroad, price_avg, price_high, price_low, quantity FROM lots),
k AS (SELECT * FROM s WHERE state IS NOT NULL AND spec IS NOT NULL AND packaging <> ''), t AS (SELECT species, state, packaging, spec FROM k GROUP BY species, state, packaging, spec QUALIFY row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, state, packaging, spec) = 1)
SELECT k.species || '/' || w AS config_id, trade_date, round(avg(price_avg), 6) AS price, max(price_high) AS high, min(price_low) AS low, sum(quantity) AS quantity, count(*) AS lots
FROM k JOIN t ON k.species = t.species AND k.state = t.state AND k.spec = t.spec JOIN (VALUES ('own'), ('shared')) v(w) ON CASE w WHEN 'own' THEN k.packaging = t.packaging ELSE NOT abroad END GROUP BY ALL""",
    "ev_cqr_first": """WITH d AS (SELECT species, trade_date, avg(price_avg) AS p FROM lots GROUP BY ALL), f AS (SELECT species, row_number() OVER w - 1 AS i, lead(p, 7) OVER w AS a, avg(p) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m, stddev_pop(p) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS sd FROM d WINDOW w AS (PARTITION BY species ORDER BY trade_date)),
b AS (SELECT species, a, m - sd AS lo, m + sd AS hi, row_number() OVER (PARTITION BY species ORDER BY i) AS k, CAST(floor(0.8 * count(*) OVER (PARTITION BY species)) AS BIGINT) AS cal FROM f WHERE a IS NOT NULL AND i >= 30),
q AS (SELECT species, quantile_cont(greatest(lo - a, a - hi), 0.9) AS q FROM b WHERE k <= cal AND cal >= 10 GROUP BY species)
SELECT b.species, round(any_value(q), 4) AS qhat, round(avg(CASE WHEN q IS NULL THEN 0 WHEN a >= lo - q AND a <= hi + q THEN 1 ELSE 0 END), 6) AS held_out_coverage, round(coalesce(avg(hi - lo + 2 * q), 0), 4) AS width, max(cal) AS calibrated FROM b LEFT JOIN q ON q.species = b.species WHERE k > cal GROUP BY b.species""",
    "jn_weather_fill": """WITH days AS (SELECT DISTINCT trade_date AS date FROM lots), o AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1),
k AS (SELECT location, date, CAST(n * f AS DOUBLE) AS t, CASE WHEN n % 2 = 0 THEN n * 0.5 END AS w FROM o CROSS JOIN (VALUES ('busan', 1), ('yeosu', 2), ('sokcho', 3)) p(location, f) WHERE n % 3 = 0 AND month(date) > 2),
j AS (SELECT p.location, d.date, t, w FROM days d CROSS JOIN (VALUES ('busan'), ('yeosu'), ('sokcho')) p(location) LEFT JOIN k ON k.location = p.location AND k.date = d.date)
SELECT location, date, round(coalesce(last_value(t IGNORE NULLS) OVER s, avg(t) OVER (), 0), 6) AS temperature, round(coalesce(last_value(w IGNORE NULLS) OVER s, avg(w) OVER (), 0), 6) AS wind, 0.0::DOUBLE AS pressure FROM j WINDOW s AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "src_row_store": "SELECT species, CAST(year(trade_date) AS INT) AS year, count(*) AS n, CAST(sum(price_avg) AS BIGINT) AS price, count(DISTINCT origin) AS origins FROM lots WHERE quantity >= 10 GROUP BY ALL",
}
ORACLES = {name: oracle(text) for name, text in SQL.items()}
