"""Serving queries with parameters and limits, projections of records, and joins of result sets, with the DataFrame API."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import cleaning
from tidemark.plans.dialect import oracle
from tidemark.plans.studies import daily, mode_of, scored_configs
from tidemark.sources import html, page_rows
from tidemark.sources.lots import star_lots

# What a request may ask for at most.
MAX_ROWS, MAX_DAYS, MAX_SPECIES, MIN_SEARCH, MAX_GROUPS = 100, 90, 50, 2, 10
UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}
#: Multipliers of the channels between the auction and the consumer, and grams of a serving.
CHANNELS, SERVING, YIELD = {"wholesale": 1.3, "market": 1.6, "restaurant": 2.2}, 250, 0.45


class RequestError(ValueError):
    """A request that can't be answered: its code, and what it may have meant."""

    def __init__(self, code: str, message: str, suggestions: list[str] | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.suggestions = code, suggestions or []


def checked(species: str | None, known: DataFrame) -> None:
    """The species must be known; else the three nearest names are suggested."""
    if species is None or not known.where(F.col("species") == species).isEmpty():
        return
    near = known.orderBy(F.levenshtein("species", F.lit(species)), "species").limit(3)
    raise RequestError("SPECIES_NOT_FOUND", species, [r["species"] for r in near.collect()])  # three rows


def clamped(start: str, end: str) -> tuple[Column, Column, bool]:
    """The range, cut to its most recent MAX_DAYS days, and whether it was cut."""
    from datetime import date

    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if a > b:
        raise RequestError("INVALID_RANGE", f"{start} to {end}")
    return F.greatest(F.lit(a), F.date_sub(F.lit(b), MAX_DAYS)), F.lit(b), (b - a).days > MAX_DAYS


def current_price(lots: DataFrame, species: str | None = None, origin: str | None = None, state: str | None = None, limit: int = 50) -> DataFrame:
    """Lots of the last day, with the class that the vocabulary gives each species."""
    last = lots.agg(F.max("trade_date").alias("trade_date"))
    rows = lots.join(F.broadcast(last), "trade_date", "left_semi")  # one row
    for name, value in (("species", species), ("origin", origin), ("state", state)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    vocabulary = lots.groupBy("species").agg(F.count("*").alias("species_lots"))
    order = ["species", "origin", "state", "price_avg", "quantity", "price_high"]
    return rows.join(vocabulary, "species", "left").orderBy(*order).limit(min(limit, MAX_ROWS)).select(*order, "species_lots")


def historical_price(lots: DataFrame, species: str, start: str, end: str, unit: str = "daily", origin: str | None = None) -> DataFrame:
    first, last, cut = clamped(start, end)
    rows = lots.where((F.col("species") == species) & F.col("trade_date").between(first, last))
    rows = rows if origin is None else rows.where(F.col("origin") == origin)
    period = F.to_date(F.date_trunc(UNITS[unit], "trade_date"))
    out = rows.groupBy(period.alias("period")).agg(F.round(F.avg("price_avg"), 6).alias("price"), F.min("price_low").alias("low"), F.max("price_high").alias("high"), F.sum("quantity").alias("qty"))
    return out.orderBy(F.desc("period")).limit(MAX_ROWS).withColumn("truncated", F.lit(cut))


def all_histories(lots: DataFrame) -> DataFrame:
    """Three requests in three units; the longest is cut to its last 90 days."""
    asked = [("Brand#11", "1996-01-01", "1996-12-31", "weekly"), ("Brand#12", "1995-05-01", "1995-06-15", "daily"), ("Brand#13", "1994-01-01", "1994-03-31", "monthly")]
    parts = [historical_price(lots, s, a, b, u).select(F.lit(s).alias("species"), F.lit(u).alias("unit"), "*") for s, a, b, u in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def trends(lots: DataFrame, days: int = 30) -> DataFrame:
    """First and last daily price of each species in the last days, beside the period of the same length before: change and label."""
    last = lots.agg(F.max("trade_date").alias("last"))
    rows = daily(lots).join(F.broadcast(last)).withColumn("back", F.datediff("last", "trade_date")).where(F.col("back") <= 2 * days)  # one row
    period = F.when(F.col("back") <= days, "current").otherwise("previous")
    ends = rows.groupBy("species", period.alias("period")).agg(F.min_by("p", "trade_date").alias("a"), F.max_by("p", "trade_date").alias("b"), F.avg("p").alias("mean"))
    change = (F.col("b") - F.col("a")) / F.col("a") * 100
    return ends.select("species", "period", F.round("mean", 4).alias("mean"), F.round(change, 4).alias("change_pct"), F.when(change > 5, "up").when(change < -5, "down").otherwise("stable").alias("trend"))


def listed(lots: DataFrame, category: str | None = None, search: str | None = None) -> DataFrame:
    """Species of a category (their dominant packaging) whose name holds the text, with statistics of their last 30 days."""
    if search is not None and len(search) < MIN_SEARCH:
        raise RequestError("SEARCH_TOO_SHORT", search)
    names = mode_of(lots, "packaging", "category")
    names = names if category is None else names.where(F.col("category") == category)
    names = names if search is None else names.where(F.contains("species", F.lit(search)))
    last = lots.agg(F.max("trade_date").alias("last"))
    recent = lots.join(F.broadcast(last)).where(F.datediff("last", "trade_date") <= 30).groupBy("species").agg(F.count("*").alias("n"), F.round(F.avg("price_avg"), 6).alias("mean"))  # one row
    return names.join(recent, "species", "left").fillna(0, ["n"]).orderBy("species").limit(MAX_SPECIES)


def resources(lots: DataFrame) -> DataFrame:
    """The three resources: species, the price of each on its last day, and the summary of the market's last day."""
    day = daily(lots)
    species = day.groupBy("species").agg(F.sum("n").alias("n"), F.max("trade_date").alias("day")).select(F.lit("species").alias("resource"), F.col("species").alias("key"), "n", F.lit(None).cast("double").alias("value"))
    price = day.groupBy("species").agg(F.max_by("n", "trade_date").alias("n"), F.max_by("p", "trade_date").alias("p"), F.max("trade_date").alias("d")).select(F.lit("price").alias("resource"), F.concat_ws("/", "species", F.col("d").cast("string")).alias("key"), "n", F.round("p", 6).alias("value"))
    summary = lots.groupBy("trade_date").agg(F.count("*").alias("n"), F.avg("price_avg").alias("p")).orderBy(F.desc("trade_date")).limit(1).select(F.lit("summary").alias("resource"), F.col("trade_date").cast("string").alias("key"), "n", F.round("p", 6).alias("value"))
    return species.unionByName(price).unionByName(summary)


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests get: rows, or an error's code and suggestions."""
    lots = star_lots(spark, sf_dir)
    known = lots.select("species").distinct()

    def ask(species: str | None, run: Callable[[], DataFrame]) -> tuple[str, int, str]:
        try:
            checked(species, known)
            return "OK", run().count(), ""
        except RequestError as e:
            return e.code, 0, ",".join(e.suggestions)

    asked = [
        ("current", None, lambda: current_price(lots, limit=1000)), ("current", "Brnd#11", lambda: current_price(lots, "Brnd#11")), ("history", "Brand#12", lambda: historical_price(lots, "Brand#12", "1996-02-01", "1996-01-01")),
        ("list", None, lambda: listed(lots, search="x")), ("list", None, lambda: listed(lots, search="Brand#2")),
    ]
    rows = [(i, name, *ask(species, run)) for i, (name, species, run) in enumerate(asked)]
    return spark.createDataFrame(rows, "request int, tool string, code string, n long, suggestions string")


def chain(lots: DataFrame, ratio: float = 42.0) -> DataFrame:
    """From the auction to the consumer: the price without the distribution's share, by channel, and of a serving, as whole numbers."""
    means = lots.groupBy("species").agg(F.avg("price_avg").alias("p"))
    whole = lambda c: c.cast("long")
    return means.select(
        "species", whole(F.col("p") / (1 - ratio / 100)).alias("consumer"), *[whole(F.col("p") * m).alias(name) for name, m in CHANNELS.items()],
        whole(F.col("p") / YIELD / 10).alias("per_100g"), whole(F.col("p") / YIELD / 1000 * SERVING).alias("serving"))


def dashboard(lots: DataFrame) -> DataFrame:
    """Figures of the pages on models and on data: tier, colour and size of each configuration's mark."""
    rows = scored_configs(lots)
    tier = F.when(F.col("mape") < 10, "A").when(F.col("mape") < 20, "B").when(F.col("mape") < 30, "C").otherwise("D")
    colour = F.when(F.col("mape") < 10, "green").when(F.col("mape") < 20, "blue").when(F.col("mape") < 30, "orange").otherwise("red")
    return rows.select("config", F.round("mape", 4).alias("mape"), tier.alias("tier"), colour.alias("colour"), F.greatest(F.lit(8.0), F.least(F.lit(40.0), F.col("n") / 500)).alias("marker"))


# Projections


def dirty(lots: DataFrame) -> DataFrame:
    """Lots as they may come: names to replace, padded specs, empty texts, averages and days that are missing or wrong."""
    at = F.dayofmonth("trade_date")
    return lots.select(
        F.when(at == 31, "2024.13.45").otherwise(F.date_format("trade_date", "yyyy.MM.dd")).alias("trade_date"), F.when(F.col("species") == "Brand#11", "쭈구미").otherwise(F.col("species")).alias("species"),
        F.when(F.col("state") == "A", "활").when(F.col("state") == "R", "냉건").otherwise("").alias("state"), F.when(at % 2 == 0, "").otherwise(F.col("origin")).alias("origin"),
        F.when(F.length("spec") == 2, F.concat(F.lit("0"), "spec")).otherwise(F.col("spec")).alias("spec"), "packaging", F.when(at == 13, -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity"), "price_high", "price_low",
        F.when(at % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("price_avg")).alias("price_avg"))


def records(lots: DataFrame) -> DataFrame:
    """Normalised records: seconds since 1970 (null for a day that is none), the state's English name, and the record as JSON."""
    rows = cleaning.normalised(dirty(lots))
    epoch = F.unix_timestamp(F.try_to_timestamp("trade_date", F.lit("yyyy.MM.dd")))
    english = F.when(F.col("state").isNotNull(), cleaning.mapped(F.col("state"), schemas.STATE_NAMES))
    body = F.to_json(F.struct("species", "spec", "price_avg"))
    made = rows.select("species", english.alias("state"), epoch.alias("epoch"), "origin", "price_avg", F.get_json_object(body, "$.spec").alias("spec"), F.get_json_object(body, "$.price_avg").cast("long").alias("json_price"))
    return made.groupBy("species", "state").agg(F.count("*").alias("n"), F.count("epoch").alias("dated"), F.sum("epoch").alias("seconds"), F.count("origin").alias("origins"), F.sum("json_price").alias("price"), F.count_if(F.col("spec").startswith("0")).alias("padded"))


def valid_batch(lots: DataFrame) -> DataFrame:
    """Only the valid rows of a batch, normalised, by species."""
    rows = cleaning.normalised(dirty(lots)).where(cleaning.is_valid())
    return rows.groupBy("species").agg(F.count("*").alias("n"), F.sum("price_avg").alias("price"))


def dominant_only(lots: DataFrame) -> DataFrame:
    """Lots of each species' most frequent state and packaging."""
    rows = lots.join(mode_of(lots, "packaging", "top_packaging"), "species").join(mode_of(lots, "state", "top_state"), "species").where("packaging = top_packaging and state = top_state")
    return rows.groupBy("species", "packaging", "state").agg(F.count("*").alias("n"), F.round(F.avg("price_avg"), 6).alias("mean"))


def shared_packaging(lots: DataFrame) -> DataFrame:
    """Configurations whose packaging "S/P" stands for any, where the dashboard reads it so and where it doesn't."""
    spark = lots.sparkSession
    configs = spark.createDataFrame([("all", "Brand#11", None, "S/P", None, False), ("one", "Brand#12", "A", "ECONOMY", None, False), ("none", "Brand#13", None, "none", None, False)], "config_id string, species string, state string, packaging string, spec string, domestic boolean")
    ways = [cleaning.for_configs(lots, F.broadcast(configs), shared).select(F.lit(shared).alias("shared"), "config_id", "price_avg") for shared in (True, False)]  # three rows
    return ways[0].unionByName(ways[1]).groupBy("shared", "config_id").agg(F.count("*").alias("n"), F.round(F.avg("price_avg"), 6).alias("mean"))


# Joins and sets


def merged_results(lots: DataFrame) -> DataFrame:
    """Two result sets joined by configuration, where the second writes its names in another way."""
    first = scored_configs(lots).select("config", F.round("mape", 4).alias("mape"))
    names = lots.select("species", "packaging").distinct().select(F.concat_ws("_", "species", "packaging").alias("config"), F.lower(F.concat_ws("-", "packaging", "species")).alias("other"))
    second = lots.where("year(trade_date) >= 1997").groupBy(F.lower(F.concat_ws("-", "packaging", "species")).alias("other")).agg(F.count("*").alias("recent"))
    return first.join(names, "config").join(second, "other", "left").select("config", "mape", F.coalesce("recent", F.lit(0)).alias("recent"))


def zipped(lots: DataFrame) -> DataFrame:
    """Two lists of each species, zipped by position: its packagings by name and its days with most lots."""
    a = lots.groupBy("species").agg(F.array_sort(F.collect_set("packaging")).alias("x")).select("species", F.posexplode("x").alias("place", "packaging"))
    b = lots.groupBy("species", F.year("trade_date").alias("year")).agg(F.count("*").alias("n"))
    b = b.withColumn("place", F.row_number().over(W.partitionBy("species").orderBy(F.desc("n"), "year")) - 1)
    return a.join(b, ["species", "place"]).select("species", "place", "packaging", "year", "n")


def strategies(lots: DataFrame) -> DataFrame:
    """One full and one inner join by every strategy that Spark can be asked for: all give the same."""
    day = daily(lots)
    a, b = day.where("year(trade_date) < 1996"), day.where("year(trade_date) > 1994").select("species", "trade_date", F.col("q").alias("q2"))
    out = []
    for hint in ("merge", "shuffle_hash", "broadcast", "shuffle_replicate_nl"):
        right = b if hint == "broadcast" else b.hint(hint)
        inner = a.join(F.broadcast(b.where("species < 'Brand#2'")) if hint == "broadcast" else right.where("species < 'Brand#2'"), ["species", "trade_date"])
        out.append(inner.agg(F.lit(f"inner {hint}").alias("strategy"), F.count("*").alias("n"), F.sum("q2").alias("qty")))
    for hint in ("merge", "shuffle_hash"):
        out.append(a.join(b.hint(hint), ["species", "trade_date"], "full").agg(F.lit(f"full {hint}").alias("strategy"), F.count("*").alias("n"), F.sum("q2").alias("qty")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def vocabulary_changes(lots: DataFrame) -> DataFrame:
    """Names that only the new vocabulary has, and those that only the old one has."""
    names = lambda rows: rows.select(F.concat_ws(" ", "species", "packaging", "state").alias("name")).distinct()
    old, new = names(lots.where("trade_date < '1993-06-01' and origin < 'NATION_2'")), names(lots.where("trade_date >= '1998-06-01' and origin < 'NATION_2'"))
    return new.subtract(old).select(F.lit("added").alias("change"), "name").unionByName(old.subtract(new).select(F.lit("removed").alias("change"), "name"))


# Extensions


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lots written as pages and read back by the table function: the ten columns of a lot, page after page of each day."""
    lots = star_lots(spark, sf_dir)
    shown = html.render_pages(lots.withColumns({"date": F.date_format("trade_date", "yyyy.MM.dd"), "line": F.pmod(F.xxhash64(*lots.columns), F.lit(1000))}))
    page_rows.register(spark)
    back = spark.sql("SELECT * FROM page_lots(TABLE({pages}) PARTITION BY date ORDER BY page)", pages=shown)
    few = spark.sql("SELECT species, price_avg FROM page_lots(TABLE({pages}) PARTITION BY date ORDER BY page, columns => 'price_avg,species')", pages=shown)
    of = few.groupBy("species").agg(F.sum("price_avg").alias("price_again"))
    return back.groupBy("species").agg(
        F.count("*").alias("n"), F.count("state").alias("stated"), F.count_distinct("origin").alias("origins"), F.count_distinct("spec").alias("specs"), F.count_distinct("packaging").alias("packagings"), F.round(F.sum("quantity"), 2).alias("quantity"),
        F.sum("price_high").alias("high"), F.sum("price_low").alias("low"), F.sum("price_avg").alias("price"), F.min("trade_date").alias("first")).join(of, "species")


#: Losses and models by name; more can be added under new names.
LOSSES: dict[str, Callable[[Column, Column], Column]] = {
    "mae": lambda f, y: F.abs(f - y), "mse": lambda f, y: (f - y) * (f - y), "huber": lambda f, y: F.when(F.abs(f - y) <= 1, 0.5 * (f - y) * (f - y)).otherwise(F.abs(f - y) - 0.5),
}
MODELS: dict[str, Callable[[], Column]] = {
    "last": lambda: F.lag("p").over(W.partitionBy("species").orderBy("trade_date")),
    "mean7": lambda: F.avg("p").over(W.partitionBy("species").orderBy("trade_date").rowsBetween(-7, -1)),
}


def backtest(days: DataFrame, model: str | Callable[[], Column], loss: str | Callable[[Column, Column], Column]) -> DataFrame:
    """The mean loss of a forecast of the day's price by species; model and loss by name, or given as functions."""
    forecast = MODELS[model] if isinstance(model, str) else model
    of = LOSSES[loss] if isinstance(loss, str) else loss
    rows = days.select("species", (F.col("p") / 1000).alias("y"), (forecast() / 1000).alias("f")).where("f is not null")
    return rows.groupBy("species").agg(F.round(F.avg(of(F.col("f"), F.col("y"))), 6).alias("loss"))


def registry(lots: DataFrame) -> DataFrame:
    days = daily(lots)
    half = lambda: MODELS["last"]() * 0.5 + MODELS["mean7"]() * 0.5
    parts = [backtest(days, m, l).select(F.lit(name).alias("model"), F.lit(l).alias("loss_name"), "species", "loss") for name, m, l in (("last", "last", "mae"), ("mean7", "mean7", "huber"), ("half", half, "mse"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of a run as an observation beside its result, without a second pass."""
    from pyspark.sql import Observation

    seen = Observation("progress")
    lots = star_lots(spark, sf_dir).observe(seen, F.count("*").alias("rows_"), F.count_if(F.col("state").isNull()).alias("stateless"))
    days = lots.groupBy("trade_date").agg(F.count("*").alias("n")).agg(F.count("*").alias("days")).first()["days"]
    return spark.createDataFrame([(seen.get["rows_"], seen.get["stateless"], days)], "rows_ long, stateless long, days long")


_ON_LOTS = {
    "tl_current": current_price, "tl_histories": all_histories, "tl_trends": trends, "tl_listed": lambda lots: listed(lots, search="Brand#"), "tl_resources": resources, "tl_chain": chain, "tl_dashboard": dashboard,
    "prj_records": records, "prj_valid_batch": valid_batch, "prj_dominant": dominant_only, "prj_shared_packaging": shared_packaging, "jn_merged_results": merged_results, "jn_zipped": zipped, "jn_strategies": strategies,
    "set_vocabulary": vocabulary_changes, "udf_registry": registry,
}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(star_lots(spark, sf_dir))) for name, f in _ON_LOTS.items()} | {"tl_errors": answered, "udf_table_function": table_function, "udf_observed": observed}

_CFG = "cfg AS (SELECT species || '_' || packaging AS config, lower(packaging || '-' || species) AS other, 100 * stddev_pop(price_avg) / avg(price_avg) AS m, count(*) AS n, count(*) FILTER (year(trade_date) >= 1997) AS recent FROM lots GROUP BY species, packaging)"
_DIRTY = """dirt AS (SELECT trade_date, day(trade_date) AS dd, CASE species WHEN 'Brand#11' THEN '쭈꾸미' ELSE species END AS species, CASE state WHEN 'A' THEN 'live' WHEN 'R' THEN 'frozen_dried' END AS state, CASE WHEN day(trade_date) % 2 <> 0 THEN origin END AS origin,
  quantity * CASE WHEN day(trade_date) = 13 THEN -1 ELSE 1 END AS quantity, price_high, price_low, CASE WHEN day(trade_date) % 5 <> 0 THEN price_avg WHEN price_high > 0 AND price_low > 0 THEN (price_high + price_low) // 2 ELSE 0 END AS price_avg FROM lots)"""
_HIST = "SELECT * FROM (SELECT '{0}' AS species, '{3}' AS unit, CAST(date_trunc('{4}', trade_date) AS DATE) AS period, round(avg(price_avg), 6) AS price, min(price_low) AS low, max(price_high) AS high, sum(quantity) AS qty, {5} AS truncated FROM lots WHERE species = '{0}' AND trade_date BETWEEN greatest(DATE '{1}', DATE '{2}' - 90) AND DATE '{2}' GROUP BY ALL ORDER BY period DESC LIMIT 100)"
SQL = {
    "tl_current": "SELECT species, origin, state, price_avg, quantity, price_high, (SELECT count(*) FROM lots v WHERE v.species = l.species) AS species_lots FROM lots l WHERE trade_date = (SELECT max(trade_date) FROM lots) ORDER BY species, origin, state NULLS FIRST, price_avg, quantity, price_high LIMIT 50",
    "tl_histories": " UNION ALL ".join(_HIST.format(*x) for x in (("Brand#11", "1996-01-01", "1996-12-31", "weekly", "week", "TRUE"), ("Brand#12", "1995-05-01", "1995-06-15", "daily", "day", "FALSE"), ("Brand#13", "1994-01-01", "1994-03-31", "monthly", "month", "FALSE"))),
    "tl_trends": """WITH d AS (SELECT species, trade_date, avg(price_avg) AS p, CAST((SELECT max(trade_date) FROM lots) - trade_date AS INT) AS back FROM lots GROUP BY ALL), e AS (SELECT species, CASE WHEN back <= 30 THEN 'current' ELSE 'previous' END AS period, arg_min(p, trade_date) AS a, arg_max(p, trade_date) AS b, avg(p) AS m FROM d WHERE back <= 60 GROUP BY ALL)
SELECT species, period, round(m, 4) AS mean, round((b - a) / a * 100, 4) AS change_pct, CASE WHEN (b - a) / a * 100 > 5 THEN 'up' WHEN (b - a) / a * 100 < -5 THEN 'down' ELSE 'stable' END AS trend FROM e""",
    "tl_listed": """WITH m AS (SELECT species, packaging AS category, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, packaging) AS r FROM lots GROUP BY species, packaging), s AS (SELECT species, count(*) AS n, round(avg(price_avg), 6) AS mean FROM lots WHERE trade_date >= (SELECT max(trade_date) FROM lots) - 30 GROUP BY species)
SELECT m.species, category, coalesce(n, 0) AS n, mean FROM m LEFT JOIN s ON s.species = m.species WHERE r = 1 ORDER BY m.species LIMIT 50""",
    "tl_resources": """WITH d AS (SELECT species, trade_date, avg(price_avg) AS p, count(*) AS n FROM lots GROUP BY ALL) SELECT 'species' AS resource, species AS key, CAST(sum(n) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS value FROM d GROUP BY species
UNION ALL SELECT 'price', species || '/' || max(trade_date), arg_max(n, trade_date), round(arg_max(p, trade_date), 6) FROM d GROUP BY species UNION ALL SELECT 'summary', CAST(max(trade_date) AS VARCHAR), count(*), round(avg(price_avg), 6) FROM lots WHERE trade_date = (SELECT max(trade_date) FROM lots)""",
    "tl_chain": "SELECT species, CAST(trunc(p / 0.58) AS BIGINT) AS consumer, CAST(trunc(p * 1.3) AS BIGINT) AS wholesale, CAST(trunc(p * 1.6) AS BIGINT) AS market, CAST(trunc(p * 2.2) AS BIGINT) AS restaurant, CAST(trunc(p / 0.45 / 10) AS BIGINT) AS per_100g, CAST(trunc(p / 0.45 / 1000 * 250) AS BIGINT) AS serving FROM (SELECT species, avg(price_avg) AS p FROM lots GROUP BY species)",
    "tl_dashboard": f"WITH {_CFG} SELECT config, round(m, 4) AS mape, CASE WHEN m < 10 THEN 'A' WHEN m < 20 THEN 'B' WHEN m < 30 THEN 'C' ELSE 'D' END AS tier, CASE WHEN m < 10 THEN 'green' WHEN m < 20 THEN 'blue' WHEN m < 30 THEN 'orange' ELSE 'red' END AS colour, greatest(8.0, least(40.0, n / 500)) AS marker FROM cfg",
    "prj_records": f"""WITH {_DIRTY} SELECT species, state, count(*) AS n, count(*) FILTER (dd <> 31) AS dated, CAST(sum(epoch(trade_date)) FILTER (dd <> 31) AS BIGINT) AS seconds, count(origin) AS origins, CAST(sum(price_avg) AS BIGINT) AS price, CAST(0 AS BIGINT) AS padded FROM dirt GROUP BY species, state""",
    "prj_valid_batch": f"WITH {_DIRTY} SELECT species, count(*) AS n, CAST(sum(price_avg) AS BIGINT) AS price FROM dirt WHERE quantity >= 0 AND price_high >= price_low AND (price_avg <= 0 OR price_avg BETWEEN price_low * 0.99 AND price_high * 1.01) GROUP BY species",
    "prj_dominant": """WITH p AS (SELECT species, packaging FROM (SELECT species, packaging, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, packaging) AS r FROM lots GROUP BY species, packaging) WHERE r = 1), s AS (SELECT species, state FROM (SELECT species, state, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, state) AS r FROM lots WHERE state IS NOT NULL GROUP BY species, state) WHERE r = 1)
SELECT species, packaging, state, count(*) AS n, round(avg(price_avg), 6) AS mean FROM lots JOIN p USING (species, packaging) JOIN s USING (species, state) GROUP BY ALL""",
    "prj_shared_packaging": "SELECT TRUE AS shared, 'all' AS config_id, count(*) AS n, round(avg(price_avg), 6) AS mean FROM lots WHERE species = 'Brand#11' HAVING count(*) > 0 UNION ALL SELECT v.s, 'one', count(*), round(avg(price_avg), 6) FROM lots CROSS JOIN (VALUES (TRUE), (FALSE)) v(s) WHERE species = 'Brand#12' AND state = 'A' AND packaging = 'ECONOMY' GROUP BY v.s",
    "jn_merged_results": f"WITH {_CFG} SELECT config, round(m, 4) AS mape, recent FROM cfg",
    "jn_zipped": """WITH a AS (SELECT species, packaging, row_number() OVER (PARTITION BY species ORDER BY packaging) - 1 AS place FROM (SELECT DISTINCT species, packaging FROM lots)), b AS (SELECT species, year(trade_date) AS year, count(*) AS n, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, year(trade_date)) - 1 AS place FROM lots GROUP BY 1, 2)
SELECT species, place, packaging, year, n FROM a JOIN b USING (species, place)""",
    "jn_strategies": """WITH d AS (SELECT species, trade_date, sum(quantity) AS q FROM lots GROUP BY ALL), a AS (SELECT * FROM d WHERE year(trade_date) < 1996), b AS (SELECT * FROM d WHERE year(trade_date) > 1994), i AS (SELECT count(*) AS n, sum(b.q) AS qty FROM a JOIN b USING (species, trade_date) WHERE species < 'Brand#2'), f AS (SELECT count(*) AS n, sum(b.q) AS qty FROM a FULL JOIN b USING (species, trade_date))
SELECT 'inner ' || h AS strategy, n, qty FROM i CROSS JOIN (VALUES ('merge'), ('shuffle_hash'), ('broadcast'), ('shuffle_replicate_nl')) v(h) UNION ALL SELECT 'full ' || h, n, qty FROM f CROSS JOIN (VALUES ('merge'), ('shuffle_hash')) v(h)""",
    "set_vocabulary": """WITH o AS (SELECT DISTINCT concat_ws(' ', species, packaging, state) AS name FROM lots WHERE trade_date < DATE '1993-06-01' AND origin < 'NATION_2'), n AS (SELECT DISTINCT concat_ws(' ', species, packaging, state) AS name FROM lots WHERE trade_date >= DATE '1998-06-01' AND origin < 'NATION_2')
SELECT 'added' AS change, name FROM n WHERE name NOT IN (SELECT name FROM o) UNION ALL SELECT 'removed', name FROM o WHERE name NOT IN (SELECT name FROM n)""",
    "udf_registry": """WITH d AS (SELECT species, trade_date, avg(price_avg) / 1000 AS y FROM lots GROUP BY ALL), f AS (SELECT species, y, lag(y) OVER w AS l, avg(y) OVER (PARTITION BY species ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM d WINDOW w AS (PARTITION BY species ORDER BY trade_date))
SELECT 'last' AS model, 'mae' AS loss_name, species, round(avg(abs(l - y)), 6) AS loss FROM f WHERE l IS NOT NULL GROUP BY species UNION ALL SELECT 'mean7', 'huber', species, round(avg(CASE WHEN abs(m - y) <= 1 THEN (m - y) * (m - y) / 2 ELSE abs(m - y) - 0.5 END), 6) FROM f WHERE m IS NOT NULL GROUP BY species
UNION ALL SELECT 'half', 'mse', species, round(avg(power((l + m) / 2 - y, 2)), 6) FROM f WHERE l IS NOT NULL GROUP BY species""",
    "tl_errors": """SELECT * FROM (SELECT 0 AS request, 'current' AS tool, 'OK' AS code, least(100, count(*)) AS n, '' AS suggestions FROM lots WHERE trade_date = (SELECT max(trade_date) FROM lots)) UNION ALL SELECT 1, 'current', 'SPECIES_NOT_FOUND', 0, (SELECT string_agg(species, ',' ORDER BY dist, species) FROM (SELECT species, levenshtein(species, 'Brnd#11') AS dist FROM (SELECT DISTINCT species FROM lots) ORDER BY dist, species LIMIT 3))
UNION ALL SELECT 2, 'history', 'INVALID_RANGE', 0, '' UNION ALL SELECT 3, 'list', 'SEARCH_TOO_SHORT', 0, '' UNION ALL SELECT 4, 'list', 'OK', count(DISTINCT species), '' FROM lots WHERE species LIKE '%Brand#2%'""",
    "udf_table_function": "SELECT species, count(*) AS n, count(state) AS stated, count(DISTINCT origin) AS origins, count(DISTINCT spec) AS specs, count(DISTINCT packaging) AS packagings, round(sum(quantity), 2) AS quantity, CAST(sum(price_high) AS BIGINT) AS high, CAST(sum(price_low) AS BIGINT) AS low, CAST(sum(price_avg) AS BIGINT) AS price, strftime(min(trade_date), '%Y.%m.%d') AS first, CAST(sum(price_avg) AS BIGINT) AS price_again FROM lots GROUP BY species",
    "udf_observed": "SELECT count(*) AS rows_, count(*) FILTER (state IS NULL) AS stateless, count(DISTINCT trade_date) AS days FROM lots",
}
ORACLES = {name: oracle(text) for name, text in SQL.items()}
