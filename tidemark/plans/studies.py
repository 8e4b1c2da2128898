"""Aggregation studies with the DataFrame API; their SQL is written apart, from the surveyed rule.

The star schema has less than one lot a species, day, state, packaging and spec, so the studies that compare lots of
one such group run over lots whose days are binned to quarters (`quarters`); every lot counts. Studies that leave out
the 30 largest species run over species by packaging (`fine`), as there are only 25 species.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import cleaning
from tidemark.sources.lots import star_lots
from tidemark.sources.staging import staged

#: Specs and origins of the lots as the source writes them, in place of some of the star schema's.
SPECS = {"1미": "특대", "2미": "10/11미", "3미": "300/400", "4미": "바라"}
ORIGINS = {"NATION_3": "일본", "NATION_5": "중국(수입)", "NATION_7": "동해(원양)", "NATION_9": "러시아산"}


def quarters(lots: DataFrame) -> DataFrame:
    return lots.withColumn("trade_date", F.trunc("trade_date", "quarter"))


def fine(lots: DataFrame) -> DataFrame:
    return lots.withColumn("species", F.concat_ws(" ", "species", "packaging"))


def sourced(lots: DataFrame) -> DataFrame:
    """Lots with some of the source's own specs and origins; the spec "5미" is none."""
    spec = F.when(F.col("spec") != "5미", cleaning.mapped(F.col("spec"), SPECS))
    return lots.withColumns({"spec": spec, "origin": cleaning.mapped(F.col("origin"), ORIGINS)})


def cv(c: Column | str) -> Column:
    return F.stddev_pop(c) / F.nullif(F.avg(c), F.lit(0.0))


def share_of(whole: Column, part: Column) -> Column:
    return whole / F.nullif(part, F.lit(0.0))


def as_text(entries: Column) -> Column:
    """A map as "key=value" in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def map_of(key: str, value: str) -> Column:
    return as_text(F.map_from_entries(F.collect_list(F.struct(F.coalesce(key, F.lit("(null)")), F.col(value)))))


def mode_of(lots: DataFrame, column: str, name: str) -> DataFrame:
    """species and its most frequent value of a column (the lesser on ties), nulls left out."""
    counts = lots.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy("species", column).agg(F.count("*").alias("n"))
    return counts.groupBy("species").agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(name))


def lag1(frame: DataFrame, column: str, name: str) -> DataFrame:
    """species and the correlation of a daily series with its previous value; 0 for fewer than three days."""
    w = W.partitionBy("species").orderBy("trade_date")
    pairs = frame.select("species", F.col(column).cast("double").alias("x"), F.lag(F.col(column).cast("double")).over(w).alias("y"))
    return pairs.groupBy("species").agg(F.when(F.count("*") >= 3, F.corr("x", "y")).otherwise(0.0).alias(name))


def spec_classes(lots: DataFrame) -> DataFrame:
    return sourced(lots).groupBy(cleaning.spec_class(F.col("spec")).alias("class")).agg(F.count("*").alias("n"), F.count_distinct("species").alias("n_species"))


def spec_class_kinds(lots: DataFrame) -> DataFrame:
    kinds = sourced(lots).groupBy("species", "packaging").agg(F.count_distinct(cleaning.spec_class(F.col("spec"))).alias("kinds"))
    return kinds.groupBy("kinds").agg(F.count("*").alias("n_species"))


def cv_ratio(lots: DataFrame, outer: list[str], inner: str) -> DataFrame:
    """species, within and across CV (medians over groups) and their ratio: of groups with three lots, and of parts with two."""
    parts = lots.groupBy(*outer, inner).agg(F.count("*").alias("n"), cv("price_avg").alias("own"))
    within = parts.where("n >= 2").groupBy(*outer).agg(F.avg("own").alias("within"))
    across = lots.groupBy(*outer).agg(F.count("*").alias("n"), cv("price_avg").alias("cv"))
    same = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in outer]
    wide = across.alias("a").join(within.alias("b"), same, "left").select("a.species", F.when(F.col("n") >= 3, F.col("cv")).alias("across"), "within")
    both = wide.groupBy("species").agg(F.median("within").alias("within"), F.median("across").alias("across")).dropna()
    return both.withColumn("ratio", F.when(F.col("within") > 0, F.col("across") / F.col("within")).otherwise(0.0))


def spec_cv(lots: DataFrame) -> DataFrame:
    lots = quarters(lots).where("packaging <> '' and spec <> ''")
    out = cv_ratio(lots, ["species", "trade_date", "state", "packaging"], "spec")
    return out.select("species", F.round("within", 4).alias("within_cv"), F.round("across", 4).alias("across_cv"), F.round("ratio", 2).alias("ratio"), F.when(F.col("ratio") > 1.5, "segments").otherwise("ok").alias("verdict"))


def packaging_ratio(lots: DataFrame) -> DataFrame:
    return cv_ratio(lots.where("packaging <> ''"), ["species", "trade_date"], "packaging")


def threshold_sweep(lots: DataFrame) -> DataFrame:
    limits = F.explode(F.array(F.lit(1.5), F.lit(2.0), F.lit(2.5))).alias("threshold")
    rows = packaging_ratio(quarters(lots)).select(limits, F.round("ratio", 2).alias("ratio"))
    return rows.groupBy("threshold").agg(F.count_if(F.col("ratio") > F.col("threshold")).alias("n"), F.count("*").alias("species"))


def origin_spread(lots: DataFrame) -> DataFrame:
    """Over (species, day, state, packaging, spec) groups of two lots and more; null keys group together."""
    mean = F.avg("price_avg")
    groups = quarters(lots).groupBy("species", "trade_date", "state", "packaging", "spec").agg(F.count("*").alias("n"), mean.alias("mean"), ((F.max("price_avg") - F.min("price_avg")) / mean).alias("s"))
    pct = lambda c, name: F.round(100 * c, 4).alias(name)
    return groups.where("n >= 2 and mean <> 0").agg(F.count("*").alias("n"), pct(F.median("s"), "median_pct"), pct(F.avg("s"), "mean_pct"), pct(F.percentile("s", 0.95), "p95_pct"))


def weighting(lots: DataFrame) -> DataFrame:
    """species, and the correlation of simple and quantity-weighted daily means where there are 30 days."""
    day = lots.groupBy("species", "trade_date").agg(F.avg("price_avg").alias("p"), share_of(F.sum(F.col("price_avg") * F.col("quantity")), F.sum("quantity")).alias("w"))
    return day.groupBy("species").agg(F.corr("p", "w").alias("c"), F.count("*").alias("n")).where("n >= 30").select("species", "c")


def blend_series(lots: DataFrame) -> DataFrame:
    """species, trade_date, blended and dominant price of the days on which the dominant packaging was sold, and the weighting."""
    top = mode_of(lots, "packaging", "top")
    own = F.col("packaging") == F.col("top")
    mean = lambda kept: share_of(F.sum(F.when(kept, F.col("price_avg") * F.col("quantity"))), F.sum(F.when(kept, F.col("quantity"))))
    day = lots.join(top, "species").groupBy("species", "trade_date").agg(
        F.avg("price_avg").alias("p"), mean(F.lit(True)).alias("w"), F.avg(F.when(own, F.col("price_avg"))).alias("dp"), mean(own).alias("dw"))
    day = day.where("dp is not null").join(weighting(lots), "species", "left").withColumn("weighted", F.coalesce(F.col("c") > 0.98, F.lit(True)))
    return day.select("species", "trade_date", "weighted", F.when(F.col("weighted"), F.col("w")).otherwise(F.col("p")).alias("blended"), F.when(F.col("weighted"), F.col("dw")).otherwise(F.col("dp")).alias("dominant"))


def blended_scores(lots: DataFrame) -> DataFrame:
    rows = blend_series(lots)
    out = rows.groupBy("species").agg(F.corr("blended", "dominant").alias("corr"), F.count("*").alias("n_days"), F.first("weighted").alias("weighted")).where("n_days >= 30")
    return out.join(lag1(rows, "blended", "lag1_blend"), "species").join(lag1(rows, "dominant", "lag1_dom"), "species")


def blended(lots: DataFrame) -> DataFrame:
    out = blended_scores(lots)
    verdict = F.when((F.round("corr", 4) > 0.95) & (F.round("lag1_blend", 4) > 0.8), "blend").otherwise("dominant")
    return out.select("species", *[F.round(c, 4).alias(c) for c in ("corr", "lag1_blend", "lag1_dom")], "n_days", F.when(F.col("weighted"), "weighted").otherwise("unweighted").alias("weighting"), verdict.alias("verdict"))


def row_reduction(lots: DataFrame) -> DataFrame:
    """Distinct groups of four strategies, in all and a day, from one pass of grouping sets."""
    keys = ["trade_date", "species", "state", "packaging", "origin", "spec"]
    sets = {"species": keys[:2], "species+state": keys[:3], "species+state+packaging": keys[:4], "raw": keys}
    names = F.create_map(*[F.lit(x) for name, own in sets.items() for x in (sum(1 << (5 - i) for i, k in enumerate(keys) if k not in own), name)])
    groups = lots.groupingSets(list(sets.values()), *keys).agg(F.grouping_id(*keys).cast("int").alias("gid"))
    a_day = groups.groupBy("gid", "trade_date").agg(F.count("*").alias("n"))
    out = a_day.groupBy("gid").agg(F.sum("n").alias("total_groups"), F.bround(F.median("n"), 0).cast("long").alias("median_per_day"), F.round(F.avg("n"), 1).alias("mean_per_day"))
    raw = F.max(F.when(F.col("gid") == 0, F.col("total_groups"))).over(W.partitionBy(F.lit(1)))  # four rows
    return out.select(F.try_element_at(names, "gid").alias("strategy"), "total_groups", "median_per_day", "mean_per_day", F.round(raw / F.col("total_groups"), 4).alias("compression"))


def viable_species(lots: DataFrame, top: int = 30) -> DataFrame:
    """Species outside the largest ones: trading days, longest run of days at most a week apart, and whether there are 100."""
    lots = fine(lots)
    largest = lots.groupBy("species").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "species").limit(top)
    days = lots.join(largest.select("species"), "species", "left_anti").select("species", "trade_date").distinct()
    w = W.partitionBy("species").orderBy("trade_date")
    run = days.withColumn("new", F.when(F.datediff("trade_date", F.lag("trade_date").over(w)) <= 7, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = run.groupBy("species", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("species").agg(F.sum("n").alias("total_days"), F.max("n").alias("max_streak"), (F.sum("n") >= 100).alias("viable"))


def gate_regularity(lots: DataFrame, least: float = 0.6) -> DataFrame:
    """Trading days of the year up to the last day, against the market's; those that reach the gate pass."""
    last = lots.agg(F.max("trade_date").alias("last"))
    days = lots.select("species", "trade_date").distinct().join(F.broadcast(last)).where(F.datediff("last", "trade_date") <= 365)  # one row
    market = days.agg(F.count_distinct("trade_date").alias("market_days"))
    out = days.groupBy("species").agg(F.count("*").alias("days")).join(F.broadcast(market))  # one row
    return out.withColumn("regularity", F.round(F.col("days") / F.col("market_days"), 3)).withColumn("passed", F.col("regularity") >= least)


def gate_signal(lots: DataFrame, least: float = 0.3) -> DataFrame:
    """Daily means of the dominant packaging and state, their lag-1 correlation, plain and of 7-day means, and the gate."""
    own = lots.join(mode_of(lots, "packaging", "dom_pkg"), "species").join(mode_of(lots, "state", "dom_state"), "species").where("packaging = dom_pkg and state = dom_state")
    day = own.groupBy("species", "trade_date").agg(F.avg("price_avg").alias("p"))
    w = W.partitionBy("species").orderBy("trade_date")
    smooth = day.withColumns({"m": F.avg("p").over(w.rowsBetween(-6, 0)), "at": F.row_number().over(w)}).where("at >= 7")
    stats = day.groupBy("species").agg(F.count("*").alias("n_days"), F.bround(F.avg("p"), 0).alias("mean"), F.bround(F.stddev_pop("p"), 0).alias("std"))
    out = stats.join(lag1(day, "p", "one"), "species").join(lag1(smooth, "m", "seven"), "species", "left")
    enough = F.col("n_days") >= 30
    one, seven = F.when(enough, F.round("one", 4)).otherwise(0.0), F.when(enough, F.round(F.col("seven"), 4)).otherwise(0.0)
    return out.select(
        "species", "n_days", one.alias("lag1"), seven.alias("lag1_7d"), F.when(enough, F.col("mean")).alias("mean_price"), F.when(enough, F.round(F.col("std") / F.col("mean"), 4)).alias("cv"),
        (F.greatest(one, seven) >= least).alias("passed"))


def state_verdicts(lots: DataFrame) -> DataFrame:
    """species and state verdict: filter to a state that has 90 %, partition where state means differ by half, else aggregate."""
    counts = lots.groupBy("species", F.coalesce("state", F.lit("(null)")).alias("state")).agg(F.count("*").alias("n"), F.bround(F.avg("price_avg"), 0).alias("mean"))
    top = counts.groupBy("species").agg(F.min_by("state", F.struct(-F.col("n"), F.col("state"))).alias("dominant"), (100 * F.max("n") / F.sum("n")).alias("pct"))
    means = counts.where("n > 10 and state <> '(null)'").groupBy("species").agg(F.count("*").alias("states"), (F.max("mean") / F.min("mean")).alias("r")).where("states >= 2")
    verdict = F.when(F.round("pct", 1) >= 90, F.concat(F.lit("filter:"), "dominant")).when(F.round("r", 2) > 1.5, "partition").otherwise("aggregate")
    return top.join(means, "species", "left").select("species", verdict.alias("state_rule"))


def packaging_pairs(lots: DataFrame) -> DataFrame:
    """species, weighted correlation and price ratio (first to second) of the two packagings that trade on most days."""
    day = lots.groupBy("species", "packaging", "trade_date").agg(F.avg("price_avg").alias("p"), share_of(F.sum(F.col("price_avg") * F.col("quantity")), F.sum("quantity")).alias("w"))
    days = day.groupBy("species", "packaging").agg(F.count("*").alias("n")).where("n >= 100")
    rank = F.row_number().over(W.partitionBy("species").orderBy(F.desc("n"), "packaging"))
    kept = days.withColumn("rank", rank).where("rank <= 2").drop("n")
    wide = day.join(kept, ["species", "packaging"]).groupBy("species", "trade_date").agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("p", "w")]).dropna()
    return wide.groupBy("species").agg(F.corr("w1", "w2").alias("pair_corr"), F.avg("p1").alias("m1"), F.avg("p2").alias("m2"), F.count("*").alias("n")).where("n >= 30").select(
        "species", F.round("pair_corr", 4).alias("pair_corr"), F.round(F.greatest("m1", "m2") / F.least("m1", "m2"), 4).alias("price_ratio"))


def decision_tree(lots: DataFrame) -> DataFrame:
    """How each species is best grouped: by state, packaging and spec class, weighted or not. Its six branches read the lots written once."""
    lots = staged(lots, "lots")
    within = lambda r: r.select("species", F.round("ratio", 2).alias("ratio"))
    packs = within(packaging_ratio(quarters(lots))).withColumnRenamed("ratio", "pack_ratio")
    specs = within(cv_ratio(quarters(lots).where("packaging <> '' and spec <> ''"), ["species", "trade_date", "state", "packaging"], "spec")).withColumnRenamed("ratio", "spec_ratio")
    scores = blended_scores(lots).select("species", F.round("corr", 4).alias("corr"), F.round("lag1_blend", 4).alias("lag1_blend"))
    rows = packs.join(state_verdicts(lots), "species").join(specs, "species", "left").join(scores, "species", "left").join(packaging_pairs(lots), "species", "left").join(weighting(lots), "species", "left")
    packaging = (
        F.when(F.col("pack_ratio") <= 1.5, F.when((F.coalesce("corr", F.lit(0.0)) > 0.95) & (F.coalesce("lag1_blend", F.lit(0.0)) > 0.8), "blend").otherwise("dominant-pkg"))
        .when(F.col("pair_corr").isNull(), "blend").when((F.col("pair_corr") > 0.85) & (F.col("price_ratio") < 1.5), "blend").when(F.col("pair_corr") > 0.85, "dominant-pkg").otherwise("separate"))
    spec = F.when(F.coalesce("spec_ratio", F.lit(0.0)) <= 1.5, "aggregate").otherwise("spec-class")
    rows = rows.withColumns({"packaging": packaging, "spec": spec, "weighting": F.when(F.coalesce("c", F.lit(1.0)) > 0.98, "weighted").otherwise("unweighted")})
    columns = F.array_compact(F.array(
        F.lit("trade_date"), F.lit("species"), F.when(F.col("state_rule") == "partition", "state"), F.when(F.col("packaging").isin("separate", "dominant-pkg"), "packaging"), F.when(F.col("spec") == "spec-class", "spec_class")))
    return rows.select("species", "state_rule", "packaging", "spec", "weighting", F.array_join(columns, ",").alias("group_by"))


def pattern_mode(lots: DataFrame) -> DataFrame:
    """The grouping that most species take; on ties the lesser text."""
    return decision_tree(lots).groupBy("group_by").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_by").limit(1)


def run_summary(lots: DataFrame) -> DataFrame:
    by_state = lots.where("state is not null").groupBy("trade_date", "state").agg(F.count("*").alias("n")).groupBy("trade_date").agg(map_of("state", "n").alias("states"))
    day = lots.groupBy("trade_date").agg(F.count("*").alias("n"), F.count_distinct("species").alias("n_species"), F.round(F.avg("price_avg"), 6).alias("mean_price"), F.sum("quantity").alias("qty"))
    return day.join(by_state, "trade_date", "left").fillna("", ["states"])


def state_distribution(lots: DataFrame) -> DataFrame:
    counts = lots.groupBy("species", F.coalesce("state", F.lit("(null)")).alias("state")).agg(F.count("*").alias("n"))
    pct = 100 * F.max("n") / F.sum("n")
    return counts.groupBy("species").agg(
        F.min_by("state", F.struct(-F.col("n"), F.col("state"))).alias("dominant"), F.round(pct, 1).alias("pct"), F.sum("n").alias("total"), F.count("*").alias("kinds"),
        (F.round(pct, 1) < 90).alias("multi_state"), map_of("state", "n").alias("states"))


def state_divergence(lots: DataFrame) -> DataFrame:
    means = lots.where("state is not null").groupBy("species", "state").agg(F.bround(F.avg("price_avg"), 0).cast("long").alias("mean"), F.count("*").alias("n")).where("n > 10")
    ratio = F.round(F.max("mean") / F.min("mean"), 2)
    return means.groupBy("species").agg(map_of("state", "mean").alias("means"), F.count("*").alias("kinds"), ratio.alias("ratio"), (ratio > 1.5).alias("divergent")).where("kinds >= 2")


def daily(lots: DataFrame) -> DataFrame:
    return lots.groupBy("species", "trade_date").agg(F.avg("price_avg").alias("p"), F.sum("quantity").alias("q"), F.count("*").alias("n"))


def summary_stats(lots: DataFrame) -> DataFrame:
    day = daily(lots)
    stats = day.groupBy("species").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("std"))
    return stats.join(lag1(day, "p", "lag1"), "species").select("species", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(F.col("std") / F.col("mean"), 6).alias("cv"), F.round("lag1", 4).alias("lag1"))


def compared(lots: DataFrame) -> DataFrame:
    """Mean prices of each species by origin, state, year, month and season, ranked, in one pass of grouping sets."""
    season = F.element_at(F.array(*[F.lit(x) for x in ("winter", "spring", "summer", "autumn")]), (F.floor(F.month("trade_date") / 3) % 4 + 1).cast("int"))
    names = ["origin", "state", "year", "month", "season"]
    rows = lots.select("species", "origin", F.coalesce("state", F.lit("(null)")).alias("state"), F.year("trade_date").cast("string").alias("year"), F.month("trade_date").cast("string").alias("month"), season.alias("season"), "price_avg")
    means = rows.groupingSets([["species", n] for n in names], "species", *names).agg(F.avg("price_avg").alias("m"), F.count("*").alias("n"), *[F.grouping(n).alias(f"no_{n}") for n in names])
    by = F.coalesce(*[F.when(F.col(f"no_{n}") == 0, F.lit(n)) for n in names])
    out = means.select("species", by.alias("dimension"), F.coalesce(*names).alias("value"), "m", "n")
    return out.select("species", "dimension", "value", F.round("m", 6).alias("mean"), "n", F.rank().over(W.partitionBy("species", "dimension").orderBy(F.desc("m"))).alias("rank_"))


def scored_configs(lots: DataFrame) -> DataFrame:
    """config (species and packaging), category and a metric that stands for its error, as the result files hold them."""
    return lots.groupBy("species", "packaging").agg((100 * cv("price_avg")).alias("mape"), F.count("*").alias("n")).select(F.concat_ws("_", "species", "packaging").alias("config"), F.col("packaging").alias("category"), "species", "mape", "n")


def kpi(lots: DataFrame) -> DataFrame:
    """The sum of rows and the mean metric, the best and the worst five, and the mean and least of each category."""
    scores = scored_configs(lots)
    total = scores.select(F.lit("all").alias("part"), F.lit("").alias("name"), "mape", "n").groupBy("part", "name").agg(F.avg("mape").alias("mean"), F.min("mape").alias("least"), F.sum("n").alias("n"))
    top = lambda order, part: scores.orderBy(order, "config").limit(5).select(F.lit(part).alias("part"), F.col("config").alias("name"), F.col("mape").alias("mean"), F.col("mape").alias("least"), "n")
    category = scores.groupBy(F.lit("category").alias("part"), F.col("category").alias("name")).agg(F.avg("mape").alias("mean"), F.min("mape").alias("least"), F.sum("n").alias("n"))
    out = total.unionByName(top(F.asc("mape"), "best")).unionByName(top(F.desc("mape"), "worst")).unionByName(category)
    return out.select("part", "name", F.round("mean", 4).alias("mean"), F.round("least", 4).alias("least"), "n")


def feature_frame(lots: DataFrame) -> DataFrame:
    w = W.partitionBy("species").orderBy("trade_date")
    return daily(lots).select("species", "trade_date", F.lead("p", 7).over(w).alias("y"), F.col("p").alias("price"), F.lag("p").over(w).alias("lag1"), F.avg("p").over(w.rowsBetween(-7, -1)).alias("mean7"), F.avg("p").over(w.rowsBetween(-30, -1)).alias("mean30"), F.sum("q").over(w.rowsBetween(-7, -1)).alias("qty7")).dropna()


FEATURES = ["price", "lag1", "mean7", "mean30", "qty7"]


def feature_rank(lots: DataFrame, most: int = 20) -> DataFrame:
    """Importance of each feature in a species' linear model (its absolute correlation with the target, in per cent of their sum), averaged over the models, the first of them."""
    gains = feature_frame(lots).groupBy("species").agg(*[F.abs(F.corr(c, "y")).alias(c) for c in FEATURES]).unpivot("species", FEATURES, "feature", "gain")
    pct = gains.withColumn("pct", 100 * F.col("gain") / F.sum("gain").over(W.partitionBy("species")))
    mean = pct.groupBy("feature").agg(F.avg("pct").alias("mean"))
    return mean.orderBy(F.desc("mean"), "feature").limit(most).select("feature", F.round("mean", 2).alias("pct"), F.row_number().over(W.orderBy(F.desc("mean"), "feature")).alias("rank_"))


def species_profile(lots: DataFrame) -> DataFrame:
    """Foreign share, price ratio of foreign to domestic, ratio of the dearest to the cheapest spec class, and flags."""
    lots = sourced(lots).withColumn("foreign", cleaning.is_foreign(F.col("origin")))
    mean = lambda kept: F.avg(F.when(kept, F.col("price_avg")))
    own = lots.groupBy("species").agg(F.avg(F.col("foreign").cast("int")).alias("share"), (mean(F.col("foreign")) / mean(~F.col("foreign"))).alias("ratio"))
    ladder = lots.groupBy("species", cleaning.spec_class(F.col("spec")).alias("class")).agg(F.avg("price_avg").alias("m")).groupBy("species").agg((F.max("m") / F.min("m")).alias("ladder"))
    flags = F.array_join(F.array_compact(F.array(F.when(F.col("share") > 0.15, "imported"), F.when(F.col("ratio") < 1, "cheap imports"), F.when(F.col("ladder") > 1.05, "graded"))), ",")
    return own.join(ladder, "species").select("species", F.round("share", 6).alias("foreign_share"), F.round("ratio", 6).alias("price_ratio"), F.round("ladder", 6).alias("ladder_ratio"), flags.alias("flags"))


def approximate(lots: DataFrame) -> DataFrame:
    """Sketches beside exact aggregates: whether distinct counts and medians come within five per cent."""
    near = lambda a, b: F.abs(a - b) <= 0.05 * b
    return lots.groupBy("species").agg(
        near(F.approx_count_distinct("trade_date", 0.01), F.count_distinct("trade_date")).alias("distinct_near"), near(F.percentile_approx("price_avg", 0.5, 10_000), F.percentile("price_avg", 0.5)).alias("median_near"), F.count("*").alias("n"))


def config_health(lots: DataFrame) -> DataFrame:
    day = daily(lots)
    recent = F.count_if(F.year("trade_date") >= 1998)
    stats = day.groupBy("species").agg(
        F.count("*").alias("days"), F.sum("n").alias("rows_"), F.avg("p").alias("mean"), cv("p").alias("cv"), recent.alias("recent_days"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    return stats.join(lag1(day, "p", "lag1"), "species").select(
        "species", "days", "rows_", F.round(F.col("rows_") / F.col("days"), 4).alias("lots_per_day"), F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"), F.round("lag1", 4).alias("lag1"), "recent_days",
        cleaning.freshness(F.col("recent_days")).alias("health"), "first_day", "last_day")


def best_of_sections(lots: DataFrame) -> DataFrame:
    """Two result sections of configurations, of even and odd years: the better section of each, and all values of a model (packaging) in order."""
    rows = lots.groupBy("species", "packaging", (F.year("trade_date") % 2).alias("odd")).agg((100 * cv("price_avg")).alias("m"))
    section = F.when(F.col("odd") == 1, "second").otherwise("first")
    best = rows.groupBy("species", "packaging").agg(F.min_by(section, F.struct("m", "odd")).alias("section"), F.round(F.min("m"), 4).alias("best"))
    values = rows.groupBy("packaging").agg(F.array_sort(F.collect_list(F.round("m", 2))).alias("v")).select("packaging", F.size("v").cast("long").alias("n_values"), F.round(F.get("v", F.lit(0)), 2).alias("least"))
    return best.join(values, "packaging")


STUDIES = {
    "agg_spec_classes": spec_classes, "agg_spec_class_kinds": spec_class_kinds, "agg_spec_cv": spec_cv, "agg_threshold_sweep": threshold_sweep, "agg_origin_spread": origin_spread, "agg_blended": blended,
    "agg_row_reduction": row_reduction, "agg_viable_species": viable_species, "agg_gate_regularity": gate_regularity, "agg_gate_signal": gate_signal, "agg_decision_tree": decision_tree, "agg_pattern_mode": pattern_mode,
    "agg_run_summary": run_summary, "agg_state_distribution": state_distribution, "agg_state_divergence": state_divergence, "agg_summary_stats": summary_stats, "agg_compare": compared, "agg_kpi": kpi,
    "agg_feature_rank": feature_rank, "agg_species_profile": species_profile, "agg_approximate": approximate, "agg_config_health": config_health, "agg_best_of_sections": best_of_sections,
}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(star_lots(spark, sf_dir))) for name, f in STUDIES.items()}
