"""Models that learn: isolation forests kept as a table, quantile regressors, a search over boosted trees, permutation importance."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.dialect import oracle
from tidemark.plans.series import by_day, prior
from tidemark.plans.studies import daily
from tidemark.sources.lots import star_lots
from tidemark.sources.staging import staged

#: An isolation forest: trees, values a tree is grown from, share of values that are odd.
TREES, SAMPLE, ODD = 100, 256, 0.05
LEVELS = math.ceil(math.log2(SAMPLE))
EULER = 0.5772156649
ALPHAS = (0.1, 0.9)
HORIZON = 7
#: Trials of the search: depth, rounds and step of boosted trees.
TRIALS = [(depth, rounds, step) for depth in (2, 3, 4) for rounds in (4, 8) for step in (0.1, 0.3)] + [(5, 4, 0.1), (5, 4, 0.3), (1, 8, 0.3)]
FEATURES = ["p", "lag1", "lag7", "a7", "a30", "sd30", "q7", "month", "dow"]


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) that follows from the keys, the same in every engine and run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 2.0**32


def _left_to_go(n: Column) -> Column:
    """The mean path of a search among n values that are still together."""
    return F.when(n <= 1, F.lit(0.0)).when(n == 2, F.lit(1.0)).otherwise(2 * (F.ln(n - 1.0) + EULER) - 2 * (n - 1.0) / n)


def forest(values: DataFrame) -> DataFrame:
    """Leaves of isolation trees over values (species, id, p): species, tree, low (the least value that falls in), path.

    Every tree takes the SAMPLE ids of a species that come first by a hash, cuts what is together at a random place between
    its ends, level by level, and stops where one value or LEVELS cuts are reached. All trees of all species grow at once.
    """
    trees = values.select("*", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    drawn = W.partitionBy("species", "tree").orderBy(_uniform(F.col("species"), F.col("tree"), F.col("id")), "id")
    at = trees.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= SAMPLE)
    at = at.select("species", "tree", "p", F.lit(1).cast("long").alias("node"), F.lit(float("-inf")).alias("low"), F.lit(0).alias("depth"))
    node = W.partitionBy("species", "tree", "node")
    for _ in range(LEVELS):
        ends = at.withColumns({"least": F.min("p").over(node), "most": F.max("p").over(node)})
        cut = F.col("least") + _uniform(F.col("species"), F.col("tree"), F.col("node")) * (F.col("most") - F.col("least"))
        ends = ends.withColumns({"open": F.col("least") < F.col("most"), "cut": cut})
        right = F.col("open") & (F.col("p") > F.col("cut"))
        at = ends.select(
            "species", "tree", "p", F.when(F.col("open"), F.col("node") * 2 + right.cast("long")).otherwise(F.col("node")).alias("node"),
            F.when(right, F.col("cut")).otherwise(F.col("low")).alias("low"), (F.col("depth") + F.col("open").cast("int")).alias("depth"))
    leaf = at.groupBy("species", "tree", "node", "low", "depth").agg(F.count("*").alias("n"))
    return leaf.select("species", "tree", "low", (F.col("depth") + _left_to_go(F.col("n"))).alias("path"))


def isolation(values: DataFrame, leaves: DataFrame) -> DataFrame:
    """species, id, score in (0, 1) of each value: leaves and values of a tree in one order, each value takes the leaf before it."""
    held = leaves.select("species", "tree", F.col("low").alias("p"), F.lit(0).alias("kind"), F.lit(None).cast("date").alias("id"), "path")
    asked = values.select("species", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "p", F.lit(-1).alias("kind"), "id", F.lit(None).cast("double").alias("path"))
    order = W.partitionBy("species", "tree").orderBy("p", "kind").rowsBetween(W.unboundedPreceding, 0)
    found = held.unionByName(asked).withColumn("path", F.last("path", ignorenulls=True).over(order)).where("kind = -1")
    size = values.groupBy("species").agg(F.least(F.count("*"), F.lit(SAMPLE)).alias("n"))
    mean = found.groupBy("species", "id").agg(F.round(F.avg("path"), 9).alias("path")).join(size, "species")
    return mean.select("species", "id", F.round(F.pow(F.lit(2.0), -F.col("path") / _left_to_go(F.col("n"))), 9).alias("score"))


def anomalies(lots: DataFrame) -> DataFrame:
    """The last 30 days of a species that are odd by deviation, by quartiles or by the forest (its scores' upper 5 %)."""
    day = staged(daily(lots).select("species", F.col("trade_date").alias("id"), "p"), "days")
    score = isolation(day, forest(day))
    limit = score.groupBy("species").agg(F.percentile("score", 1 - ODD).alias("limit"))
    own = day.groupBy("species").agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("sd"), F.percentile("p", 0.25).alias("q1"), F.percentile("p", 0.75).alias("q3"))
    rows = day.join(score, ["species", "id"]).join(limit, "species").join(own, "species")
    rows = rows.withColumn("back", F.row_number().over(W.partitionBy("species").orderBy(F.desc("id")))).where("back <= 30")
    z, spread = (F.col("p") - F.col("m")) / F.col("sd"), 1.5 * (F.col("q3") - F.col("q1"))
    rows = rows.withColumns({"z": z, "iqr": ~F.col("p").between(F.col("q1") - spread, F.col("q3") + spread), "forest": F.col("score") > F.col("limit")})
    severity = F.when(F.abs("z") > 3, "high").when(F.abs("z") > 2.5, "medium").otherwise("low")
    return rows.where((F.abs("z") > 2) | F.col("iqr") | F.col("forest")).select(
        "species", F.col("id").alias("trade_date"), F.round("z", 6).alias("z"), "iqr", "forest", F.round("score", 6).alias("score"), severity.alias("severity"), F.when(F.col("z") > 0, "spike").otherwise("drop").alias("kind"))


def frame(lots: DataFrame) -> DataFrame:
    """Features of each species and day, the price HORIZON days on (a), the place of the day in its series (0 to 1), and its number."""
    w = by_day()
    rows = daily(lots).select(
        "species", "trade_date", "p", F.lag("p", 1).over(w).alias("lag1"), F.lag("p", 7).over(w).alias("lag7"), F.avg("p").over(prior(7)).alias("a7"), F.avg("p").over(prior(30)).alias("a30"), F.stddev_pop("p").over(prior(30)).alias("sd30"),
        F.sum("q").over(w.rowsBetween(-6, 0)).alias("q7"), F.month("trade_date").cast("double").alias("month"), F.weekday("trade_date").cast("double").alias("dow"), F.lead("p", HORIZON).over(w).alias("a"), F.row_number().over(w).alias("i"))
    return rows.dropna().where("i > 30").withColumn("place", F.percent_rank().over(w))


def pinball_fit(x, y, alpha: float, rounds: int = 60):
    """Coefficients of the least pinball loss: reweighted least squares to come near, then the exact line through the nearest points.

    The weights' floor falls with each round. At the end as many points as coefficients are met exactly, as the optimum of a
    piecewise linear loss lies in a corner; corners are left while a neighbour is better.
    """
    import numpy as np

    b = np.linalg.lstsq(x, y, rcond=None)[0]
    floor = max(np.abs(y - x @ b).mean(), 1e-9)
    for k in range(rounds):
        r = y - x @ b
        w = np.where(r > 0, alpha, 1 - alpha) / np.maximum(np.abs(r), floor * 0.7**k + 1e-12)
        b = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    loss = lambda c: (np.maximum(alpha * (y - x @ c), (alpha - 1) * (y - x @ c))).sum()
    basis: list[int] = []
    for i in np.argsort(np.abs(y - x @ b)):
        if np.linalg.matrix_rank(x[[*basis, i]]) == len(basis) + 1:
            basis.append(int(i))
        if len(basis) == x.shape[1]:
            break
    if len(basis) < x.shape[1]:
        return b
    for _ in range(2000):
        inverse = np.linalg.inv(x[basis])
        c = inverse @ y[basis]
        r = y - x @ c
        r[basis] = 0.0
        best = None
        for j in range(len(basis)):  # the edges out of the corner: one of its points is left, on either side
            for side in (1.0, -1.0):
                move = x @ inverse[:, j] * side
                out = r != 0
                slope = -(np.where(r[out] > 0, alpha, alpha - 1) * move[out]).sum() + (1 - alpha if side > 0 else alpha)
                zero = [i for i in np.flatnonzero(~out) if i not in basis]
                slope += sum((1 - alpha) * move[i] if move[i] > 0 else -alpha * move[i] for i in zero)
                if slope < -1e-9 and (best is None or slope < best[0]):
                    best = (slope, j, move)
        if best is None:
            return c
        slope, j, move = best
        steps = np.where(move != 0, r / np.where(move != 0, move, 1), np.inf)
        ahead = np.flatnonzero((steps > 1e-12) & np.isfinite(steps))
        if not len(ahead):
            return c
        entering = None
        for i in ahead[np.argsort(steps[ahead])]:
            slope += abs(move[i])
            if slope >= 0:
                entering = int(i)
                break
        if entering is None or entering in basis:
            return c
        new = [*basis[:j], entering, *basis[j + 1 :]]
        if np.linalg.matrix_rank(x[new]) < len(new) or loss(np.linalg.inv(x[new]) @ y[new]) >= loss(c):
            return c
        basis = new
    return c


QUANTILE_FEATURES = ["p", "lag7", "a7", "a30", "sd30"]
QUANTILES = "species string, alpha double, n long, below double, met long, loss double, constant_loss double, held_out_loss double, held_out_below double, coefficients array<double>"


def quantile_regressors(lots: DataFrame) -> DataFrame:
    """For each species and alpha the linear model of least pinball loss on the first 80 % of the days, and how it does on the rest.

    below is the share of training residuals under 0 and met how many points the line goes through: at the optimum alpha
    lies between below and below + met / n. A series' days follow the calendar, so one task holds a species.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("trade_date")
        scale = max(rows["p"].mean(), 1e-9)
        x = np.column_stack([np.ones(len(rows)), rows[QUANTILE_FEATURES].to_numpy() / scale])
        y, late, out = rows["a"].to_numpy() / scale, rows["place"].to_numpy() >= 0.8, []
        if (~late).sum() <= 3 * x.shape[1] or not late.any():
            return pd.DataFrame(columns=[c.split()[0] for c in QUANTILES.split(", ")])
        for alpha in ALPHAS:
            c = pinball_fit(x[~late], y[~late], alpha)
            pinball = lambda r, a=alpha: float(np.maximum(a * r, (a - 1) * r).mean() * scale)
            r, rest = y[~late] - x[~late] @ c, y[late] - x[late] @ c
            met = np.abs(r) < 1e-9
            out.append((rows["species"].iloc[0], alpha, int((~late).sum()), float(((r < 0) & ~met).mean()), int(met.sum()), pinball(r), pinball(y[~late] - np.quantile(y[~late], alpha)), pinball(rest), float((rest < 0).mean()), c.tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in QUANTILES.split(", ")])

    return frame(lots).groupBy("species").applyInPandas(work, QUANTILES)


def _model(depth: int, rounds: int, step: float):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="x", labelCol="y", weightCol="weight", maxDepth=depth, maxIter=rounds, stepSize=step, seed=1, maxBins=64)


def _vectors(lots: DataFrame) -> DataFrame:
    """The frame with features in x, the logarithm of the price ahead in y, and a weight that grows with time; staged."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(frame(lots)).withColumns({"y": F.ln(F.greatest("a", F.lit(1.0))), "weight": F.exp(2 * F.col("place"))})
    return rows.select("species", "trade_date", "place", "x", "y", "weight", "p", "a")


def _error(rows: DataFrame, forecast: Column) -> float:
    return float(rows.agg(F.avg(F.abs(forecast - F.col("a")) / F.col("a")) * 100).first()[0])


def tree_search(lots: DataFrame) -> DataFrame:
    """Every trial's error on the last quarter of the training days (the first 80 %), in the order of merit; of the best also its error on the days held out.

    Trials are Spark ML fits over all species, four at a time. The error of the naive forecast on the same days stands beside.
    """
    spark, rows = lots.sparkSession, staged(_vectors(lots), "search")
    fit, tune, test = rows.where("place < 0.6"), rows.where("place >= 0.6 and place < 0.8"), rows.where("place >= 0.8")
    guess = F.exp("prediction")
    with ThreadPool(4) as pool:
        scores = pool.map(lambda t: _error(_model(*t).fit(fit).transform(tune), guess), TRIALS)
    ranked = sorted(zip(scores, TRIALS, strict=True))
    best = _model(*ranked[0][1]).fit(rows.where("place < 0.8")).transform(test)
    held_out, naive = _error(best, guess), _error(test, F.col("p"))
    out = [(k + 1, *t, round(s, 4), round(held_out, 4) if k == 0 else None, round(naive, 4)) for k, (s, t) in enumerate(ranked)]
    return spark.createDataFrame(out, "place int, depth int, rounds int, step double, tune_mape double, test_mape double, naive_mape double")


def permutation_importance(lots: DataFrame) -> DataFrame:
    """How much the error on the held-out days grows, in per cent of all growth, when a feature's values are dealt anew within its species.

    All features are permuted in one pass: a row for each day and feature, scored by one model; the mean over two models
    (shallow and deep). Values are dealt by a hash of day and feature, so the result is the same in each run.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = staged(_vectors(lots), "importance")
    train, test = rows.where("place < 0.8"), rows.where("place >= 0.8").withColumn("v", vector_to_array("x"))
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("feature")) for i, n in enumerate(FEATURES)])).alias("f")
    wide = test.select("species", "trade_date", "v", "a", names).select("species", "trade_date", "v", "a", "f.at", "f.feature")
    own, other = W.partitionBy("species", "feature").orderBy("trade_date"), W.partitionBy("species", "feature").orderBy(_uniform(F.col("trade_date"), F.col("feature")), "trade_date")
    wide = wide.withColumns({"i": F.row_number().over(own), "j": F.row_number().over(other), "value": F.get("v", F.col("at"))})
    dealt = wide.select("species", "feature", F.col("j").alias("i"), F.col("value").alias("dealt"))
    moved = wide.join(dealt, ["species", "feature", "i"]).withColumn("x", array_to_vector(F.transform("v", lambda e, k: F.when(k == F.col("at"), F.col("dealt")).otherwise(e))))
    parts = []
    for name, settings in (("shallow", (2, 8, 0.3)), ("deep", (4, 4, 0.3))):
        model = _model(*settings).fit(train)
        wrong = F.abs(F.exp("prediction") - F.col("a")) / F.col("a") * 100
        base = F.broadcast(model.transform(test.select("x", "a")).agg(F.avg(wrong).alias("base")))  # one row
        parts.append(model.transform(moved.select("feature", "x", "a")).groupBy("feature").agg(F.avg(wrong).alias("permuted")).join(base).select(F.lit(name).alias("model"), "feature", F.greatest(F.col("permuted") - F.col("base"), F.lit(0.0)).alias("growth")))
    growth = parts[0].unionByName(parts[1])
    share = growth.withColumn("pct", F.when(F.sum("growth").over(W.partitionBy("model")) > 0, 100 * F.col("growth") / F.sum("growth").over(W.partitionBy("model"))).otherwise(0.0))
    mean = share.groupBy("feature").agg(F.avg("pct").alias("m"), F.count("*").alias("models"))
    return mean.select("feature", F.round("m", 2).alias("importance_pct"), F.row_number().over(W.partitionBy().orderBy(F.desc("m"), "feature")).alias("place"), "models")  # a row a feature


FRAMES = {"ml_isolation_forest": anomalies, "ml_quantile_regressors": quantile_regressors, "ml_tree_search": tree_search, "ml_permutation_importance": permutation_importance}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(star_lots(spark, sf_dir))) for name, f in FRAMES.items()}

_U = "CAST(('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"
_TOGO = "CASE WHEN {0} <= 1 THEN 0.0 WHEN {0} = 2 THEN 1.0 ELSE 2 * (ln({0} - 1.0) + 0.5772156649) - 2 * ({0} - 1.0) / {0} END"
SQL = {
    "ml_isolation_forest": f"""WITH RECURSIVE d AS (SELECT species, trade_date AS id, avg(price_avg) AS p FROM lots GROUP BY ALL),
drawn AS (SELECT species, tree, p FROM d CROSS JOIN generate_series(0, {TREES - 1}) t(tree) QUALIFY row_number() OVER (PARTITION BY species, tree ORDER BY {_U.format('species, tree, id')}, id) <= {SAMPLE}),
grown AS (SELECT species, tree, p, 1::BIGINT AS node, '-infinity'::DOUBLE AS low, 0 AS depth, 0 AS level FROM drawn
  UNION ALL SELECT species, tree, p, CASE WHEN least < most THEN node * 2 + CASE WHEN p > cut THEN 1 ELSE 0 END ELSE node END, CASE WHEN least < most AND p > cut THEN cut ELSE low END, depth + CASE WHEN least < most THEN 1 ELSE 0 END, level + 1
  FROM (SELECT *, least + {_U.format('species, tree, node')} * (most - least) AS cut FROM (SELECT *, min(p) OVER (PARTITION BY species, tree, node) AS least, max(p) OVER (PARTITION BY species, tree, node) AS most FROM grown WHERE level < {LEVELS}) a) b),
leaf AS (SELECT species, tree, low, depth + {_TOGO.format('n')} AS path FROM (SELECT species, tree, node, low, depth, count(*) AS n FROM grown WHERE level = {LEVELS} GROUP BY ALL) x),
asked AS (SELECT * FROM d CROSS JOIN generate_series(0, {TREES - 1}) t(tree)),
found AS (SELECT q.species, q.id, round(avg(path), 9) AS path FROM asked q ASOF JOIN leaf l ON l.species = q.species AND l.tree = q.tree AND q.p > l.low GROUP BY ALL),
score AS (SELECT species, id, round(power(2.0, -path / ({_TOGO.format('n')})), 9) AS score FROM found JOIN (SELECT species, least(count(*), {SAMPLE}) AS n FROM d GROUP BY species) s USING (species)),
own AS (SELECT species, avg(p) AS m, stddev_pop(p) AS sd, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM d GROUP BY species), lim AS (SELECT species, quantile_cont(score, {1 - ODD}) AS lim FROM score GROUP BY species),
r AS (SELECT d.species, d.id, score, (p - m) / sd AS z, p < q1 - 1.5 * (q3 - q1) OR p > q3 + 1.5 * (q3 - q1) AS iqr, score > lim AS forest, row_number() OVER (PARTITION BY d.species ORDER BY d.id DESC) AS back
  FROM d JOIN score USING (species, id) JOIN own USING (species) JOIN lim USING (species))
SELECT species, id AS trade_date, round(z, 6) AS z, iqr, forest, round(score, 6) AS score, CASE WHEN abs(z) > 3 THEN 'high' WHEN abs(z) > 2.5 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS kind
FROM r WHERE back <= 30 AND (abs(z) > 2 OR iqr OR forest)""",
}
ORACLES = {name: oracle(text) for name, text in SQL.items()}
