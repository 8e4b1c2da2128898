"""Learned models, stateful streams, the restartable run, sketches and the row store beyond what SQL can say."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import daily_run, learned, rules
from tidemark.sources import row_store
from tidemark.sources.day_stream import DayStreamReader
from tidemark.sources.lots import star_lots
from tidemark.streaming import stateful, streams

FOLDER = "/root/testdata/sf0.001"


# Quantile regressors
def optimal(x, y, c, alpha):
    """The subgradient of the loss holds 0: the sum over points off the line can be made up by those on it."""
    r = y - x @ c
    on = np.abs(r) < 1e-9
    pull = ((alpha - (r[~on] < 0))[:, None] * x[~on]).sum(axis=0)
    weights = np.linalg.lstsq(x[on].T, -pull, rcond=None)[0]
    return np.allclose(x[on].T @ weights, -pull, atol=1e-6) and (weights <= alpha + 1e-6).all() and (weights >= alpha - 1 - 1e-6).all()


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.9])
def test_pinball_fit_is_optimal(alpha):
    rng = np.random.default_rng(4)
    for n, k in ((40, 1), (60, 3), (200, 5)):
        x = np.column_stack([np.ones(n), rng.normal(size=(n, k - 1))]) if k > 1 else np.ones((n, 1))
        y = x @ rng.normal(size=k) + rng.standard_t(3, size=n)
        assert optimal(x, y, learned.pinball_fit(x, y, alpha), alpha)


def test_quantile_regressors(spark):
    rows = learned.quantile_regressors(star_lots(spark, FOLDER)).collect()
    assert {r.alpha for r in rows} == {0.1, 0.9} and len(rows) > 20
    for r in rows:
        assert r.below <= r.alpha + 1e-9 and r.alpha <= r.below + r.met / r.n + 1e-9 and r.met >= 6
        assert r.loss <= r.constant_loss + 1e-6


# Forests
def test_forest_finds_what_stands_apart(spark):
    days = spark.createDataFrame([("a", k, 100.0 + (k * 37 % 20)) for k in range(300)] + [("a", 999, 900.0)], "species string, k int, p double").select("species", F.date_add(F.lit("2000-01-01").cast("date"), F.col("k")).alias("id"), "p")
    leaves = learned.forest(days)
    per_tree = leaves.groupBy("tree").agg(F.count("*").alias("n"), F.min("low").alias("low")).collect()
    assert len(per_tree) == learned.TREES and all(r.n <= learned.SAMPLE and r.low == -math.inf for r in per_tree)
    first = learned.isolation(days, leaves).orderBy(F.desc("score")).collect()
    assert str(first[0].id) == "2002-09-26" and first[0].score > first[1].score + 0.1


# Trees
def test_tree_search(spark):
    rows = learned.tree_search(star_lots(spark, FOLDER)).orderBy("place").collect()
    assert len(rows) == len(learned.TRIALS) == 15 and [r.place for r in rows] == list(range(1, 16))
    assert [r.tune_mape for r in rows] == sorted(r.tune_mape for r in rows) and rows[0].test_mape < rows[0].naive_mape
    again = learned.tree_search(star_lots(spark, FOLDER)).orderBy("place").first()
    assert again == rows[0]


def test_permutation_importance(spark):
    rows = learned.permutation_importance(star_lots(spark, FOLDER)).collect()
    assert {r.feature for r in rows} == set(learned.FEATURES) and abs(sum(r.importance_pct for r in rows) - 100) < 0.1
    assert [r.place for r in sorted(rows, key=lambda r: (-r.importance_pct, r.place))] == sorted(r.place for r in rows)
    assert learned.permutation_importance(star_lots(spark, FOLDER)).collect() == rows


# Streams
def verdicts(spark, times, limits, last):
    rows = spark.createDataFrame([(k, t, 7) for k, t in enumerate([*times, last])], "event_id long, ms long, user_id long").select("event_id", F.timestamp_millis("ms").alias("ts"), "user_id")
    own = stateful.session_of(spark)
    path = f"{streams.shared_dir(spark)}/tidemark-test-{streams.uuid.uuid4().hex}"
    for low, high in ((0, 3), (3, 10**9)):
        rows.where(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    stream = own.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(path)
    return sorted((r.at, r.verdict) for r in streams.settled(stateful.limited(stream, limits, "0 seconds"), "append").collect())


def test_a_block_ends_by_its_timer(spark):
    got = verdicts(spark, [1000, 2000, 3000, 4000, 20_000, 31_500, 40_000], ((10, 2, 30), (60, 3, 20)), 400_000)
    assert got == [(1000, "allowed"), (2000, "allowed"), (3000, "limit 10"), (4000, "blocked"), (20_000, "blocked"), (31_500, "blocked"), (33_000, "freed"), (40_000, "allowed"), (400_000, "allowed")]


class Told:
    """Map state without a clock."""

    def __init__(self):
        self.words = {}

    def containsKey(self, key):
        return key in self.words

    def updateValue(self, key, value):
        self.words[key] = value


def test_a_word_is_told_once_while_it_is_kept():
    alerts = stateful.WordAlerts(1000)
    alerts.told = Told()
    tell = lambda *words: [r.word for r in alerts.handleInputRows((1,), iter([{"word": w} for w in words]), None)]
    assert tell("b", "a", None, "b") == ["a", "b"] and tell("a", "c") == ["c"]
    alerts.told.words.clear()  # expired
    assert tell("a") == ["a"]


def test_offsets_name_the_days():
    options = {"path": "/none", "start": "2000-01-30", "until": "2000-02-02", "again": json.dumps({"1999.12.31": 1}), "run": "2"}
    reader = DayStreamReader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"next": "2000-02-03", "again": {"1999.12.31": 1}, "run": 2}
    parts = [(p.month, p.days, p.asked) for p in reader.partitions(start, end)]
    assert parts == [("2000.01", ["2000.01.30", "2000.01.31"], 0), ("2000.02", ["2000.02.01", "2000.02.02"], 0), ("1999.12", ["1999.12.31"], 1)]
    assert reader.partitions(end, end) == []
    assert [(r[0], r[3]) for r in reader.read(reader.partitions(start, end)[1])] == [("2000.02.01", False), ("2000.02.02", False)]


def test_a_batch_that_breaks_runs_again(spark, monkeypatch):
    """A fault after the days are written: the next start asks for the same days, and nothing is there twice."""
    lots = star_lots(spark, FOLDER).where("year(trade_date) = 1995 and month(trade_date) <= 2")
    monkeypatch.setattr(daily_run, "RUNS", ("1995-01-31", "1995-02-28"))
    store, folder = daily_run.ingest.scratch(spark, "store"), daily_run.ingest.scratch(spark, "run")
    daily_run.store_twice(lots, store)
    daily_run.run_once(spark, store, folder, daily_run.FIRST, "1995-01-31")
    whole = daily_run.written

    def broken(*args):
        whole(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(daily_run, "written", broken)
    with pytest.raises(Exception, match="lost"):
        daily_run.run_once(spark, store, folder, daily_run.FIRST, "1995-02-28")
    monkeypatch.setattr(daily_run, "written", whole)
    daily_run.run_once(spark, store, folder, daily_run.FIRST, "1995-02-28")
    daily_run.run_once(spark, store, folder, daily_run.FIRST, "1995-02-28")
    state = daily_run.state_of(spark, folder)
    assert state["statistics"]["failed_dates"] == [] and state["statistics"]["total_days_crawled"] == 59
    kept = daily_run.kept_lots(spark, folder)
    assert kept.count() == lots.count() == state["statistics"]["total_records"]
    assert kept.agg(F.sum("price_avg")).first() == lots.agg(F.sum("price_avg")).first()


# Sketches and the row store
def test_merged_sketches_come_within_their_bounds(spark):
    for r in rules.stored_sketches(spark, FOLDER).collect():
        assert r.distinct_error <= 0.08 and r.rank_error <= 0.02


def test_the_row_store_reads_in_parts_with_filters(spark):
    url = "jdbc:derby:memory:tidemark-test;create=true"
    row_store.copy_star(spark, FOLDER, url)
    item = row_store.read_table(spark, url, "lineitem", "l_orderkey", 4)
    assert item.rdd.getNumPartitions() == 4 and item.count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    plan = row_store.joined(spark, url).where("quantity >= 10 and species = 'Brand#1'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10" in plan.replace(" ", "") and "EqualTo(p_brand,Brand#1)" in plan.replace(" ", "")
    empty = spark.createDataFrame([], "k long, name string")
    row_store.write_table(empty, url, "few")
    assert row_store.read_table(spark, url, "few", "k").count() == 0


# Smoothing and the table function
def test_fitted_constants_are_no_worse_than_given_ones(spark):
    from tidemark.plans import smoothing

    rows = smoothing.holt(star_lots(spark, FOLDER)).collect()
    assert rows and all(r.rmse <= r.rmse_given for r in rows)


def test_page_lots_gives_the_columns_asked_for(spark):
    from tidemark.sources import page_rows

    cell = "<td>{}</td>".format
    row = "<tr>" + "".join(map(cell, ["(활)<b>넙치</b>", "동해", "1미", "S/P", "1.5", "1,200", "900", "-1,000"])) + "</tr>"
    html = "<table><tbody>" + row + "<tr><td class='no-data'>x</td>" + "<td>1</td>" * 8 + "</tr><tr><td>few</td></tr></tbody></table><tbody>" + row + "</tbody>"
    pages = spark.createDataFrame([("2020.01.02", 1, html), ("2020.01.03", 1, None), ("2020.01.04", 1, "<tbody></tbody>")], "date string, page int, html string")
    page_rows.register(spark)
    (got,) = spark.sql("SELECT * FROM page_lots(TABLE({p}) PARTITION BY date ORDER BY page)", p=pages).collect()
    assert tuple(got) == ("2020.01.02", "(활)넙치", "넙치", "활", "동해", "1미", "S/P", 1.5, 1200, 900, 1000)
    few = spark.sql("SELECT * FROM page_lots(TABLE({p}) PARTITION BY date, columns => 'price_low, species')", p=pages)
    assert few.columns == ["trade_date", "price_low", "species"] and tuple(few.first()) == ("2020.01.02", 900, "넙치")
    with pytest.raises(Exception, match="no such columns: colour"):
        spark.sql("SELECT * FROM page_lots(TABLE({p}) PARTITION BY date, columns => 'colour')", p=pages)
