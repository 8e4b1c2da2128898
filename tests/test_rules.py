"""Hand-made cases of parsing, cleaning, series functions, sinks and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import recursive
from tidemark.operators import cleaning
from tidemark.sources import html, lots, side_tables, sinks
from tidemark.streaming import streams


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("쭈구미", "쭈꾸미"), ("넙치", "넙치"), (None, None)])
def test_alias(spark, raw, want):
    assert one(spark, cleaning.species_alias, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("08미", "8미"), ("09/10", "09/10"), ("10미", "10미"), ("010미", "10미")])
def test_spec_padding(spark, raw, want):
    assert one(spark, cleaning.spec_unpadded, raw) == want


@pytest.mark.parametrize(("hla", "want"), [((10, 10, 0), 10), ((11, 10, 0), 10), ((10, 0, 0), 0), ((10, 8, 9), 9)])
def test_average_repair(spark, hla, want):
    df = spark.createDataFrame([hla], "h long, l long, a long")
    assert df.select(cleaning.avg_repaired(F.col("h"), F.col("l"), F.col("a"))).first()[0] == want


@pytest.mark.parametrize(("origin", "want"), [("일본", True), ("부산", False), (None, False), ("동해(원양)", True), ("원양", False)])
def test_foreign(spark, origin, want):
    assert one(spark, cleaning.is_foreign, origin) is want


@pytest.mark.parametrize(("spec", "want"), [("특대", "size_grade"), ("20미", "count"), ("300/400", "weight_range"), ("10/11미", "count_range"), ("바라", "other"), (None, "null")])
def test_spec_class(spark, spec, want):
    assert one(spark, cleaning.spec_class, spec) == want


@pytest.mark.parametrize(("row", "want"), [(("a", 10, 9, 9, 1.0), True), (("a", 8, 9, 9, 1.0), False), (("a", 9, 9, 0, 1.0), True), (("a", 1000, 1000, 995, 1.0), True), (("a", 1000, 1000, 980, 1.0), False), (("a", 9, 9, 9, -1.0), False), (("", 9, 9, 9, 1.0), False), ((None, 9, 9, 9, 1.0), False)])
def test_validity(spark, row, want):
    df = spark.createDataFrame([row], "species string, price_high long, price_low long, price_avg long, quantity double")
    assert df.select(cleaning.is_valid()).first()[0] is want


ROW = "<tr>" + "".join(f"<td>{c}</td>" for c in ("<b>(활)방어</b>", "일본&nbsp;", "2미", "kg", "203", "30,000", "5,000", "13,900")) + "</tr>"


def test_pages(spark):
    seven = "<tr>" + "<td>x</td>" * 7 + "</tr>"
    blank = ROW.replace("<b>(활)방어</b>", " ")
    broken = ROW.replace("203", "1.2.3")
    minus = ROW.replace("203", "-5").replace("13,900", "")
    empty = "<tr><td class='no-data'>x</td>" + "<td>x</td>" * 8 + "</tr>"
    pages = [("d", 1, f"<table><TBODY id=x>{ROW}{seven}{blank}{broken}{minus}{empty}</TBODY></table><tbody>{ROW}</tbody>"), ("d", 2, "조회된 경락시세가 없습니다 " + ROW), ("d", 3, None)]
    rows = html.parse_pages(spark.createDataFrame(pages, "date string, page int, html string")).orderBy("line").collect()
    assert [(r.species, r.state, r.origin, r.quantity, r.price_high, r.price_low, r.price_avg) for r in rows] == [("방어", "활", "일본", 203.0, 30000, 5000, 13900), ("방어", "활", "일본", 5.0, 30000, 5000, 0)]


@pytest.mark.parametrize(("page", "want"), [('<a class="arr last" href="#" onclick="fnList(12)">', 12), ("fnList(3) fnList(11) fnList(7)", 11), ("", 1)])
def test_page_count(spark, page, want):
    assert one(spark, html.page_count, page) == want


def test_recursions_against_loops():
    x = np.random.default_rng(1).normal(100, 10, 200)
    want = [x[0]]
    for v in x[1:]:
        want.append(v * 2 / 8 + want[-1] * 6 / 8)
    assert np.allclose(recursive.ema(x, 7), want)
    assert np.allclose(recursive.ema(np.array([1.0, 2, 3]), 3), [1, 1.5, 2.25])
    assert (recursive.rsi(x)[:15] == 50).all() and (recursive.rsi(np.arange(15.0)) == 50).all()
    assert recursive.rsi(np.arange(30.0))[-1] == 100
    trend, season, rest = recursive.stl(x)
    assert np.allclose(trend + season + rest, x)
    t = np.arange(256)
    tone = np.cos(2 * np.pi * 0.02 * t) + 0.5 * np.cos(2 * np.pi * 0.2 * t)
    modes = recursive.vmd(tone, 2)
    assert np.abs(modes.sum(0) - tone)[20:-20].max() < 0.2
    assert len(recursive.holt_winters(x)) == 7 and len(recursive.arima_forecast(x)) == 7 and len(recursive.holt_winters(x[:3])) == 7


def test_loess_and_stl():
    rng = np.random.default_rng(3)
    y, own = rng.normal(0, 1, 60), rng.uniform(0.2, 1, 60)
    at = np.arange(-1.0, 61.0)
    got = recursive.loess(y, 9, own, at)
    for x0, value in zip(at, got):
        near = sorted(range(60), key=lambda i: (abs(i - x0), i))[:9]
        first = min(max(int(np.round(x0)) - 4, 0), 51)
        near = list(range(first, first + 9))
        reach = max(abs(i - x0) for i in near)
        w = np.array([max(1 - (abs(i - x0) / reach) ** 3, 0) ** 3 * own[i] for i in near])
        line = np.polyfit(near, y[near], 1, w=np.sqrt(w))
        assert abs(np.polyval(line, x0) - value) < 1e-6
    t = np.arange(280.0)
    season = np.tile([3, 1, 0, -2, -4, 0, 2.0], 40)
    x = 50 + 0.1 * t + season + rng.normal(0, 0.1, 280)
    x[[40, 111, 200]] += 60
    trend, found, rest = recursive.stl(x)
    assert np.allclose(trend + found + rest, x)
    assert np.abs(trend - 50 - 0.1 * t)[10:-10].max() < 0.5 and np.abs(found - season)[10:-10].max() < 0.5
    assert (rest[[40, 111, 200]] > 50).all()


def test_autoregression_with_moving_average_follows_its_series():
    rng = np.random.default_rng(4)
    e, d = rng.normal(0, 0.01, 500), np.zeros(500)
    for i in range(2, 500):
        d[i] = 0.5 * d[i - 1] - 0.2 * d[i - 2] + e[i] + 0.4 * e[i - 1]
    x = 1000 * np.exp(np.cumsum(d))
    errors = [(abs(recursive.arima_forecast(x[:n], 1)[0] / x[n] - 1), abs(x[n - 1] / x[n] - 1)) for n in range(300, 490)]
    assert np.mean([a for a, _ in errors]) < 0.9 * np.mean([b for _, b in errors])


def test_search_finds_the_best_candidate(spark):
    x = np.cos(np.arange(64) * 0.7) + np.cos(np.arange(64) * 2.0)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "species string, at int, residual double")
    best = recursive.searched(rows, (2, 3), (200, 5000), 50).first()
    want = min(((float(np.mean((recursive.vmd(x, k, a, rounds=50).sum(0) - x) ** 2)), k, a) for k in (2, 3) for a in (200, 5000)))
    assert (best.n_modes, best.alpha, best.tried) == (want[1], want[2], 4) and abs(best.error - want[0]) < 1e-12


def test_days_replace_themselves_and_prune(spark, tmp_path):
    path = str(tmp_path / "lots")
    row = lambda day, p: (day, "a", "a", None, "o", "1미", "kg", 1.0, p, p, p)
    schema = "trade_date string, species_raw string, species string, state string, origin string, spec string, packaging string, quantity double, price_high long, price_low long, price_avg long"
    write = lambda rows: spark.createDataFrame(rows, schema).withColumn("day", F.to_date("trade_date", "yyyy.MM.dd")).withColumns({"year": F.year("day"), "month": F.date_format("day", "MM")}).drop("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
    write([row("2024.01.02", 1), row("2024.02.03", 2)])
    write([row("2024.02.03", 5)])
    df = lots.read_lots(spark, path, "2024-02-01", "2024-02-28", ["trade_date", "price_avg"])
    assert [(str(r[0]), r[1]) for r in df.collect()] == [("2024-02-03", 5)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((" in plan or "PartitionFilters: [(" in plan
    assert lots.read_lots(spark, path).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02", "a", None, 1), ("2024-01-03", "b", "x", 2)], "trade_date string, species string, state string, price_avg long").withColumn("trade_date", F.to_date("trade_date"))
    sinks.write_days(df, f"{tmp_path}/days")
    sinks.write_days(df.where("species = 'a'").withColumn("price_avg", F.lit(9).cast("long")), f"{tmp_path}/days")
    assert sorted(r.price_avg for r in spark.read.parquet(f"{tmp_path}/days").collect()) == [2, 9]
    sinks.writer("json")(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").agg(F.sum("record_count")).first()[0] == 2
    sinks.append_csv(df, f"{tmp_path}/csv")
    sinks.append_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 4
    assert sinks.insert_absent(df, df.where("species = 'a'"), ["species"]).count() == 1
    sinks.compact(df, f"{tmp_path}/compact")
    assert spark.read.parquet(f"{tmp_path}/compact").count() == 2
    assert sinks.fan_out(df, [lambda d: None]) and not sinks.fan_out(df, [lambda d: 1 / 0])


def test_streamed_inserts_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    df.write.parquet(f"{tmp_path}/in")
    for turn in range(2):
        stream = spark.readStream.schema("k int, v string").parquet(f"{tmp_path}/in")
        streams.insert_if_absent(stream, f"{tmp_path}/out", ["k"], f"{tmp_path}/c{turn}")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_side_tables(spark):
    body = '{"daily": {"time": ["2024-01-01", "2024-01-02"], "sunshine_duration": [3600, 0], "wind": [1.5, null]}}'
    rows = side_tables.daily_from_parallel(spark.createDataFrame([("busan", body)], "location string, body string"), ["sunshine_duration", "wind"]).orderBy("date").collect()
    assert [(r.date, r.sunshine_hours, r.wind) for r in rows] == [("2024.01.01", 1.0, 1.5), ("2024.01.02", 0.0, None)]
    readings = spark.createDataFrame([("s", "2024-01-01 00:00:00", 10.0, 1.0, 350.0), ("s", "2024-01-01 01:00:00", 12.0, 3.0, 10.0)], "station_code string, ts string, water_temp double, wind_speed double, wind_dir double").withColumn("ts", F.to_timestamp("ts"))
    r = side_tables.station_daily(readings).first()
    assert (r.water_temp_avg, r.wind_speed_max, round(r.wind_dir_avg) % 360, r.wind_dir_plain) == (11.0, 3.0, 0, 180.0)
    retail = spark.createDataFrame([("2024", "01/02", "평균", "a", "retail", "1,200"), ("2024", "01/02", "평균", "a", "wholesale", "1,000"), ("2024", "01/02", "서울", "a", "retail", "9"), ("2024", "01/03", "평균", "a", "retail", "-")], "yyyy string, regday string, countyname string, item_name string, type string, price string")
    r = side_tables.price_chain(side_tables.retail_rows(retail)).first()
    assert (r.retail, round(r.markup_pct, 6), r.retail_days) == (1200.0, 20.0, 1)
    state = spark.createDataFrame([("x", "running", "2024.01.02", (1, 5, ["2024.01.03"]))], "last_updated string, status string, last_completed_date string, statistics struct<total_days_crawled:bigint,total_records:bigint,failed_dates:array<string>>")
    assert str(side_tables.resume_date(state).first()[0]) == "2024-01-03"
    after = side_tables.marked(state, "2024.01.03", 7).first()
    assert after.statistics.total_records == 12 and after.statistics.failed_dates == [] and after.last_completed_date == "2024.01.03"
    assert side_tables.marked(state, "2024.01.04", 0, failed=True).first().last_completed_date == "2024.01.02"
    gaps = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", 1, None)], "location string, date int, v double")
    assert [r.v for r in side_tables.filled(gaps, ["v"]).orderBy("location", "date").collect()] == [2.0, 2.0, 2.0]


def test_memo_makes_a_frame_again_when_it_is_old(spark):
    from tidemark.functions.memo import Memo

    now, made = [0.0], []

    def make():
        made.append(1)
        return spark.range(3)

    memo = Memo(10, lambda: now[0])
    first = memo.get("a", make)
    assert memo.get("a", make) is first and len(made) == 1
    now[0] = 10.0
    second = memo.get("a", make)
    assert second is not first and len(made) == 2 and second.count() == 3 and not first.is_cached
    memo.clear()
    assert not memo.held


@pytest.mark.parametrize(("answers", "want"), [([200], ("x", True, 1, 1.5)), ([429, 429, 200], ("x", True, 3, 184.5)), ([-1, 500, -1], ("", False, 3, 5.5)), ([-2, 200], ("", False, 1, 1.5))])
def test_retries(answers, want):
    from tidemark.sources import pages

    assert pages.fetched(lambda i: (answers[i], "x"), 3) == want
    assert pages.pages_of("<a href='#' onclick='go(4)'><a class='arr last' onclick=\"go(9)\">") == 9 and pages.pages_of("<a onclick='f(3)'><a onclick='f(2)'>") == 3 and pages.pages_of("") == 1


def test_limits_block_and_expire(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{i:02d}") for i in range(4)] + [(1, "2024-01-01 00:05:00")]
    spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/e")
    got = streams.settled(streams.limited(stream, ((60, 2, 60),)), "append").orderBy("ts").collect()
    assert [r.verdict for r in got] == ["allowed", "allowed", "blocked", "blocked", "allowed"]


def test_native_queries_run_no_python(spark):
    from tidemark import catalog

    for name in ("daily_summary", "ts_trailing", "agg_config_daily"):
        assert "Python" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
