"""Indicators, forecasts and decompositions take the daily series whole."""

from collections import defaultdict

import pytest

from tidemark import catalog
from tidemark.sources.lots import star_lots

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    lots, out = defaultdict(list), defaultdict(list)
    for r in star_lots(spark, FOLDER).select("species", "trade_date", "price_avg").collect():
        lots[r.species, r.trade_date].append(r.price_avg)
    for (species, day), prices in sorted(lots.items()):
        out[species].append((day, sum(prices) / len(prices)))
    return out


def rows_of(spark, name):
    return catalog.QUERIES[name](spark, FOLDER).collect()


def test_decomposition_is_daily(spark, series):
    got = {(r.species, r.trade_date): r.trend + r.season + r.residual for r in rows_of(spark, "ml_decomposition")}
    assert got == {(s, day): pytest.approx(p) for s, x in series.items() for day, p in x}


def test_forecasts_start_from_the_last_day(spark, series):
    got = {(r.species, r.step): r.naive for r in rows_of(spark, "ml_forecasts")}
    assert got == {(s, h): pytest.approx(x[-1][1]) for s, x in series.items() for h in range(1, 8)}


def test_daily_indicators(spark, series):
    want = {}
    for s, x in series.items():
        e7 = e30 = e12 = e26 = x[0][1]
        signal, up, down, before = 0.0, 0.0, 0.0, x[0][1]
        for i, (day, p) in enumerate(x):
            e7, e30, e12, e26 = (e + (p - e) * 2 / (n + 1) for e, n in ((e7, 7), (e30, 30), (e12, 12), (e26, 26)))
            signal += (e12 - e26 - signal) / 5
            gain, loss, before = max(p - before, 0), max(before - p, 0), p
            up, down = (up + gain / 14, down + loss / 14) if i <= 14 else ((up * 13 + gain) / 14, (down * 13 + loss) / 14)
            want[s, day] = pytest.approx([e7, e30, e12 - e26, signal, 50 if i <= 14 else 100 if down == 0 else 100 - 100 / (1 + up / down)], abs=1e-3)
    assert {(r.species, r.trade_date): [r.ema7, r.ema30, r.macd, r.signal, r.rsi14] for r in rows_of(spark, "ts_indicators_daily")} == want
