"""Daily price series and their windows: winsorised prices, lags, momentum, supply, calendar, targets, splits and metrics.

All windows of a series share one partitioning and order, so a query shuffles once for the daily aggregate and
once for its windows. Series are species; day_idx counts the trading days of a series.
"""

_DAILY = "SELECT species, trade_date, avg(price_avg) AS p, max(price_high) AS hi, min(price_low) AS lo, count(*) AS n, count(DISTINCT origin) AS o, sum(quantity) AS q FROM lots GROUP BY species, trade_date"
_D = f"d AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY trade_date) - 1 AS i FROM ({_DAILY}) x)"
_W = "WINDOW w AS (PARTITION BY species ORDER BY i), w7 AS (PARTITION BY species ORDER BY i ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), w30 AS (PARTITION BY species ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), w90 AS (PARTITION BY species ORDER BY i ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING), c7 AS (PARTITION BY species ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_PI = "3.141592653589793"
_NAIVE = f"f AS (SELECT species, i, p, lead(p, 7) OVER (PARTITION BY species ORDER BY i) AS a, lag(p, 1) OVER (PARTITION BY species ORDER BY i) AS prev, avg(p) OVER (PARTITION BY species ORDER BY i ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s7, stddev_pop(p) OVER (PARTITION BY species ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS sd, count(*) OVER (PARTITION BY species) AS n FROM d)"
_SUPPLY = """c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS di, count(*) AS ml, sum(quantity) AS mq FROM lots GROUP BY trade_date),
s AS (SELECT DISTINCT species FROM lots), g AS (SELECT species, trade_date, sum(quantity) AS q, count(*) AS n FROM lots GROUP BY species, trade_date),
z AS (SELECT s.species, c.trade_date, c.di, c.ml, c.mq, coalesce(g.q, 0) AS q, coalesce(g.n, 0) AS n FROM c CROSS JOIN s LEFT JOIN g ON g.species = s.species AND g.trade_date = c.trade_date),
k AS (SELECT *, sum(q) OVER w3 / 7 AS q7, sum(n) OVER w3 / 7.0 AS n7, sum(ml) OVER w3 / 7.0 AS ml7, sum(mq) OVER w3 / 7 AS mq7, avg(q) OVER (PARTITION BY species ORDER BY di ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS q30 FROM z WINDOW w3 AS (PARTITION BY species ORDER BY di ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""

QUERIES = {
    "daily_summary": f"WITH {_D} SELECT species, trade_date, round(p, 6) AS price, hi AS high, lo AS low, n AS n_lots, q AS qty, round(avg(p) OVER (PARTITION BY species ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7, round(avg(p) OVER (PARTITION BY species ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS ma30 FROM d",
    "ts_winsor_bounds": """WITH x AS (SELECT *, dense_rank() OVER (PARTITION BY species, packaging ORDER BY trade_date) - 1 AS i FROM lots),
b AS (SELECT species, packaging, i, trade_date, price_avg, PCT(CAST(price_avg AS DOUBLE), 0.1) OVER r AS lo, PCT(CAST(price_avg AS DOUBLE), 0.9) OVER r AS hi, count(*) OVER r AS n FROM x WINDOW r AS (PARTITION BY species, packaging ORDER BY i RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT species, packaging, trade_date, count(*) AS lots, round(avg(CASE WHEN n >= 10 THEN least(greatest(price_avg, lo), hi) ELSE price_avg END), 6) AS winsorised, round(avg(price_avg), 6) AS plain FROM b GROUP BY species, packaging, trade_date""",
    "ts_origin_weights": """WITH x AS (SELECT *, dense_rank() OVER (PARTITION BY species ORDER BY trade_date) - 1 AS i FROM lots), o AS (SELECT DISTINCT species, origin, i FROM x),
t AS (SELECT species, origin, i + k.k AS i, count(*) AS seen FROM o CROSS JOIN (SELECT SERIES(1, 30) AS k) k GROUP BY species, origin, i + k.k), m AS (SELECT species, i, max(seen) AS most FROM t GROUP BY species, i),
w AS (SELECT x.species, x.trade_date, x.price_avg AS p, CAST(coalesce(t.seen, 1) AS DOUBLE) / coalesce(m.most, 1) AS w FROM x LEFT JOIN t ON t.species = x.species AND t.origin = x.origin AND t.i = x.i LEFT JOIN m ON m.species = x.species AND m.i = x.i)
SELECT species, trade_date, round(CASE WHEN sum(w) > 0 THEN sum(p * w) / sum(w) ELSE avg(p) END, 6) AS weighted, round(avg(p), 6) AS plain FROM w GROUP BY species, trade_date""",
    "ts_weighted_mean": "SELECT species, trade_date, round(CASE WHEN sum(quantity) > 0 THEN sum(price_avg * quantity) / sum(quantity) ELSE avg(price_avg) END, 6) AS price FROM lots GROUP BY species, trade_date",
    "ts_outliers": f"WITH {_D}, e AS (SELECT species, trade_date, i, p, avg(p) OVER w30 AS m, stddev_pop(p) OVER w30 AS s FROM d {_W}) SELECT species, count(CASE WHEN i >= 30 AND s > 0 AND abs(p - m) > 3 * s THEN 1 END) AS outliers, count(*) AS days FROM e GROUP BY species",
    "ts_lags": f"WITH {_D} SELECT species, trade_date, round(p, 6) AS price_t, round(coalesce(lag(p, 1) OVER w, p), 6) AS price_lag1, round(coalesce(lag(p, 7) OVER w, lag(p, 1) OVER w, p), 6) AS price_lag7, round(coalesce(lag(p, 30) OVER w, lag(p, 1) OVER w, p), 6) AS price_lag30 FROM d {_W}",
    "ts_momentum": f"WITH {_D}, l AS (SELECT *, coalesce(lag(p, 1) OVER w, p) AS p1, coalesce(lag(p, 7) OVER w, lag(p, 1) OVER w, p) AS p7, coalesce(lag(p, 30) OVER w, lag(p, 1) OVER w, p) AS p30, lag(p, 14) OVER w AS p14, avg(p) OVER w7 AS a7, avg(p) OVER w30 AS a30 FROM d {_W}) SELECT species, trade_date, round(CASE WHEN p1 > 0 THEN (p - p1) / p1 * 100 ELSE 0 END, 6) AS m1, round(CASE WHEN p7 > 0 THEN (p - p7) / p7 * 100 ELSE 0 END, 6) AS m7, round(CASE WHEN p30 > 0 THEN (p - p30) / p30 * 100 ELSE 0 END, 6) AS m30, round(CASE WHEN a30 > 0 THEN a7 / a30 - 1 ELSE 0 END, 6) AS m7v30, round(CASE WHEN p14 > 0 THEN (p - p14) / p14 * 100 ELSE 0 END, 6) AS m14 FROM l",
    "ts_centred": f"WITH {_D} SELECT species, trade_date, round(sum(p) OVER c7 / 7, 6) AS c7, round(sum(p) OVER (PARTITION BY species ORDER BY i ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) / 30, 6) AS c30, CASE WHEN i >= 6 THEN round(avg(p) OVER (PARTITION BY species ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) END AS valid7 FROM d {_W}",
    "ts_bollinger_zscore": f"WITH {_D}, e AS (SELECT *, avg(p) OVER w30 AS a, stddev_pop(p) OVER w30 AS s FROM d {_W}) SELECT species, trade_date, round(CASE WHEN s > 0 THEN (p - (a - 2 * s)) / (4 * s) ELSE 0.5 END, 6) AS bollinger, round(CASE WHEN s > 0 THEN (p - a) / s ELSE 0 END, 6) AS z FROM e",
    "ts_supply_own": f"WITH {_SUPPLY}, l AS (SELECT *, coalesce(lag(q7, 7) OVER w, first_value(q7) OVER w) AS q7b, coalesce(lag(n7, 7) OVER w, first_value(n7) OVER w) AS n7b, lag(n7, 14) OVER w AS n14 FROM k WINDOW w AS (PARTITION BY species ORDER BY di)) SELECT species, trade_date, round(q7, 6) AS qty_7d, round(n7, 6) AS lots_7d, round(CASE WHEN coalesce(q30, q7) > 0 THEN q7 / coalesce(q30, q7) ELSE 1 END, 6) AS ratio, round((q7 - q7b) / greatest(q7b, 1), 6) AS qty_change, round((n7 - n7b) / greatest(n7b, 1), 6) AS lots_change, CASE WHEN di >= 14 AND n7 < n14 * 0.5 THEN 1 ELSE 0 END AS lots_drop, CASE WHEN q30 > 0 AND q7 < q30 * 0.5 THEN 1 ELSE 0 END AS qty_drop FROM l",
    "ts_streak": f"WITH {_D}, g AS (SELECT species, trade_date, CASE WHEN DAYS(trade_date, lag(trade_date) OVER w) <= 7 THEN 0 ELSE 1 END AS new_ FROM d {_W}), s AS (SELECT species, sum(new_) OVER (PARTITION BY species ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g) SELECT species, max(n) AS longest FROM (SELECT species, island, count(*) AS n FROM s GROUP BY species, island) x GROUP BY species",
    "ts_gaps": f"WITH {_D} SELECT species, trade_date, coalesce(DAYS(trade_date, lag(trade_date) OVER w), 0) AS gap, CASE WHEN coalesce(DAYS(lead(trade_date) OVER w, trade_date), 1) > 2 THEN 1 ELSE 0 END AS pre_holiday FROM d {_W}",
    "ts_diversity": f"WITH {_D} SELECT species, trade_date, round(avg(o) OVER w7, 6) AS origins, round(avg(q / greatest(n, 1)) OVER w7, 6) AS lot_size, round(avg(hi - lo) OVER w7, 6) AS spread FROM d {_W}",
    "ts_seasonal": f"WITH {_D} SELECT species, trade_date, round(p / avg(p) OVER (PARTITION BY species, month(trade_date)), 6) AS vs_month, round(sin(2 * {_PI} * month(trade_date) / 12), 6) AS sin_month, round(cos(2 * {_PI} * month(trade_date) / 12), 6) AS cos_month, CASE WHEN month(trade_date) IN (11, 12, 1, 2) THEN 1 ELSE 0 END AS peak FROM d",
    "ts_calendar": f"SELECT DISTINCT trade_date, DOW(trade_date) AS dow, month(trade_date) AS month, day(trade_date) AS dom, CASE WHEN DOW(trade_date) >= 5 THEN 1 ELSE 0 END AS weekend, WOY(trade_date) AS week, quarter(trade_date) AS quarter, CASE WHEN DOW(trade_date) <= 4 THEN DOW(trade_date) / 4.0 ELSE 1.0 END AS week_pos, greatest(0, 4 - DOW(trade_date)) AS days_left FROM lots".replace("DOW(trade_date) / 4.0 ELSE 1.0 END", "CAST(DOW(trade_date) AS DOUBLE) / 4 ELSE CAST(1 AS DOUBLE) END"),
    "ts_fourier": f"SELECT DISTINCT trade_date, round(sin(2 * {_PI} * DOY(trade_date) / 365), 6) AS s365, round(cos(2 * {_PI} * DOY(trade_date) / 365), 6) AS c365, round(sin(2 * {_PI} * DOY(trade_date) / CAST(182.5 AS DOUBLE)), 6) AS s182, round(cos(2 * {_PI} * DOY(trade_date) / CAST(182.5 AS DOUBLE)), 6) AS c182, round(sin(2 * {_PI} * DOW(trade_date) / 7), 6) AS s7, round(cos(2 * {_PI} * DOW(trade_date) / 7), 6) AS c7 FROM lots",
    "ts_target": f"WITH {_D}, l AS (SELECT *, ln(greatest(p, 1)) AS lp, ln(greatest(sum(p) OVER c7 / 7, 1)) AS lc FROM d {_W}) SELECT species, trade_date, round(lead(lp, 7) OVER (PARTITION BY species ORDER BY i), 6) AS y, round(lead(lc, 7) OVER (PARTITION BY species ORDER BY i), 6) AS y_smooth FROM l",
    "ts_weekly_target": f"WITH {_D}, l AS (SELECT species, i, trade_date, ln(greatest(p, 1)) AS lp, count(*) OVER (PARTITION BY species) AS n FROM d), m AS (SELECT species, i, trade_date, CASE WHEN i + 8 <= n THEN avg(lp) OVER (PARTITION BY species ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) ELSE lead(lp) OVER (PARTITION BY species ORDER BY i) END AS wk FROM l) SELECT species, trade_date, round(lead(wk, 7) OVER (PARTITION BY species ORDER BY i), 6) AS y FROM m",
    "ts_partner": f"WITH {_D}, a AS (SELECT * FROM d WHERE species = 'Brand#1'), b AS (SELECT trade_date, p FROM d WHERE species = 'Brand#2'), j AS (SELECT a.i, a.trade_date, a.p, b.p AS bp FROM a LEFT JOIN b ON a.trade_date = b.trade_date) SELECT trade_date, round(coalesce(lag(bp) OVER (ORDER BY i), bp, p), 6) AS partner_lag1, round(coalesce(avg(bp) OVER (ORDER BY i ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), lag(bp) OVER (ORDER BY i), bp, p), 6) AS partner_a7, round(p / coalesce(lag(bp) OVER (ORDER BY i), bp, p), 6) AS ratio FROM j",
    "ts_yoy_lag": "WITH y AS (SELECT species, year(trade_date) AS year, avg(price_avg) AS m FROM lots GROUP BY species, year(trade_date)) SELECT species, year, round(m, 6) AS mean, round((m - lag(m) OVER (PARTITION BY species ORDER BY year)) / lag(m) OVER (PARTITION BY species ORDER BY year) * 100, 4) AS yoy_pct FROM y",
    "ts_ranks": "SELECT species, rank() OVER (ORDER BY cv DESC) AS rank_, round(percent_rank() OVER (ORDER BY cv), 6) AS more_volatile_than, ntile(4) OVER (ORDER BY cv, species) AS quarter FROM (SELECT species, stddev_pop(price_avg) / avg(price_avg) AS cv FROM lots GROUP BY species) x",
    "ts_recency_weight": f"WITH {_D} SELECT species, trade_date, round(exp(2.0 * i / count(*) OVER (PARTITION BY species)), 6) AS weight FROM d",
    "ts_range_days": f"WITH {_D}, e AS (SELECT species, trade_date, p, DAYS(trade_date, DATE '1990-01-01') AS dn FROM d) SELECT species, trade_date, count(*) OVER r AS days, round(avg(p) OVER r, 6) AS mean7 FROM e WINDOW r AS (PARTITION BY species ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)",
    "ts_normalised": f"WITH {_D}, t AS (SELECT species, avg(CASE WHEN i < 0.8 * days THEN p END) AS m, stddev_pop(CASE WHEN i < 0.8 * days THEN p END) AS s FROM (SELECT *, count(*) OVER (PARTITION BY species) AS days FROM d) x GROUP BY species) SELECT d.species, d.trade_date, round(least(10, greatest(-10, (d.p - t.m) / CASE WHEN t.s < 0.00000001 THEN 1 ELSE t.s END)), 6) AS z FROM d JOIN t ON t.species = d.species",
    "ml_naive": f"WITH {_D}, {_NAIVE} SELECT species, count(*) AS n, round(avg(abs(p - a) / CASE WHEN a > 0 THEN a ELSE 1 END) * 100, 6) AS mape, round(sqrt(avg((p - a) * (p - a))), 4) AS rmse, round(avg(abs(p - a)), 6) AS mae FROM f WHERE a IS NOT NULL GROUP BY species",
    "ml_sma": f"WITH {_D}, {_NAIVE} SELECT species, round(avg(CASE WHEN a > 0 THEN abs(s7 - a) / a END) * 100, 6) AS mape_skipping, round(1 - sum((a - s7) * (a - s7)) / sum((a - m) * (a - m)), 4) AS r2 FROM (SELECT *, avg(a) OVER (PARTITION BY species) AS m FROM f WHERE a IS NOT NULL AND s7 IS NOT NULL) x GROUP BY species",
    "ml_adaptive_k": f"WITH {_D}, r AS (SELECT species, stddev_pop(p) AS s, stddev_pop(CASE WHEN i >= days - 90 THEN p END) AS s90, max(days) AS n FROM (SELECT *, count(*) OVER (PARTITION BY species) AS days FROM d) x GROUP BY species) SELECT species, CASE WHEN n < 90 THEN 3 WHEN s90 > s THEN 5 ELSE 3 END AS k FROM r",
    "ml_time_folds": f"""WITH {_D}, n AS (SELECT species, count(*) AS n FROM d GROUP BY species), f AS (SELECT n.species, n.n, k.k AS fold, BUCKET(n.n / 2.0) AS base, BUCKET((n.n - BUCKET(n.n / 2.0)) / 5.0) AS step FROM n CROSS JOIN (SELECT SERIES(0, 4) AS k) k)
SELECT f.species, f.fold, count(CASE WHEN d.i < f.base + f.fold * f.step THEN 1 END) AS train, count(CASE WHEN d.i >= f.base + f.fold * f.step AND d.i < f.base + (f.fold + 1) * f.step THEN 1 END) AS test FROM f JOIN d ON d.species = f.species WHERE f.step >= 10 AND f.base >= 100 GROUP BY f.species, f.fold""",
    "ml_rolling_origins": f"WITH {_D}, {_NAIVE} SELECT species, count(*) AS origins, round(avg(abs(p - a) / a) * 100, 6) AS mape FROM f WHERE i >= 180 AND i < n - 7 AND (i - 180) % 7 = 0 AND a > 0 GROUP BY species",
    "ml_chronological_split": f"WITH {_D} SELECT species, count(CASE WHEN i + 1 <= floor(0.8 * n) THEN 1 END) AS train, count(CASE WHEN i + 1 > floor(0.8 * n) THEN 1 END) AS test FROM (SELECT species, i, count(*) OVER (PARTITION BY species) AS n FROM d) x GROUP BY species",
    "ml_anomalies": f"WITH {_D}, s AS (SELECT species, avg(p) AS m, stddev_pop(p) AS sd, PCT(p, 0.25) AS q1, PCT(p, 0.75) AS q3 FROM d GROUP BY species), r AS (SELECT d.species, d.trade_date, d.p, (d.p - s.m) / s.sd AS z, d.p < q1 - 1.5 * (q3 - q1) OR d.p > q3 + 1.5 * (q3 - q1) AS iqr, count(*) OVER (PARTITION BY d.species) - d.i AS back FROM d JOIN s ON s.species = d.species) SELECT species, trade_date, round(z, 6) AS z, iqr, CASE WHEN abs(z) > 3 THEN 'high' WHEN abs(z) > 2.5 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS kind FROM r WHERE back <= 30 AND (abs(z) > 2 OR iqr)",
    "ml_volatility": f"WITH {_D}, v AS (SELECT species, i, CASE WHEN i >= 29 THEN stddev_samp(p) OVER (PARTITION BY species ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS s, abs(p / lag(p) OVER (PARTITION BY species ORDER BY i) - 1) AS r FROM d) SELECT species, round(max_by(s, i) / max(s), 6) AS index_, CASE WHEN max_by(s, i) / max(s) < 0.33 THEN 'low' WHEN max_by(s, i) / max(s) < 0.66 THEN 'medium' ELSE 'high' END AS label, round(avg(r) * 100, 6) AS mean_move FROM v GROUP BY species",
    "ml_trend": f"WITH {_D}, l AS (SELECT species, i, p, count(*) OVER (PARTITION BY species) - i AS back FROM d), t AS (SELECT species, (avg(i * p) - avg(i) * avg(p)) / (avg(i * i) - avg(i) * avg(i)) AS slope, stddev_pop(p) AS s FROM (SELECT species, CAST(30 - back AS DOUBLE) AS i, p FROM l WHERE back <= 30) x GROUP BY species) SELECT species, round(slope, 4) AS slope, round(least(abs(slope) / nullif(s, 0), 1), 4) AS strength, CASE WHEN slope > 0.1 * s THEN 'up' WHEN slope < -0.1 * s THEN 'down' ELSE 'flat' END AS label FROM t",
    "ml_seasonality": f"WITH {_D}, m AS (SELECT species, month(trade_date) AS month, avg(p) AS m FROM d GROUP BY species, month(trade_date)), o AS (SELECT species, avg(p) AS a FROM d GROUP BY species) SELECT m.species, month, round(m.m / o.a, 6) AS index_, rank() OVER (PARTITION BY m.species ORDER BY m.m DESC) AS rank_ FROM m JOIN o ON o.species = m.species",
    "ev_direction": f"WITH {_D}, {_NAIVE} SELECT species, round(avg(CASE WHEN (a > prev) = (s7 > prev) THEN 1.0 ELSE 0.0 END), 6) AS direction FROM f WHERE a IS NOT NULL AND prev IS NOT NULL GROUP BY species",
    "ev_interval": f"WITH {_D}, {_NAIVE} SELECT species, round(avg(CASE WHEN a BETWEEN s7 - 1.28 * sd AND s7 + 1.28 * sd THEN 100.0 ELSE 0.0 END), 6) AS coverage, round(avg(2.56 * sd), 4) AS width, round(avg(2.56 * sd / a) * 100, 4) AS width_pct FROM f WHERE a IS NOT NULL AND i >= 30 GROUP BY species",
    "ev_conformal": f"WITH {_D}, {_NAIVE} SELECT species, round(PCT(abs(a - p), 0.8), 4) AS q80 FROM f WHERE a IS NOT NULL GROUP BY species",
    "ev_cqr": f"WITH {_D}, {_NAIVE}, b AS (SELECT species, i, a, s7 - sd AS lo, s7 + sd AS hi, greatest(s7 - sd - a, a - s7 - sd) AS score, row_number() OVER (PARTITION BY species ORDER BY i DESC) AS back, count(*) OVER (PARTITION BY species) AS m FROM f WHERE a IS NOT NULL AND i >= 30), q AS (SELECT species, PCT(score, 0.9) AS qhat FROM b WHERE back <= greatest(1, BUCKET(m / 5.0)) GROUP BY species) SELECT b.species, round(max(q.qhat), 4) AS qhat, round(avg(CASE WHEN a BETWEEN lo - q.qhat AND hi + q.qhat THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM b JOIN q ON q.species = b.species GROUP BY b.species",
    "ev_pinball": f"WITH {_D}, {_NAIVE} SELECT species, round(avg(greatest(0.1 * (a - (s7 - sd)), -0.9 * (a - (s7 - sd)))), 4) AS p10, round(avg(greatest(0.9 * (a - (s7 + sd)), -0.1 * (a - (s7 + sd)))), 4) AS p90 FROM f WHERE a IS NOT NULL AND i >= 30 GROUP BY species",
    "ev_losses": f"WITH {_D}, {_NAIVE} SELECT species, round(avg(2 * abs(p - a) / (abs(p) + abs(a))) * 100, 6) AS smape, round(avg(CASE WHEN abs(p - a) <= 1 THEN 0.5 * (p - a) * (p - a) ELSE abs(p - a) - 0.5 END), 4) AS huber FROM f WHERE a IS NOT NULL GROUP BY species",
    "ev_best_variant": f"WITH {_D}, {_NAIVE}, m AS (SELECT species, avg(abs(p - a) / a) AS naive, avg(abs(s7 - a) / a) AS sma FROM f WHERE a > 0 AND s7 IS NOT NULL GROUP BY species) SELECT species, CASE WHEN naive <= sma THEN 'naive' ELSE 'sma' END AS best, CASE WHEN least(naive, sma) < 0.1 THEN 'A' WHEN least(naive, sma) < 0.2 THEN 'B' WHEN least(naive, sma) < 0.3 THEN 'C' ELSE 'D' END AS tier, round((naive + sma) / 2 * 100, 6) AS ensemble_metric FROM m",
    "ev_direction_previous": f"WITH {_D}, {_NAIVE}, g AS (SELECT species, a > lag(a) OVER (PARTITION BY species ORDER BY i) AS up, s7 > lag(s7) OVER (PARTITION BY species ORDER BY i) AS guess FROM f WHERE a IS NOT NULL AND s7 IS NOT NULL) SELECT species, round(avg(CASE WHEN up = guess THEN 1.0 ELSE 0.0 END), 6) AS direction FROM g WHERE up IS NOT NULL AND guess IS NOT NULL GROUP BY species",
    "ev_split_conformal": f"WITH {_D}, {_NAIVE}, b AS (SELECT species, i, a, s7, abs(a - s7) AS r, row_number() OVER (PARTITION BY species ORDER BY i) AS rn, count(*) OVER (PARTITION BY species) AS m FROM f WHERE a IS NOT NULL AND i >= 30), q AS (SELECT species, PCT(r, 0.8) AS q FROM b WHERE rn <= BUCKET(0.8 * m) GROUP BY species) SELECT b.species, round(max(q.q), 4) AS half_width, round(avg(CASE WHEN b.r <= q.q THEN 1.0 ELSE 0.0 END), 6) AS held_out_coverage FROM b JOIN q ON q.species = b.species WHERE rn > BUCKET(0.8 * m) GROUP BY b.species",
}
