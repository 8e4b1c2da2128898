"""Aggregation studies over lots: summaries, distributions, dominance, correlation, row reduction, funnels."""

_SHARES = """WITH c AS (SELECT species, coalesce({k}, '(null)') AS v, count(*) AS n FROM lots {where} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY n DESC, v) AS rn, sum(n) OVER (PARTITION BY species) AS total, count(*) OVER (PARTITION BY species) AS kinds FROM c)
SELECT species, v AS dominant, round(100.0 * n / total, 1) AS pct, CAST(total AS BIGINT) AS total, kinds, {flag} FROM r WHERE rn = 1"""
_DAILY = "SELECT species, trade_date, avg(price_avg) AS p, sum(quantity) AS q, sum(price_avg * quantity) / nullif(sum(quantity), 0) AS w FROM lots GROUP BY species, trade_date"
_CORR = "round((avg({x} * {y}) - avg({x}) * avg({y})) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 4)"

QUERIES = {
    "agg_config_daily": "SELECT species, state, packaging, trade_date, round(avg(price_avg), 6) AS price, max(price_high) AS high, min(price_low) AS low, count(*) AS n_lots, count(DISTINCT nullif(origin, '')) AS n_origins, sum(quantity) AS qty FROM lots GROUP BY species, state, packaging, trade_date",
    "agg_species_daily": "SELECT trade_date, species, round(avg(price_avg), 6) AS avg_price, max(price_high) AS max_price, min(price_low) AS min_price, sum(quantity) AS total_qty, count(price_avg) AS lots FROM lots GROUP BY trade_date, species",
    "agg_packaging_dominance": _SHARES.format(k="packaging", where="WHERE packaging <> ''", flag="100.0 * n / total > 80 AS dominated"),
    "agg_heterogeneous": "SELECT species, pct FROM (" + _SHARES.format(k="packaging", where="WHERE packaging <> ''", flag="1 AS one") + ") x WHERE pct < 50",
    "agg_origins_per_day": "SELECT min(k) AS least, max(k) AS most, PCT(k, 0.5) AS median, round(avg(k), 6) AS mean, PCT(k, 0.25) AS p25, PCT(k, 0.75) AS p75, PCT(k, 0.95) AS p95 FROM (SELECT trade_date, species, count(DISTINCT origin) AS k FROM lots GROUP BY trade_date, species) x",
    "agg_packaging_cv": """WITH a AS (SELECT species, trade_date, stddev_pop(price_avg) / avg(price_avg) AS cv FROM lots GROUP BY species, trade_date HAVING count(*) >= 3),
w AS (SELECT species, trade_date, avg(cv) AS cv FROM (SELECT species, trade_date, packaging, stddev_pop(price_avg) / avg(price_avg) AS cv FROM lots GROUP BY species, trade_date, packaging HAVING count(*) >= 2) x GROUP BY species, trade_date)
SELECT a.species, count(*) AS days, round(PCT(a.cv, 0.5), 6) AS cv_all, round(PCT(w.cv, 0.5), 6) AS cv_within, round(PCT(a.cv, 0.5) / nullif(PCT(w.cv, 0.5), 0), 4) AS ratio FROM a JOIN w ON a.species = w.species AND a.trade_date = w.trade_date GROUP BY a.species""",
    "agg_weighting_corr": f"SELECT species, count(*) AS days, {_CORR.format(x='p', y='w')} AS corr FROM ({_DAILY}) d GROUP BY species HAVING count(*) >= 30",
    "agg_lag1": f"SELECT species, count(*) AS days, {_CORR.format(x='p', y='prev')} AS lag1 FROM (SELECT species, p, lag(p) OVER (PARTITION BY species ORDER BY trade_date) AS prev FROM ({_DAILY}) d) x WHERE prev IS NOT NULL GROUP BY species HAVING count(*) >= 3",
    "agg_gate_volume": "SELECT species, count(DISTINCT trade_date) AS days FROM lots GROUP BY species HAVING count(DISTINCT trade_date) >= 200",
    "agg_gate_tiers": "SELECT species, n, qty, rank_, CASE WHEN rank_ <= 15 THEN 'A' WHEN rank_ <= 30 THEN 'B' ELSE 'C' END AS tier FROM (SELECT species, count(*) AS n, sum(quantity) AS qty, row_number() OVER (ORDER BY sum(quantity) DESC, species) AS rank_ FROM lots GROUP BY species) x",
    "agg_market_calendar": """WITH c AS (SELECT DISTINCT trade_date FROM lots), s AS (SELECT DISTINCT species FROM lots), d AS (SELECT species, trade_date, sum(quantity) AS q, count(*) AS n FROM lots GROUP BY species, trade_date)
SELECT s.species, c.trade_date, coalesce(d.q, 0) AS qty, coalesce(d.n, 0) AS lots FROM c CROSS JOIN s LEFT JOIN d ON d.species = s.species AND d.trade_date = c.trade_date""",
    "agg_month_mean": "SELECT species, month(trade_date) AS month, round(avg(price_avg), 6) AS mean FROM lots GROUP BY species, month(trade_date)",
    "agg_year_month_pivot": "SELECT year(trade_date) AS year, " + ", ".join(f"round(coalesce(avg(CASE WHEN month(trade_date) = {m} THEN price_avg END), 0), 6) AS m{m}" for m in range(1, 13)) + " FROM lots GROUP BY year(trade_date)",
    "agg_histogram": "WITH b AS (SELECT min(price_avg) AS lo, max(price_avg) AS hi FROM lots) SELECT least(49, BUCKET((price_avg - lo) * 50.0 / nullif(hi - lo, 0))) AS bin, count(*) AS n FROM lots CROSS JOIN b GROUP BY 1",
    "agg_species_counts": "SELECT species, count(*) AS n, sum(count(*)) OVER () AS total FROM lots GROUP BY species",
    "agg_by_origin": "SELECT origin, round(avg(price_avg), 6) AS avg_price, sum(quantity) AS qty, count(*) AS n FROM lots WHERE species = 'Brand#1' GROUP BY origin",
    "agg_month_seasonality": "SELECT species, extract(MONTH FROM trade_date) AS month, round(avg(price_avg), 6) AS avg_price, round(stddev_samp(price_avg), 6) AS std, count(*) AS n FROM lots GROUP BY species, extract(MONTH FROM trade_date)",
    "agg_year_counts": "SELECT year(trade_date) AS year, count(*) AS n, count(DISTINCT trade_date) AS days FROM lots GROUP BY year(trade_date)",
    "agg_json_distinct": "SELECT event_type, count(DISTINCT JSON(props, 'k')) AS kinds, count(*) AS n FROM events GROUP BY event_type",
    "agg_weekly": "SELECT species, WEEKOF(trade_date) AS week, round(avg(price_avg), 6) AS avg_price, min(price_low) AS low, max(price_high) AS high FROM lots GROUP BY species, WEEKOF(trade_date)",
    "agg_monthly": "SELECT species, MONTHOF(trade_date) AS month_start, round(avg(price_avg), 6) AS avg_price, min(price_low) AS low, max(price_high) AS high FROM lots GROUP BY species, MONTHOF(trade_date)",
    "agg_compare_season": "SELECT season, round(avg(price_avg), 6) AS avg_price, count(*) AS n, rank() OVER (ORDER BY avg(price_avg) DESC) AS rank_ FROM (SELECT price_avg, CASE WHEN month(trade_date) IN (3, 4, 5) THEN 'spring' WHEN month(trade_date) IN (6, 7, 8) THEN 'summer' WHEN month(trade_date) IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS season FROM lots) x GROUP BY season",
    "agg_daily_view": "SELECT trade_date, species, sum(quantity) AS qty, max(price_high) AS high, min(price_low) AS low, CAST(BROUND(avg(price_avg), 0) AS INT) AS avg_price, count(*) AS n FROM lots WHERE state IS NOT NULL AND packaging IS NOT NULL GROUP BY trade_date, species",
    "agg_cube": "SELECT grouping(species) AS all_species, grouping(state) AS all_states, species, state, count(*) AS n FROM lots GROUP BY CUBE (species, state)",
    "agg_rollup": "SELECT year(trade_date) AS year, month(trade_date) AS month, count(*) AS n, sum(quantity) AS qty FROM lots GROUP BY ROLLUP (year(trade_date), month(trade_date))",
}
