"""SQL of the aggregation studies for the checking engine, written from the surveyed rules and apart from the queries."""

from __future__ import annotations

from tidemark.plans.dialect import oracle

_SRC = """src AS (SELECT * REPLACE (CASE origin WHEN 'NATION_3' THEN '일본' WHEN 'NATION_5' THEN '중국(수입)' WHEN 'NATION_7' THEN '동해(원양)' WHEN 'NATION_9' THEN '러시아산' ELSE origin END AS origin,
  CASE spec WHEN '1미' THEN '특대' WHEN '2미' THEN '10/11미' WHEN '3미' THEN '300/400' WHEN '4미' THEN '바라' WHEN '5미' THEN NULL ELSE spec END AS spec) FROM lots),
cls AS (SELECT *, CASE WHEN spec IS NULL THEN 'null' WHEN spec IN ('특대', '대', '중', '소') THEN 'size_grade' WHEN regexp_full_match(spec, '[0-9]+미') THEN 'count' WHEN regexp_full_match(spec, '[0-9]+/[0-9]+미') THEN 'count_range' WHEN regexp_full_match(spec, '[0-9]+/[0-9]+') THEN 'weight_range' ELSE 'other' END AS class FROM src)"""
_QUARTERS = "qtr AS (SELECT * REPLACE (CAST(date_trunc('quarter', trade_date) AS DATE) AS trade_date) FROM lots)"
_DAY = "day AS (SELECT species, trade_date, avg(price_avg) AS p, sum(quantity) AS q, count(*) AS n FROM lots GROUP BY ALL)"
_LAG = "(SELECT species, corr(x, y) AS c, count(*) AS m FROM (SELECT species, {c} AS x, lag({c}) OVER (PARTITION BY species ORDER BY trade_date) AS y FROM {t}) GROUP BY species)"


def _cv_ratio(source: str, outer: str, inner: str) -> str:
    """CTEs that end in ratio (species, within, across, ratio)."""
    return f"""p AS (SELECT {outer}, {inner}, count(*) AS n, stddev_pop(price_avg) / avg(price_avg) AS cv FROM {source} GROUP BY ALL),
wi AS (SELECT {outer}, avg(cv) AS cv FROM p WHERE n >= 2 GROUP BY ALL),
ac AS (SELECT {outer}, stddev_pop(price_avg) / avg(price_avg) AS cv FROM {source} GROUP BY ALL HAVING count(*) >= 3),
ratio AS (SELECT w.species, w.m AS within, a.m AS across, CASE WHEN w.m > 0 THEN a.m / w.m ELSE 0 END AS ratio FROM (SELECT species, median(cv) AS m FROM wi GROUP BY species) w JOIN (SELECT species, median(cv) AS m FROM ac GROUP BY species) a USING (species))"""


_BLEND = """cor AS (SELECT species, corr(p, w) AS c FROM (SELECT species, trade_date, avg(price_avg) AS p, sum(price_avg * quantity) / nullif(sum(quantity), 0) AS w FROM lots GROUP BY ALL) GROUP BY species HAVING count(*) >= 30),
pk AS (SELECT species, packaging FROM (SELECT species, packaging, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, packaging) AS r FROM lots WHERE packaging <> '' GROUP BY species, packaging) WHERE r = 1),
a AS (SELECT species, trade_date, avg(price_avg) AS p, sum(price_avg * quantity) / nullif(sum(quantity), 0) AS w FROM lots GROUP BY ALL),
b AS (SELECT l.species, trade_date, avg(price_avg) AS p, sum(price_avg * quantity) / nullif(sum(quantity), 0) AS w FROM lots l JOIN pk USING (species, packaging) GROUP BY ALL),
s AS (SELECT a.species, a.trade_date, coalesce(c > 0.98, TRUE) AS weighted, CASE WHEN coalesce(c > 0.98, TRUE) THEN a.w ELSE a.p END AS bl, CASE WHEN coalesce(c > 0.98, TRUE) THEN b.w ELSE b.p END AS dm FROM a JOIN b USING (species, trade_date) LEFT JOIN cor USING (species)),
lags AS (SELECT species, corr(bl, pb) AS lb, corr(dm, pd) AS ld FROM (SELECT *, lag(bl) OVER x AS pb, lag(dm) OVER x AS pd FROM s WINDOW x AS (PARTITION BY species ORDER BY trade_date)) GROUP BY species),
blend AS (SELECT species, round(corr(bl, dm), 4) AS corr, round(any_value(lb), 4) AS lag1_blend, round(any_value(ld), 4) AS lag1_dom, count(*) AS n_days, bool_or(weighted) AS weighted FROM s JOIN lags USING (species) GROUP BY species HAVING count(*) >= 30)"""
_STATE = """sc AS (SELECT species, coalesce(state, '(null)') AS state, count(*) AS n, round_even(avg(price_avg), 0) AS mean FROM lots GROUP BY ALL),
st AS (SELECT t.species, CASE WHEN round(100.0 * t.n / t.total, 1) >= 90 THEN 'filter:' || t.state WHEN round(m.r, 2) > 1.5 THEN 'partition' ELSE 'aggregate' END AS state_rule
  FROM (SELECT *, sum(n) OVER (PARTITION BY species) AS total, row_number() OVER (PARTITION BY species ORDER BY n DESC, state) AS rn FROM sc) t
  LEFT JOIN (SELECT species, max(mean) / min(mean) AS r FROM sc WHERE n > 10 AND state <> '(null)' GROUP BY species HAVING count(*) >= 2) m USING (species) WHERE rn = 1)"""
_PAIR = """pd AS (SELECT species, packaging, trade_date, avg(price_avg) AS p, sum(price_avg * quantity) / nullif(sum(quantity), 0) AS w FROM lots GROUP BY ALL),
pr AS (SELECT species, packaging, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, packaging) AS rn FROM pd GROUP BY species, packaging HAVING count(*) >= 100),
pair AS (SELECT x.species, round(corr(x.w, y.w), 4) AS pair_corr, round(greatest(avg(x.p), avg(y.p)) / least(avg(x.p), avg(y.p)), 4) AS price_ratio FROM (SELECT pd.* FROM pd JOIN pr USING (species, packaging) WHERE rn = 1) x
  JOIN (SELECT pd.* FROM pd JOIN pr USING (species, packaging) WHERE rn = 2) y ON x.species = y.species AND x.trade_date = y.trade_date GROUP BY x.species HAVING count(*) >= 30)"""
_TREE = f"""WITH {_QUARTERS}, pr1 AS (WITH {_cv_ratio("qtr", "species, trade_date", "packaging")} SELECT species, round(ratio, 2) AS pack_ratio FROM ratio),
sp1 AS (WITH {_cv_ratio("qtr", "species, trade_date, state, packaging", "spec")} SELECT species, round(ratio, 2) AS spec_ratio FROM ratio),
{_BLEND}, {_STATE}, {_PAIR},
d AS (SELECT pr1.species, state_rule,
  CASE WHEN pack_ratio <= 1.5 THEN CASE WHEN coalesce(blend.corr, 0) > 0.95 AND coalesce(lag1_blend, 0) > 0.8 THEN 'blend' ELSE 'dominant-pkg' END
       WHEN pair_corr IS NULL THEN 'blend' WHEN pair_corr > 0.85 AND price_ratio < 1.5 THEN 'blend' WHEN pair_corr > 0.85 THEN 'dominant-pkg' ELSE 'separate' END AS packaging,
  CASE WHEN coalesce(spec_ratio, 0) <= 1.5 THEN 'aggregate' ELSE 'spec-class' END AS spec, CASE WHEN coalesce(cor.c, 1.0) > 0.98 THEN 'weighted' ELSE 'unweighted' END AS weighting
  FROM pr1 JOIN st USING (species) LEFT JOIN sp1 USING (species) LEFT JOIN blend USING (species) LEFT JOIN pair USING (species) LEFT JOIN cor USING (species)),
tree AS (SELECT *, 'trade_date,species' || CASE WHEN state_rule = 'partition' THEN ',state' ELSE '' END || CASE WHEN packaging IN ('separate', 'dominant-pkg') THEN ',packaging' ELSE '' END || CASE WHEN spec = 'spec-class' THEN ',spec_class' ELSE '' END AS group_by FROM d)"""
_GROUPS = "SELECT '{0}' AS strategy, trade_date, count(*) AS n FROM (SELECT DISTINCT {1} FROM lots) GROUP BY trade_date"
_COMPARE = "SELECT species, '{0}' AS dimension, CAST({1} AS VARCHAR) AS value, avg(price_avg) AS m, count(*) AS n FROM lots GROUP BY ALL"
_CONFIGS = "cfg AS (SELECT species || '_' || packaging AS config, packaging AS category, 100 * stddev_pop(price_avg) / avg(price_avg) AS m, count(*) AS n FROM lots GROUP BY species, packaging)"
_FEATURES = ["price", "lag1", "mean7", "mean30", "qty7"]

SQL = {
    "agg_spec_classes": f"WITH {_SRC} SELECT class, count(*) AS n, count(DISTINCT species) AS n_species FROM cls GROUP BY class",
    "agg_spec_class_kinds": f"WITH {_SRC} SELECT kinds, count(*) AS n_species FROM (SELECT species, packaging, count(DISTINCT class) AS kinds FROM cls GROUP BY species, packaging) GROUP BY kinds",
    "agg_spec_cv": f"WITH {_QUARTERS}, {_cv_ratio('qtr', 'species, trade_date, state, packaging', 'spec')} SELECT species, round(within, 4) AS within_cv, round(across, 4) AS across_cv, round(ratio, 2) AS ratio, CASE WHEN ratio > 1.5 THEN 'segments' ELSE 'ok' END AS verdict FROM ratio",
    "agg_threshold_sweep": f"""WITH {_QUARTERS}, {_cv_ratio("qtr", "species, trade_date", "packaging")}
SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (round(ratio, 2) > t) AS n, count(*) AS species FROM ratio CROSS JOIN (VALUES (1.5), (2.0), (2.5)) v(t) GROUP BY t""",
    "agg_origin_spread": f"""WITH {_QUARTERS}, g AS (SELECT (max(price_avg) - min(price_avg)) / avg(price_avg) AS s FROM qtr GROUP BY species, trade_date, state, packaging, spec HAVING count(*) >= 2 AND avg(price_avg) <> 0)
SELECT count(*) AS n, round(100 * median(s), 4) AS median_pct, round(100 * avg(s), 4) AS mean_pct, round(100 * quantile_cont(s, 0.95), 4) AS p95_pct FROM g""",
    "agg_blended": f"WITH {_BLEND} SELECT species, corr, lag1_blend, lag1_dom, n_days, CASE WHEN weighted THEN 'weighted' ELSE 'unweighted' END AS weighting, CASE WHEN corr > 0.95 AND lag1_blend > 0.8 THEN 'blend' ELSE 'dominant' END AS verdict FROM blend",
    "agg_row_reduction": "WITH g AS (" + " UNION ALL ".join(_GROUPS.format(a, b) for a, b in (("raw", "trade_date, species, state, origin, spec, packaging"), ("species", "trade_date, species"), ("species+state", "trade_date, species, state"), ("species+state+packaging", "trade_date, species, state, packaging"))) + """)
SELECT strategy, CAST(sum(n) AS BIGINT) AS total_groups, CAST(round_even(median(n), 0) AS BIGINT) AS median_per_day, round(avg(n), 1) AS mean_per_day, round((SELECT sum(n) FROM g WHERE strategy = 'raw') / sum(n), 4) AS compression FROM g GROUP BY strategy""",
    "agg_viable_species": """WITH f AS (SELECT species || ' ' || packaging AS species, trade_date FROM lots), top AS (SELECT species FROM f GROUP BY species ORDER BY count(*) DESC, species LIMIT 30),
d AS (SELECT DISTINCT species, trade_date FROM f WHERE species NOT IN (SELECT species FROM top)), s AS (SELECT *, trade_date - lag(trade_date) OVER (PARTITION BY species ORDER BY trade_date) > 7 AS gap FROM d),
r AS (SELECT species, trade_date, count(*) FILTER (gap) OVER (PARTITION BY species ORDER BY trade_date) AS run FROM s)
SELECT species, CAST(sum(n) AS BIGINT) AS total_days, max(n) AS max_streak, sum(n) >= 100 AS viable FROM (SELECT species, run, count(*) AS n FROM r GROUP BY species, run) GROUP BY species""",
    "agg_gate_regularity": "WITH r AS (SELECT DISTINCT species, trade_date FROM lots WHERE trade_date >= (SELECT max(trade_date) FROM lots) - 365) SELECT species, count(*) AS days, (SELECT count(DISTINCT trade_date) FROM r) AS market_days, round(count(*) / (SELECT count(DISTINCT trade_date) FROM r), 3) AS regularity, round(count(*) / (SELECT count(DISTINCT trade_date) FROM r), 3) >= 0.6 AS passed FROM r GROUP BY species",
    "agg_gate_signal": f"""WITH pk AS (SELECT species, packaging FROM (SELECT species, packaging, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, packaging) AS r FROM lots GROUP BY species, packaging) WHERE r = 1),
ss AS (SELECT species, state FROM (SELECT species, state, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, state) AS r FROM lots WHERE state IS NOT NULL GROUP BY species, state) WHERE r = 1),
d AS (SELECT species, trade_date, avg(price_avg) AS p FROM lots JOIN pk USING (species, packaging) JOIN ss USING (species, state) GROUP BY ALL),
m AS (SELECT species, trade_date, avg(p) OVER w AS p, count(*) OVER w AS k FROM d WINDOW w AS (PARTITION BY species ORDER BY trade_date ROWS 6 PRECEDING)), m7 AS (SELECT * FROM m WHERE k = 7),
x AS (SELECT species, count(*) AS n_days, round_even(avg(p), 0) AS mean, round_even(stddev_pop(p), 0) AS std FROM d GROUP BY species)
SELECT x.species, n_days, CASE WHEN n_days < 30 THEN 0 ELSE round(l.c, 4) END AS lag1, CASE WHEN n_days < 30 THEN 0 ELSE round(s.c, 4) END AS lag1_7d, CASE WHEN n_days >= 30 THEN mean END AS mean_price, CASE WHEN n_days >= 30 THEN round(std / mean, 4) END AS cv,
  CASE WHEN n_days < 30 THEN FALSE ELSE greatest(round(l.c, 4), round(s.c, 4)) >= 0.3 END AS passed FROM x JOIN {_LAG.format(c="p", t="d")} l USING (species) LEFT JOIN {_LAG.format(c="p", t="m7")} s USING (species)""",
    "agg_decision_tree": f"{_TREE} SELECT species, state_rule, packaging, spec, weighting, group_by FROM tree",
    "agg_pattern_mode": f"{_TREE} SELECT group_by, count(*) AS n FROM tree GROUP BY group_by ORDER BY n DESC, group_by LIMIT 1",
    "agg_run_summary": """SELECT l.trade_date, count(*) AS n, count(DISTINCT species) AS n_species, round(avg(price_avg), 6) AS mean_price, sum(quantity) AS qty, coalesce(any_value(s.states), '') AS states FROM lots l
LEFT JOIN (SELECT trade_date, string_agg(state || '=' || n, ',' ORDER BY state) AS states FROM (SELECT trade_date, state, count(*) AS n FROM lots WHERE state IS NOT NULL GROUP BY ALL) GROUP BY trade_date) s ON s.trade_date = l.trade_date GROUP BY l.trade_date""",
    "agg_state_distribution": """WITH c AS (SELECT species, coalesce(state, '(null)') AS state, count(*) AS n FROM lots GROUP BY ALL), t AS (SELECT species, sum(n) AS total, count(*) AS kinds, string_agg(state || '=' || n, ',' ORDER BY state) AS states FROM c GROUP BY species)
SELECT species, state AS dominant, round(100.0 * n / total, 1) AS pct, CAST(total AS BIGINT) AS total, kinds, round(100.0 * n / total, 1) < 90 AS multi_state, states FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY n DESC, state) AS rn FROM c) JOIN t USING (species) WHERE rn = 1""",
    "agg_state_divergence": """SELECT species, string_agg(state || '=' || m, ',' ORDER BY state) AS means, count(*) AS kinds, round(max(m) / min(m), 2) AS ratio, round(max(m) / min(m), 2) > 1.5 AS divergent FROM
(SELECT species, state, CAST(round_even(avg(price_avg), 0) AS BIGINT) AS m FROM lots WHERE state IS NOT NULL GROUP BY ALL HAVING count(*) > 10) GROUP BY species HAVING count(*) >= 2""",
    "agg_summary_stats": f"WITH {_DAY} SELECT species, count(*) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, round(stddev_samp(p) / avg(p), 6) AS cv, round(CASE WHEN count(*) < 3 THEN 0 ELSE any_value(c) END, 4) AS lag1 FROM day JOIN {_LAG.format(c='p', t='day')} l USING (species) GROUP BY species",
    "agg_compare": "SELECT species, dimension, value, round(m, 6) AS mean, n, rank() OVER (PARTITION BY species, dimension ORDER BY m DESC) AS rank_ FROM (" + " UNION ALL ".join(_COMPARE.format(a, b) for a, b in (
        ("origin", "origin"), ("state", "coalesce(state, '(null)')"), ("year", "year(trade_date)"), ("month", "month(trade_date)"),
        ("season", "CASE WHEN month(trade_date) IN (3, 4, 5) THEN 'spring' WHEN month(trade_date) IN (6, 7, 8) THEN 'summer' WHEN month(trade_date) IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END"))) + ")",
    "agg_kpi": f"""WITH {_CONFIGS} SELECT 'all' AS part, '' AS name, round(avg(m), 4) AS mean, round(min(m), 4) AS least, CAST(sum(n) AS BIGINT) AS n FROM cfg
UNION ALL SELECT * FROM (SELECT 'best', config, round(m, 4), round(m, 4), n FROM cfg ORDER BY m, config LIMIT 5) UNION ALL SELECT * FROM (SELECT 'worst', config, round(m, 4), round(m, 4), n FROM cfg ORDER BY m DESC, config LIMIT 5)
UNION ALL SELECT 'category', category, round(avg(m), 4), round(min(m), 4), CAST(sum(n) AS BIGINT) FROM cfg GROUP BY category""",
    "agg_feature_rank": f"""WITH {_DAY}, f AS (SELECT * FROM (SELECT species, lead(p, 7) OVER x AS y, p AS price, lag(p) OVER x AS lag1, avg(p) OVER (PARTITION BY species ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean7, avg(p) OVER (PARTITION BY species ORDER BY trade_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS mean30, sum(q) OVER (PARTITION BY species ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS qty7 FROM day WINDOW x AS (PARTITION BY species ORDER BY trade_date)) WHERE y IS NOT NULL AND lag1 IS NOT NULL),
c AS ({" UNION ALL ".join(f"SELECT species, '{x}' AS feature, abs(corr({x}, y)) AS g FROM f GROUP BY species" for x in _FEATURES)}), s AS (SELECT feature, avg(pct) AS m FROM (SELECT feature, 100 * g / sum(g) OVER (PARTITION BY species) AS pct FROM c) GROUP BY feature)
SELECT feature, round(m, 2) AS pct, row_number() OVER (ORDER BY m DESC, feature) AS rank_ FROM s""",
    "agg_species_profile": f"""WITH {_SRC}, x AS (SELECT *, origin SIMILAR TO '.*(일본|중국|미국|러시아|\\(원양\\)).*' AS foreign_ FROM cls), o AS (SELECT species, avg(CAST(foreign_ AS INT)) AS share, avg(price_avg) FILTER (foreign_) / avg(price_avg) FILTER (NOT foreign_) AS ratio FROM x GROUP BY species),
l AS (SELECT species, max(m) / min(m) AS ladder FROM (SELECT species, class, avg(price_avg) AS m FROM x GROUP BY species, class) GROUP BY species)
SELECT species, round(share, 6) AS foreign_share, round(ratio, 6) AS price_ratio, round(ladder, 6) AS ladder_ratio, concat_ws(',', CASE WHEN share > 0.15 THEN 'imported' END, CASE WHEN ratio < 1 THEN 'cheap imports' END, CASE WHEN ladder > 1.05 THEN 'graded' END) AS flags FROM o JOIN l USING (species)""",
    "agg_approximate": "SELECT species, TRUE AS distinct_near, TRUE AS median_near, count(*) AS n FROM lots GROUP BY species",
    "agg_config_health": f"""WITH {_DAY} SELECT species, count(*) AS days, CAST(sum(n) AS BIGINT) AS rows_, round(sum(n) / count(*), 4) AS lots_per_day, round(avg(p), 6) AS mean, round(stddev_pop(p) / avg(p), 6) AS cv, round(any_value(c), 4) AS lag1, count(*) FILTER (year(trade_date) >= 1998) AS recent_days,
CASE WHEN count(*) FILTER (year(trade_date) >= 1998) >= 100 THEN 'active' WHEN count(*) FILTER (year(trade_date) >= 1998) >= 1 THEN 'caution' ELSE 'stopped' END AS health, min(trade_date) AS first_day, max(trade_date) AS last_day FROM day JOIN {_LAG.format(c="p", t="day")} l USING (species) GROUP BY species""",
    "agg_best_of_sections": """WITH r AS (SELECT species, packaging, year(trade_date) % 2 AS odd, 100 * stddev_pop(price_avg) / avg(price_avg) AS m FROM lots GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY species, packaging ORDER BY m, odd) AS rn FROM r)
SELECT species, b.packaging, CASE WHEN odd = 1 THEN 'second' ELSE 'first' END AS section, round(m, 4) AS best, n_values, least FROM b JOIN (SELECT packaging, count(*) AS n_values, round(min(m), 2) AS least FROM r GROUP BY packaging) v ON v.packaging = b.packaging WHERE rn = 1""",
}
ORACLES = {name: oracle(text) for name, text in SQL.items()}
