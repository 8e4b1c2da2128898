"""Joins, set operations, sorts and limits, predicates and serving queries over lots and tables."""

_DAILY = "SELECT species, trade_date, avg(price_avg) AS p, sum(quantity) AS q, count(*) AS n FROM lots GROUP BY species, trade_date"
_TIERS = "CASE WHEN {m} < 10 THEN 'A' WHEN {m} < 20 THEN 'B' WHEN {m} < 30 THEN 'C' ELSE 'D' END"

QUERIES = {
    "jn_inner_dates": f"SELECT a.trade_date, round(a.p, 6) AS p1, round(b.p, 6) AS p2 FROM ({_DAILY}) a JOIN ({_DAILY}) b ON a.trade_date = b.trade_date WHERE a.species = 'Brand#1' AND b.species = 'Brand#2'",
    "jn_left_default": f"SELECT a.trade_date, a.n, coalesce(b.n, 0) AS partner_lots FROM ({_DAILY}) a LEFT JOIN (SELECT trade_date, n FROM ({_DAILY}) y WHERE species = 'Brand#2') b ON a.trade_date = b.trade_date WHERE a.species = 'Brand#1'",
    "jn_partner_previous": f"""WITH d AS ({_DAILY}), a AS (SELECT trade_date, p, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM d WHERE species = 'Brand#1'), b AS (SELECT trade_date, p FROM d WHERE species = 'Brand#2')
SELECT a.trade_date, round(coalesce(y.p, t.p, a.p), 6) AS partner FROM a LEFT JOIN b y ON y.trade_date = a.prev LEFT JOIN b t ON t.trade_date = a.trade_date""",
    "jn_offset_range": f"""WITH d AS (SELECT * FROM ({_DAILY}) z WHERE species IN ('Brand#1', 'Brand#2')), a AS (SELECT * FROM d WHERE species = 'Brand#1'), b AS (SELECT * FROM d WHERE species = 'Brand#2')
SELECT a.trade_date, count(b.p) AS days, round(avg(b.p), 6) AS mean7 FROM a LEFT JOIN b ON b.trade_date >= DADD(a.trade_date, -7) AND b.trade_date < a.trade_date GROUP BY a.trade_date""",
    "jn_broadcast_dimension": "SELECT n_name AS origin, r_name AS region, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
    "jn_theta_domestic": "SELECT c.id, l.species, count(*) AS n, sum(l.quantity) AS qty FROM lots l JOIN (SELECT 'a' AS id, 'Brand#1' AS species, FALSE AS domestic UNION ALL SELECT 'b', 'Brand#1', TRUE UNION ALL SELECT 'c', 'Brand#2', TRUE) c ON l.species = c.species AND (NOT c.domestic OR l.origin NOT LIKE 'NATION_1%') GROUP BY c.id, l.species",
    "jn_anti_new": "SELECT count(*) AS n_new FROM (SELECT DISTINCT species, trade_date FROM lots WHERE year(trade_date) >= 1998) a LEFT ANTI JOIN (SELECT DISTINCT species, trade_date FROM lots WHERE state = 'R') b ON a.species = b.species AND a.trade_date = b.trade_date".replace("LEFT ANTI JOIN (SELECT DISTINCT species, trade_date FROM lots WHERE state = 'R') b ON a.species = b.species AND a.trade_date = b.trade_date", "WHERE NOT EXISTS (SELECT 1 FROM lots b WHERE b.state = 'R' AND a.species = b.species AND a.trade_date = b.trade_date)"),
    "jn_semi_top": "SELECT species, count(*) AS n FROM lots WHERE species IN (SELECT species FROM (SELECT species, row_number() OVER (ORDER BY count(*) DESC, species) AS rn FROM lots GROUP BY species) t WHERE rn <= 10) GROUP BY species",
    "jn_best_of_two": """WITH r AS (SELECT species, packaging AS model, stddev_pop(price_avg) / avg(price_avg) * 100 AS m FROM lots GROUP BY species, packaging), a AS (SELECT species, model, m, row_number() OVER (PARTITION BY species ORDER BY m, model) AS rn FROM r)
SELECT x.species, x.model AS best, round(x.m, 4) AS mape, y.model AS second FROM a x JOIN a y ON x.species = y.species AND x.rn = 1 AND y.rn = 2""",
    "jn_star": "SELECT r_name, p_brand, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, p_brand",
    "jn_next_day": "SELECT a.user_id, count(*) AS pairs FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) a JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) b ON a.user_id = b.user_id AND b.d = DADD(a.d, 1) GROUP BY a.user_id",
    "jn_cross": "SELECT s.species, p.packaging, t.h AS horizon FROM (SELECT DISTINCT species FROM lots) s CROSS JOIN (SELECT DISTINCT packaging FROM lots) p CROSS JOIN (SELECT 7 AS h UNION ALL SELECT 14) t",
    "jn_full_outer": "SELECT coalesce(a.d, b.d) AS day, coalesce(a.n, 0) AS orders_, coalesce(b.n, 0) AS shipped FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) a FULL OUTER JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1) b ON a.d = b.d",
    "set_union": "SELECT species, packaging FROM (SELECT species, packaging FROM lots WHERE state = 'A' UNION SELECT species, packaging FROM lots WHERE state = 'R') x",
    "set_union_all": "SELECT kind, count(*) AS n FROM (SELECT 'A' AS kind FROM lots WHERE state = 'A' UNION ALL SELECT 'R' FROM lots WHERE state = 'R' UNION ALL SELECT 'none' FROM lots WHERE state IS NULL) x GROUP BY kind",
    "set_intersect": "SELECT trade_date FROM lots WHERE species = 'Brand#1' INTERSECT SELECT trade_date FROM lots WHERE species = 'Brand#2'",
    "set_except": "SELECT trade_date FROM lots WHERE species = 'Brand#1' EXCEPT SELECT trade_date FROM lots WHERE species = 'Brand#2'",
    "set_distinct": "SELECT DISTINCT species, state, packaging FROM lots",
    "srt_top_species": "SELECT species, count(*) AS n FROM lots GROUP BY species ORDER BY n DESC, species LIMIT 10",
    "srt_mode": "SELECT species, packaging FROM (SELECT species, packaging, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, packaging) AS rn FROM lots GROUP BY species, packaging) x WHERE rn = 1",
    "srt_top2_packaging": "SELECT species, packaging, days FROM (SELECT species, packaging, count(DISTINCT trade_date) AS days, row_number() OVER (PARTITION BY species ORDER BY count(DISTINCT trade_date) DESC, packaging) AS rn FROM lots GROUP BY species, packaging) x WHERE rn <= 2",
    "srt_latest": "SELECT species, day, price FROM (SELECT species, trade_date AS day, round(avg(price_avg), 6) AS price, row_number() OVER (PARTITION BY species ORDER BY trade_date DESC) AS rn FROM lots GROUP BY species, trade_date) x WHERE rn = 1",
    "srt_argmin_variant": "SELECT species, min_by(packaging, m) AS best FROM (SELECT species, packaging, avg(price_avg) AS m FROM lots GROUP BY species, packaging) x GROUP BY species",
    "prj_predicates": "SELECT count(*) AS n, sum(quantity) AS qty FROM lots WHERE species LIKE '%#1%' AND price_avg BETWEEN 1000 AND 2000 AND state IS NOT NULL AND packaging IN ('ECONOMY', 'PROMO', 'STANDARD') AND extract(DAY FROM trade_date) = 15",
    "prj_regime_split": "SELECT CASE WHEN month(trade_date) IN (11, 12, 1, 2) THEN 'peak' ELSE 'off' END AS regime, species, count(*) AS n, round(avg(price_avg), 6) AS mean FROM lots GROUP BY 1, 2",
    "prj_spec_unpad": "SELECT spec, padded, regexp_replace(padded, '^0([0-9]+미)$', '{g}1') AS spec_clean, count(*) AS n FROM (SELECT spec, CASE WHEN length(spec) = 2 THEN '0' || spec ELSE spec END AS padded FROM lots) x GROUP BY 1, 2, 3",
    "prj_validity": "SELECT price_high >= price_low AND (price_avg = 0 OR price_avg BETWEEN price_low AND price_high OR (price_avg >= price_low * 0.99 AND price_avg <= price_high * 1.01)) AND quantity >= 0 AS valid, count(*) AS n FROM lots GROUP BY 1",
    "prj_price_chain": "SELECT species, TRUNC(avg(price_avg) / (1 - 0.42)) AS consumer, TRUNC(avg(price_avg) * 1.3) AS wholesale, TRUNC(avg(price_avg) / 10 * 2.5) AS serving FROM lots GROUP BY species",
    "tl_current_price": "SELECT species, origin, state, price_avg, quantity FROM lots WHERE trade_date = (SELECT max(trade_date) FROM lots) ORDER BY species, origin, state, price_avg, quantity LIMIT 50",
    "tl_historical": "WITH m AS (SELECT max(trade_date) AS last FROM lots) SELECT trade_date, round(avg(price_avg), 6) AS price, sum(quantity) AS qty FROM lots CROSS JOIN m WHERE species = 'Brand#1' AND trade_date >= DADD(m.last, -90) GROUP BY trade_date ORDER BY trade_date DESC LIMIT 100",
    "tl_trend": """WITH m AS (SELECT max(trade_date) AS last FROM lots), d AS (SELECT species, trade_date, avg(price_avg) AS p FROM lots CROSS JOIN m WHERE trade_date >= DADD(m.last, -30) GROUP BY species, trade_date)
SELECT species, round(f, 4) AS first_price, round(l, 4) AS last_price, round((l - f) / f * 100, 4) AS change_pct, CASE WHEN (l - f) / f * 100 > 5 THEN 'up' WHEN (l - f) / f * 100 < -5 THEN 'down' ELSE 'stable' END AS trend FROM (SELECT species, min_by(p, trade_date) AS f, max_by(p, trade_date) AS l FROM d GROUP BY species) x""",
    "tl_list_species": "SELECT species, count(*) AS n, round(avg(price_avg), 6) AS mean FROM lots WHERE species LIKE '%Brand#2%' GROUP BY species ORDER BY species LIMIT 50",
    "tl_compare_origin": "SELECT origin, round(avg(price_avg), 6) AS mean, rank() OVER (ORDER BY avg(price_avg) DESC) AS rank_ FROM lots WHERE species = 'Brand#3' GROUP BY origin ORDER BY rank_, origin LIMIT 10",
    "tl_compare_year": "SELECT year(trade_date) AS year, round(avg(price_avg), 6) AS mean, rank() OVER (ORDER BY avg(price_avg) DESC) AS rank_ FROM lots WHERE species = 'Brand#3' GROUP BY year(trade_date)",
    "tl_price_range": "SELECT species, trade_date, count(*) AS n FROM lots WHERE price_avg BETWEEN 1500 AND 1600 GROUP BY species, trade_date",
    "tl_yearly": "SELECT species, year(trade_date) AS year, round(avg(price_avg), 6) AS mean, min(price_low) AS low, max(price_high) AS high, round(stddev_samp(price_avg), 6) AS std, count(DISTINCT trade_date) AS days, count(CASE WHEN extract(DAY FROM trade_date) = 15 THEN 1 END) AS mid_month FROM lots GROUP BY species, year(trade_date)",
    "tl_kpi": f"WITH r AS (SELECT species, stddev_pop(price_avg) / avg(price_avg) * 100 AS m, count(*) AS n FROM lots GROUP BY species) SELECT {_TIERS.format(m='m')} AS tier, count(*) AS configs, sum(n) AS n, round(avg(m), 4) AS mean, round(min(m), 4) AS best FROM r GROUP BY 1",
    "tl_error_suggestions": "SELECT species FROM (SELECT DISTINCT species FROM lots) s ORDER BY levenshtein(species, 'Brnd#11'), species LIMIT 3",
    "prj_scale_clamp": "SELECT species, count(*) AS n, greatest(8, least(40, count(*) / 500.0)) AS marker FROM lots GROUP BY species",
    "agg_metric_rank": "SELECT model, mean, rank_ FROM (SELECT packaging AS model, round(avg(m), 4) AS mean, row_number() OVER (ORDER BY avg(m), packaging) AS rank_ FROM (SELECT species, packaging, stddev_pop(price_avg) / avg(price_avg) * 100 AS m FROM lots GROUP BY species, packaging) x WHERE m < 900 GROUP BY packaging) y WHERE rank_ <= 20",
    "agg_retail_markup": "SELECT p_brand AS item, round(avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice / l_quantity END), 4) AS retail, round(avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice / l_quantity END), 4) AS wholesale, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN CAST(l_shipdate AS DATE) END) AS retail_days FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "tl_species_resource": "SELECT species, trade_date, round(avg(price_avg), 6) AS price, count(*) AS n FROM lots WHERE species = 'Brand#5' GROUP BY species, trade_date",
    "tl_data_health": "SELECT species, count(DISTINCT trade_date) AS days, count(*) AS n, round(CAST(count(*) AS DOUBLE) / count(DISTINCT trade_date), 4) AS lots_per_day, min(trade_date) AS first_day, max(trade_date) AS last_day FROM lots GROUP BY species",
    "jn_known_words": "SELECT count(*) AS n, count(CASE WHEN k.species IS NOT NULL THEN 1 END) AS known FROM lots l LEFT JOIN (SELECT DISTINCT species FROM lots WHERE year(trade_date) < 1996) k ON k.species = l.species",
    "prj_key_level": "SELECT c_custkey, KEYHASH(c_name) AS key_hash, CASE WHEN c_acctbal > 5000 THEN 'premium' WHEN c_acctbal > 0 THEN 'basic' ELSE 'none' END AS level FROM customer",
}
QUERIES["prj_spec_unpad"] = QUERIES["prj_spec_unpad"].replace("'{g}1'", "GROUPREF")
