"""More reporting and web-analytics shapes: one SQL text for Spark and the oracle.

Each is named by what its plan shows. Ordered limits end in a unique key, and sums
of doubles are rounded.
"""

from __future__ import annotations

REVENUE = "l_extendedprice * (1 - l_discount)"
YEAR = "CAST(extract(year FROM o_orderdate) AS INT)"
SHIP_MONTH = "CAST(extract(month FROM l_shipdate) AS INT)"
BEFORE = "TS'1997-01-01 00:00:00'"

SQL: dict[str, str] = {
    "ds_prefix_intersect": """
        SELECT n_name, round(sum(c_acctbal), 2) AS balance FROM customer, nation,
            (SELECT substr(c_name, 1, 14) AS k FROM customer WHERE c_acctbal > 0 INTERSECT
             SELECT substr(c_name, 1, 14) AS k FROM customer, orders WHERE o_custkey = c_custkey GROUP BY substr(c_name, 1, 14) HAVING count(*) > 10) p
        WHERE c_nationkey = n_nationkey AND substr(c_name, 1, 14) = p.k GROUP BY n_name""",
    "ds_or_of_bands": """
        SELECT round(avg(l_quantity), 6) AS q, round(avg(l_extendedprice), 4) AS p, round(sum(l_tax), 4) AS t, count(*) AS n FROM lineitem, orders, customer
        WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey
          AND ((c_mktsegment = 'BUILDING' AND l_quantity BETWEEN 10 AND 20 AND o_orderpriority = '1-URGENT') OR (c_mktsegment = 'MACHINERY' AND l_quantity BETWEEN 20 AND 30 AND o_orderpriority = '2-HIGH')
               OR (c_mktsegment = 'AUTOMOBILE' AND l_quantity BETWEEN 30 AND 40 AND o_orderpriority = '3-MEDIUM'))
          AND ((c_nationkey IN (1, 2, 3, 4, 5) AND l_discount BETWEEN 0.01 AND 0.04) OR (c_nationkey IN (11, 12, 13, 14) AND l_discount BETWEEN 0.05 AND 0.08) OR (c_nationkey > 18))""",
    "ds_three_facts_stddev": """
        SELECT p_brand, p_type, count(l1.l_quantity) AS n1, round(avg(l1.l_quantity), 4) AS a1, round(stddev_samp(l1.l_quantity), 4) AS d1, count(l2.l_quantity) AS n2, round(stddev_samp(l2.l_quantity) / avg(l2.l_quantity), 4) AS cov2
        FROM lineitem l1, lineitem l2, part, orders
        WHERE l1.l_orderkey = l2.l_orderkey AND l1.l_linenumber < l2.l_linenumber AND l1.l_returnflag = 'R' AND l2.l_returnflag <> 'R' AND p_partkey = l1.l_partkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
        GROUP BY p_brand, p_type""",
    "ds_before_and_after": f"""
        SELECT * FROM (SELECT p_brand, p_size, round(sum(CASE WHEN l_shipdate < {BEFORE} THEN l_quantity ELSE 0 END), 2) AS before, round(sum(CASE WHEN l_shipdate >= {BEFORE} THEN l_quantity ELSE 0 END), 2) AS after
            FROM lineitem, part WHERE p_partkey = l_partkey AND p_retailprice BETWEEN 900 AND 1500 GROUP BY p_brand, p_size) x
        WHERE CASE WHEN before > 0 THEN after / before ELSE NULL END BETWEEN 2.0 / 3.0 AND 3.0 / 2.0""",
    "ds_frequent_and_best": """
        WITH frequent AS (SELECT l_partkey AS k FROM lineitem GROUP BY l_partkey HAVING count(*) > 30),
        spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
        top AS (SELECT max(total) AS most FROM spent), best AS (SELECT o_custkey FROM spent, top WHERE total > 0.5 * most)
        SELECT count(*) AS n, round(sum(l_quantity * l_extendedprice), 2) AS amount FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_partkey IN (SELECT k FROM frequent) AND o_custkey IN (SELECT o_custkey FROM best)""",
    "ds_crossed_aggregates": """
        SELECT * FROM (SELECT round(avg(l_extendedprice), 4) AS a1, count(l_extendedprice) AS n1, count(DISTINCT l_extendedprice) AS u1 FROM lineitem WHERE l_quantity BETWEEN 0 AND 5 AND (l_discount BETWEEN 0.02 AND 0.04 OR l_tax < 0.02)) b1,
            (SELECT round(avg(l_extendedprice), 4) AS a2, count(l_extendedprice) AS n2, count(DISTINCT l_extendedprice) AS u2 FROM lineitem WHERE l_quantity BETWEEN 6 AND 10 AND (l_discount BETWEEN 0.04 AND 0.06 OR l_tax < 0.03)) b2,
            (SELECT round(avg(l_extendedprice), 4) AS a3, count(l_extendedprice) AS n3, count(DISTINCT l_extendedprice) AS u3 FROM lineitem WHERE l_quantity BETWEEN 11 AND 15 AND (l_discount BETWEEN 0.06 AND 0.08 OR l_tax < 0.04)) b3""",
    "ds_lines_between": """
        SELECT c_name, x.o_orderkey, x.n FROM customer, (SELECT o_orderkey, o_custkey, count(*) AS n FROM lineitem, orders WHERE l_orderkey = o_orderkey AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderkey, o_custkey) x
        WHERE x.o_custkey = c_custkey AND x.n BETWEEN 5 AND 7 AND c_acctbal > 5000 ORDER BY c_name, x.n DESC, x.o_orderkey LIMIT 200""",
    "ds_left_join_before_after": f"""
        SELECT n_name, round(sum(CASE WHEN l.l_shipdate < {BEFORE} THEN l.l_extendedprice - coalesce(r.back, 0) ELSE 0 END), 2) AS before, round(sum(CASE WHEN l.l_shipdate >= {BEFORE} THEN l.l_extendedprice - coalesce(r.back, 0) ELSE 0 END), 2) AS after
        FROM lineitem l LEFT OUTER JOIN (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS back FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber) r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber, supplier, nation
        WHERE l.l_suppkey = s_suppkey AND s_nationkey = n_nationkey GROUP BY n_name""",
    "ds_or_in_subquery": """
        SELECT n_name, c_mktsegment, round(sum(o_totalprice), 2) AS total FROM orders, customer, nation
        WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND (substr(c_name, 10, 9) IN ('000000001', '000000007') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)) GROUP BY n_name, c_mktsegment""",
    "ds_neighbours_by_rank": f"""
        WITH v1 AS (SELECT p_brand, {SHIP_MONTH} AS mo, round(sum(l_extendedprice), 2) AS total, avg(sum(l_extendedprice)) OVER (PARTITION BY p_brand) AS mean, rank() OVER (PARTITION BY p_brand ORDER BY {SHIP_MONTH}) AS rn
            FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_brand, {SHIP_MONTH})
        SELECT v1.p_brand, v1.mo, v1.total, round(v1.mean, 1) AS mean, before.total AS psum, after.total AS nsum FROM v1, v1 before, v1 after
        WHERE v1.p_brand = before.p_brand AND v1.p_brand = after.p_brand AND v1.rn = before.rn + 1 AND v1.rn = after.rn - 1 AND v1.mean > 0 AND abs(v1.total - v1.mean) / nullif(v1.mean, 0) > 0.01""",
    "ds_return_ratio_ranks": """
        SELECT channel, item, ratio, CAST(r1 AS INT) AS r1, CAST(r2 AS INT) AS r2 FROM (
            SELECT 'brand' AS channel, item, ratio, rank() OVER (ORDER BY ratio, item) AS r1, rank() OVER (ORDER BY q DESC NULLS FIRST, item) AS r2
            FROM (SELECT p_brand AS item, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 8) AS ratio, sum(l_quantity) AS q FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_brand) a) x WHERE r1 <= 10 OR r2 <= 10
        UNION SELECT channel, item, ratio, CAST(r1 AS INT) AS r1, CAST(r2 AS INT) AS r2 FROM (
            SELECT 'type' AS channel, item, ratio, rank() OVER (ORDER BY ratio, item) AS r1, rank() OVER (ORDER BY q DESC NULLS FIRST, item) AS r2
            FROM (SELECT p_type AS item, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 8) AS ratio, sum(l_quantity) AS q FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_type) b) y WHERE r1 <= 10 OR r2 <= 10""",
    "ds_revenue_segments": """
        WITH revenue AS (SELECT o_custkey, sum(o_totalprice) AS r FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey)
        SELECT segment, count(*) AS customers, segment * 50000 AS base FROM (SELECT CAST(floor(r / 50000) AS BIGINT) AS segment FROM revenue) s GROUP BY segment""",
    "ds_alike_in_all_channels": """
        WITH a AS (SELECT l_partkey AS k, sum(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey), n AS (SELECT l_partkey AS k, sum(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey),
        r AS (SELECT l_partkey AS k, sum(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
        SELECT a.k, round(a.s, 2) AS sa, round(n.s, 2) AS sn, round(r.s, 2) AS sr, round((a.s + n.s + r.s) / 3, 2) AS mean FROM a, n, r
        WHERE a.k = n.k AND a.k = r.k AND a.s BETWEEN 0.8 * n.s AND 1.2 * n.s AND a.s BETWEEN 0.8 * r.s AND 1.2 * r.s AND n.s BETWEEN 0.8 * r.s AND 1.2 * r.s""",
    "ds_year_on_year_pivot": f"""
        WITH w AS (SELECT o_custkey, {YEAR} AS y, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE NULL END) AS urgent, sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice ELSE NULL END) AS low FROM orders GROUP BY o_custkey, {YEAR})
        SELECT a.o_custkey, round(b.urgent / a.urgent, 6) AS urgent_ratio, round(b.low / a.low, 6) AS low_ratio FROM (SELECT * FROM w WHERE y = 1995) a, (SELECT * FROM w WHERE y = 1996) b WHERE a.o_custkey = b.o_custkey""",
    "ds_lag_buckets": """
        SELECT n_name, count(CASE WHEN d <= 30 THEN 1 END) AS d30, count(CASE WHEN d > 30 AND d <= 60 THEN 1 END) AS d60, count(CASE WHEN d > 60 AND d <= 90 THEN 1 END) AS d90, count(CASE WHEN d > 90 THEN 1 END) AS more
        FROM (SELECT s_nationkey, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS BIGINT) AS d FROM lineitem, orders, supplier WHERE l_orderkey = o_orderkey AND l_suppkey = s_suppkey) x, nation WHERE s_nationkey = n_nationkey GROUP BY n_name""",
    "ds_below_tenth_of_average": """
        SELECT s_name, sc.l_partkey, round(sc.revenue, 2) AS revenue FROM supplier, (SELECT l_suppkey, avg(revenue) AS ave FROM (SELECT l_suppkey, l_partkey, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY l_suppkey, l_partkey) sa GROUP BY l_suppkey) sb,
            (SELECT l_suppkey, l_partkey, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY l_suppkey, l_partkey) sc
        WHERE sb.l_suppkey = sc.l_suppkey AND sc.revenue <= 0.1 * sb.ave AND s_suppkey = sc.l_suppkey""",
    "ds_deep_rollup_rank": f"""
        SELECT * FROM (SELECT p_brand, p_type, y, mo, total, CAST(rank() OVER (PARTITION BY p_brand ORDER BY total DESC NULLS FIRST) AS INT) AS rk FROM (
            SELECT p_brand, p_type, CAST(extract(year FROM l_shipdate) AS INT) AS y, {SHIP_MONTH} AS mo, round(sum(coalesce(l_extendedprice * l_quantity, 0)), 2) AS total
            FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY ROLLUP (p_brand, p_type, CAST(extract(year FROM l_shipdate) AS INT), {SHIP_MONTH})) a) b WHERE rk <= 25""",
    "ds_net_of_returns_by_year": """
        WITH y AS (SELECT y, k, sum(q) AS q, sum(amount) AS amount FROM (
            SELECT CAST(extract(year FROM l_shipdate) AS INT) AS y, l_partkey % 50 AS k, l_quantity AS q, l_extendedprice AS amount FROM lineitem WHERE l_returnflag <> 'R'
            UNION ALL SELECT CAST(extract(year FROM l_shipdate) AS INT) AS y, l_partkey % 50 AS k, -l_quantity AS q, -l_extendedprice AS amount FROM lineitem WHERE l_returnflag = 'R') s GROUP BY y, k)
        SELECT prev.y AS prev_year, cur.y AS cur_year, cur.k, round(prev.q, 2) AS prev_q, round(cur.q, 2) AS cur_q, round(cur.amount - prev.amount, 2) AS diff FROM y cur, y prev WHERE cur.k = prev.k AND cur.y = prev.y + 1 AND cur.q / nullif(prev.q, 0) < 0.9""",
    "ds_missing_values_union": """
        SELECT channel, col, y, count(*) AS n, round(sum(amount), 2) AS amount FROM (
            SELECT 'store' AS channel, 'value' AS col, CAST(extract(day FROM ts) AS INT) AS y, coalesce(value, 0) AS amount FROM events WHERE CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END IS NULL
            UNION ALL SELECT 'web' AS channel, 'type' AS col, CAST(extract(day FROM ts) AS INT) AS y, value AS amount FROM events WHERE nullif(event_type, 'click') IS NULL) f GROUP BY channel, col, y""",
    "ds_sales_without_returns": f"""
        WITH kept AS (SELECT {YEAR} AS y, o_custkey, sum(o_totalprice) AS amount, count(*) AS n FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r ON r.l_orderkey = o_orderkey WHERE r.l_orderkey IS NULL GROUP BY {YEAR}, o_custkey),
        back AS (SELECT {YEAR} AS y, o_custkey, sum(o_totalprice) AS amount, count(*) AS n FROM orders, (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r WHERE r.l_orderkey = o_orderkey GROUP BY {YEAR}, o_custkey)
        SELECT kept.y, kept.o_custkey, round(kept.amount / (coalesce(back.amount, 0) + 1), 4) AS ratio, kept.n, coalesce(back.n, 0) AS returned FROM kept LEFT JOIN back ON back.y = kept.y AND back.o_custkey = kept.o_custkey WHERE coalesce(back.n, 0) > 0""",
    "ds_crossed_counts_by_hour": """
        SELECT * FROM (SELECT count(*) AS h8 FROM events WHERE extract(hour FROM ts) = 8 AND extract(minute FROM ts) >= 30) a, (SELECT count(*) AS h9a FROM events WHERE extract(hour FROM ts) = 9 AND extract(minute FROM ts) < 30) b,
            (SELECT count(*) AS h9b FROM events WHERE extract(hour FROM ts) = 9 AND extract(minute FROM ts) >= 30) c, (SELECT count(*) AS h10 FROM events WHERE extract(hour FROM ts) = 10 AND extract(minute FROM ts) < 30) d""",
    "ds_morning_evening_ratio": """
        SELECT round(CAST(am AS DOUBLE) / nullif(CAST(pm AS DOUBLE), 0), 8) AS ratio FROM (SELECT count(*) AS am FROM events WHERE extract(hour FROM ts) BETWEEN 8 AND 9) a, (SELECT count(*) AS pm FROM events WHERE extract(hour FROM ts) BETWEEN 19 AND 20) p""",
    "ds_actual_sales": """
        SELECT o_custkey, round(sum(act), 2) AS total FROM (SELECT o_custkey, CASE WHEN r.q IS NOT NULL THEN (l.l_quantity - r.q) * l.l_extendedprice ELSE l.l_quantity * l.l_extendedprice END AS act
            FROM lineitem l JOIN orders ON o_orderkey = l.l_orderkey LEFT OUTER JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) - 1 AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber) r ON r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber) t
        GROUP BY o_custkey""",
    "ds_correlated_discount": """
        SELECT round(sum(l_extendedprice), 2) AS excess FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 20 AND l_discount > (SELECT 1.3 * avg(l2.l_discount) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "ds_county_growth": f"""
        WITH t AS (SELECT c_nationkey AS k, {YEAR} AS y, o_orderstatus AS s, sum(o_totalprice) AS v FROM orders, customer WHERE o_custkey = c_custkey GROUP BY c_nationkey, {YEAR}, o_orderstatus)
        SELECT a.k, round(b.v / a.v, 6) AS f_growth, round(d.v / c.v, 6) AS o_growth FROM t a, t b, t c, t d
        WHERE a.k = b.k AND a.k = c.k AND a.k = d.k AND a.s = 'F' AND b.s = 'F' AND c.s = 'O' AND d.s = 'O' AND a.y = 1995 AND b.y = 1996 AND c.y = 1995 AND d.y = 1996 AND CASE WHEN a.v > 0 THEN b.v / a.v END > CASE WHEN c.v > 0 THEN d.v / c.v END""",
    "cb_like_order_time": "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE props LIKE '%9%' ORDER BY ts, event_id LIMIT 10",
    "cb_two_keys_sum_avg": "SELECT user_id, event_type, count(*) AS c, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS refresh, round(avg(value), 4) AS width FROM events WHERE props <> '' GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10",
    "cb_wide_keys_sum_avg": "SELECT event_id, user_id, count(*) AS c, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS refresh, round(avg(value), 4) AS width FROM events GROUP BY event_id, user_id ORDER BY c DESC, event_id LIMIT 10",
    "cb_group_by_text": "SELECT url, count(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10",
    "cb_group_by_constant_text": "SELECT 1 AS one, url, count(*) AS c FROM pages GROUP BY 1, url ORDER BY c DESC, url LIMIT 10",
    "cb_window_of_days": "SELECT props, count(*) AS views FROM events WHERE user_id BETWEEN 1 AND 40 AND ts >= TS'2024-01-05 00:00:00' AND ts <= TS'2024-01-25 00:00:00' AND event_type <> 'error' AND props <> '' GROUP BY props ORDER BY views DESC, props LIMIT 10",
    "cb_window_with_offset": "SELECT props, count(*) AS views FROM events WHERE ts >= TS'2024-01-02 00:00:00' AND ts <= TS'2024-01-28 00:00:00' AND event_type IN ('click', 'view') GROUP BY props ORDER BY views DESC, props LIMIT 10 OFFSET 20",
    "cb_hash_days": "SELECT user_id % 16 AS h, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS d, count(*) AS views FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id % 16, CAST(CAST(ts AS DATE) AS VARCHAR(10)) ORDER BY views DESC, h, d LIMIT 10 OFFSET 10",
    "cb_sums_of_many": "SELECT " + ", ".join(f"CAST(sum(user_id + {k}) AS BIGINT) AS s{k}" for k in range(30)) + " FROM events",
}
