"""Further reporting and web-analytics shapes, one SQL text for Spark and the oracle."""

from __future__ import annotations

REVENUE = "l_extendedprice * (1 - l_discount)"
YEAR = "CAST(extract(year FROM o_orderdate) AS INT)"

SQL: dict[str, str] = {
    "ds_customer_above_store_avg": """
        WITH spent AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey, o_orderpriority)
        SELECT c_name, s1.o_orderpriority FROM spent s1, customer
        WHERE s1.total > (SELECT avg(s2.total) * 1.2 FROM spent s2 WHERE s1.o_orderpriority = s2.o_orderpriority) AND c_custkey = s1.o_custkey
        ORDER BY c_name, s1.o_orderpriority LIMIT 100""",
    "ds_channel_rollup": f"""
        WITH parts AS (
            SELECT 'sales' AS channel, l_returnflag AS id, {REVENUE} AS sales, CAST(0 AS DOUBLE) AS refunds FROM lineitem WHERE l_returnflag <> 'R'
            UNION ALL SELECT 'returns' AS channel, l_linestatus AS id, CAST(0 AS DOUBLE) AS sales, {REVENUE} AS refunds FROM lineitem WHERE l_returnflag = 'R')
        SELECT channel, id, round(sum(sales), 4) AS sales, round(sum(refunds), 4) AS refunds FROM parts GROUP BY ROLLUP (channel, id)""",
    "ds_case_of_subqueries": """
        SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT round(avg(l_extendedprice), 4) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) ELSE (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS bucket1,
               CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) > 1000000000 THEN (SELECT round(avg(l_extendedprice), 4) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) ELSE (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) END AS bucket2
        FROM region WHERE r_regionkey = 1""",
    "ds_three_way_intersect": """
        SELECT count(*) AS n FROM (
            SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') hot""",
    "ds_three_way_except": """
        SELECT count(*) AS n FROM ((SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') EXCEPT (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 490000)) cool""",
    "ds_best_and_worst": """
        SELECT a.rnk, p1.p_name AS best, p2.p_name AS worst FROM
            (SELECT l_partkey, CAST(rank() OVER (ORDER BY avg(l_quantity) DESC NULLS FIRST, l_partkey) AS INT) AS rnk FROM lineitem GROUP BY l_partkey) a,
            (SELECT l_partkey, CAST(rank() OVER (ORDER BY avg(l_quantity) ASC NULLS LAST, l_partkey) AS INT) AS rnk FROM lineitem GROUP BY l_partkey) b, part p1, part p2
        WHERE a.rnk = b.rnk AND a.rnk < 11 AND p1.p_partkey = a.l_partkey AND p2.p_partkey = b.l_partkey ORDER BY a.rnk""",
    "ds_cumulative_full_outer": f"""
        WITH web AS (SELECT o_custkey, {YEAR} AS y, sum(sum(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY {YEAR} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cume FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey, {YEAR}),
        store AS (SELECT o_custkey, {YEAR} AS y, sum(sum(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY {YEAR} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cume FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, {YEAR})
        SELECT k, y, round(web_cume, 2) AS web_cume, round(store_cume, 2) AS store_cume FROM (
            SELECT CASE WHEN web.o_custkey IS NOT NULL THEN web.o_custkey ELSE store.o_custkey END AS k, CASE WHEN web.y IS NOT NULL THEN web.y ELSE store.y END AS y, web.cume AS web_cume, store.cume AS store_cume
            FROM web FULL OUTER JOIN store ON web.o_custkey = store.o_custkey AND web.y = store.y) x
        WHERE web_cume > store_cume""",
    "ds_avg_over_group": """
        SELECT * FROM (SELECT p_brand, p_size, round(sum(l_extendedprice), 2) AS sales, round(avg(sum(l_extendedprice)) OVER (PARTITION BY p_brand), 2) AS avg_sales
            FROM lineitem, part WHERE l_partkey = p_partkey AND p_size IN (1, 5, 9, 13) GROUP BY p_brand, p_size) t
        WHERE CASE WHEN avg_sales > 0 THEN abs(sales - avg_sales) / avg_sales ELSE NULL END > 0.1""",
    "ds_growth_by_customer": f"""
        WITH total AS (SELECT c_custkey, c_name, o_orderstatus AS kind, {YEAR} AS y, sum(o_totalprice) AS t FROM customer, orders WHERE c_custkey = o_custkey GROUP BY c_custkey, c_name, o_orderstatus, {YEAR})
        SELECT a.c_name FROM total a, total b, total c, total d
        WHERE a.c_custkey = b.c_custkey AND a.c_custkey = c.c_custkey AND a.c_custkey = d.c_custkey AND a.kind = 'O' AND b.kind = 'O' AND c.kind = 'F' AND d.kind = 'F'
          AND a.y = 1996 AND b.y = 1997 AND c.y = 1996 AND d.y = 1997 AND a.t > 0 AND c.t > 0
          AND CASE WHEN a.t > 0 THEN b.t / a.t ELSE NULL END > CASE WHEN c.t > 0 THEN d.t / c.t ELSE NULL END ORDER BY a.c_name LIMIT 100""",
    "ds_inventory_variation": f"""
        WITH m AS (SELECT l_suppkey, CAST(extract(month FROM l_shipdate) AS INT) AS mo, stddev_samp(l_quantity) AS dev, avg(l_quantity) AS mean FROM lineitem GROUP BY l_suppkey, CAST(extract(month FROM l_shipdate) AS INT))
        SELECT a.l_suppkey, a.mo, round(a.dev / a.mean, 6) AS cov, round(b.dev / b.mean, 6) AS next_cov FROM m a, m b
        WHERE a.l_suppkey = b.l_suppkey AND b.mo = a.mo + 1 AND CASE WHEN a.mean = 0 THEN 0 ELSE a.dev / a.mean END > 0.55""",
    "ds_union_of_years": f"""
        WITH y AS (SELECT {YEAR} AS y, o_orderpriority, count(*) AS n FROM (SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 100000) u GROUP BY {YEAR}, o_orderpriority)
        SELECT cur.y, cur.o_orderpriority, cur.n AS cur_n, prev.n AS prev_n FROM y cur, y prev WHERE cur.o_orderpriority = prev.o_orderpriority AND cur.y = prev.y + 1 ORDER BY cur.y, cur.o_orderpriority""",
    "ds_pivot_days": """
        SELECT o_orderpriority, round(sum(CASE WHEN date_part('month', o_orderdate) <= 3 THEN o_totalprice END), 2) AS q1, round(sum(CASE WHEN date_part('month', o_orderdate) BETWEEN 4 AND 6 THEN o_totalprice END), 2) AS q2,
               round(sum(CASE WHEN date_part('month', o_orderdate) BETWEEN 7 AND 9 THEN o_totalprice END), 2) AS q3, round(sum(CASE WHEN date_part('month', o_orderdate) > 9 THEN o_totalprice END), 2) AS q4
        FROM orders GROUP BY o_orderpriority""",
    "ds_left_join_returns": """
        SELECT o_orderstatus, count(*) AS n, count(l.l_orderkey) AS returned, round(sum(coalesce(l.q, 0)), 2) AS q
        FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) l ON o_orderkey = l.l_orderkey GROUP BY o_orderstatus""",
    "ds_not_exists_and_distinct": """
        SELECT count(DISTINCT l1.l_orderkey) AS orders, round(sum(l1.l_extendedprice), 2) AS price FROM lineitem l1
        WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l1.l_orderkey = l2.l_orderkey AND l1.l_suppkey <> l2.l_suppkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l1.l_orderkey AND o_orderstatus = 'P')""",
    "ds_in_having_subquery": """
        SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT avg(n) * 1.5 FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) x)) ORDER BY c_custkey""",
    "ds_rank_in_rollup": """
        SELECT * FROM (SELECT p_brand, p_type, sales, CAST(rank() OVER (PARTITION BY p_brand ORDER BY sales DESC NULLS FIRST) AS INT) AS rk FROM (
            SELECT p_brand, p_type, round(sum(l_extendedprice * l_quantity), 2) AS sales FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY ROLLUP (p_brand, p_type)) a) b WHERE rk <= 3""",
    "cb_count": "SELECT count(*) AS n FROM events",
    "cb_count_filter": "SELECT count(*) AS n FROM events WHERE user_id <> 0",
    "cb_sum_count_avg": "SELECT CAST(sum(user_id) AS BIGINT) AS s, count(*) AS n, round(avg(value), 6) AS a FROM events",
    "cb_distinct_users": "SELECT count(DISTINCT user_id) AS users, count(DISTINCT props) AS phrases FROM events",
    "cb_min_max_time": "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM events",
    "cb_group_filter": "SELECT user_id, count(*) AS n FROM events WHERE user_id <> 0 GROUP BY user_id ORDER BY n DESC, user_id",
    "cb_distinct_by_group": "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "cb_two_keys": "SELECT event_type, props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY event_type, props ORDER BY u DESC, event_type, props LIMIT 10",
    "cb_point_lookup": "SELECT user_id, event_id FROM events WHERE user_id = 7",
    "cb_like_group": "SELECT props, min(event_type) AS first_type, count(*) AS c FROM events WHERE props LIKE '%7%' AND event_type NOT LIKE '%err%' GROUP BY props ORDER BY c DESC, props LIMIT 10",
    "cb_order_by_time": "SELECT event_id, props FROM events WHERE props <> '' ORDER BY ts, event_id LIMIT 10",
    "cb_order_by_two": "SELECT event_id, props FROM events WHERE props <> '' ORDER BY ts, props, event_id LIMIT 10",
    "cb_avg_length": "SELECT event_type, round(avg(length(props)), 4) AS l, count(*) AS c FROM events WHERE props <> '' GROUP BY event_type HAVING count(*) > 10 ORDER BY l DESC, event_type LIMIT 25",
    "cb_constant_group": "SELECT 1 AS one, user_id, count(*) AS c FROM events GROUP BY 1, user_id ORDER BY c DESC, user_id LIMIT 10",
    "cb_case_source": "SELECT event_type, CASE WHEN event_type = 'click' AND value < 20 THEN props ELSE '' END AS src, count(*) AS c FROM events GROUP BY event_type, CASE WHEN event_type = 'click' AND value < 20 THEN props ELSE '' END ORDER BY c DESC, event_type, src LIMIT 10 OFFSET 3",
    "cb_date_range": "SELECT date_trunc('hour', ts) AS h, count(*) AS c FROM events WHERE ts >= TS'2024-01-05 00:00:00' AND ts < TS'2024-01-08 00:00:00' AND user_id IN (1, 2, 3, 4, 5, 6, 7, 8) GROUP BY date_trunc('hour', ts) ORDER BY h LIMIT 10 OFFSET 2",
}
