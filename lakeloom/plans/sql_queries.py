"""Relational queries as SQL over the fixture tables.

One text serves Spark and the oracle; where their dialects differ, a query has two.
``TS'...'`` stands for a timestamp literal without zone. Every ordered limit has a
unique last key, and sums of doubles are rounded, so results don't depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans import report_queries, workload_queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

REVENUE = "l_extendedprice * (1 - l_discount)"

SQL: dict[str, str] = {
    # ---- decision-support shapes on the star schema
    "tpch_q1": f"""
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
               round(sum({REVENUE}), 4) AS sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 2) AS sum_charge,
               round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TS'1998-09-02 00:00:00'
        GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q2_like": """
        SELECT s_acctbal, s_name, n_name, p_partkey FROM part, supplier, lineitem, nation, region
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND p_size < 10
          AND l_extendedprice = (SELECT min(l2.l_extendedprice) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)
        ORDER BY s_acctbal DESC NULLS LAST, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q3": f"""
        SELECT l_orderkey, round(sum({REVENUE}), 4) AS revenue, o_orderdate
        FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
          AND o_orderdate < TS'1995-03-15 00:00:00' AND l_shipdate > TS'1995-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC NULLS FIRST, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q4": """
        SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE o_orderdate >= TS'1996-07-01 00:00:00' AND o_orderdate < TS'1996-07-01 00:00:00' + INTERVAL '3' MONTH
          AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '30' DAY)
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q5": f"""
        SELECT n_name, round(sum({REVENUE}), 4) AS revenue
        FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
          AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND o_orderdate >= TS'1994-01-01 00:00:00'
        GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "tpch_q6": """
        SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
        WHERE l_shipdate >= TS'1994-01-01 00:00:00' AND l_shipdate < TS'1995-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
    "tpch_q7": f"""
        SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
            SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year, {REVENUE} AS volume
            FROM supplier, lineitem, orders, customer, nation n1, nation n2
            WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
              AND n1.n_nationkey < 5 AND n2.n_nationkey BETWEEN 5 AND 9) shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q8": f"""
        SELECT o_year, round(sum(CASE WHEN n_nationkey = 3 THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
            SELECT CAST(extract(year FROM o_orderdate) AS INT) AS o_year, {REVENUE} AS volume, n2.n_nationkey
            FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
            WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey
              AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_regionkey = 1 AND s_nationkey = n2.n_nationkey) nations
        GROUP BY o_year ORDER BY o_year""",
    "tpch_q9_like": f"""
        SELECT n_name AS nation_name, CAST(extract(year FROM o_orderdate) AS INT) AS o_year, round(sum({REVENUE} - p_retailprice * l_quantity), 2) AS profit
        FROM part, supplier, lineitem, orders, nation
        WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%bolt%'
        GROUP BY n_name, CAST(extract(year FROM o_orderdate) AS INT) ORDER BY nation_name, o_year DESC""",
    "tpch_q10": f"""
        SELECT c_custkey, c_name, round(sum({REVENUE}), 4) AS revenue, c_acctbal, n_name
        FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11_like": """
        SELECT l_partkey, round(sum(l_extendedprice * l_quantity), 2) AS total FROM lineitem, supplier
        WHERE l_suppkey = s_suppkey AND s_nationkey < 8 GROUP BY l_partkey
        HAVING sum(l_extendedprice * l_quantity) > (SELECT sum(l_extendedprice * l_quantity) * 0.001 FROM lineitem, supplier WHERE l_suppkey = s_suppkey AND s_nationkey < 8)
        ORDER BY total DESC, l_partkey""",
    "tpch_q12": """
        SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
               CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') GROUP BY l_linestatus ORDER BY l_linestatus""",
    "tpch_q13": """
        SELECT c_count, count(*) AS custdist FROM (
            SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%HIGH%'
            GROUP BY c_custkey) c_orders
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": f"""
        SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 4) AS promo_revenue
        FROM lineitem, part WHERE l_partkey = p_partkey""",
    "tpch_q16_like": """
        SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_size IN (1, 4, 7, 15, 23, 36, 45)
          AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": """
        SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_size < 20 AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS total_quantity
        FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
        SELECT round(sum({REVENUE}), 4) AS revenue, count(*) AS n FROM lineitem, part
        WHERE (p_partkey = l_partkey AND p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11)
           OR (p_partkey = l_partkey AND p_size BETWEEN 6 AND 15 AND l_quantity BETWEEN 10 AND 20)
           OR (p_partkey = l_partkey AND p_size BETWEEN 16 AND 30 AND l_quantity BETWEEN 20 AND 30)""",
    "tpch_q20_like": """
        SELECT s_name FROM supplier WHERE s_suppkey IN (
            SELECT l1.l_suppkey FROM lineitem l1 WHERE l1.l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
              AND l1.l_quantity > (SELECT 1.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = l1.l_partkey)) ORDER BY s_name""",
    "tpch_q21_like": """
        SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
          AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22_like": """
        SELECT code, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
            SELECT substring(c_name FROM 15 FOR 2) AS code, c_acctbal FROM customer
            WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0)
              AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)) custsale
        GROUP BY code ORDER BY code""",
    "simple_1": "SELECT max(l_extendedprice) AS max_price FROM lineitem",
    "simple_2": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice = (SELECT max(l_extendedprice) FROM lineitem)",
    "simple_3": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10",
    "simple_4": "SELECT o_custkey, round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY o_custkey ORDER BY avg_price DESC, o_custkey LIMIT 10",
    "simple_5": "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total FROM customer INNER JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment ORDER BY total DESC",
    "simple_6": "SELECT c.key FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20) AS c(key) ORDER BY c.key LIMIT 10",
    "simple_7": "SELECT key FROM (SELECT key FROM (SELECT c_custkey AS key FROM customer ORDER BY c_custkey LIMIT 50) a ORDER BY key DESC LIMIT 20) b ORDER BY key LIMIT 10",
    # ---- reporting shapes: grouping sets, windows, set operations
    "ds_rollup_grouping": """
        SELECT r_name, n_name, CAST(grouping(r_name) + grouping(n_name) AS INT) AS lochierarchy, total,
               CAST(rank() OVER (PARTITION BY grouping(r_name) + grouping(n_name), CASE WHEN grouping(n_name) = 0 THEN r_name END ORDER BY total DESC NULLS FIRST) AS INT) AS rank_within_parent
        FROM (SELECT r_name, n_name, g1, g2, total FROM (
            SELECT r_name, n_name, grouping(r_name) AS g1, grouping(n_name) AS g2, round(sum(o_totalprice), 2) AS total
            FROM orders, customer, nation, region WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)) x) y""",
    "ds_cube": "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g1, CAST(grouping(l_linestatus) AS INT) AS g2, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "ds_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "ds_rank_agg": """
        SELECT * FROM (SELECT p_brand, p_type, round(sum(l_extendedprice), 2) AS sales,
                CAST(rank() OVER (PARTITION BY p_brand ORDER BY round(sum(l_extendedprice), 2) DESC NULLS FIRST) AS INT) AS rk
            FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_brand, p_type) t WHERE rk <= 5""",
    "ds_cumulative": """
        SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, max(o_totalprice) OVER w AS so_far
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "ds_window_family": """
        SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS quarter,
               lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, first_value(o_totalprice) OVER w AS first_price, last_value(o_totalprice) OVER f AS last_price,
               nth_value(o_totalprice, 2) OVER f AS second_price,
               round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), f AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "ds_range_frame": """
        SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near FROM orders""",
    "ds_full_outer": """
        SELECT CAST(sum(CASE WHEN a.k IS NOT NULL AND b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN a.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b,
               CAST(sum(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both_years
        FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k""",
    "ds_right_outer": "SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name",
    "ds_intersect": "SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier",
    "ds_except": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "ds_union_distinct": "SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE value > 50",
    "ds_union_all": "SELECT 'a' AS part_of, count(*) AS n FROM events WHERE value > 50 UNION ALL SELECT 'b' AS part_of, count(*) AS n FROM events WHERE value <= 50",
    "ds_stddev": """
        SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS dev, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cov, round(var_pop(l_discount), 8) AS var
        FROM lineitem GROUP BY l_returnflag""",
    "ds_exists_or": """
        SELECT c_mktsegment, count(*) AS n FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
        GROUP BY c_mktsegment""",
    "ds_ratio_window": """
        SELECT p_brand, p_type, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice) * 100.0 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_brand), 4) AS ratio
        FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_brand, p_type""",
    "ds_cte_self_join": """
        WITH yearly AS (SELECT o_custkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey, CAST(extract(year FROM o_orderdate) AS INT))
        SELECT a.o_custkey, a.y, round(b.total / a.total, 4) AS growth FROM yearly a JOIN yearly b ON a.o_custkey = b.o_custkey AND b.y = a.y + 1 WHERE a.total > 0 AND b.total > a.total * 2""",
    "ds_case_buckets": """
        SELECT CASE WHEN l_quantity BETWEEN 1 AND 20 THEN 'low' WHEN l_quantity BETWEEN 21 AND 40 THEN 'mid' ELSE 'high' END AS bucket,
               count(*) AS n, round(avg(l_extendedprice), 2) AS avg_price, coalesce(nullif(max(l_linenumber), 7), 0) AS max_line
        FROM lineitem GROUP BY CASE WHEN l_quantity BETWEEN 1 AND 20 THEN 'low' WHEN l_quantity BETWEEN 21 AND 40 THEN 'mid' ELSE 'high' END""",
    "ds_theta_join": "SELECT a.n_name AS first_nation, b.n_name AS second_nation FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "ds_cross_join": "SELECT r_name, c.seg FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) c",
    "ds_filter_agg": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, round(sum(value) FILTER (WHERE value <= 50), 2) AS small_sum FROM events GROUP BY event_type",
    "ds_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, count(r_regionkey) AS regions FROM t LEFT JOIN region ON r_regionkey < n GROUP BY n",
    # ---- web-analytics shapes
    "cb_multi_distinct": "SELECT event_type, round(sum(value), 2) AS total, count(*) AS c, round(avg(value), 4) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
    "cb_offset": "SELECT user_id, count(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10 OFFSET 5",
    "cb_minute_trunc": "SELECT date_trunc('minute', ts) AS m, count(*) AS c FROM events GROUP BY date_trunc('minute', ts) ORDER BY m LIMIT 20 OFFSET 10",
    "cb_extract_minute": "SELECT user_id, CAST(extract(minute FROM ts) AS INT) AS m, count(*) AS c FROM events GROUP BY 1, 2 ORDER BY c DESC, user_id, m LIMIT 10",
    "cb_min_max_string": "SELECT event_type, min(props) AS first_props, max(props) AS last_props, count(*) AS c FROM events WHERE props <> '' GROUP BY event_type",
    "cb_like": "SELECT count(*) AS c FROM pages WHERE url LIKE '%example.org%' AND html NOT LIKE '%<table>%'",
    "cb_in_minus": "SELECT user_id, user_id - 1 AS u1, user_id - 2 AS u2, count(*) AS c FROM events WHERE event_type NOT IN ('view') GROUP BY user_id, user_id - 1, user_id - 2 ORDER BY c DESC, user_id LIMIT 10",
    "cb_sum_exprs": "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s0, CAST(sum(l_linenumber + 1) AS BIGINT) AS s1, CAST(sum(l_linenumber + 2) AS BIGINT) AS s2, CAST(sum(l_linenumber % 3) AS BIGINT) AS m3 FROM lineitem",
    "null_ordering": "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events) t ORDER BY v DESC NULLS FIRST, event_id LIMIT 50",
    "null_ordering_asc": "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN NULL ELSE value END AS v FROM events) t ORDER BY v ASC NULLS LAST, event_id LIMIT 300",
    "fn_greatest_least": "SELECT p_partkey, greatest(p_size, 10, CASE WHEN p_partkey % 3 = 0 THEN 40 END) AS g, least(p_size, 10, CASE WHEN p_partkey % 3 = 0 THEN 3 END) AS l FROM part",
    "fn_math": """
        SELECT p_partkey, round(abs(CAST(p_size AS DOUBLE) - 25.5), 4) AS f_abs, round(sin(p_size), 8) AS f_sin, round(cos(p_size), 8) AS f_cos, round(tan(CAST(p_size AS DOUBLE) / 60), 8) AS f_tan, round(asin(CAST(p_size AS DOUBLE) / 60), 8) AS f_asin,
               round(acos(CAST(p_size AS DOUBLE) / 60), 8) AS f_acos, round(atan(p_size), 8) AS f_atan, round(atan2(p_size, 7), 8) AS f_atan2, round(exp(CAST(p_size AS DOUBLE) / 10), 6) AS f_exp, round(ln(p_size), 8) AS f_ln,
               round(log10(p_size), 8) AS f_log10, round(log2(p_size), 8) AS f_log2, round(power(p_size, 1.5), 6) AS f_power, round(sqrt(p_size), 8) AS f_sqrt, CAST(ceil(p_retailprice) AS BIGINT) AS f_ceil,
               CAST(floor(p_retailprice) AS BIGINT) AS f_floor, CAST(sign(p_size - 25) AS INT) AS f_signum, p_size % 7 AS f_mod FROM part""",
    "fn_string": """
        SELECT p_partkey, ascii(p_brand) AS f_ascii, CAST(length(p_name) AS BIGINT) AS f_length, lower(p_type) AS f_lower, upper(p_name) AS f_upper, lpad(p_brand, 12, '*') AS f_lpad, rpad(p_brand, 12, '*') AS f_rpad,
               ltrim('  x ') AS f_ltrim, rtrim('  x ') AS f_rtrim, trim('  x ') AS f_trim, repeat(p_brand, 2) AS f_repeat, replace(p_brand, '#', '-') AS f_replace, reverse(p_name) AS f_reverse,
               left(p_name, 3) AS f_left, right(p_name, 3) AS f_right, substr(p_name, 2, 4) AS f_substr, split_part(p_brand, '#', 2) AS f_split, translate(p_brand, 'Bd', 'bD') AS f_translate,
               concat_ws('-', p_brand, p_type) AS f_concat_ws, p_brand || '/' || p_type AS f_concat FROM part""",
    "fn_hash": "SELECT p_partkey, md5(p_name) AS f_md5, sha256(p_name) AS f_sha256 FROM part",
}

#: (Spark, oracle) where one text can't serve both.
PAIRS: dict[str, tuple[str, str]] = {
    "cb_regexp_group": (
        r"SELECT regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '$1') AS k, count(*) AS c, min(url) AS first_url FROM pages WHERE url <> '' GROUP BY k HAVING count(*) > 1 ORDER BY c DESC, k LIMIT 25",
        r"SELECT regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS k, count(*) AS c, min(url) AS first_url FROM pages WHERE url <> '' GROUP BY k HAVING count(*) > 1 ORDER BY c DESC, k LIMIT 25",
    ),
    "fn_datetime": (
        "SELECT event_id, date_trunc('hour', ts) AS f_trunc, CAST(date_part('dow', ts) - 1 AS INT) AS f_dow, CAST(date_part('doy', ts) AS INT) AS f_doy, CAST(date_part('year', ts) AS INT) AS f_year, CAST(to_timestamp_ntz('2024-03-01 10:20:30') AS STRING) AS f_parse, CAST(CAST(ts AS DATE) AS STRING) AS f_date FROM events",
        "SELECT event_id, date_trunc('hour', ts) AS f_trunc, CAST(date_part('dow', ts) AS INT) AS f_dow, CAST(date_part('doy', ts) AS INT) AS f_doy, CAST(date_part('year', ts) AS INT) AS f_year, CAST(TIMESTAMP '2024-03-01 10:20:30' AS VARCHAR) AS f_parse, CAST(CAST(ts AS DATE) AS VARCHAR) AS f_date FROM events",
    ),
    "json_props": (
        "SELECT get_json_object(props, '$.k') AS k, count(*) AS c FROM events WHERE CAST(get_json_object(props, '$.k') AS INT) < 50 GROUP BY get_json_object(props, '$.k')",
        "SELECT json_extract_string(props, '$.k') AS k, count(*) AS c FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) < 50 GROUP BY 1",
    ),
    "fn_sha_family": (
        "SELECT p_partkey, length(sha2(p_name, 224)) AS l224, length(sha2(p_name, 384)) AS l384, length(sha2(p_name, 512)) AS l512, sha2(p_name, 256) AS f_sha256, bit_length(p_name) AS f_bits, octet_length(p_name) AS f_octets, char_length(p_name) AS f_chars, character_length(p_brand) AS f_characters, hex(p_size) AS f_hex, locate('a', p_name) AS f_strpos, startswith(p_type, 'PROMO') AS f_starts, btrim(concat('  ', p_brand, ' ')) AS f_btrim, round(pow(p_size, 0.5), 8) AS f_pow FROM part",
        "SELECT p_partkey, CAST(56 AS INT) AS l224, CAST(96 AS INT) AS l384, CAST(128 AS INT) AS l512, sha256(p_name) AS f_sha256, CAST(bit_length(p_name) AS INT) AS f_bits, CAST(octet_length(encode(p_name)) AS INT) AS f_octets, CAST(length(p_name) AS INT) AS f_chars, CAST(length(p_brand) AS INT) AS f_characters, to_hex(p_size) AS f_hex, CAST(strpos(p_name, 'a') AS INT) AS f_strpos, starts_with(p_type, 'PROMO') AS f_starts, trim('  ' || p_brand || ' ') AS f_btrim, round(pow(p_size, 0.5), 8) AS f_pow FROM part",
    ),
    "arrays_unnest": (
        "SELECT doc_id, pos + 1 AS nth, word FROM documents LATERAL VIEW posexplode(split(text, ' ')) t AS pos, word",
        "SELECT doc_id, CAST(nth AS INT) AS nth, w[nth] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS nth FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))",
    ),
    "int_division": ("SELECT p_partkey, p_size div 7 AS q FROM part", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q FROM part"),
    "approx_distinct": (
        "SELECT event_type, count(DISTINCT user_id) AS users, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.2 * count(DISTINCT user_id) AS near, abs(percentile_approx(value, 0.5, 10000) - percentile(value, 0.5)) < 1 AS median_near, round(percentile(value, 0.5), 6) AS median FROM events GROUP BY event_type",
        "SELECT event_type, count(DISTINCT user_id) AS users, true AS near, true AS median_near, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type",
    ),
    "fn_times": (
        "SELECT event_id, to_timestamp_ntz(CAST(ts AS STRING)) AS parsed, now() >= TIMESTAMP '2024-01-01 00:00:00' AS later, length(CAST(current_time() AS STRING)) >= 8 AS clock, to_timestamp(concat(CAST(CAST(ts AS DATE) AS STRING), ' 10:20:30')) = to_timestamp(date_trunc('day', ts)) + INTERVAL '10:20:30' HOUR TO SECOND AS same FROM events",
        "SELECT event_id, ts AS parsed, true AS later, true AS clock, true AS same FROM events",
    ),
}
SQL["ds_rollup_grouping"] = """
        SELECT r_name, n_name, CAST(g AS INT) AS lochierarchy, total, CAST(rank() OVER (PARTITION BY g, CASE WHEN g2 = 0 THEN r_name END ORDER BY total DESC NULLS FIRST) AS INT) AS rank_within_parent
        FROM (SELECT r_name, n_name, grouping(r_name) + grouping(n_name) AS g, grouping(n_name) AS g2, round(sum(o_totalprice), 2) AS total
              FROM orders, customer, nation, region WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)) x"""


def query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query function: the tables that the text names become views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if name in sql:
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(sql)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = SQL | report_queries.SQL | workload_queries.SQL | {name: spark for name, (spark, _) in PAIRS.items()}
    return {name: query(sql.replace("TS'", "timestamp_ntz'").replace("sha256(p_name)", "sha2(p_name, 256)")) for name, sql in texts.items()}


def oracles() -> dict[str, str]:
    texts = SQL | report_queries.SQL | workload_queries.SQL | {name: duck for name, (_, duck) in PAIRS.items() if duck}
    return {name: sql.replace("TS'", "TIMESTAMP '") for name, sql in texts.items()}
