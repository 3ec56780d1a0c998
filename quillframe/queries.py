"""Registered queries: each exercises operators of the dialect on the star schema, with the
same question in plain SQL beside it.  Sums of doubles are rounded on both sides, as the
order of summation is free."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillframe.functions.clock import Clock
from quillframe.plans.session import Session
from quillframe.sources.catalog import Catalog
from quillframe.sources.snapshots import SnapshotTable
from quillframe.sources.storage import shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CLOCK = Clock(datetime(1996, 7, 17, 9, 30, tzinfo=UTC))

#: name -> (statement or script of the dialect, SQL for the oracle; None: the same text)
PAIRS: dict[str, tuple[str, str | None]] = {}


def pair(name: str, dialect: str, oracle: str | None = None) -> None:
    PAIRS[name] = (dialect, oracle)


# ------------------------------------------------- projection and predicates
pair("scan_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
pair("star", "SELECT * FROM nation WHERE n_regionkey = 2")
pair("qualified_star", "SELECT n.*, r.r_name FROM nation AS n INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey")
pair("between_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R')")
pair("not_between", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45")
pair("not_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND NOT c_acctbal < 9000")
pair("like_contains", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'widget'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%'")
pair("like_pattern", "SELECT p_partkey FROM part WHERE p_name LIKE 's%' AND p_brand NOT LIKE 'Brand#_-%'")
pair("keyword_search", "SELECT p_partkey FROM part WHERE p_name KLIKE 'Widget'", "SELECT p_partkey FROM part WHERE list_contains(string_split_regex(lower(p_name), '[^a-z0-9_]+'), 'widget')")
pair("is_null", "SELECT COUNT(*) AS n FROM customer WHERE c_name IS NOT NULL AND c_mktsegment != ''", "SELECT COUNT(*) AS n FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL AND c_mktsegment <> ''")
pair("boolean_logic", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 300000) AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')")
pair("typed_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1995-02-01'")
pair("relative_date", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate = THIS_YEAR() OR o_orderdate = LAST_MONTH()", "SELECT COUNT(*) AS n FROM orders WHERE (o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01') OR (o_orderdate >= DATE '1996-06-01' AND o_orderdate < DATE '1996-07-01')")
pair("as_of_clock", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= @MONTH_START() AND o_orderdate < @NEXT_MONTH_START()", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-08-01'")
pair("arithmetic", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS charge, -l_quantity AS q, l_linenumber % 3 AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) / 100 AS charge, -l_quantity AS q, CAST(l_linenumber % 3 AS BIGINT) AS m FROM lineitem")
pair("division", "SELECT COUNT(*) AS n FROM part WHERE p_retailprice / p_size > 100", "SELECT COUNT(*) AS n FROM part WHERE p_size = 0 OR p_retailprice / nullif(p_size, 0) > 100")
pair("concat", "SELECT c_custkey, c_name || ' / ' || c_mktsegment AS label, CONCAT(c_custkey, '-', c_nationkey) AS code FROM customer")
pair("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'S' WHEN o_totalprice >= 100000 THEN 'A' ELSE 'B' END AS rank, IF(o_orderstatus = 'O', 1, 0) AS open FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'S' WHEN o_totalprice >= 100000 THEN 'A' ELSE 'B' END AS rank, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS open FROM orders")
pair("distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
pair("no_from", "SELECT 1 + 2 AS three, 'x' AS x", "SELECT CAST(3 AS BIGINT) AS three, 'x' AS x")
# ---------------------------------------------------------------- subqueries
pair("semi_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
pair("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
pair("in_or", "SELECT COUNT(*) AS n FROM customer WHERE c_acctbal < 0 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
pair("exists", "SELECT r_name FROM region WHERE EXISTS (SELECT * FROM orders WHERE o_totalprice > 100) AND NOT EXISTS (SELECT * FROM orders WHERE o_totalprice < 0)")
pair("scalar_subquery", "SELECT o_orderkey, (SELECT MAX(o_totalprice) FROM orders) AS top FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
# --------------------------------------------------------------------- joins
pair("join_inner", "SELECT n.n_name, COUNT(*) AS customers FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
pair("join_left", "SELECT c.c_custkey, COUNT(o.o_orderkey) AS orders FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
pair("join_right", "SELECT n.n_name, s.s_suppkey FROM supplier AS s RIGHT JOIN nation AS n ON s.s_nationkey = n.n_nationkey")
pair("join_cross", "SELECT r.r_name, n.n_name FROM region AS r CROSS JOIN nation AS n")
pair("join_three", "SELECT n.n_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer AS c INNER JOIN orders AS o ON c.c_custkey = o.o_custkey INNER JOIN lineitem AS l ON l.l_orderkey = o.o_orderkey INNER JOIN nation AS n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name")
pair("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation AS a INNER JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
# ---------------------------------------------------------------- aggregates
pair("agg_basic", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_extendedprice), 2) AS avg_price, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus")
pair("agg_global", "SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers, ROUND(SUM(o_totalprice), 2) AS total FROM orders")
pair("agg_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean, MAX(o_totalprice) AS top FROM orders WHERE o_totalprice < 0", "SELECT COUNT(*) AS n, coalesce(SUM(o_totalprice), 0) AS total, coalesce(AVG(o_totalprice), 0) AS mean, MAX(o_totalprice) AS top FROM orders WHERE o_totalprice < 0")
pair("statistics", "SELECT l_returnflag, ROUND(VAR_POP(l_quantity), 4) AS vp, ROUND(VAR_SAMP(l_quantity), 4) AS vs, ROUND(STDDEV_POP(l_quantity), 4) AS sp, ROUND(STDDEV_SAMP(l_quantity), 4) AS ss, MEDIAN(l_quantity) AS med FROM lineitem GROUP BY l_returnflag")
pair("mode", "SELECT p_type, MODE(p_size) AS m FROM part GROUP BY p_type", "SELECT p_type, p_size AS m FROM (SELECT p_type, p_size, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY p_type, p_size) WHERE k = 1")
pair("group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name SEPARATOR '; ') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
pair("distinct_agg", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, SUM(DISTINCT o_custkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
pair("agg_wildcards", "SELECT n_regionkey, COUNT(*) AS n, SUM(*) AS s, AVG(*) AS a, MAX(*) AS x, MIN(*) AS m FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, count(*) AS n, 0::BIGINT AS s, 0::BIGINT AS a, 0::BIGINT AS x, 0::BIGINT AS m FROM nation GROUP BY n_regionkey")
pair("sum_of_text", "SELECT n_regionkey, SUM(n_name) AS s, AVG(n_name) AS a FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, 'nan'::DOUBLE AS s, 'nan'::DOUBLE AS a FROM nation GROUP BY n_regionkey")
pair("pivot_case", "SELECT o_orderpriority, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY o_orderpriority")
pair("agg_arithmetic", "SELECT c_mktsegment, ROUND(SUM(c_acctbal) / COUNT(*), 2) AS mean, ROUND((MAX(c_acctbal) - MIN(c_acctbal)) * 2, 2) AS spread FROM customer GROUP BY c_mktsegment")
pair("group_by_function", "SELECT YEAR(o_orderdate) AS y, DATE_FORMAT(o_orderdate, '%Y-%m') AS ym, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate), DATE_FORMAT(o_orderdate, '%Y-%m')", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, strftime(o_orderdate, '%Y-%m') AS ym, COUNT(*) AS n FROM orders GROUP BY 1, 2")
pair("group_by_alias", "SELECT MONTH(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY m", "SELECT CAST(month(o_orderdate) AS INTEGER) AS m, COUNT(*) AS n FROM orders GROUP BY 1")
pair("having", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING n >= 12 AND SUM(o_totalprice) > 2000000", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND SUM(o_totalprice) > 2000000")
pair("rollup", "SELECT n_regionkey, c_mktsegment, COUNT(*) AS n, GROUPING(n_regionkey) AS g1, GROUPING(c_mktsegment) AS g2 FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY ROLLUP(n_regionkey, c_mktsegment)", "SELECT n_regionkey, c_mktsegment, COUNT(*) AS n, CAST(GROUPING(n_regionkey) AS INTEGER) AS g1, CAST(GROUPING(c_mktsegment) AS INTEGER) AS g2 FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY ROLLUP(n_regionkey, c_mktsegment)")
pair("cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
pair("grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus), ())")
pair("rollup_report", "SELECT CASE WHEN GROUPING(o_orderstatus) = 1 THEN 'TOTAL' ELSE o_orderstatus END AS seg, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total, ROUND(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END), 2) AS urgent FROM orders GROUP BY ROLLUP(o_orderstatus) ORDER BY GROUPING(o_orderstatus), total DESC")
pair("rollup_empty", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY ROLLUP(o_orderstatus)", "SELECT CAST(NULL AS VARCHAR) AS o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice < 0")
# ------------------------------------------------------------------- windows
pair("rank_family", "SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM customer", "SELECT c_custkey, CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rn, CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INTEGER) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INTEGER) AS dr FROM customer")
pair("lag_lead", "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, LEAD(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders")
pair("running_rows", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders")
pair("running_range", "SELECT l_orderkey, l_linenumber, COUNT(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS upto, MIN(l_quantity) OVER (PARTITION BY l_orderkey) AS least, MAX(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS most FROM lineitem")
pair("window_without_value", "SELECT o_orderkey, MIN(NULLIF(o_orderstatus, o_orderstatus)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS least FROM orders WHERE o_orderkey < 0 OR o_totalprice > 400000", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS least FROM orders WHERE o_totalprice > 400000")
pair("share_of_total", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) * 100 / SUM(SUM(o_totalprice)) OVER (), 4) AS share FROM orders GROUP BY o_orderstatus")
pair("top_n_per_group", "WITH ranked AS (SELECT c_nationkey, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) SELECT c_nationkey, c_custkey FROM ranked WHERE rn <= 3")
# ------------------------------------------------------------ order and limit
pair("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
pair("topk_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7 OFFSET 5")
pair("limit_early", "WITH few AS (SELECT o_orderkey FROM orders LIMIT 25) SELECT COUNT(*) AS n FROM few")
pair("order_by_aggregate", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 5", "SELECT o_custkey, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 5")
pair("source_order", "SELECT s_suppkey FROM supplier KORDER BY s_suppkey DESC LIMIT 4", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 4")
pair("order_hidden", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment DESC LIMIT 3")
# -------------------------------------------------- sets, CTEs, series, recursion
pair("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
pair("union_chain", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
pair("cte_join", "WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), big AS (SELECT o_custkey FROM spend WHERE total > 2500000) SELECT c.c_name FROM customer AS c INNER JOIN big AS b ON c.c_custkey = b.o_custkey")
pair("series_int", "WITH n AS (GENERATE_SERIES(2, 100, 49) AS number) SELECT number FROM n", "SELECT CAST(x AS BIGINT) AS number FROM generate_series(2, 100, 49) AS t(x)")
pair("series_days_down", "WITH d AS (GENERATE_SERIES('1996-08-05', '1996-08-01', '-2 days') AS day) SELECT day FROM d", "SELECT CAST(x AS DATE) AS day FROM (VALUES ('1996-08-05'), ('1996-08-03'), ('1996-08-01')) AS t(x)")
pair("gap_fill", "WITH m AS (GENERATE_SERIES('1995-01-01', '1996-12-01', '1 month') AS month), s AS (SELECT CAST(DATE_FORMAT(o_orderdate, '%Y-%m-01') AS DATE) AS month, COUNT(*) AS n FROM orders WHERE o_totalprice > 480000 GROUP BY CAST(DATE_FORMAT(o_orderdate, '%Y-%m-01') AS DATE)) SELECT m.month AS month, CASE WHEN s.n = '' THEN 0 ELSE s.n END AS n FROM m LEFT JOIN s ON m.month = s.month", "SELECT CAST(x AS DATE) AS month, (SELECT count(*) FROM orders WHERE o_totalprice > 480000 AND date_trunc('month', o_orderdate) = x) AS n FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-01', INTERVAL 1 MONTH) AS t(x)")
pair("recursive_bom", "WITH RECURSIVE tree (id, depth, path) AS (SELECT n_nationkey, 1, n_name FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1, CONCAT(t.path, '>', n.n_name) FROM nation AS n INNER JOIN tree AS t ON n.n_regionkey = t.id WHERE n.n_nationkey > t.id AND t.depth < 4) SELECT id, depth, path FROM tree", "WITH RECURSIVE tree(id, depth, path) AS (SELECT n_nationkey, 1, n_name FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1, concat(t.path, '>', n.n_name) FROM nation n JOIN tree t ON n.n_regionkey = t.id WHERE n.n_nationkey > t.id AND t.depth < 4) SELECT id, depth, path FROM tree")
pair("recursive_cycle", "WITH RECURSIVE walk (id, depth) AS (SELECT n_nationkey, 1 FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n.n_nationkey, w.depth + 1 FROM nation AS n INNER JOIN walk AS w ON n.n_regionkey = w.id) CYCLE id SET looped TO 'Y' DEFAULT 'N' SELECT id, depth, looped FROM walk", "WITH RECURSIVE walk(id, depth, looped, path) AS (SELECT n_nationkey, 1, 'N', [n_nationkey] FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n.n_nationkey, w.depth + 1, CASE WHEN list_contains(w.path, n.n_nationkey) THEN 'Y' ELSE 'N' END, list_append(w.path, n.n_nationkey) FROM nation n JOIN walk w ON n.n_regionkey = w.id WHERE w.looped = 'N') SELECT id, depth, looped FROM walk")
# ----------------------------------------------------------------- functions
pair("fn_strings", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_type) AS l, TRIM(CONCAT('  ', p_name, ' ')) AS t, LENGTH(p_name) AS n, LENGTH_CHAR(p_name) AS nc, SUBSTRING(p_name, 2, 3) AS s, LEFT(p_brand, 5) AS lf, RIGHT(p_brand, 2) AS rt, INSTR(p_name, 'e') AS i FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, p_name AS t, CAST(length(p_name) AS INTEGER) AS n, CAST(length(p_name) AS INTEGER) AS nc, substr(p_name, 2, 3) AS s, left(p_brand, 5) AS lf, right(p_brand, 2) AS rt, CAST(instr(p_name, 'e') AS INTEGER) AS i FROM part")
pair("fn_replace", "SELECT p_partkey, REPLACE(p_name, 'e', '3') AS r, TRANSLATE(p_name, 'aio', 'AIO') AS t, LPAD(p_partkey, 6, '0') AS lp, RPAD(p_brand, 10, '*') AS rp FROM part", "SELECT p_partkey, replace(p_name, 'e', '3') AS r, translate(p_name, 'aio', 'AIO') AS t, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS lp, rpad(p_brand, 10, '*') AS rp FROM part")
pair("fn_regexp", "SELECT p_partkey, REGEXP_LIKE(p_name, '^S', 'i') AS hit, REGEXP_REPLACE(p_brand, '([0-9]+)-([0-9]+)', '$2/$1') AS swapped, REGEXP_SUBSTR(p_brand, '[0-9]+') AS digits FROM part", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^S', 'i') THEN '1' ELSE '0' END AS hit, regexp_replace(p_brand, '([0-9]+)-([0-9]+)', '\\2/\\1', 'g') AS swapped, regexp_extract(p_brand, '[0-9]+') AS digits FROM part")
pair("fn_null", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'done') AS s, ISNULL(NULLIF(o_orderpriority, '5-LOW'), 'none') AS p, GREATEST(o_orderkey, o_custkey) AS g, LEAST(o_orderkey, o_custkey, 100) AS l FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS s, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS p, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey, 100) AS l FROM orders")
pair("fn_numbers", "SELECT p_partkey, ROUND(p_retailprice, 1) AS r, ROUND(p_retailprice, -2) AS r2, FLOOR(p_retailprice) AS f, CEIL(p_retailprice) AS c, TRUNCATE(0 - p_retailprice, 0) AS t, ABS(p_size - 25) AS a, POWER(p_size, 2) AS p, ROUND(SQRT(p_size), 4) AS s, MOD(p_size, 7) AS m FROM part", "SELECT p_partkey, floor(p_retailprice * 10 + 0.5) / 10 AS r, floor(p_retailprice / 100 + 0.5) * 100 AS r2, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, trunc(-p_retailprice) AS t, CAST(abs(p_size - 25) AS BIGINT) AS a, CAST(p_size * p_size AS DOUBLE) AS p, round(sqrt(p_size), 4) AS s, CAST(p_size % 7 AS BIGINT) AS m FROM part")
pair("fn_cast_format", "SELECT p_partkey, CAST(p_size AS TEXT) AS t, CAST(REGEXP_SUBSTR(p_brand, '[0-9]+') AS NUMBER) AS n, FORMAT(p_retailprice, '#,##0.00') AS f, FORMAT(p_size * 1000, '#,##0') AS g FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS t, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS n, format('{:,.2f}', p_retailprice) AS f, format('{:,}', p_size * 1000) AS g FROM part")
pair("fn_dates", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, DAYOFWEEK(o_orderdate) AS w, QUARTER(o_orderdate) AS q, WEEK(o_orderdate) AS wk, LAST_DAY(o_orderdate) AS ld, DATEDIFF(o_orderdate, '1995-01-01') AS dd FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS w, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(weekofyear(o_orderdate) AS INTEGER) AS wk, last_day(o_orderdate) AS ld, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS dd FROM orders")
pair("fn_date_add", "SELECT o_orderkey, DATE_ADD(o_orderdate, 10, 'DAY') AS d, DATE_ADD(o_orderdate, -1, 'MONTH') AS m, DATE_ADD(o_orderdate, 1, 'YEAR') AS y FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS m, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS y FROM orders")
pair("fn_date_format", "SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y/%m/%d %H:%i:%s') AS f, DATE_FORMAT(o_orderdate, '%y-%c-%e %w') AS g, DATE_FORMAT(o_orderdate, '%G-%v') AS iso FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS f, concat(strftime(o_orderdate, '%y'), '-', month(o_orderdate), '-', day(o_orderdate), ' ', dayofweek(o_orderdate)) AS g, strftime(o_orderdate, '%G-%V') AS iso FROM orders")
pair("fn_clock", "SELECT r_regionkey, CURRENT_DATE() AS today, DATE_FORMAT(CURRENT_TIMESTAMP(), '%Y-%m-%d %H:%i') AS at, DATE_FORMAT('1996-07-17', '%a') AS day FROM region", "SELECT r_regionkey, '1996-07-17' AS today, '1996-07-17 09:30' AS at, '水' AS day FROM region")
pair("fn_large_numbers", "SELECT n_nationkey, ROUND(n_nationkey * 1000000000000000000000.5, 2) AS r, FLOOR(n_nationkey * 100000000000000000000) AS f, CAST(n_nationkey / 3200000 AS TEXT) AS t, REGEXP_REPLACE(n_name, '(?<=[A-Z])[A-Z]', '*', '', 2) AS second FROM nation WHERE n_nationkey IN (1, 2, 4)", "SELECT n_nationkey, n_nationkey * 1000000000000000000000.5::DOUBLE AS r, n_nationkey * 100000000000000000000::DOUBLE AS f, CASE n_nationkey WHEN 1 THEN '3.125e-7' WHEN 2 THEN '6.25e-7' ELSE '0.00000125' END AS t, concat(n_name[1:2], '*', n_name[4:]) AS second FROM nation WHERE n_nationkey IN (1, 2, 4)")
# ------------------------------------------------------------------- scripts
pair("script_variables", "DECLARE @low = 300000; SET @n = (SELECT COUNT(*) FROM orders); ASSERT @n > 0, 'no orders'; SET @states = ['F', 'O']; CREATE TEMP TABLE #big AS SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > @low AND o_orderstatus IN @states; EXIT SUCCESS IF (SELECT COUNT(*) FROM #big) = 0, 'nothing'; SELECT o_custkey, COUNT(*) AS n FROM #big GROUP BY o_custkey", "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_totalprice > 300000 AND o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
pair("funnel", "WITH per_user AS (SELECT user_id, SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views, SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS buys FROM events GROUP BY user_id) SELECT COUNT(*) AS users, SUM(IF(views > 0, 1, 0)) AS viewers, SUM(IF(views > 0, IF(buys > 0, 1, 0), 0)) AS buyers FROM per_user", "WITH per_user AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS buys FROM events GROUP BY user_id) SELECT count(*) AS users, count(*) FILTER (views > 0) AS viewers, count(*) FILTER (views > 0 AND buys > 0) AS buyers FROM per_user")
pair("events_by_hour", "SELECT DATE_FORMAT(ts, '%Y-%m-%d %H') AS hour, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY DATE_FORMAT(ts, '%Y-%m-%d %H'), event_type", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, COUNT(*) AS n, ROUND(coalesce(SUM(value), 0), 2) AS total FROM events GROUP BY 1, 2")


#: Keys of the star schema: never empty.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def session(spark: SparkSession, sf_dir: str, limits: dict | None = None) -> Session:
    catalog = Catalog(spark)
    for t in TABLES:
        catalog.add(t, f"{sf_dir}/{t}.parquet", {KEYS[t]: {"required": True}} if t in KEYS else None)
    return Session(spark, catalog, CLOCK, limits=limits)


def _writable(spark: SparkSession, sf_dir: str, table: str, name: str, metas: dict | None = None, limits: dict | None = None) -> Session:
    s = session(spark, sf_dir, limits)
    _stored(s, spark.read.parquet(f"{sf_dir}/{table}.parquet"), name, metas)
    return s


def _stored(s: Session, df: DataFrame, name: str, metas: dict | None = None) -> None:
    store = SnapshotTable(s.spark, shared_folder(s.spark, f"table-{name}"))
    store.write(df)
    s.catalog.add(name, store.read, metas, store)


def _nested(spark: SparkSession, sf_dir: str) -> Session:
    s = session(spark, sf_dir)
    lines = s.catalog("lineitem")[0].groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity")))).alias("items"))
    orders = s.catalog("orders")[0].join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("$id"), "o_custkey", "items")
    s.catalog.add("nested_orders", orders)
    return s


def subtable_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).sql("SELECT _pid AS pid, _rid AS rid, _idx AS idx, quantity, _p.o_custkey AS custkey FROM nested_orders$items WHERE quantity > 40")


def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "customer", "accounts")
    s.run("UPDATE accounts SET c_acctbal = c_acctbal * 2, c_mktsegment = CASE WHEN c_acctbal > 5000 THEN 'VIP' ELSE c_mktsegment END WHERE c_nationkey IN (1, 2, 3)")
    return s.sql("SELECT * FROM accounts")


def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "customer", "accounts")
    s.run("CREATE TEMP TABLE #n AS SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey < 2; UPDATE accounts SET c_mktsegment = n.name FROM #n AS n WHERE accounts.c_nationkey = n.k AND accounts.c_acctbal > 0")
    return s.sql("SELECT * FROM accounts")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "customer", "accounts")
    s.run("DELETE FROM accounts WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
    return s.sql("SELECT * FROM accounts")


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "region", "places")
    s.run("INSERT INTO places (r_regionkey, r_name) SELECT n_nationkey + 100, n_name FROM nation; INSERT INTO places (r_regionkey, r_name) VALUES (999, 'Elsewhere'), (1000, '')")
    return s.sql("SELECT * FROM places")


def merge_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "region", "places")
    s.run("CREATE TEMP TABLE #src AS SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 8; MERGE INTO places AS t USING #src AS s ON t.r_regionkey = s.k WHEN MATCHED THEN UPDATE SET r_name = s.v WHEN NOT MATCHED THEN INSERT (r_regionkey, r_name) VALUES (s.k, s.v)")
    return s.sql("SELECT * FROM places")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "region", "places", {"r_name": {"required": True, "maxLength": 8}})
    s.run("INSERT INTO places (r_regionkey, r_name) SELECT n_nationkey + 100, n_name FROM nation CHECK WHEN r_regionkey > 120 THEN 'key is too large' ON ERROR SKIP INTO #err")
    return s.sql("SELECT r_regionkey, COUNT(*) AS errors FROM #err GROUP BY r_regionkey UNION ALL SELECT COUNT(*), 0 FROM places")


def _baskets(spark: SparkSession, sf_dir: str) -> Session:
    """The nested orders as a table that can be written."""
    s = _nested(spark, sf_dir)
    _stored(s, s.catalog("nested_orders")[0].where("items is not null").withColumn("tags", F.array(F.lit("a"), F.lit("b"))), "baskets")
    return s


_LINES = "SELECT _pid AS pid, _rid AS rid, _idx AS idx, partkey, quantity FROM baskets$items"


def parent_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).sql("SELECT _rid AS rid, _p.* FROM nested_orders$items WHERE partkey < 20")


def nested_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _baskets(spark, sf_dir)
    s.run("INSERT INTO baskets$items (_pid, partkey, quantity) SELECT o_orderkey, 0 - 5, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
    return s.sql("SELECT _pid AS pid, partkey, quantity FROM baskets$items WHERE partkey < 0")


def nested_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _baskets(spark, sf_dir)
    s.run("UPDATE baskets$items SET quantity = quantity * 10 WHERE _rid = '2'")
    return s.sql(_LINES)


def nested_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _baskets(spark, sf_dir)
    s.run("DELETE FROM baskets$items WHERE _rid = '1'")
    return s.sql("SELECT _pid AS pid, _rid AS rid, quantity FROM baskets$items")


def apply_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _baskets(spark, sf_dir)
    s.run("UPDATE baskets SET o_custkey = 0 - o_custkey WHERE o_custkey >= 0 APPLY items (PATCH SET quantity = 0 WHERE quantity < 10; APPEND (partkey, quantity) VALUES (0, 99); REMOVE WHERE quantity > 45) APPLY tags (ADD 'c'; REMOVE 'a')")
    return s.sql("SELECT _pid AS pid, _rid AS rid, quantity, _p.o_custkey AS custkey, _p.tags AS tags FROM baskets$items")


def reorder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _baskets(spark, sf_dir)
    s.run("REORDER ALL baskets$items BY quantity DESC, partkey ASC")
    return s.sql("SELECT _pid AS pid, _idx AS idx, partkey, quantity FROM baskets$items")


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "region", "places")
    s.run("UPSERT INTO places (r_regionkey, r_name) SELECT n_nationkey, UPPER(n_name) FROM nation WHERE n_nationkey BETWEEN 3 AND 9 ON DUPLICATE (r_regionkey); UPSERT INTO places (r_regionkey, r_name) VALUES (0, 'zero'), (77, 'new') ON DUPLICATE (r_regionkey)")
    return s.sql("SELECT * FROM places")


def input_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    _stored(s, spark.createDataFrame([], "id int, day date, at timestamp, tags array<string>, amount double"), "cells")
    s.run("INSERT INTO cells (id, day, at, tags, amount) VALUES (1, '1996/07/17', '1996/07/17 08:30:00', 'x, y', '12.50'), (2, '', '', '', ''), (3, '1996-02-29', '1996-02-29T23:59:59Z', 'z', 1 + 1)")
    return s.sql("SELECT id, day, DATE_FORMAT(at, '%Y-%m-%d %H:%i:%s') AS stamp, CONCAT(tags, '') AS tags, amount FROM cells")


RULES = {"c_name": {"required": True, "maxLength": 18, "unique": True}, "c_acctbal": {"min": -900, "max": 9900}, "c_mktsegment": {"optionOrder": ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"]}}


def validate_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "customer", "accounts", RULES)
    return s.sql("VALIDATE accounts (c_acctbal, c_mktsegment) CHECK WHEN c_nationkey = 7 THEN 'seven'").groupBy(F.col("`$err_field`").alias("field"), F.col("`$err_code`").alias("code"), F.col("`$err_message`").alias("message"), F.col("`$err_value`").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "customer", "accounts", RULES)
    return s.sql("VALIDATE accounts SUMMARY").select(F.col("`$err_field`").alias("field"), F.col("`$err_code`").alias("code"), F.col("`$err_count`").alias("n"))


def validate_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "region", "places", {"r_name": {"required": True, "unique": True, "maxLength": 8}})
    s.run("INSERT INTO places (r_regionkey, r_name) SELECT r_regionkey + 10, r_name FROM region WHERE r_regionkey < 3 VALIDATE ONLY INTO #err")
    return s.sql("SELECT `$err_code` AS code, `$err_value` AS value FROM #err UNION ALL SELECT 'ROWS', CAST(COUNT(*) AS TEXT) FROM places")


def _file(spark: SparkSession, name: str, lines: list[str]) -> str:
    folder = shared_folder(spark, "files")
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(f"{folder}/{name}")
    return f"{folder}/{name}"


def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "region", "places")
    path = _file(spark, "in.csv", ["r_name,r_regionkey,other", '"North, ""far"" away",50,x', "NEW NAME,1,y", ",51,z"])
    s.run(f"IMPORT INTO places FROM CSV '{path}' BY NAME IGNORE UNKNOWN COLUMNS ON DUPLICATE (r_regionkey)")
    return s.sql("SELECT * FROM places")


def import_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _writable(spark, sf_dir, "region", "places")
    path = _file(spark, "in.json", ['[{"r_regionkey": 60, "r_name": "sixty"}, {"r_regionkey": 61}]'])
    s.run(f"IMPORT INTO places (r_regionkey, r_name) FROM JSON '{path}'")
    return s.sql("SELECT * FROM places")


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the file that the export writes."""
    from quillframe.sources.files import csv_lines

    out = session(spark, sf_dir).sql("SELECT n_nationkey AS k, CONCAT(n_name, ',', n_regionkey) AS label, IF(n_regionkey = 1, '', n_name) AS name FROM nation")
    return spark.createDataFrame([(x.removesuffix("\r\n"),) for x in csv_lines(out)], "line string")


def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.sources.files import markdown

    return spark.createDataFrame([(x,) for x in markdown(session(spark, sf_dir).sql("SELECT r_regionkey, r_name FROM region")).split("\n")], "line string")


def export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.sources.files import jsonl

    return spark.createDataFrame([(x,) for x in jsonl(session(spark, sf_dir).sql("SELECT n_nationkey, n_name FROM nation"))], "line string")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("SHOW APPS").select("id", "name")


def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).sql("DESCRIBE nested_orders").select("code", "label", "type", "subtable")


def option_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.catalog.add("orders", f"{sf_dir}/orders.parquet", {"o_orderpriority": {"optionOrder": ["3-MEDIUM", "1-URGENT", "5-LOW"]}})
    return s.sql("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 20")


def record_number_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.catalog.add("numbered", s.catalog("customer")[0].select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "B-").otherwise("A-"), F.col("c_custkey").cast("string")).alias("no")), {"no": {"fieldType": "RECORD_NUMBER"}})
    return s.sql("SELECT no FROM numbered ORDER BY no DESC LIMIT 25")


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _writable(spark, sf_dir, "nation", "lands").preview("UPDATE lands SET n_name = 'X' WHERE n_regionkey = 2 AND n_name != 'X'")


def explain_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = [r[0] for r in session(spark, sf_dir).sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_totalprice > 250000").collect()]
    scan = next(x for x in plan if x.startswith("scan 0"))
    return spark.createDataFrame([("GreaterThan(o_totalprice,250000.0)" in scan, "o_orderkey" in scan and "o_orderstatus" not in scan)], "pushed boolean, pruned boolean")


def saved_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile

    from quillframe.plans.saved import SavedQueries
    from quillframe.plans.session import header

    with tempfile.TemporaryDirectory() as folder:  # read by the driver alone
        saved = SavedQueries(f"{folder}/saved.json")
        saved.save("big", "-- @ksql name: big orders\n-- @ksql timeout: 30\nDECLARE @low = 1; SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > @low", {"low": 100000})
        saved.save("gone", "SELECT 1 AS x")
        saved.delete("gone")
        n = saved.run("big", session(spark, sf_dir), {"low": 300000})[-1].frame.first()[0]
        head = header(saved.get("big")["sql"])
        return spark.createDataFrame([(len(saved.all()), head["name"], head["timeout"], n)], "saved int, name string, timeout int, n long")


#: What the dialect refuses, each with what kind of error.
REFUSED = [
    ("statistics of a date", "SELECT VAR_POP(o_orderdate) AS v FROM orders", "ArgumentError"),
    ("column that is not grouped", "SELECT o_orderstatus, o_custkey FROM orders GROUP BY o_orderstatus", "AnalysisError"),
    ("window in WHERE", "SELECT o_orderkey FROM orders WHERE ROW_NUMBER() OVER (ORDER BY o_orderkey) = 1", "EngineError"),
    ("recursion without end", "WITH RECURSIVE w (k) AS (SELECT r_regionkey FROM region UNION ALL SELECT w.k FROM region AS r INNER JOIN w ON r.r_regionkey = w.k) SELECT COUNT(*) AS n FROM w", "LimitError"),
    ("write of all rows", "DELETE FROM places WHERE 1 = 1", "AnalysisError"),
    ("write of too many rows", "DELETE FROM places WHERE r_regionkey >= 0", "LimitError"),
    ("key twice in the source", "UPSERT INTO places (r_regionkey, r_name) VALUES (1, 'a'), (1, 'b') ON DUPLICATE (r_regionkey)", "ArgumentError"),
    ("unions of unequal width", "SELECT r_name FROM region UNION ALL SELECT n_name, n_nationkey FROM nation", "EngineError"),
    ("unknown table", "SELECT x FROM nowhere", "AnalysisError"),
    ("unknown column", "SELECT nothing FROM region", "AnalysisError"),
    ("assertion", "ASSERT (SELECT COUNT(*) FROM region) > 1000, 'few'", "AssertionFailed"),
]


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe import errors

    s = _writable(spark, sf_dir, "region", "places", limits={"dml_rows": 2, "recursion_depth": 5})
    out = []
    for what, text, kind in REFUSED:
        try:
            s.run(text)
            out.append((what, "accepted"))
        except errors.EngineError as e:
            out.append((what, kind if isinstance(e, getattr(errors, kind)) else type(e).__name__))
    return spark.createDataFrame(out, "what string, error string")


_ROWS = "SELECT l_orderkey AS pid, CAST(l_linenumber AS VARCHAR) AS rid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS INTEGER) AS idx, l_partkey AS partkey, l_quantity AS quantity, o_custkey AS custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "parent_wildcard": (parent_wildcard, "SELECT CAST(l_linenumber AS VARCHAR) AS rid, o_orderkey AS \"_p.$id\", o_custkey AS \"_p.o_custkey\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey < 20"),
    "nested_insert": (nested_insert, "SELECT o_orderkey AS pid, CAST(-5 AS BIGINT) AS partkey, o_totalprice AS quantity FROM orders WHERE o_totalprice > 300000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
    "nested_update": (nested_update, f"SELECT pid, rid, idx, partkey, CASE WHEN rid = '2' THEN quantity * 10 ELSE quantity END AS quantity FROM ({_ROWS})"),
    "nested_delete": (nested_delete, f"SELECT pid, rid, quantity FROM ({_ROWS}) WHERE rid <> '1'"),
    "apply_block": (apply_block, f"WITH b AS ({_ROWS}) SELECT pid, rid, CASE WHEN quantity < 10 THEN 0 ELSE quantity END AS quantity, -custkey AS custkey, ['b', 'c'] AS tags FROM b WHERE quantity <= 45 UNION ALL SELECT DISTINCT pid, NULL, 99.0, -custkey, ['b', 'c'] FROM b"),
    "reorder_lines": (reorder_lines, "SELECT l_orderkey AS pid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) - 1 AS INTEGER) AS idx, l_partkey AS partkey, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "upsert_rows": (upsert_rows, "SELECT * FROM (VALUES (0, 'zero'), (77, 'new')) AS v(r_regionkey, r_name) UNION ALL SELECT n_nationkey, upper(n_name) FROM nation WHERE n_nationkey BETWEEN 3 AND 9 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (1, 2)"),
    "input_conversion": (input_conversion, "SELECT * FROM (VALUES (1, DATE '1996-07-17', '1996-07-17 08:30:00', 'x,y', 12.5::DOUBLE), (2, NULL, NULL, NULL, NULL), (3, DATE '1996-02-29', '1996-02-29 23:59:59', 'z', 2.0)) AS v(id, day, stamp, tags, amount)"),
    "validate_detail": (validate_detail, "SELECT field, code, message, value, count(*) AS n FROM (SELECT 'c_acctbal' AS field, 'ERR_RANGE_MIN' AS code, 'c_acctbal is below -900' AS message, CAST(c_acctbal AS VARCHAR) AS value FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'c_acctbal', 'ERR_RANGE_MAX', 'c_acctbal is above 9900', CAST(c_acctbal AS VARCHAR) FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 'c_mktsegment', 'ERR_CHOICE_INVALID', 'c_mktsegment has an unknown option', c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') UNION ALL SELECT '', 'ERR_CHECK', 'seven', NULL FROM customer WHERE c_nationkey = 7) GROUP BY ALL"),
    "validate_summary": (validate_summary, "SELECT field, code, count(*) AS n FROM (SELECT 'c_acctbal' AS field, 'ERR_RANGE_MIN' AS code FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'c_acctbal', 'ERR_RANGE_MAX' FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 'c_mktsegment', 'ERR_CHOICE_INVALID' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') UNION ALL SELECT 'c_name', 'ERR_LENGTH_MAX' FROM customer WHERE length(c_name) > 18 UNION ALL SELECT 'c_name', 'ERR_DUPLICATE' FROM customer WHERE c_name IN (SELECT c_name FROM customer GROUP BY c_name HAVING count(*) > 1)) GROUP BY ALL"),
    "validate_only": (validate_only, "SELECT 'ERR_DUPLICATE' AS code, r_name AS value FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'ERR_LENGTH_MAX', r_name FROM region WHERE r_regionkey < 3 AND length(r_name) > 8 UNION ALL SELECT 'ROWS', CAST(count(*) AS VARCHAR) FROM region"),
    "import_csv": (import_csv, "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'NEW NAME' ELSE r_name END AS r_name FROM region UNION ALL SELECT * FROM (VALUES (50, 'North, \"far\" away'), (51, NULL))"),
    "import_json": (import_json, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (60, 'sixty'), (61, NULL))"),
    "export_csv": (export_csv, "SELECT 'k,label,name' AS line UNION ALL SELECT concat(n_nationkey, ',\"', n_name, ',', n_regionkey, '\",', CASE WHEN n_regionkey = 1 THEN '' ELSE n_name END) FROM nation"),
    "export_markdown": (export_markdown, "SELECT '| r_regionkey | r_name |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT concat('| ', r_regionkey, ' | ', r_name, ' |') FROM region"),
    "export_jsonl": (export_jsonl, "SELECT concat('{\"n_nationkey\":', n_nationkey, ',\"n_name\":\"', n_name, '\"}') AS line FROM nation"),
    "show_tables": (show_tables, "SELECT x AS id, x AS name FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") AS v(x)"),
    "describe_table": (describe_table, "SELECT * FROM (VALUES ('$id', '$id', 'bigint', ''), ('o_custkey', 'o_custkey', 'bigint', ''), ('items', 'items', 'array<struct<id:int,partkey:bigint,quantity:double>>', ''), ('id', 'id', 'int', 'items'), ('partkey', 'partkey', 'bigint', 'items'), ('quantity', 'quantity', 'double', 'items')) AS v(code, label, type, subtable)"),
    "option_order": (option_order, "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END DESC, o_orderkey LIMIT 20"),
    "record_number_order": (record_number_order, "SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN 'B-' ELSE 'A-' END, c_custkey) AS no FROM customer ORDER BY c_custkey DESC LIMIT 25"),
    "preview_rows": (preview_rows, "SELECT '-' AS change, * FROM nation WHERE n_regionkey = 2 UNION ALL SELECT '+', n_nationkey, 'X', n_regionkey FROM nation WHERE n_regionkey = 2"),
    "explain_scans": (explain_scans, "SELECT true AS pushed, true AS pruned"),
    "saved_query": (saved_query, "SELECT 1 AS saved, 'big orders' AS name, 30 AS timeout, count(*) AS n FROM orders WHERE o_totalprice > 300000"),
    "refused": (refused, "SELECT * FROM (VALUES " + ", ".join(f"('{what}', '{kind}')" for what, _, kind in REFUSED) + ") AS v(what, error)"),
}

FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "subtable_scan": (subtable_scan, "SELECT l_orderkey AS pid, CAST(l_linenumber AS VARCHAR) AS rid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS INTEGER) AS idx, l_quantity AS quantity, o_custkey AS custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY l_quantity > 40"),
    "update_where": (update_where, "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey IN (1, 2, 3) THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey IN (1, 2, 3) AND c_acctbal > 5000 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "update_from": (update_from, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN n_name IS NOT NULL AND c_acctbal > 0 THEN n_name ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey"),
    "delete_where": (delete_where, "SELECT * FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')"),
    "insert_select": (insert_select, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation UNION ALL SELECT 999, 'Elsewhere' UNION ALL SELECT 1000, NULL"),
    "merge_into": (merge_into, "SELECT coalesce(r_regionkey, n_nationkey) AS r_regionkey, coalesce(n_name, r_name) AS r_name FROM region FULL JOIN (SELECT * FROM nation WHERE n_nationkey < 8) ON r_regionkey = n_nationkey"),
    "quarantine": (quarantine, "WITH e AS (SELECT CAST(n_nationkey + 100 AS BIGINT) AS k, CAST((length(n_name) > 8)::INT + (n_nationkey + 100 > 120)::INT AS BIGINT) AS errors FROM nation) SELECT k AS r_regionkey, errors FROM e WHERE errors > 0 UNION ALL SELECT (SELECT count(*) FROM region) + count(*), 0 FROM e WHERE errors = 0"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda spark, sf_dir, text=text: session(spark, sf_dir).sql(text)) for name, (text, _) in PAIRS.items()}
    return out | {name: f for name, (f, _) in (FRAMES | MORE).items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle or text for name, (text, oracle) in PAIRS.items()} | {name: sql for name, (_, sql) in (FRAMES | MORE).items() if sql}
