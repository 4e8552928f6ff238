"""Queries over log tables built from the driver's parquet, and the SQL that gives the same rows.

Each fixture is built once for a data folder and session.  Queries read whole
tables; what they exercise is named in their keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelog import fixtures as X
from tablelog import schema as S
from tablelog.errors import ConstraintError, TableLogError
from tablelog.functions import metadata
from tablelog.operators.checkpoint import checkpoint_rows, write_checkpoint
from tablelog.operators.joins import asof_join, range_join
from tablelog.operators.transaction import Transaction
from tablelog.operators.write import create_table
from tablelog.session import Session
from tablelog.sources.fs import Fs
from tablelog.sources.scan import scan, scan_snapshot
from tablelog.sources.snapshot import LOG_DIR, Snapshot, commit_name
from tablelog.streaming.sink import append_once
from tablelog.workspace import scratch

_BUILT: dict[tuple, str] = {}


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fixture(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], str]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Log table of a driver table: lineitem and orders in three commits by key (nulls in the last), others in one."""

    def make() -> str:
        df = _raw(spark, sf_dir, name)
        if name not in ("lineitem", "orders"):
            return X.build(spark, name, [df])
        key = "l_orderkey" if name == "lineitem" else "o_orderkey"
        low, high = df.agg(F.min(key), F.max(key)).first()
        low, high = low or 0, high or 0  # no rows, or no keys
        step = (high - low) // 3 + 1
        thirds = [(F.col(key) >= low + k * step) & (F.col(key) < low + (k + 1) * step) for k in range(3)]
        return X.build(spark, name, [df.filter(t) for t in (*thirds[:2], thirds[2] | F.col(key).isNull())])

    return _fixture(spark, sf_dir, name, make)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def session(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> Session:
    out = Session(spark)
    for n in names:
        out.attach(table(spark, sf_dir, n), n)
    return out


def _sql(text: str, *names: str, spark_text: str | None = None):
    """A query whose text runs on attached tables as it does on the oracle's views."""
    return (lambda spark, sf_dir: session(spark, sf_dir, names).sql(spark_text or text)), text


# -- queries shaped like the usual decision-support suite; partsupp is absent ----------

Q1 = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
Q3 = """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10"""
Q5 = """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY n_name"""
Q6 = """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00'
AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"""
Q10 = """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""
Q12 = """
SELECT o_orderpriority, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS high_count, count(*) AS line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' GROUP BY o_orderpriority"""
Q14 = """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END)
  / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey"""
Q4 = """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority"""
Q7 = """
SELECT s_nation, c_nation, round(sum(volume), 4) AS revenue FROM (
  SELECT n1.n_name AS s_nation, n2.n_name AS c_nation, l_extendedprice * (1 - l_discount) AS volume
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey) AS shipping GROUP BY s_nation, c_nation"""
Q13 = """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) AS c_orders
GROUP BY c_count"""
Q15 = """
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total = (SELECT max(total) FROM revenue)"""
Q17 = """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)"""
Q18 = """
SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)
GROUP BY c_name, c_custkey, o_orderkey, o_totalprice"""
Q19 = """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 10 AND 30 AND l_quantity BETWEEN 20 AND 30)"""
Q21 = """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey
WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 40)
GROUP BY s_name"""
Q22 = """
SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey"""

_CO, _COL = ("customer", "orders"), ("customer", "orders", "lineitem")
_TEXTS = {
    "q1": (Q1, "lineitem"), "q3": (Q3, *_COL), "q4": (Q4, "orders", "lineitem"),
    "q5": (Q5, *_COL, "supplier", "nation", "region"), "q6": (Q6, "lineitem"), "q7": (Q7, *_COL, "supplier", "nation"),
    "q10": (Q10, *_COL, "nation"), "q12": (Q12, "orders", "lineitem"), "q13": (Q13, *_CO), "q14": (Q14, "lineitem", "part"),
    "q15": (Q15, "lineitem", "supplier"), "q17": (Q17, "lineitem", "part"), "q18": (Q18, *_COL), "q19": (Q19, "lineitem", "part"),
    "q21": (Q21, "supplier", "lineitem"), "q22": (Q22, *_CO),
    "scan_full": ("SELECT * FROM orders", "orders"),
    "scan_projection": ("SELECT l_orderkey, l_quantity FROM lineitem", "lineitem"),
    "count_star": ("SELECT count(*) AS n FROM lineitem", "lineitem"),
    "skip_eq": ("SELECT * FROM orders WHERE o_orderkey = 77", "orders"),
    "skip_ne": ("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus != 'F' GROUP BY o_orderstatus", "orders"),
    "skip_range": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 10 AND l_orderkey <= 200", "lineitem"),
    "skip_between": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 50 AND 90", "orders"),
    "skip_in": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 2, 3, 900)", "orders"),
    "skip_single_in": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (7)", "orders"),
    "skip_or": ("SELECT o_orderkey FROM orders WHERE o_orderkey < 20 OR o_orderkey > 14990", "orders"),
    "skip_is_null": ("SELECT count(*) AS n FROM orders WHERE o_custkey IS NULL", "orders"),
    "skip_is_not_null": ("SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL", "lineitem"),
    "skip_not_between": ("SELECT count(*) AS n FROM orders WHERE o_orderkey NOT BETWEEN 100 AND 14000", "orders"),
    "skip_distinct_from": ("SELECT count(*) AS n FROM orders WHERE o_orderkey IS DISTINCT FROM 5", "orders"),
    "dynamic_scalar_subquery": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) - 3 FROM orders)", "orders"),
    "dynamic_join_filter": ("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey < 40", "lineitem", "orders"),
    "join_left_outer": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", *_CO),
    "join_full_outer": ("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3", "customer", "supplier"),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation"),
    "join_theta": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", "nation"),
    "agg_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", "lineitem"),
    "agg_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem"),
    "agg_cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders"),
    "agg_grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "lineitem"),
    "window_rank": ("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders", "orders"),
    "window_lag": ("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders", "orders"),
    "window_frame": ("SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM orders", "orders"),
    "window_topk": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) AS x WHERE rn <= 2", "orders"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5", "orders"),
    "set_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "customer", "supplier"),
    "set_union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "customer", "supplier"),
    "set_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "customer", "supplier"),
    "set_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier", "nation", "supplier"),
    "recursive_cte": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, (SELECT count(*) FROM region) AS r FROM t", "region"),
    "semi_join": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", *_CO),
    "anti_join": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", *_CO),
    "cte_shadows_table": ("WITH nation AS (SELECT r_regionkey AS x FROM region) SELECT x FROM nation", "nation", "region"),
    "cte_in_subquery": ("SELECT (WITH nation AS (SELECT r_name FROM region) SELECT count(*) FROM nation) AS inner_n, count(*) AS outer_n FROM nation", "nation", "region"),
    "comma_join": ("SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey", *_CO),
    "quoted_name": ('SELECT n_nationkey, n_name FROM "nation"', "nation"),
    "set_intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "customer", "supplier"),
    "set_except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "customer", "supplier"),
    "window_ranking": (
        """SELECT o_orderkey, CAST(dense_rank() OVER w AS BIGINT) AS d, CAST(ntile(3) OVER w AS BIGINT) AS t,
        round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, CAST(row_number() OVER w AS BIGINT) AS r
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""", "orders"),
    "window_analytic": (
        """SELECT o_orderkey, lead(o_orderkey, 2) OVER w AS ahead, first_value(o_orderkey) OVER w AS f,
        last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l,
        nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""", "orders"),
    "window_range": ("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 250 FOLLOWING) AS n FROM customer", "customer"),
    "window_range_interval": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS n FROM events", "events"),
    "interval_join": (
        """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id
        AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '30' MINUTE WHERE a.event_type = 'click'""", "events"),
    "skip_timestamp": ("SELECT count(*) AS n, max(l_orderkey) AS high FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-03-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-04-01 00:00:00'", "lineitem"),
    "skip_float": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 350000.5", "orders"),
    "agg_statistics": (
        """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c,
        round(median(l_quantity), 6) AS m, count(*) FILTER (WHERE l_quantity > 40) AS big FROM lineitem GROUP BY l_returnflag""", "lineitem"),
    "grouping_flags": ("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING count(*) > 10", "lineitem"),
    "lateral_join": ("SELECT c_custkey, x.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS x", *_CO),
    "scalar_functions": ("SELECT upper(substring(c_name, 1, 8)) AS s, length(c_name) AS l, abs(c_acctbal) AS a, c_custkey % 7 AS m FROM customer", "customer"),
}

#: (oracle's text, text for Spark, tables): the same result where the dialects differ.
_PAIRS = {
    "functions_cast_typeof": (
        "SELECT o_orderkey, lower(typeof(o_orderkey)) AS t, CAST(o_totalprice AS BIGINT) AS p, TRY_CAST(o_orderpriority AS INTEGER) AS bad, o_orderkey::VARCHAR AS s FROM orders WHERE o_totalprice - floor(o_totalprice) < 0.4",
        "SELECT o_orderkey, typeof(o_orderkey) AS t, CAST(round(o_totalprice) AS BIGINT) AS p, TRY_CAST(o_orderpriority AS INTEGER) AS bad, o_orderkey::STRING AS s FROM orders WHERE o_totalprice - floor(o_totalprice) < 0.4",
        "orders"),
    "functions_map": (
        "SELECT n_nationkey, m['name'] AS name, m['none'] AS none, len(map_keys(m))::BIGINT AS k FROM (SELECT n_nationkey, map {'name': n_name, 'key': n_nationkey::VARCHAR} AS m FROM nation)",
        "SELECT n_nationkey, m['name'] AS name, m['none'] AS none, CAST(size(map_keys(m)) AS BIGINT) AS k FROM (SELECT n_nationkey, map('name', n_name, 'key', CAST(n_nationkey AS STRING)) AS m FROM nation)",
        "nation"),
    "functions_unnest": (
        "SELECT n_nationkey, unnest([n_regionkey, n_regionkey + 10, n_nationkey * 2]) AS x FROM nation",
        "SELECT n_nationkey, explode(array(n_regionkey, n_regionkey + 10, n_nationkey * 2)) AS x FROM nation",
        "nation"),
    "functions_struct": (
        "SELECT s.k AS k, s.t.name AS name, s.t.region AS region FROM (SELECT {'k': n_nationkey, 't': {'name': n_name, 'region': n_regionkey}} AS s FROM nation) WHERE s.t.region > 1",
        "SELECT s.k AS k, s.t.name AS name, s.t.region AS region FROM (SELECT named_struct('k', n_nationkey, 't', named_struct('name', n_name, 'region', n_regionkey)) AS s FROM nation) WHERE s.t.region > 1",
        "nation"),
    "star_exclude": ("SELECT * EXCLUDE (c_name, c_mktsegment) FROM customer", "SELECT * EXCEPT (c_name, c_mktsegment) FROM customer", "customer"),
    "functions_json": (
        "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50",
        "SELECT event_id, get_json_object(props, '$.k') AS k FROM events WHERE CAST(get_json_object(props, '$.k') AS INT) > 50",
        "events"),
    "functions_string_slice": (
        "SELECT c_custkey, c_name[1:4] AS a, right(c_name, 3) AS b, c_name LIKE '%7' AS c, regexp_replace(c_name, '[0-9]+', '#') AS d, split_part(c_name, '#', 2) AS e FROM customer",
        "SELECT c_custkey, substring(c_name, 1, 4) AS a, right(c_name, 3) AS b, c_name LIKE '%7' AS c, regexp_replace(c_name, '[0-9]+', '#') AS d, split_part(c_name, '#', 2) AS e FROM customer",
        "customer"),
    "functions_dates": (
        "SELECT date_trunc('month', l_shipdate)::DATE AS m, count(*) AS n, min(extract(year FROM l_shipdate))::BIGINT AS y, max(date_diff('day', DATE '1992-01-01', l_shipdate::DATE))::BIGINT AS d FROM lineitem GROUP BY 1",
        "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, count(*) AS n, CAST(min(extract(year FROM l_shipdate)) AS BIGINT) AS y, CAST(max(datediff(l_shipdate, DATE '1992-01-01')) AS BIGINT) AS d FROM lineitem GROUP BY 1",
        "lineitem"),
    "agg_approx_within": (
        "SELECT l_returnflag, count(DISTINCT l_orderkey) > 0 AS ok FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, abs(approx_count_distinct(l_orderkey, 0.02) - count(DISTINCT l_orderkey)) <= 0.1 * count(DISTINCT l_orderkey) AS ok FROM lineitem GROUP BY l_returnflag",
        "lineitem"),
}


def _q12_spark(text: str) -> str:
    return text.replace("sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT", "sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)")


# -- partitions, versions, schemas, deletes, writes ------------------------------------


def _partitioned(spark: SparkSession, sf_dir: str) -> str:
    """orders by priority and status; one status in ten is null."""

    def make() -> str:
        df = _raw(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END"))
        return X.build(spark, "partitioned", [df], ["o_orderpriority", "o_orderstatus"])

    return _fixture(spark, sf_dir, "partitioned", make)


_PARTED = "(SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus) FROM orders)"


def scan_partitioned(spark, sf_dir):
    return scan(spark, _partitioned(spark, sf_dir))


def partition_filter(spark, sf_dir):
    return scan(spark, _partitioned(spark, sf_dir), where="o_orderpriority = '1-URGENT' AND o_orderstatus IS NOT NULL")


def null_partition(spark, sf_dir):
    return scan(spark, _partitioned(spark, sf_dir), where="o_orderstatus IS NULL").select("o_orderkey", "o_orderpriority")


def partition_aggregate(spark, sf_dir):
    s = Session(spark)
    s.attach(_partitioned(spark, sf_dir), "p")
    return s.sql("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM p GROUP BY o_orderpriority")


def partition_constants_join(spark, sf_dir):
    return scan(spark, _partitioned(spark, sf_dir), pushdown_partition_info=False).select("o_orderkey", "o_orderpriority", "o_orderstatus")


def url_encoded_partition(spark, sf_dir):
    path = _fixture(spark, sf_dir, "encoded", lambda: X.build(spark, "encoded", [
        _raw(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.col("n_regionkey").cast("string"), F.lit("+/ %")).alias("part"))], ["part"]))
    return scan(spark, path)


def virtual_columns(spark, sf_dir):
    df = scan(spark, table(spark, sf_dir, "orders"), virtual=["filename", "file_row_number", "file_number"])
    return df.agg(F.count("filename").alias("named"), F.count_if(F.col("file_row_number") < 0).alias("negative"), F.count_distinct("filename", "file_row_number").alias("places"))


def _versions(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def time_travel(spark, sf_dir):
    s = Session(spark)
    s.attach(_versions(spark, sf_dir), "orders")
    return s.sql("SELECT count(*) AS n, max(o_orderkey) AS high FROM orders AT (VERSION => 1)")


def time_travel_empty(spark, sf_dir):
    return scan(spark, _versions(spark, sf_dir), version=0).agg(F.count("*").alias("n"))


def pinned_version(spark, sf_dir):
    s = Session(spark)
    s.attach(_versions(spark, sf_dir), "orders", version=2)
    return s.sql("SELECT count(*) AS n FROM orders")


def incremental_snapshot(spark, sf_dir):
    path = _versions(spark, sf_dir)
    old = Snapshot.load(spark, path, 1)
    new = Snapshot.load(spark, path, 3, previous=old)
    rows = [scan_snapshot(x).agg(F.lit(x.version).cast("bigint").alias("version"), F.count("*").alias("n"), F.max("o_orderkey").alias("high")) for x in (old, new)]
    return rows[0].union(rows[1])


_THIRD = "(SELECT * FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) + {k} * ((max(o_orderkey) - min(o_orderkey)) // 3 + 1) FROM orders))"


def _mapped(spark, sf_dir, mode: str) -> str:
    """nation under physical names and ids, partitioned by region; written action by action."""

    def make() -> str:
        root = scratch(spark, f"mapped-{mode}")
        own = [("n_nationkey", T.IntegerType()), ("n_name", T.StringType()), ("n_regionkey", T.IntegerType())]
        schema = T.StructType([T.StructField(n, t, True, {S.FIELD_ID: k + 1, S.PHYSICAL_NAME: f"col-{k}"}) for k, (n, t) in enumerate(own)])
        df = _raw(spark, sf_dir, "nation")
        config = {S.MAPPING_MODE: mode}
        actions = [X.protocol("columnMapping"), X.metadata(schema, ["n_regionkey"], config)]
        for r in range(5):
            rows = df.filter(F.col("n_regionkey") == r).select(F.col("n_nationkey").alias("col-0"), F.col("n_name").alias("col-1"))
            actions.append(X.data_file(rows, root, f"ab{r}.parquet", {"col-2": str(r)}, json.dumps({"numRecords": rows.count()})))
        X.publish(spark, root, 0, actions)
        return root

    return _fixture(spark, sf_dir, f"mapped-{mode}", make)


def mapped_by_name(spark, sf_dir):
    return scan(spark, _mapped(spark, sf_dir, "name"))


def mapped_by_id(spark, sf_dir):
    return scan(spark, _mapped(spark, sf_dir, "id"), where="n_regionkey = 2")


def _evolved(spark, sf_dir) -> str:
    """v0 region; v1 adds a column, widens the key; v2 adds rows; v3 drops and adds r_name again."""

    def make() -> str:
        root = scratch(spark, "evolved")
        meta = lambda name, k: {S.FIELD_ID: k, S.PHYSICAL_NAME: name}
        v0 = T.StructType([T.StructField("r_regionkey", T.IntegerType(), True, meta("a", 1)), T.StructField("r_name", T.StringType(), True, meta("b", 2))])
        v1 = T.StructType([T.StructField("r_regionkey", T.LongType(), True, meta("a", 1)), v0.fields[1], T.StructField("extra", T.DoubleType(), True, meta("c", 3))])
        v3 = T.StructType([v1.fields[0], v1.fields[2], T.StructField("r_name", T.LongType(), True, meta("d", 4))])
        df = _raw(spark, sf_dir, "region")
        config = {S.MAPPING_MODE: "name"}
        X.publish(spark, root, 0, [X.protocol("columnMapping"), X.metadata(v0, (), config), X.data_file(df.toDF("a", "b"), root, "f0.parquet")])
        more = df.select((F.col("r_regionkey") + 10).cast("long").alias("a"), F.col("r_name").alias("b"), (F.col("r_regionkey") / 2.0).alias("c"))
        X.publish(spark, root, 1, [X.metadata(v1, (), config)])
        X.publish(spark, root, 2, [X.data_file(more, root, "f1.parquet")])
        last = spark.createDataFrame([(99, 1.5, 7)], "a long, c double, d long").select("a", "c", "d")
        X.publish(spark, root, 3, [X.metadata(v3, (), config), X.data_file(last, root, "f2.parquet")])
        return root

    return _fixture(spark, sf_dir, "evolved", make)


def schema_add_and_widen(spark, sf_dir):
    return scan(spark, _evolved(spark, sf_dir), version=2)


def schema_drop_readd(spark, sf_dir):
    return scan(spark, _evolved(spark, sf_dir))


def nested_fields(spark, sf_dir):
    """A struct that gains a field, skipped by a nested statistic."""

    def make() -> str:
        root = scratch(spark, "nested")
        df = _raw(spark, sf_dir, "nation")
        old = T.StructType([T.StructField("v", T.StructType([T.StructField("key", T.IntegerType()), T.StructField("name", T.StringType())]))])
        new = T.StructType([T.StructField("v", T.StructType([*old["v"].dataType.fields, T.StructField("region", T.IntegerType())]))])
        low = df.filter("n_nationkey < 10").select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("v"))
        high = df.filter("n_nationkey >= 10").select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("v"))
        stats = lambda n, a, b: json.dumps({"numRecords": n, "nullCount": {"v": {"key": 0}}, "minValues": {"v": {"key": a}}, "maxValues": {"v": {"key": b}}})
        X.publish(spark, root, 0, [X.protocol(), X.metadata(old), X.data_file(low, root, "low.parquet", None, stats(10, 0, 9))])
        X.publish(spark, root, 1, [X.metadata(new), X.data_file(high, root, "high.parquet", None, stats(15, 10, 24))])
        return root

    s = Session(spark)
    s.attach(_fixture(spark, sf_dir, "nested", make), "nested")
    return s.sql("SELECT v.key AS k, v.name AS name, v.region AS region FROM nested WHERE v.key > 5")


def _deleted(spark, sf_dir) -> str:
    """customer in two files, every seventh row of the first and some of the second deleted by vectors."""

    def make() -> str:
        root = scratch(spark, "deleted")
        df = _raw(spark, sf_dir, "customer").orderBy("c_custkey")
        n = df.count()
        half = df.limit(n // 2)
        a = X.data_file(half.coalesce(1).sortWithinPartitions("c_custkey"), root, "a.parquet", None, json.dumps({"numRecords": n // 2}),
                        X.inline_vector(np.arange(0, n // 2, 7)))
        low = half.agg(F.max("c_custkey")).first()[0]
        rest = df.filter(F.col("c_custkey") > low).coalesce(1).sortWithinPartitions("c_custkey")
        b = X.data_file(rest, root, "b.parquet", None, json.dumps({"numRecords": n - n // 2}), X.stored_vector(spark, root, np.arange(5), bytes(range(16))))
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        X.publish(spark, root, 0, [X.protocol("deletionVectors"), X.metadata(schema), a, b])
        return root

    return _fixture(spark, sf_dir, "deleted", make)


_KEPT = """(SELECT c.* FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS rn, count(*) OVER () // 2 AS h FROM customer) AS c
WHERE (rn < h AND rn % 7 <> 0) OR rn >= h + 5)"""


def deletion_vectors(spark, sf_dir):
    return scan(spark, _deleted(spark, sf_dir)).select("c_custkey", "c_name")


def deletion_vectors_pushdown(spark, sf_dir):
    return scan(spark, _deleted(spark, sf_dir), where="c_custkey > 20 AND c_mktsegment = 'BUILDING'").select("c_custkey")


def list_files_deletes(spark, sf_dir):
    out = metadata.list_files(Snapshot.load(spark, _deleted(spark, sf_dir)), delete_count=True)
    return out.select("cardinality", "have_deletes", "delete_count")


def _written(spark, sf_dir) -> str:
    """Appends of all kinds to one table; ends with the rows of region three times."""

    def make() -> str:
        df = _raw(spark, sf_dir, "region")
        root = scratch(spark, "written")
        create_table(spark, root, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]))
        s = Session(spark)
        s.attach(root, "w")
        with s.transaction():  # two inserts, one commit
            s.insert("w", df.filter("r_regionkey < 2"))
            s.insert("w", df.filter("r_regionkey >= 2"))
        try:
            with s.transaction():
                s.insert("w", df)
                raise TableLogError("rolled back")
        except TableLogError:
            pass
        a, b = Transaction(Snapshot.load(spark, root)), Transaction(Snapshot.load(spark, root))
        a.insert(df)
        b.insert(df)
        a.commit()
        try:
            b.commit()
        except TableLogError:
            pass
        write_checkpoint(Snapshot.load(spark, root))
        for _ in range(2):  # the second is known already
            append_once(spark, root, df, "ingest", 1)
        return root

    return _fixture(spark, sf_dir, "written", make)


def append_rollback_conflict(spark, sf_dir):
    return scan(spark, _written(spark, sf_dir))


def checkpoint_then_read(spark, sf_dir):
    snapshot = Snapshot.load(spark, _written(spark, sf_dir))
    return spark.createDataFrame([(snapshot.version, bool(snapshot.base))], "version bigint, from_checkpoint boolean")


def app_transaction_version(spark, sf_dir):
    return metadata.app_version(Snapshot.load(spark, _written(spark, sf_dir)), "ingest")


def list_files(spark, sf_dir):
    out = metadata.list_files(Snapshot.load(spark, table(spark, sf_dir, "nation")))
    return out.agg(F.sum("cardinality").alias("rows"), F.count_if("have_deletes").alias("deleted"))


def stats_json(spark, sf_dir):
    """Bounds and null counts of the log's statistics over all files."""
    files = Snapshot.load(spark, table(spark, sf_dir, "lineitem")).files
    s = F.from_json("stats", "numRecords bigint, nullCount struct<l_orderkey:bigint>, minValues struct<l_orderkey:bigint,l_quantity:double>, maxValues struct<l_orderkey:bigint,l_returnflag:string>")
    return files.select(s.alias("s")).agg(
        F.sum("s.numRecords").alias("n"), F.sum("s.nullCount.l_orderkey").alias("nulls"), F.min("s.minValues.l_orderkey").alias("low"),
        F.max("s.maxValues.l_orderkey").alias("high"), F.min("s.minValues.l_quantity").alias("low_quantity"), F.max("s.maxValues.l_returnflag").alias("high_flag"),
    )


def domain_metadata(spark, sf_dir):
    def make() -> str:
        root = table(spark, sf_dir, "region") + "-domains"
        schema = T.StructType([T.StructField("a", T.IntegerType())])
        domain = lambda d, c, r=False: {"domainMetadata": {"domain": d, "configuration": c, "removed": r}}
        X.publish(spark, root, 0, [X.protocol("domainMetadata"), X.metadata(schema), domain("one", "{}"), domain("two", "x"), domain("gone", "y")])
        X.publish(spark, root, 1, [domain("gone", "y", True), domain("two", "z")])
        return root

    return metadata.domain_metadata(Snapshot.load(spark, _fixture(spark, sf_dir, "domains", make)))


def variant_roundtrip(spark, sf_dir):
    """events.props as a variant column, written and read through a log table: rows, and those whose value came back."""

    def make() -> str:
        return X.build(spark, "variant", [_raw(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))])

    df = scan(spark, _fixture(spark, sf_dir, "variant", make)).select("event_id", F.to_json("v").alias("got"))
    events = _raw(spark, sf_dir, "events").select("event_id", F.to_json(F.try_parse_json("props")).alias("put"))
    same = F.col("got").eqNullSafe(F.col("put"))
    return df.join(events, "event_id", "left").agg(F.count("*").alias("n"), F.count(F.when(same, F.col("event_id"))).alias("ids"))


def decimals_and_dates(spark, sf_dir):
    """Skipping on decimal and date columns."""

    def make() -> str:
        df = _raw(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.to_date("l_shipdate").alias("day"))
        return X.build(spark, "decimals", [df.filter("price < 30000"), df.filter("price >= 30000")])

    s = Session(spark)
    s.attach(_fixture(spark, sf_dir, "decimals", make), "d")
    return s.sql("SELECT count(*) AS n, CAST(max(price) AS DOUBLE) AS high FROM d WHERE price < CAST(20000.00 AS DECIMAL(12,2)) AND day >= DATE '1995-01-01'")


def asof_events(spark, sf_dir):
    """Each click with the last purchase of its user at or before it."""
    e = session(spark, sf_dir, ("events",)).table("events")
    types = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    left = e.filter(F.col("event_type") == types[0]).select("user_id", "ts", "event_id")
    right = e.filter(F.col("event_type") == types[1]).groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    return asof_join(left, right, "ts", ["user_id"], ["last_id"])


_ASOF = """
WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS r FROM (SELECT DISTINCT event_type FROM events)),
l AS (SELECT user_id, ts, event_id FROM events JOIN k USING (event_type) WHERE r = 1),
r AS (SELECT user_id, ts, max(event_id) AS last_id FROM events JOIN k USING (event_type) WHERE r = 2 GROUP BY user_id, ts)
SELECT user_id, ts, event_id, (SELECT max_by(last_id, r.ts) FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS last_id FROM l"""


def range_join_parts(spark, sf_dir):
    """Customers with the price band of their balance."""
    s = session(spark, sf_dir, ("customer", "supplier"))
    bands = s.table("supplier").select(F.col("s_suppkey"), F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 100).alias("high"))
    out = range_join(s.table("customer").select("c_custkey", "c_acctbal"), bands, F.col("c_acctbal"), F.col("low"), F.col("high"), 100.0)
    return out.select("c_custkey", "s_suppkey")


def _copied(spark, sf_dir, name: str, change: Callable[[str], None]) -> str:
    """Log table of orders of its own, so that its log may be changed."""

    def make() -> str:
        df = _raw(spark, sf_dir, "orders")
        root = X.build(spark, name, [df.filter("o_orderkey % 2 = 0"), df.filter("o_orderkey % 2 = 1")])
        change(root)
        return root

    return _fixture(spark, sf_dir, name, make)


def _rows_from_checkpoint(spark, sf_dir, name: str, put: Callable[[Snapshot, str], None]):
    """All rows of a table whose commits are gone: what is read comes from the checkpoint."""

    def change(root: str) -> None:
        snapshot, log_dir, fs = Snapshot.load(spark, root), f"{root}/{LOG_DIR}", Fs(spark)
        put(snapshot, log_dir)
        for version in range(snapshot.version + 1):
            fs.delete(f"{log_dir}/{commit_name(version)}")

    return scan(spark, _copied(spark, sf_dir, name, change)).select("o_orderkey", "o_custkey", "o_totalprice")


def checkpoint_rows_classic(spark, sf_dir):
    return _rows_from_checkpoint(spark, sf_dir, "checkpointed", lambda s, _: write_checkpoint(s))


def checkpoint_rows_multipart(spark, sf_dir):
    def put(s: Snapshot, log_dir: str) -> None:
        fs, staging = Fs(spark), f"{log_dir}/_parts"
        checkpoint_rows(s).repartition(2, F.col("add.path")).write.parquet(staging)
        names = sorted(n for n, _, _ in fs.names(staging) if n.startswith("part-"))
        for k, n in enumerate(names):
            fs.rename(f"{staging}/{n}", f"{log_dir}/{s.version:020d}.checkpoint.{k + 1:010d}.{len(names):010d}.parquet")
        fs.delete(staging, recursive=True)

    return _rows_from_checkpoint(spark, sf_dir, "checkpointed-parts", put)


def checkpoint_rows_v2(spark, sf_dir):
    """A manifest in JSON and the files' actions in a sidecar."""

    def put(s: Snapshot, log_dir: str) -> None:
        fs, staging = Fs(spark), f"{log_dir}/_parts"
        rows = checkpoint_rows(s)
        rows.filter("add IS NOT NULL").select("add").coalesce(1).write.parquet(staging)
        (part,) = [n for n, _, _ in fs.names(staging) if n.startswith("part-")]
        side = "00000000-0000-0000-0000-000000000002.parquet"
        fs.rename(f"{staging}/{part}", f"{log_dir}/_sidecars/{side}")
        fs.delete(staging, recursive=True)
        size, changed = fs.status(f"{log_dir}/_sidecars/{side}")
        lines = [r[0] for r in rows.filter("add IS NULL").select(F.to_json(F.struct("*"))).collect()]
        lines += [json.dumps({"checkpointMetadata": {"version": s.version}}), json.dumps({"sidecar": {"path": side, "sizeInBytes": size, "modificationTime": changed}})]
        fs.write(f"{log_dir}/{s.version:020d}.checkpoint.00000000-0000-0000-0000-000000000001.json", "\n".join([*lines, ""]).encode())

    return _rows_from_checkpoint(spark, sf_dir, "checkpointed-v2", put)


def skip_struct(spark, sf_dir):
    """Files that a field of a struct rules out, and the rows of the others."""
    nested_fields(spark, sf_dir)
    s = Session(spark)
    s.attach(_fixture(spark, sf_dir, "nested", str), "nested")
    out = s.sql("SELECT v.key AS k, v.name AS name FROM nested WHERE v.key < 8")
    seen = s.log.pushdowns[-1]
    return out.withColumns({"files_before": F.lit(seen.files_before).cast("bigint"), "files_after": F.lit(seen.files_after).cast("bigint")})


def partition_single_in(spark, sf_dir):
    s = Session(spark)
    s.attach(_partitioned(spark, sf_dir), "p")
    return s.sql("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM p WHERE o_orderpriority IN ('1-URGENT') AND o_orderstatus IN ('F')")


def variant_access(spark, sf_dir):
    variant_roundtrip(spark, sf_dir)
    s = Session(spark)
    s.attach(_fixture(spark, sf_dir, "variant", str), "variants")
    return s.sql("SELECT event_id, variant_get(v, '$.k', 'bigint') AS k FROM variants WHERE variant_get(v, '$.k', 'bigint') % 2 = 0")


def map_and_list_columns(spark, sf_dir):
    """Maps and lists as columns of a log table: entries, elements and lengths."""

    def make() -> str:
        df = _raw(spark, sf_dir, "nation").select(
            "n_nationkey", F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string")).alias("m"), F.array("n_regionkey", "n_nationkey").alias("l"))
        return X.build(spark, "maps", [df.filter("n_nationkey < 12"), df.filter("n_nationkey >= 12")])

    s = Session(spark)
    s.attach(_fixture(spark, sf_dir, "maps", make), "maps")
    return s.sql("SELECT n_nationkey, m['name'] AS name, m['region'] AS region, e AS element FROM maps LATERAL VIEW explode(l) AS e")


def virtual_columns_by_file(spark, sf_dir):
    """Row numbers of each file run from 0 without gaps; files are numbered and their rows add up."""
    df = scan(spark, table(spark, sf_dir, "lineitem"), virtual=["filename", "file_row_number", "file_number"])
    # 64 rows' numbers are the bits of a word, so distinct ones are counted without a group for each row
    words = df.groupBy("filename", F.shiftright("file_row_number", 6).alias("word")).agg(
        F.count("*").alias("n"), F.min("file_row_number").alias("low"), F.max("file_row_number").alias("high"),
        F.bit_or(F.expr("shiftleft(1L, CAST(file_row_number & 63 AS INT))")).alias("bits"), F.min("file_number").alias("first"), F.max("file_number").alias("last"),
    )
    files = words.groupBy("filename").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.bit_count("bits")).alias("d"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    whole = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("d") == F.col("n")) & (F.col("first") == F.col("last"))
    whole = F.coalesce(whole, F.lit(False))
    return files.agg(F.sum("n").alias("n"), F.count_if(~whole).alias("broken"))


def not_null_refused(spark, sf_dir):
    """Rows of a required column: an append with a null fails as a whole."""

    def make() -> str:
        df = _raw(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        root = scratch(spark, "required")
        create_table(spark, root, T.StructType([T.StructField("n_nationkey", df.schema["n_nationkey"].dataType, False), T.StructField("n_name", T.StringType())]))
        s = Session(spark)
        s.attach(root, "r")
        s.insert("r", df)
        try:
            s.insert("r", df.withColumn("n_nationkey", F.expr("nullif(n_nationkey, 7)")))
        except ConstraintError:
            pass
        return root

    return scan(spark, _fixture(spark, sf_dir, "required", make))


def log_tail(spark, sf_dir):
    """A version that only the catalog's list names, not the log's listing."""

    def make() -> str:
        df = _raw(spark, sf_dir, "region")
        root = X.build(spark, "tailed", [df.filter("r_regionkey < 3"), df.filter("r_regionkey >= 3")])
        Fs(spark).rename(f"{root}/{LOG_DIR}/{commit_name(2)}", f"{root}/{LOG_DIR}/_staged_commits/{2:020d}.00000000-0000-0000-0000-000000000003.json")
        return root

    root = _fixture(spark, sf_dir, "tailed", make)
    assert scan(spark, root).count() < 5
    name = f"{2:020d}.00000000-0000-0000-0000-000000000003.json"
    size, changed = Fs(spark).status(f"{root}/{LOG_DIR}/_staged_commits/{name}")
    tail = [{"version": 2, "file_name": name, "file_size": size, "file_modification_timestamp": changed, "timestamp": changed}]
    s = Session(spark)
    s.attach(root, "tailed", log_tail=tail)
    return s.sql("SELECT r_regionkey, r_name FROM tailed")


def pushdown_log_rows(spark, sf_dir):
    """What the session's log says of three filters: the files of orders before and after."""
    s = session(spark, sf_dir, ("orders",))
    low, high = _raw(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    for text in (f"o_orderkey = {low}", f"o_orderkey > {high}", f"o_orderkey BETWEEN {low} AND {high}"):
        s.sql(f"SELECT count(*) AS n FROM orders WHERE {text}").collect()
    log = s.pushdown_log()
    share = F.expr("CASE WHEN files_after = 0 THEN 'none' WHEN files_after < files_before THEN 'some' ELSE 'all' END")
    return log.groupBy(share.alias("share")).agg(F.count("*").alias("n"))


_FUNCTIONS = {
    "checkpoint_rows_classic": (checkpoint_rows_classic, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"),
    "checkpoint_rows_multipart": (checkpoint_rows_multipart, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"),
    "checkpoint_rows_v2": (checkpoint_rows_v2, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"),
    "skip_struct": (skip_struct, "SELECT n_nationkey AS k, n_name AS name, 2::BIGINT AS files_before, 1::BIGINT AS files_after FROM nation WHERE n_nationkey < 8"),
    "partition_single_in": (partition_single_in, f"SELECT o_orderkey, o_orderpriority, o_orderstatus FROM {_PARTED} WHERE o_orderpriority IN ('1-URGENT') AND o_orderstatus IN ('F')"),
    "variant_access": (variant_access, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0"),
    "map_and_list_columns": (map_and_list_columns, "SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR AS region, unnest([n_regionkey, n_nationkey]) AS element FROM nation"),
    "virtual_columns_by_file": (virtual_columns_by_file, "SELECT count(*) AS n, 0::BIGINT AS broken FROM lineitem"),
    "not_null_refused": (not_null_refused, "SELECT n_nationkey, n_name FROM nation"),
    "log_tail": (log_tail, "SELECT r_regionkey, r_name FROM region"),
    "pushdown_log_rows": (pushdown_log_rows, "SELECT * FROM (VALUES ('some', 1::BIGINT), ('none', 1::BIGINT), ('all', 1::BIGINT)) AS t(share, n)"),
    "scan_partitioned": (scan_partitioned, f"SELECT * FROM {_PARTED}"),
    "partition_filter": (partition_filter, f"SELECT * FROM {_PARTED} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IS NOT NULL"),
    "null_partition": (null_partition, f"SELECT o_orderkey, o_orderpriority FROM {_PARTED} WHERE o_orderstatus IS NULL"),
    "partition_aggregate": (partition_aggregate, "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority"),
    "partition_constants_join": (partition_constants_join, f"SELECT o_orderkey, o_orderpriority, o_orderstatus FROM {_PARTED}"),
    "url_encoded_partition": (url_encoded_partition, "SELECT n_nationkey, n_regionkey || '+/ %' AS part FROM nation"),
    "virtual_columns": (virtual_columns, "SELECT count(*) AS named, 0::BIGINT AS negative, count(*) AS places FROM orders"),
    "time_travel": (time_travel, f"SELECT count(*) AS n, max(o_orderkey) AS high FROM {_THIRD.format(k=1)}"),
    "time_travel_empty": (time_travel_empty, "SELECT 0::BIGINT AS n"),
    "pinned_version": (pinned_version, f"SELECT count(*) AS n FROM {_THIRD.format(k=2)}"),
    "incremental_snapshot": (incremental_snapshot, f"SELECT 1::BIGINT AS version, count(*) AS n, max(o_orderkey) AS high FROM {_THIRD.format(k=1)} UNION ALL SELECT 3, count(*), max(o_orderkey) FROM orders"),
    "mapped_by_name": (mapped_by_name, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "mapped_by_id": (mapped_by_id, "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2"),
    "schema_add_and_widen": (schema_add_and_widen, "SELECT r_regionkey::BIGINT AS r_regionkey, r_name, NULL::DOUBLE AS extra FROM region UNION ALL SELECT r_regionkey + 10, r_name, r_regionkey / 2.0 FROM region"),
    "schema_drop_readd": (schema_drop_readd, "SELECT r_regionkey::BIGINT AS r_regionkey, NULL::DOUBLE AS extra, NULL::BIGINT AS r_name FROM region UNION ALL SELECT r_regionkey + 10, r_regionkey / 2.0, NULL FROM region UNION ALL SELECT 99, 1.5, 7"),
    "nested_fields": (nested_fields, "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey >= 10 THEN n_regionkey END AS region FROM nation WHERE n_nationkey > 5"),
    "deletion_vectors": (deletion_vectors, f"SELECT c_custkey, c_name FROM {_KEPT}"),
    "deletion_vectors_pushdown": (deletion_vectors_pushdown, f"SELECT c_custkey FROM {_KEPT} WHERE c_custkey > 20 AND c_mktsegment = 'BUILDING'"),
    "list_files_deletes": (list_files_deletes, "SELECT count(*) // 2 AS cardinality, true AS have_deletes, (count(*) // 2 + 6) // 7 AS delete_count FROM customer UNION ALL SELECT count(*) - count(*) // 2, true, 5 FROM customer"),
    "append_rollback_conflict": (append_rollback_conflict, "SELECT * FROM region UNION ALL SELECT * FROM region UNION ALL SELECT * FROM region"),
    "checkpoint_then_read": (checkpoint_then_read, "SELECT 3::BIGINT AS version, true AS from_checkpoint"),
    "app_transaction_version": (app_transaction_version, "SELECT 1::BIGINT AS version"),
    "list_files": (list_files, "SELECT count(*) AS rows, 0::BIGINT AS deleted FROM nation"),
    "stats_json": (stats_json, "SELECT count(*) AS n, 0::BIGINT AS nulls, min(l_orderkey) AS low, max(l_orderkey) AS high, min(l_quantity) AS low_quantity, max(l_returnflag) AS high_flag FROM lineitem"),
    "domain_metadata": (domain_metadata, "SELECT * FROM (VALUES ('one', '{}'), ('two', 'z')) AS t(domain, configuration)"),
    "variant_roundtrip": (variant_roundtrip, "SELECT count(*) AS n, count(event_id) AS ids FROM events"),
    "decimals_and_dates": (decimals_and_dates, "SELECT count(*) AS n, max(l_extendedprice::DECIMAL(12,2))::DOUBLE AS high FROM lineitem WHERE l_extendedprice::DECIMAL(12,2) < 20000 AND l_shipdate::DATE >= DATE '1995-01-01'"),
    "asof_events": (asof_events, _ASOF),
    "range_join": (range_join_parts, "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 100"),
}

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
for _name, (_text, *_names) in _TEXTS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _sql(_text, *_names, spark_text=_q12_spark(_text))
for _name, (_text, _spark_text, *_names) in _PAIRS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _sql(_text, *_names, spark_text=_spark_text)
for _name, (_run, _text) in _FUNCTIONS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _run, _text


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q1"](spark, sf_dir)
