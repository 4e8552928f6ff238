"""Scans: partitions, virtual columns, mapping, and skipping that never changes rows."""

import datetime
import decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelog import fixtures as X
from tablelog.errors import CatalogError, InvalidInput
from tablelog.functions import metadata
from tablelog.operators.transaction import Transaction
from tablelog.operators.write import create_table
from tablelog.plans import catalyst
from tablelog.session import Session
from tablelog.sources.scan import prune, scan, scan_snapshot
from tablelog.sources.snapshot import Snapshot

ROWS = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("s", T.StringType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("day", T.DateType()),
        T.StructField("dec", T.DecimalType(10, 2)),
        T.StructField("n", T.StructType([T.StructField("x", T.LongType())])),
        T.StructField("b", T.BooleanType()),
        T.StructField("part", T.IntegerType()),
    ]
)


def row(k):
    day = datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    return (k, f"v{k:02d}", float("nan") if k == 13 else k / 2, day, decimal.Decimal(k) + decimal.Decimal("0.25"), (k * 10,), k % 2 == 0, k // 5 if k < 15 else None)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('scan')}/t"
    from tablelog.operators.write import create_table

    create_table(spark, root, ROWS, ["part"])
    s = Session(spark)
    s.attach(root, "t")
    for k in range(0, 20, 4):
        s.insert("t", spark.createDataFrame([row(x) for x in range(k, k + 4)], ROWS).coalesce(1))
    nulls = [(None,) * 8]
    s.insert("t", spark.createDataFrame(nulls, ROWS))
    return s, root


CONDITIONS = [
    "i = 7", "i != 7", "i < 3", "i <= 3", "i > 17", "i >= 17", "i BETWEEN 5 AND 6", "i IN (1, 19)", "i = 1 OR i = 18", "s = 'v03'", "s > 'v15'",
    "d > 6", "d = 2.5", "day = DATE '2024-01-03'", "dec < CAST(3.00 AS DECIMAL(10,2))", "n.x >= 150", "b", "NOT b", "i IS NULL", "i IS NOT NULL", "part = 1",
    "part IS NULL", "part IS NULL AND i > 16", "part = 0 AND i = 19", "i IS NOT DISTINCT FROM 4", "NOT (i BETWEEN 2 AND 17)", "i + 1 = 5", "part IN (0, 2)", "i > 100", "d != d", "isnan(d)",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_skipping_keeps_results(spark, table, condition):
    s, root = table
    full = scan(spark, root).filter(condition)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(scan(spark, root, where=condition)) == key(full)
    assert key(s.sql(f"SELECT * FROM t WHERE {condition}")) == key(full)


@pytest.mark.parametrize(
    ("condition", "files"),
    [("i = 7", 1), ("i > 100", 0), ("part = 3", 0), ("s = 'v03'", 1), ("n.x >= 150", 2), ("i IS NULL", 1), ("day < DATE '2024-01-02'", 1), ("i = 1 OR i = 18", 2), ("i IN (1, 18)", 2)],
)
def test_files_that_are_skipped(spark, table, condition, files):
    s, root = table
    snapshot = Snapshot.load(spark, root)
    assert prune(snapshot, catalyst.parse(spark, condition)).after == files
    assert f"Scanning Files: {files}/" in s.explain(f"SELECT * FROM t WHERE {condition}")


OPS = st.sampled_from(["=", "!=", "<", "<=", ">", ">="])
ATOMS = st.builds("{} {} {}".format, st.sampled_from(["i", "n.x", "part"]), OPS, st.integers(-1, 40)) | st.builds(
    "{} IS {}NULL".format, st.sampled_from(["i", "s", "part"]), st.sampled_from(["", "NOT "])
)
TREES = st.recursive(ATOMS, lambda x: st.builds("({} {} {})".format, x, st.sampled_from(["AND", "OR"]), x), max_leaves=5)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(condition=TREES)
def test_skipping_is_sound(spark, table, condition):
    _, root = table
    snapshot = Snapshot.load(spark, root)
    pruned = scan_snapshot(snapshot, catalyst.parse(spark, condition)).filter(condition)
    assert pruned.count() == scan_snapshot(snapshot).filter(condition).count()


def test_filters_of_modes(spark, table):
    _, root = table
    for mode, expected in (("all", 1), ("none", 0), ("CONSTANT_ONLY", 1), ("dynamic_only", 0)):
        s = Session(spark)
        s.attach(root, "t", pushdown_filters=mode)
        assert s.sql("SELECT i FROM t WHERE i = 7").count() == 1
        assert s.pushdown_log().count() == expected
    with pytest.raises(InvalidInput):
        scan(spark, root, pushdown_filters="some")


def test_pushdown_log_and_dynamic(spark, table):
    s, root = table
    s.log.clear()
    assert s.sql("SELECT i FROM t WHERE n.x = (SELECT max(id) * 10 FROM range(8))").collect()[0][0] == 7
    (r,) = s.pushdown_log().collect()
    assert (r["filter_type"], r["filters_after"], r["files_after"]) == ("dynamic", ["n.x=70"], 1)
    s.settings["explain_files_filtered"] = False
    s.sql("SELECT i FROM t WHERE i = 7")
    assert s.pushdown_log().collect()[-1]["files_before"] is None
    s.settings["explain_files_filtered"] = True


def test_self_join_reads_what_either_side_needs(spark, table):
    s, _ = table
    got = s.sql("SELECT a.i, b.i FROM t a JOIN t b ON a.i + 10 = b.i WHERE a.i = 3").collect()
    assert [tuple(r) for r in got] == [(3, 13)]


def test_virtual_columns_and_estimate(spark, table):
    s, root = table
    df = scan(spark, root, virtual=["filename", "file_row_number", "file_number", "rowid", "delta_file_number"])
    assert df.select("filename", "file_row_number").distinct().count() == 21
    assert df.select("rowid").distinct().count() == 21
    assert {r[0] for r in scan(spark, root, virtual=["delta_file_number"], constant_file_number=True).select("delta_file_number").collect()} == {7}
    name = df.filter("i = 7").first()["filename"]
    assert scan(spark, root, filename=1).filter(f"filename = '{name}'").filter("i = 7").count() == 1
    snapshot = Snapshot.load(spark, root)
    assert metadata.estimate(snapshot) == 21
    assert metadata.estimate(snapshot, catalyst.parse(spark, "i > 100")) == 0
    assert s.sql("SELECT count(*) AS n FROM t WHERE filename IS NOT NULL").first()["n"] == 21


def test_list_files(spark, table):
    _, root = table
    df = metadata.list_files(Snapshot.load(spark, root), delete_count=True, transform_expression=True)
    assert df.columns == ["data_file", "cardinality", "partitions", "have_deletes", "delete_count", "transform_expression"]
    assert df.agg({"cardinality": "sum"}).first()[0] == 21
    assert metadata.list_files(Snapshot.load(spark, root, 0)).count() == 0


def test_names_that_need_escapes(spark, root):
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("p", T.StringType())])
    from tablelog.operators.write import create_table

    create_table(spark, root, schema, ["p"])
    s = Session(spark)
    s.attach(root, "t")
    values = ["0+/", "a b", "100%", "x=y", "ü", "[z]", "", None, "a:b"]
    s.insert("t", spark.createDataFrame(list(enumerate(values)), schema))
    expected = [(k, v or None) for k, v in enumerate(values)]
    assert sorted(map(tuple, scan(spark, root).collect())) == expected
    assert sorted(map(tuple, scan(spark, root, pushdown_partition_info=False).collect())) == expected
    assert scan(spark, root, where="p = '0+/'").count() == 1


def test_variant_query_reads_values(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tablelog import queries

    sf_dir = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert tuple(queries.variant_roundtrip(spark, sf_dir).first()) == (n, n)
    altered = F.when(F.col("event_id") == 5, F.parse_json(F.lit("[]"))).otherwise(F.col("v"))
    monkeypatch.setattr(queries, "scan", lambda *a: scan(*a).withColumn("v", altered))
    assert tuple(queries.variant_roundtrip(spark, sf_dir).first()) == (n, n - 1)


def test_variant(spark, root):
    X.build(spark, "unused", [spark.range(1)])
    df = spark.sql("""SELECT id, parse_json('{"a": ' || id || '}') AS v FROM range(3)""")
    path = X.build(spark, "variant", [df])
    got = scan(spark, path).selectExpr("id", "variant_get(v, '$.a', 'int') AS a").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 1), (2, 2)]


def test_names_are_resolved_by_scope(spark, root):
    s = Session(spark)
    for name, n in (("nation", 3), ("orders", 5)):
        create_table(spark, f"{root}-{name}", T.StructType([T.StructField("i", T.LongType())]))
        with Transaction(Snapshot.load(spark, f"{root}-{name}")) as tx:
            tx.insert(spark.range(n))
        s.attach(f"{root}-{name}", name)
    one = lambda text: s.sql(text).collect()[0][0]
    # an expression of that name hides the table, within its scope only
    assert one("WITH nation AS (SELECT 1 AS x) SELECT count(*) FROM nation") == 1
    assert one("WITH nation AS (SELECT * FROM nation WHERE i > 0) SELECT count(*) FROM nation") == 2
    assert one("SELECT (WITH nation AS (SELECT 1 AS x) SELECT count(*) FROM nation) + count(*) FROM nation") == 4
    assert one("WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM orders, a) SELECT count(*) FROM b") == 5
    assert one("WITH RECURSIVE orders AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM orders WHERE k < 4) SELECT count(*) FROM orders") == 4
    # lists, quotes, schemas, aliases, subqueries, strings and comments
    assert one("SELECT count(*) FROM orders o, nation n WHERE o.i = n.i") == 3
    assert one("SELECT count(*) FROM orders, nation WHERE orders.i = nation.i") == 3
    assert one('SELECT count(*) FROM "nation"') == 3 and one("SELECT count(*) FROM `orders` AS o") == 5
    assert one("SELECT count(*) FROM nation.nation") == 3 and one("SELECT count(*) FROM nation.main.nation x") == 3
    assert one("SELECT count(*) FROM orders o WHERE EXISTS (SELECT 1 FROM nation WHERE nation.i = o.i)") == 3
    assert one("SELECT count(*) FROM orders WHERE i IN (SELECT i FROM nation) AND 'FROM nation' <> 'x' -- FROM nation") == 3
    assert one("SELECT count(*) FROM nation AT (VERSION => 0) v, orders AT (VERSION => 1)") == 0
    assert one("SELECT count(*) FROM orders AS o(k) WHERE k > 2") == 2
    assert one("SELECT sum(nation) FROM (SELECT i AS nation FROM orders) nation") == 10
    assert "FileScan parquet" in one("EXPLAIN SELECT * FROM nation WHERE i > 1")
    assert one("SELECT count(*) FROM (SELECT i FROM nation UNION ALL SELECT i FROM orders) u JOIN nation USING (i)") == 6
    s.use("nation")
    assert one("SELECT count(*) FROM main.nation") == 3
    s.detach("nation")
    with pytest.raises(Exception, match="nation"):
        s.sql("SELECT * FROM main.nation")
    with pytest.raises(CatalogError):
        s.use("nation")


def test_joins_skip_files(spark, root):
    """A filter on another column of a small side leaves a range of keys, which skips files of the large side."""
    s = Session(spark)
    for name in ("facts", "dims"):
        schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
        create_table(spark, f"{root}-{name}", schema)
        for part in range(5):
            with Transaction(Snapshot.load(spark, f"{root}-{name}")) as tx:
                tx.insert(spark.range(part * 100, part * 100 + 100, 1, 1).selectExpr("id AS k", "id % 100 AS v"))
        s.attach(f"{root}-{name}", name)
    text = "SELECT {} FROM facts f JOIN dims d ON f.k = d.k WHERE d.v >= 98 AND d.k + d.v < 300"
    expected = sorted(map(tuple, s.sql(text.format("f.k, d.v")).collect()))
    before = len(s.log.pushdowns)
    s.join_scan_bytes = 0
    for query in ("f.k, d.v", "f.k, row_number() OVER (ORDER BY f.k) AS r"):
        got = sorted(map(tuple, s.sql(text.format(query)).collect()))
        assert len(got) == len(expected) and [x[0] for x in got] == [x[0] for x in expected]
    seen = [p for p in s.log.pushdowns[before:] if "facts" in p.path]
    assert seen and all((p.files_before, p.files_after, p.filter_type) == (5, 2, "dynamic") for p in seen)
    # what a window or a limit has looked at isn't pruned, nor the kept side of an outer join
    for query in (
        "SELECT f.k, f.r FROM (SELECT k, row_number() OVER (ORDER BY k) AS r FROM facts) f JOIN (SELECT k FROM dims WHERE v = 99) d ON f.k = d.k",
        "SELECT f.k FROM (SELECT k FROM facts ORDER BY k LIMIT 150) f JOIN (SELECT k FROM dims WHERE v = 99) d ON f.k = d.k",
        "SELECT f.k, d.v FROM facts f LEFT JOIN (SELECT k, v FROM dims WHERE v = 99) d ON f.k = d.k",
        "SELECT f.k FROM facts f WHERE f.k IN (SELECT k FROM dims WHERE v = 7 AND k > 150)",
        "SELECT f.k, n FROM (SELECT k, count(*) AS n FROM facts GROUP BY k) f JOIN (SELECT k FROM dims WHERE v = 3) d ON f.k = d.k",
    ):
        s.join_scan_bytes = 0
        got = sorted(map(tuple, s.sql(query).collect()), key=str)
        s.join_scan_bytes = 1 << 40
        assert got == sorted(map(tuple, s.sql(query).collect()), key=str)


def test_large_tables_are_planned_without_their_files(spark, root):
    """Plans over empty stand-ins push the same filters; each reference is pruned by its own; rows are the same."""
    create_table(spark, root, T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType())]))
    for part in range(4):
        with Transaction(Snapshot.load(spark, root)) as tx:
            tx.insert(spark.range(part * 10, part * 10 + 10, 1, 1).selectExpr("id AS k", "concat('x', id) AS s"))
    s = Session(spark)
    s.attach(root, "t")
    queries = {
        "SELECT k, s FROM t WHERE k = 7": [1],
        "SELECT a.k FROM t a JOIN t b ON a.k = b.k + 10 WHERE a.k < 15 AND b.k >= 3": [2, 4],
        "SELECT count(*) AS n FROM t": [4],
        "SELECT k FROM t WHERE k > (SELECT max(k) - 3 FROM t)": [4, 4],
        "SELECT k, file_row_number, filename FROM t WHERE k BETWEEN 12 AND 13": [1],
        "WITH u AS (SELECT * FROM t WHERE s = 'x31') SELECT u.k, t.s FROM u LEFT JOIN t ON u.k = t.k": [2, 4],
        "SELECT k FROM t WHERE k = 99": [0],
    }
    for text, files in queries.items():
        s.probe_files = 10_000
        expected = sorted(map(tuple, s.sql(text).collect()))
        s.probe_files = 0
        df, scans = s._planned(text)
        assert sorted(map(tuple, df.collect())) == expected
        assert sum(p.after for _, p in scans) <= sum(files), (text, [p.after for _, p in scans])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT c.k, x.k AS v FROM c, LATERAL (SELECT k FROM t WHERE g = c.k ORDER BY p DESC, k LIMIT 1) AS x", {(0, 9), (1, 10), (2, 11)}),
        ("SELECT c.k, (SELECT k FROM t WHERE g = c.k ORDER BY p DESC, k LIMIT 1) AS v FROM c WHERE c.k < 3", {(0, 9), (1, 10), (2, 11)}),
        ("SELECT c.k, count(x.k) AS v FROM c LEFT JOIN LATERAL (SELECT k FROM t WHERE g = c.k ORDER BY p LIMIT 1 OFFSET 1) AS x GROUP BY c.k", {(0, 1), (1, 1), (2, 1), (3, 0)}),
        ("SELECT c.k, x.v FROM c, LATERAL (SELECT y.v FROM c d, LATERAL (SELECT k AS v FROM t WHERE g = d.k ORDER BY p LIMIT 1) AS y WHERE d.k = c.k) AS x", {(0, 27), (1, 28), (2, 29)}),
        ("SELECT k, k AS v FROM c WHERE k + 9 IN (SELECT k FROM t WHERE g = c.k ORDER BY p DESC LIMIT 1) OR k = 3", {(0, 0), (1, 1), (2, 2), (3, 3)}),
    ],
)
def test_limits_of_correlated_subqueries_keep_their_order(spark, root, tmp_path, text, expected):
    """Rows are numbered by the ORDER BY, not in the order that a shuffle happens to bring them."""
    create_table(spark, root, T.StructType([T.StructField(n, T.LongType()) for n in ("k", "g", "p")]))
    outer = f"file://{tmp_path}/outer"
    create_table(spark, outer, T.StructType([T.StructField("k", T.LongType())]))
    s = Session(spark)
    s.attach(root, "t")
    s.attach(outer, "c")
    s.insert("t", spark.range(0, 30, 1, 5).selectExpr("id AS k", "id % 3 AS g", "CASE WHEN id < 12 THEN 50 + id DIV 3 ELSE 40 - id END AS p"))
    s.insert("c", spark.range(4))
    df = s.sql(text)
    assert set(map(tuple, df.collect())) == expected
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number() windowspecdefinition(" in line]
    assert windows
    assert all(" ASC " in line or " DESC " in line for line in windows)


def test_fixture_keeps_rows_without_keys(spark, tmp_path):
    """Null keys belong to the last of the three commits; keys may be null everywhere."""
    from tablelog import queries

    for name, key in (("some", "CASE WHEN id % 4 = 0 THEN NULL ELSE id END"), ("all", "CAST(NULL AS BIGINT)")):
        spark.range(20).selectExpr(f"{key} AS o_orderkey", "id AS o_custkey").write.parquet(f"file://{tmp_path}/{name}/orders.parquet")
        path = queries.table(spark, f"file://{tmp_path}/{name}", "orders")
        assert sorted(r[0] for r in scan(spark, path).select("o_custkey").collect()) == list(range(20))


def test_range_join_deals_a_large_bucket_to_many_tasks(spark):
    """All rows in one bucket, copies, nulls, ends of intervals and empty sides: the pairs of a plain join, no task with most of them."""
    from tablelog.operators.joins import range_join

    left = spark.range(0, 600, 1, 3).selectExpr("id % 500 AS k", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 7 = 0 THEN id * 10.0D ELSE 100.0D + id % 60 END AS p", "map('k', id) AS m")
    right = spark.range(0, 90, 1, 2).selectExpr("id AS r", "100.0D + id % 40 AS low", "CASE WHEN id % 9 = 0 THEN 90.0D ELSE 110.0D + id % 45 END AS high")
    condition = (F.col("low") <= F.col("p")) & (F.col("p") < F.col("high"))
    for a, b in ((left, right), (left.limit(0), right), (left, right.filter("high < low"))):
        got = range_join(a, b, F.col("p"), F.col("low"), F.col("high"), 100.0, block_rows=16, task_pairs=1000)
        expected = a.join(b, condition)
        assert got.columns == expected.columns
        key = lambda df: sorted(map(tuple, df.select("k", "p", "r", "low", "high").collect()))
        assert key(got) == key(expected)
    got = range_join(left, right, F.col("p"), F.col("low"), F.col("high"), 100.0, block_rows=16, task_pairs=1000)
    parts = [r[0] for r in got.select("k", "r").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(parts) > 20
    assert max(parts) < sum(parts) / 4
    assert "BroadcastHashJoin [__b" not in got._jdf.queryExecution().sparkPlan().toString().split("SortMergeJoin")[0]


def test_row_numbers_are_counted_without_a_group_for_each_row(spark, tmp_path, monkeypatch):
    """Gaps, repeats, nulls, other starts and several file numbers are found; rows are neither sorted nor shuffled by file."""
    from tablelog import queries

    lineitem = spark.range(0, 300, 1, 2).selectExpr("id AS l_orderkey", "concat('x', id) AS l_returnflag")
    lineitem.write.parquet(f"file://{tmp_path}/lineitem.parquet")
    df = queries.virtual_columns_by_file(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in df.collect()] == [(300, 0)]
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert not any(k in plan for k in ("SortMergeJoin", "SortAggregate", "Expand"))
    rows = [(f, k, 1) for f, numbers in {
        "whole": range(200), "gap": [0, 1, 3, 4], "repeat": [0, 1, 1, 3], "late": range(1, 5), "null": [0, 1, None], "nulls": [None], "below": [-1, 0, 1],
    }.items() for k in numbers] + [("two", 0, 1), ("two", 1, 2), ("none", 0, None)]
    made = spark.createDataFrame(rows, "filename string, file_row_number bigint, file_number bigint")
    monkeypatch.setattr(queries, "scan", lambda *a, **b: made)
    assert [tuple(r) for r in queries.virtual_columns_by_file(spark, f"file://{tmp_path}").collect()] == [(len(rows), 8)]


def test_statistics_of_strings_are_hashed(spark, root, monkeypatch):
    """Bounds of strings are aggregated in a hash table: no sort of all rows by their file."""
    plans, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or collect(df))
    create_table(spark, root, T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType())]))
    with Transaction(Snapshot.load(spark, root)) as tx:
        tx.insert(spark.range(40).selectExpr("id AS k", "concat('v', id) AS s"))
    (plan,) = {p for p in plans if "min(s#" in p}
    assert "ObjectHashAggregate" in plan
    assert "SortAggregate" not in plan


def test_distinct_values_come_before_sketches(spark, root):
    """No sketch is kept for each distinct value; results are those of Spark's own plan, and other queries keep theirs."""
    create_table(spark, root, T.StructType([T.StructField("g", T.StringType()), T.StructField("k", T.LongType()), T.StructField("v", T.LongType())]))
    s = Session(spark)
    s.attach(root, "t")
    rows = spark.range(0, 400, 1, 3).selectExpr("CASE WHEN id % 5 < 4 THEN concat('g', id % 5) END AS g", "CASE WHEN id % 5 <> 1 AND id % 7 > 0 THEN id % 90 END AS k", "id % 11 AS v")
    s.insert("t", rows)
    rows.createOrReplaceTempView("plain_rows")
    first = [
        "SELECT g, abs(approx_count_distinct(k, 0.02) - count(DISTINCT k)) AS d, count(DISTINCT k) AS n FROM {} GROUP BY g",
        "SELECT approx_count_distinct(k) AS a, sum(DISTINCT k) + max(k) AS n FROM {}",
        "SELECT g, v, approx_count_distinct(k) AS a, count(DISTINCT k) AS n, grouping(v) AS r FROM {} GROUP BY ROLLUP (g, v) HAVING count(DISTINCT k) > 1",
        "SELECT g, approx_count_distinct(k) AS a, count(DISTINCT v, k) AS n FROM {} GROUP BY g",
        "SELECT approx_count_distinct(k) AS a, count(DISTINCT k) AS n FROM {} WHERE k < 0",
        "SELECT * FROM (SELECT g, approx_count_distinct(g) AS a, count(DISTINCT g) AS n FROM {} GROUP BY g) WHERE n = 1",
    ]
    own = [
        "SELECT g, approx_count_distinct(v) AS a, count(DISTINCT k) AS n FROM {} GROUP BY g",
        "SELECT g, approx_count_distinct(k) AS a, count(DISTINCT k) AS n, count(k) AS c FROM {} GROUP BY g",
        "SELECT g, approx_count_distinct(k) AS a, count(DISTINCT k) FILTER (WHERE v > 2) AS n FROM {} GROUP BY g",
        "SELECT g, approx_count_distinct(k) AS a, count(DISTINCT k + 1) AS n FROM {} GROUP BY g",
    ]
    for text in first + own:
        df = s.sql(text.format("t"))
        expected = spark.sql(text.format("plain_rows"))
        assert df.schema == expected.schema
        assert sorted(map(str, df.collect())) == sorted(map(str, expected.collect())), text
        analyzed = df._jdf.queryExecution().analyzed().toString()
        assert ("distinct" in analyzed.replace("approx_count_distinct", "")) == (text in own), text
