"""Appends, transactions, constraints, the session's SQL, and the streaming sink."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelog import fixtures as X
from tablelog.errors import CatalogError, CommitConflict, ConstraintError, InvalidInput, LogError, TransactionError, Unsupported
from tablelog.functions import util
from tablelog.functions.observe import parse_logline
from tablelog.operators.committer import CatalogCommitter, FileCommitter
from tablelog.operators.transaction import Transaction
from tablelog.operators.write import create_table
from tablelog.session import Session
from tablelog.sources import storage
from tablelog.sources.fs import Fs
from tablelog.sources.scan import scan
from tablelog.sources.snapshot import Snapshot
from tablelog.streaming.sink import append_once, foreach_batch

I = T.StructType([T.StructField("i", T.LongType())])


def made(spark, root, schema=I, parts=()):
    create_table(spark, root, schema, list(parts))
    s = Session(spark)
    s.attach(root, "t")
    return s


def commit(root, version):
    with open(f"{root.removeprefix('file://')}/_delta_log/{version:020d}.json") as f:
        return [json.loads(x) for x in f]


def adds(root, version):
    return [a["add"] for a in commit(root, version) if "add" in a]


def data_files(root):
    from pathlib import Path

    return [p for p in Path(root.removeprefix("file://")).rglob("*.parquet") if "_delta_log" not in str(p)]


def test_stats_of_values(spark, root):
    s = made(spark, root)
    s.sql("INSERT INTO t VALUES (5)")
    s.sql("INSERT INTO t SELECT id FROM range(10)")
    s.sql("INSERT INTO t VALUES (NULL)")
    assert adds(root, 1)[0]["stats"] == '{"numRecords":1,"nullCount":{"i":0},"minValues":{"i":5},"maxValues":{"i":5},"tightBounds":true}'
    assert json.loads(adds(root, 3)[0]["stats"]) == {"numRecords": 1, "nullCount": {"i": 1}, "minValues": {}, "maxValues": {}, "tightBounds": True}
    assert not adds(root, 1)[0]["path"].startswith("/")
    assert s.sql("SELECT i FROM t WHERE i IS NULL OR i = 5 ORDER BY i").count() == 3


def test_nested_stats_skip_lists(spark, root):
    nested = T.StructType([T.StructField("a", T.StructType([T.StructField("b", T.LongType())])), T.StructField("l", T.ArrayType(T.IntegerType())), T.StructField("m", T.MapType(T.StringType(), T.IntegerType()))])
    s = made(spark, root, nested)
    s.insert("t", spark.createDataFrame([((10,), [1], {"k": 1})], nested).coalesce(1))
    assert adds(root, 1)[0]["stats"] == '{"numRecords":1,"nullCount":{"a":{"b":0}},"minValues":{"a":{"b":10}},"maxValues":{"a":{"b":10}},"tightBounds":true}'


def test_partition_files(spark, root):
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("part", T.IntegerType())])
    s = made(spark, root, schema, ["part"])
    s.sql("INSERT INTO t (part, i) VALUES (1, 10), (NULL, 20)")
    by = {a["partitionValues"]["part"]: a for a in adds(root, 1)}
    assert set(by) == {"1", ""} and by[""]["path"].startswith("part=__HIVE_DEFAULT_PARTITION__/")
    assert "part" not in json.loads(by["1"]["stats"])["minValues"]
    assert sorted(map(tuple, s.sql("SELECT * FROM t").collect()), key=str) == [(10, 1), (20, None)]


def test_transaction_commits_once(spark, root):
    s = made(spark, root)
    s.sql("BEGIN")
    s.sql("INSERT INTO t VALUES (1)")
    with pytest.raises(TransactionError, match="after COMMIT"):
        s.sql("SELECT * FROM t").collect()
    assert scan(spark, root).count() == 0
    s.sql("INSERT INTO t VALUES (2)")
    s.sql("COMMIT")
    assert len(adds(root, 1)) == 2 and s.sql("SELECT sum(i) AS x FROM t").first()["x"] == 3
    s.sql("BEGIN TRANSACTION")
    s.sql("INSERT INTO t VALUES (3)")
    s.sql("ROLLBACK")
    assert len(data_files(root)) == 2 and s.snapshot("t").version == 1


def test_conflict_cleans_up(spark, root):
    made(spark, root)
    a, b = (Transaction(Snapshot.load(spark, root)) for _ in range(2))
    a.insert(spark.createDataFrame([(1,)], I).coalesce(1))
    b.insert(spark.createDataFrame([(2,)], I).coalesce(1))
    assert a.commit() == 1
    with pytest.raises(CommitConflict, match="commit conflict at version 1"):
        b.commit()
    assert scan(spark, root).collect()[0][0] == 1 and len(data_files(root)) == 1
    with pytest.raises(TransactionError):
        b.insert(spark.createDataFrame([(2,)], I).coalesce(1))


def test_app_versions(spark, root):
    s = made(spark, root)

    def ingest(new, expected, rows=True):
        with s.transaction():
            s.set_app_version("t", "app", new, expected)
            if rows:
                s.sql("INSERT INTO t VALUES (1)")

    with pytest.raises(TransactionError, match=r"expected previous version of '2' \(found: 'NULL'\)"):
        ingest(3, 2)
    ingest(1, None)
    assert s.app_version("t", "app") == 1
    ingest(2, 1, rows=False)  # nothing appended: dropped
    assert s.sql("SELECT version FROM delta_get_transaction_version('t', 'app')").first()[0] == 1
    with pytest.raises(TransactionError, match="found: '1'"):
        ingest(3, None)
    s.sql("BEGIN")
    s.sql("CALL delta_set_transaction_version('t', 'app', 2::UBIGINT, 1::UBIGINT)")
    s.sql("INSERT INTO t VALUES (1)")
    s.sql("COMMIT")
    assert s.app_version("t", "app") == 2 and s.app_version("t", "other") is None


def test_not_null(spark, root):
    value = T.StructType([T.StructField("value", T.LongType(), False)])
    schema = T.StructType([T.StructField("i", T.LongType(), False), T.StructField("s", value, False), T.StructField("o", value, True)])
    s = made(spark, root, schema)
    free = T.StructType([T.StructField("i", T.LongType()), *[T.StructField(n, T.StructType([T.StructField("value", T.LongType())])) for n in "so"]])
    put = lambda r: s.insert("t", spark.createDataFrame([r], free))
    put((1, (1,), None))
    for r, path in (((None, (1,), (1,)), "t.i"), ((1, (None,), (1,)), "t.s.value"), ((1, None, (1,)), "t.s"), ((1, (1,), (None,)), "t.o.value")):
        with pytest.raises(ConstraintError, match=f"NOT NULL constraint failed: {path}"):
            put(r)
    assert scan(spark, root).count() == 1 and len(data_files(root)) == 1


def test_refusals(spark, root):
    s = made(spark, root)
    for text in ("UPDATE t SET i = 1", "DELETE FROM t", "DROP TABLE t", "ALTER TABLE t ADD COLUMN x INT", "CREATE TABLE t.main.x (i INT)", "INSERT INTO t VALUES (1) RETURNING i", "INSERT INTO t VALUES (1) ON CONFLICT DO NOTHING"):
        with pytest.raises(Unsupported):
            s.sql(text)
    with pytest.raises(InvalidInput):
        s.sql("INSERT INTO t VALUES (1, 2)")
    with pytest.raises(CatalogError):
        s.table("other")
    s.attach(root, "ro", read_only=True)
    with pytest.raises(InvalidInput, match="read-only"):
        s.sql("INSERT INTO ro VALUES (1)")
    s.attach(root, "pin", pin_snapshot=True)
    with pytest.raises(InvalidInput, match="pinned"):
        s.sql("INSERT INTO pin VALUES (1)")
    array = T.StructType([T.StructField("l", T.ArrayType(T.LongType()), False)])
    create_table(spark, f"{root}2", array)
    s.attach(f"{root}2", "arr")
    with pytest.raises(Unsupported, match="arrays"):
        s.insert("arr", spark.createDataFrame([([1],)], array))
    X.publish(spark, f"{root}3", 0, [X.protocol("columnMapping"), X.metadata(I, (), {"delta.columnMapping.mode": "name"})])
    s.attach(f"{root}3", "mapped")
    with pytest.raises(LogError, match=r"UnsupportedError \(35\)"):
        s.sql("INSERT INTO mapped VALUES (1)")


def test_pins_names_and_introspection(spark, root):
    s = made(spark, root)
    s.sql(f"ATTACH '{root}' AS pin (TYPE delta, PIN_SNAPSHOT, unknown_option 3)")
    assert s.sql("SELECT count(*) AS n FROM pin").first()["n"] == 0
    s.sql("INSERT INTO t VALUES (1)")
    assert s.sql("SELECT count(*) AS n FROM pin").first()["n"] == 0
    for name in ("t", "t.t", "t.main.t"):
        assert s.sql(f"SELECT count(*) AS n FROM {name}").first()["n"] == 1
    assert {r["name"]: r["version"] for r in s.sql("SHOW ALL TABLES").collect()} == {"t": 1, "pin": 0}
    s.sql("DETACH pin")
    with pytest.raises(CatalogError):
        s.snapshot("pin")
    s.attach("/no/such/table", "lazy")
    with pytest.raises(LogError, match="InvalidTableLocationError"):
        s.table("lazy")


def test_catalog_commits(spark, root):
    made(spark, root)
    taken = set()

    def decide(staged, version):
        if version in taken:
            return None
        taken.add(version)
        return True

    with Transaction(Snapshot.load(spark, root), committer=CatalogCommitter(spark, decide)) as tx:
        tx.insert(spark.createDataFrame([(1,)], I).coalesce(1))
    with pytest.raises(CommitConflict):
        with Transaction(Snapshot.load(spark, root), committer=CatalogCommitter(spark, decide)) as tx:
            tx.insert(spark.createDataFrame([(2,)], I).coalesce(1))
    assert taken == {1}


def test_sink_is_exactly_once(spark, root, tmp_path):
    made(spark, root)
    df = spark.createDataFrame([(1,), (2,)], I)
    assert append_once(spark, root, df, "app", 0) and not append_once(spark, root, df, "app", 0)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(I).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing new
        q = stream.writeStream.foreachBatch(foreach_batch(root, "stream")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert scan(spark, root).count() == 4


def test_utilities(spark, root, tmp_path):
    assert util.write_blob(spark, f"{tmp_path}/a/b/c.bin", b"xyz") and open(f"{tmp_path}/a/b/c.bin", "rb").read() == b"xyz"
    util.copy_dir(spark, f"{tmp_path}/a", f"{tmp_path}/copy")
    assert open(f"{tmp_path}/copy/b/c.bin", "rb").read() == b"xyz"
    s = made(spark, root)
    s.sql("INSERT INTO t VALUES (1)")
    s.sql("SELECT * FROM t WHERE i = 2").collect()
    line = [m for _, kind, m in s.log.records if kind == "FilterPushdown"][0]
    assert parse_logline(line).files_after == 0


def test_storage_options():
    s3 = storage.hadoop_options("s3://b/t", {"key_id": "k", "secret": "s", "endpoint": "h:9", "use_ssl": False, "url_style": "path"})
    assert s3["fs.s3a.bucket.b.endpoint"] == "http://h:9" and s3["fs.s3a.bucket.b.path.style.access"] == "true"
    assert "Anonymous" in storage.hadoop_options("s3://b/t", {})["fs.s3a.bucket.b.aws.credentials.provider"]
    assert storage.spark_path("gs://b/t", {"key_id": "k"}) == "s3a://b/t"
    with pytest.raises(InvalidInput, match="gcs:// gs:// or r2://"):
        storage.spark_path("gs://b/t")
    az = storage.hadoop_options("abfss://c@acc.dfs.core.windows.net/t", {"connection_string": "AccountName=acc;AccountKey=xx"})
    assert az["fs.azure.account.key.acc.dfs.core.windows.net"] == "xx"
    assert storage.spark_path("az://c/t", {"account_name": "acc"}) == "abfss://c@acc.dfs.core.windows.net/t"


def test_settings_and_logs(spark, root):
    s = made(spark, root)
    assert [tuple(r) for r in s.sql("DESCRIBE t").collect()] == [("i", "bigint", True, False)]
    s.sql("SET delta_kernel_logging = true")
    s.sql("INSERT INTO t VALUES (1)")
    text = "SELECT * FROM t WHERE i = 1"
    s.sql(text)
    s.sql("SET delta_kernel_logging = false")
    kinds = {r["type"] for r in s.log.frame(spark).collect()}
    assert {"Engine", "FilterPushdown", "MultiFileList"} <= kinds
    assert s.pushdown_log_of(spark.createDataFrame([(1, text)], "nr int, query string")).first()["nr"] == 1
    s.sql("CALL truncate_logs()")
    assert s.pushdown_log().count() == 0
    with pytest.raises(InvalidInput):
        s.set("other", True)


def test_commit_that_breaks_off_leaves_nothing(spark, root, monkeypatch):
    """A stream that fails in the middle leaves no file of the commit's name, and the table goes on."""
    made(spark, root)
    real = Fs.write

    def half(self, p, data, overwrite=False):
        if ".tmp" in p:
            real(self, p, data[: len(data) // 2], overwrite)
            raise OSError("the disk is gone")
        return real(self, p, data, overwrite)

    tx = Transaction(Snapshot.load(spark, root))
    tx.insert(spark.createDataFrame([(1,)], I).coalesce(1))
    with monkeypatch.context() as m:
        m.setattr(Fs, "write", half)
        with pytest.raises(OSError):
            tx.commit()
    log_files = os.listdir(root.removeprefix("file://") + "/_delta_log")
    assert log_files == ["00000000000000000000.json"] and data_files(root) == []
    again = Transaction(Snapshot.load(spark, root))
    again.insert(spark.createDataFrame([(2,)], I).coalesce(1))
    assert again.commit() == 1 and scan(spark, root).collect()[0][0] == 2


@pytest.mark.parametrize("case", ["ours", "another's", "not there", "unknown"])
def test_commit_that_raises_is_read_back(spark, root, monkeypatch, case):
    """Data files are deleted only if the commit is known not to be ours."""
    made(spark, root)

    class Lost(FileCommitter):
        def commit(self, at, version, lines):
            if case in ("ours", "unknown"):
                super().commit(at, version, lines)
            if case == "another's":
                super().commit(at, version, [lines[0]])
            raise TimeoutError("no answer")

        def published(self, at, version, lines):
            return None if case == "unknown" else super().published(at, version, lines)

    tx = Transaction(Snapshot.load(spark, root), committer=Lost(spark))
    tx.insert(spark.createDataFrame([(1,)], I).coalesce(1))
    if case == "ours":
        assert tx.commit() == 1
    else:
        with pytest.raises(TimeoutError):
            tx.commit()
    assert len(data_files(root)) == (case in ("ours", "unknown"))
    assert scan(spark, root).count() == (case in ("ours", "unknown"))


def test_features_that_are_not_written_are_refused(spark, root, tmp_path):
    create_table(spark, root, I, features=["catalogManaged"])
    s = Session(spark)
    s.attach(root, "t")
    with pytest.raises(Unsupported, match="catalog"):
        s.sql("INSERT INTO t VALUES (1)")
    for k, key in enumerate(("delta.generationExpression", "delta.identity.start")):
        path = f"file://{tmp_path}/g{k}"
        schema = T.StructType([T.StructField("i", T.LongType(), True, {key: "1"})])
        create_table(spark, path, schema, writer_version=6)
        with pytest.raises(LogError, match="generated or identity"):
            Transaction(Snapshot.load(spark, path)).insert(spark.createDataFrame([(1,)], I))


def test_in_commit_timestamps(spark, root):
    create_table(spark, root, I, features=["inCommitTimestamp"], configuration={"delta.enableInCommitTimestamps": "true"})
    stamps = []
    for k in range(3):
        tx = Transaction(Snapshot.load(spark, root))
        tx.insert(spark.createDataFrame([(k,)], I).coalesce(1))
        version = tx.commit()
        with open(f"{root.removeprefix('file://')}/_delta_log/{version:020d}.json") as f:
            stamps.append(json.loads(f.readline())["commitInfo"]["inCommitTimestamp"])
    assert stamps == sorted(set(stamps))


def test_input_runs_once(spark, root):
    """NOT NULL is checked on the rows as written."""
    s = made(spark, root, T.StructType([T.StructField("i", T.LongType(), False)]))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint", useArrow=False)
    def counted(x):
        seen.add(1)
        return x

    s.insert("t", spark.range(5).select(counted("id").alias("i")))
    assert seen.value == 5


def test_create_as_on_attached_names(spark, root):
    s = made(spark, root)
    s.sql("INSERT INTO t VALUES (1), (2)")
    for text in ("CREATE TABLE t AS SELECT 1 AS i", "CREATE OR REPLACE TABLE `t` AS SELECT * FROM t", "CREATE TABLE IF NOT EXISTS t (i BIGINT)", "CREATE VIEW t AS SELECT 1"):
        with pytest.raises(Unsupported):
            s.sql(text)
    assert not spark.catalog.tableExists("t")


def test_parent_catalog_publishes(spark, root):
    """Commits go to the named catalog with the table's id; a child catalog is its one table by any name."""
    create_table(spark, root, I, features=["catalogManaged"])
    asked = []

    def publish(table_id, staged, version):
        asked.append((table_id, version))
        return Fs(spark).put_if_absent(f"{root}/_delta_log/{version:020d}.json", Fs(spark).read(staged))

    s = Session(spark, catalogs={"uc": publish})
    s.attach(root, "t", parent_commit=True, parent_catalog="uc", unity_table_id="id-7", child_catalog_mode=True)
    s.sql("INSERT INTO t VALUES (1)")
    s.sql("INSERT INTO t.main.whatever VALUES (2)")
    assert asked == [("id-7", 1), ("id-7", 2)] and s.sql("SELECT sum(i) AS x FROM t.main.other").first()["x"] == 3
    with pytest.raises(CatalogError):
        s.attach(root, "u", parent_commit=True, parent_catalog="none")


def test_reader_options(spark, root):
    create_table(spark, root, T.StructType([T.StructField("b", T.BinaryType()), T.StructField("i", T.LongType())]))
    with Transaction(Snapshot.load(spark, root)) as tx:
        tx.insert(spark.createDataFrame([(bytearray(b"xy"), 1)], "b binary, i long"))
    assert scan(spark, root, binary_as_string=True, union_by_name=True, where="i = 1").collect() == [("xy", 1)]
    with pytest.raises(InvalidInput):
        scan(spark, root, schema="i int")


def test_azure_chains():
    options = lambda chain, **more: storage.hadoop_options("abfss://c@a.dfs.core.windows.net/x", {"provider": "credential_chain", "chain": chain, **more})
    name = "fs.azure.account.oauth.provider.type.a.dfs.core.windows.net"
    assert "Workload" in options("workload_identity")[name] and "Msi" in options("")[name]
    assert options("cli;env", token_provider="org.example.Cli")[name] == "org.example.Cli"
    with pytest.raises(InvalidInput, match="token_provider"):
        options("cli")
