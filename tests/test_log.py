"""Replay, checkpoints, time travel, and logs that must fail."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import types as T

from tablelog import fixtures as X
from tablelog.errors import InvalidInput, LogError
from tablelog.operators.checkpoint import write_checkpoint
from tablelog.operators.write import create_table
from tablelog.session import Session
from tablelog.sources import dv
from tablelog.sources.scan import scan
from tablelog.sources.snapshot import Snapshot

I = T.StructType([T.StructField("i", T.LongType())])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def local(root):
    return root.removeprefix("file://")


def appended(spark, root, *batches):
    create_table(spark, root, I)
    s = Session(spark)
    s.attach(root, "t")
    for b in batches:
        s.insert("t", spark.createDataFrame([(x,) for x in b], I).coalesce(1))
    return s


def test_versions_and_incremental_replay(spark, root):
    s = appended(spark, root, [1, 2], [3], [4])
    assert [scan(spark, root, version=v).count() for v in range(4)] == [0, 2, 3, 4]
    old = Snapshot.load(spark, root, 1)
    assert Snapshot.load(spark, root, 3, previous=old).files.count() == 3
    assert Snapshot.load(spark, root, 0, previous=old).version == 0
    assert rows(s.sql("SELECT * FROM t AT (VERSION => 2)")) == [(1,), (2,), (3,)]
    with pytest.raises(InvalidInput):
        s.sql("SELECT * FROM t AT (TIMESTAMP => 2)")
    with pytest.raises(LogError, match="MissingVersionError"):
        Snapshot.load(spark, root, 9)


def test_checkpoint_is_enough_and_hint_is_not_needed(spark, root):
    s = appended(spark, root, [1, 2], [3])
    assert write_checkpoint(s.snapshot("t")) and not write_checkpoint(s.snapshot("t"))
    log = f"{local(root)}/_delta_log"
    for v in range(3):
        os.remove(f"{log}/{v:020d}.json")
    assert json.load(open(f"{log}/_last_checkpoint"))["version"] == 2
    os.remove(f"{log}/_last_checkpoint")
    assert rows(scan(spark, root)) == [(1,), (2,), (3,)]
    s2 = Session(spark)
    s2.attach(root, "u")
    s2.insert("u", spark.createDataFrame([(9,)], I))
    assert rows(scan(spark, root, where="i > 2")) == [(3,), (9,)]


def test_multipart_and_json_checkpoints(spark, root):
    s = appended(spark, root, [1], [2])
    snapshot = s.snapshot("t")
    from tablelog.operators.checkpoint import checkpoint_rows

    log = f"{local(root)}/_delta_log"
    lines = [json.loads(r[0]) for r in checkpoint_rows(snapshot).selectExpr("to_json(struct(*))").collect()]
    with open(f"{log}/{2:020d}.checkpoint.80a083e8-7026-4e79-81be-64bd76c43a11.json", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)
    for v in range(3):
        os.remove(f"{log}/{v:020d}.json")
    assert rows(scan(spark, root)) == [(1,), (2,)]
    os.remove(f"{log}/{2:020d}.checkpoint.80a083e8-7026-4e79-81be-64bd76c43a11.json")
    parts = checkpoint_rows(snapshot).repartition(2)
    parts.write.parquet(f"{local(root)}/parts")
    names = sorted(n for n in os.listdir(f"{local(root)}/parts") if n.startswith("part-"))
    os.rename(f"{local(root)}/parts/{names[0]}", f"{log}/{2:020d}.checkpoint.{1:010d}.{2:010d}.parquet")
    with pytest.raises(LogError):  # half a checkpoint is none
        Snapshot.load(spark, root)
    os.rename(f"{local(root)}/parts/{names[1]}", f"{log}/{2:020d}.checkpoint.{2:010d}.{2:010d}.parquet")
    assert rows(scan(spark, root)) == [(1,), (2,)]


def test_remove_and_readd_with_other_vector(spark, root):
    df = spark.createDataFrame([(x,) for x in range(10)], I).coalesce(1)
    add = X.data_file(df, root, "a.parquet")
    X.publish(spark, root, 0, [X.protocol("deletionVectors"), X.metadata(I), add])
    again = {"add": add["add"] | {"deletionVector": X.inline_vector(np.array([0, 9]))}}
    X.publish(spark, root, 1, [{"remove": {"path": "a.parquet", "dataChange": True}}, again])
    assert scan(spark, root, version=0).count() == 10
    assert rows(scan(spark, root)) == [(x,) for x in range(1, 9)]
    assert rows(scan(spark, root, where="i > 6", virtual=["file_row_number"])) == [(7, 7), (8, 8)]
    X.publish(spark, root, 2, [{"remove": {"path": "a.parquet", "deletionVector": again["add"]["deletionVector"]}}])
    assert scan(spark, root).count() == 0


def test_vector_round_trip():
    for values in ([], [0], [1, 5, 70_000, 1 << 33], range(0, 20_000, 2), range(100_000)):
        v = np.array(sorted(values), dtype=np.int64)
        assert dv.decode(dv.encode(v)).tolist() == v.tolist()
    assert dv.z85_decode(dv.z85_encode(bytes(range(16)))) == bytes(range(16))
    with pytest.raises(LogError, match="DeletionVectorError"):
        dv.from_file(dv.framed(b"abcd")[:-1] + b"x", 0)


def test_pretty_printed_commit_and_ignored_side_files(spark, root):
    add = X.data_file(spark.createDataFrame([(1,)], I), root, "a.parquet")
    log = f"{local(root)}/_delta_log"
    os.makedirs(log)
    with open(f"{log}/{0:020d}.json", "w") as f:
        f.write("\n\n".join(json.dumps(a, indent=2) for a in [X.protocol(), X.metadata(I), add]))
    open(f"{log}/{0:020d}.crc", "w").write("x")
    assert rows(scan(spark, root)) == [(1,)]


@pytest.mark.parametrize(
    ("actions", "name"),
    [
        ([X.metadata(I)], "MissingProtocolError"),
        ([X.protocol()], "MissingMetadataError"),
        ([], "MissingMetadataAndProtocolError"),
        ([{"protocol": {"minReaderVersion": 9}}, X.metadata(I)], "UnsupportedError"),
        ([{"protocol": {"minReaderVersion": 3, "readerFeatures": ["new"]}}, X.metadata(I)], "UnsupportedError"),
        ([X.protocol(), X.metadata(I, (), {"delta.columnMapping.mode": "odd"})], "InvalidColumnMappingModeError"),
    ],
)
def test_logs_that_must_fail(spark, root, actions, name):
    X.publish(spark, root, 0, actions)
    with pytest.raises(LogError, match=name):
        Snapshot.load(spark, root)


def test_missing_table_gap_and_bad_json(spark, root):
    with pytest.raises(LogError, match=r"InvalidTableLocationError \(28\)"):
        scan(spark, root)
    X.publish(spark, root, 0, [X.protocol(), X.metadata(I)])
    X.publish(spark, root, 2, [])
    with pytest.raises(LogError, match="MissingVersionError"):
        Snapshot.load(spark, root)
    open(f"{local(root)}/_delta_log/{1:020d}.json", "w").write("{oops")
    with pytest.raises(LogError, match="MalformedJsonError"):
        Snapshot.load(spark, root)


def test_log_tail(spark, root):
    X.publish(spark, root, 0, [X.protocol(), X.metadata(I)])
    add = X.data_file(spark.createDataFrame([(5,)], I), root, "a.parquet")
    staged = f"{local(root)}/_delta_log/_staged_commits"
    os.makedirs(staged)
    name = f"{1:020d}.0af9.json"
    open(f"{staged}/{name}", "w").write(json.dumps(add))
    tail = [{"file_name": name, "timestamp": 1, "file_size": 10}]
    assert rows(scan(spark, root, log_tail=tail)) == [(5,)]
    with pytest.raises(InvalidInput):
        scan(spark, root, log_tail=[{"file_name": name}])


def test_checkpoint_in_parts(spark, root, monkeypatch):
    from tablelog.operators import checkpoint

    s = appended(spark, root, [1], [2], [3], [4], [5])
    monkeypatch.setattr(checkpoint, "PART_FILES", 2)
    assert checkpoint.write_checkpoint(s.snapshot("t")) and not checkpoint.write_checkpoint(s.snapshot("t"))
    log = f"{local(root)}/_delta_log"
    assert sorted(n for n in os.listdir(log) if n.endswith(".parquet")) == [f"{5:020d}.checkpoint.{k:010d}.{3:010d}.parquet" for k in (1, 2, 3)]
    for v in range(6):
        os.remove(f"{log}/{v:020d}.json")
    assert rows(scan(spark, root)) == [(k,) for k in range(1, 6)] and Snapshot.load(spark, root).file_count == 5


def test_files_without_vectors_are_not_compared(spark, root):
    """Some files have vectors, two of them in one vector file; row numbers and file names stay."""
    frames = [spark.createDataFrame([(10 * k + x,) for x in range(10)], I).coalesce(1) for k in range(4)]
    X.publish(spark, root, 0, [
        X.protocol("deletionVectors"), X.metadata(I), X.data_file(frames[0], root, "a.parquet"), X.data_file(frames[1], root, "b.parquet", None, None, X.inline_vector(np.array([0, 9]))),
        X.data_file(frames[2], root, "c.parquet"), X.data_file(frames[3], root, "d.parquet", None, None, X.stored_vector(spark, root, np.arange(5), bytes(range(16)))),
    ])
    kept = [*range(10), *range(11, 19), *range(20, 30), *range(35, 40)]
    assert rows(scan(spark, root)) == [(k,) for k in kept]
    got = scan(spark, root, virtual=["file_row_number"]).collect()
    assert sorted(map(tuple, got)) == [(k, k % 10) for k in kept]
    plan = scan(spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    assert sorted(r[0] for r in scan(spark, root, virtual=["file_number"]).collect()) == kept


def test_table_made_anew_at_a_path(spark, root):
    """A snapshot that is known isn't the base of another table at its place."""
    import shutil

    appended(spark, root, [1], [2]).sql("SELECT * FROM t").collect()
    shutil.rmtree(local(root))
    again = appended(spark, root, [7], [8], [9])
    assert sorted(r[0] for r in again.sql("SELECT * FROM t").collect()) == [7, 8, 9]
