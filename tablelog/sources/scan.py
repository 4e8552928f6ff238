"""Scans: a snapshot as a DataFrame.

Live files are pruned by statistics, and what is left is one ordinary parquet
scan, so column pruning, row-group pushdown, codegen and dynamic partition
pruning are Spark's.  Where the folders spell out the partition values they are
Spark's partition columns; else a join by file gives them.  Deleted rows go by
an anti-join on (file, row), for the files that have any.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelog import schema as S
from tablelog.errors import InvalidInput, LogError
from tablelog.plans import catalyst
from tablelog.plans.skipping import MODES, And, Bounds, keep
from tablelog.sources import dv as DV
from tablelog.sources.fs import Fs, glob_escaped, join
from tablelog.sources.snapshot import Snapshot

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Virtual columns on demand.
VIRTUAL = ("filename", "file_row_number", "rowid", "file_number", "delta_file_number", "file_index")
# Names of parquet readers' options.  The log says what they would say.
PARQUET_OPTIONS = {
    "can_have_nan", "compression", "debug_use_openssl", "encryption_config", "explicit_cardinality", "hive_partitioning", "hive_types",
    "hive_types_autocast", "parquet_version", "union_by_name",
}
#: Virtual columns made of a file's number; file_index is that number by another name.
_NUMBERED = {"file_number", "delta_file_number", "file_index", "rowid"}
#: Files of one reader; more are united, so that no single listing grows too long.
READER_FILES = 10_000
#: Files whose numbers and partition values are sent to each executor; those of more are joined by a shuffle.
BROADCAST_FILES = 10_000


@dataclass
class Pruned:
    """Outcome of file skipping."""

    files: list  # rows of Snapshot.files that are read
    before: int | None
    after: int
    filters: list[str] = field(default_factory=list)


def mode_of(value: str) -> str:
    if str(value).lower() not in MODES:
        raise InvalidInput(f"unknown value for pushdown_filters: '{value}', use one of {', '.join(MODES)}")
    return str(value).lower()


def prune(snapshot: Snapshot, predicate=None, count: bool = True) -> Pruned:
    """Files that may hold matching rows, in a fixed order; only those come to the driver."""
    files = snapshot.files
    bounds = Bounds(snapshot.schema, snapshot.partition_columns, snapshot.mapping_mode)
    test = keep(predicate, bounds) if predicate is not None else None
    if test is not None:
        found = bounds.files(files, test).collect()
    else:
        found = snapshot.local_files if snapshot.local_files is not None else files.collect()
    rows = sorted(found, key=lambda r: (r["path"], r["dv_id"] or ""))
    before = len(rows) if test is None else snapshot.file_count if count else None
    return Pruned(rows, before, len(rows), catalyst.described(predicate) if predicate is not None else [])


def _hive(snapshot: Snapshot, rows: Sequence) -> bool:
    """Whether every file lies in folders that spell its partition values."""
    if snapshot.mapping_mode != "none":
        return False
    for r in rows:
        if "://" in r["path"] or r["path"].startswith("/"):
            return False
        folders = [unquote(x) for x in r["path"].split("/")[:-1]]
        # the log's paths are encoded once more than the folders' own names
        expected = [(c, r["partition_values"].get(c)) for c in snapshot.partition_columns]
        if len(folders) != len(expected):
            return False
        for folder, (name, value) in zip(folders, expected):
            key, _, text = folder.partition("=")
            if key != name or unquote(text) != (value if value not in (None, "") else NULL_PARTITION):
                return False
    return True


def _file_key(c: Column) -> Column:
    """File URIs differ in slashes behind the scheme."""
    return F.regexp_replace(c, "^file:/+", "file:/")


def _uri(fs: Fs, path: str) -> str:
    p = fs.path(path)
    uri = p.getFileSystem(fs.conf).makeQualified(p).toUri().toString()
    return "file:/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def scan_snapshot(
    snapshot: Snapshot,
    predicate=None,
    pruned: Pruned | None = None,
    virtual: Sequence[str] = (),
    pushdown_partition_info: bool = True,
    constant_file_number: bool = False,
) -> DataFrame:
    """Rows of a snapshot, in the logical schema, then the virtual columns asked for.

    The predicate only skips files: filter the result by it as well.  The
    column delta_file_number is the file's number like file_number, or 7
    everywhere with ``constant_file_number``, as some readers have it.
    """
    spark, fs = snapshot.spark, Fs(snapshot.spark)
    unknown = set(virtual) - set(VIRTUAL)
    if unknown:
        raise InvalidInput(f"unknown virtual columns: {sorted(unknown)}")
    pruned = pruned or prune(snapshot, predicate)
    mode, parts = snapshot.mapping_mode, set(snapshot.partition_columns)
    rows = pruned.files
    physical = S.physical(snapshot.schema, mode)
    hive = bool(parts) and pushdown_partition_info and _hive(snapshot, rows)
    data_only = T.StructType([p for p, f in zip(physical.fields, snapshot.schema.fields) if f.name not in parts or hive])
    with_dv = [r for r in rows if r["dv"] is not None]
    if with_dv and len(with_dv) < len(rows) and not _NUMBERED & set(virtual):
        # only rows of files with a vector are compared with deleted ones
        groups = [r for r in rows if r["dv"] is None], with_dv
        parts_of = [Pruned(g, None, len(g)) for g in groups]
        plain, marked = (scan_snapshot(snapshot, None, g, virtual, pushdown_partition_info, constant_file_number) for g in parts_of)
        return plain.unionByName(marked)
    for_join = bool(parts) and not hive or bool(_NUMBERED & set(virtual))
    names = [f.name for f in snapshot.schema.fields]
    if not rows:
        empty = spark.createDataFrame([], T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in snapshot.schema.fields]))
        return empty.select("*", *[F.lit(None).cast("string" if v == "filename" else "bigint").alias(v) for v in virtual])

    df = _read(spark, snapshot, data_only, [join(snapshot.root, r["path"]) for r in rows], hive)
    need_meta = for_join or with_dv or virtual
    if need_meta:
        df = df.select("*", _file_key(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__row"))
    if with_dv:
        df = df.join(_deleted(snapshot, with_dv), (F.col("__file") == F.col("file_key")) & (F.col("__row") == F.col("row_index")), "left_anti")
    if for_join:
        constants = _constants(snapshot, fs, rows, [] if hive else sorted(parts))
        # Spark doesn't know how few they are, and would shuffle and sort all rows by their file
        constants = F.broadcast(constants) if len(rows) <= BROADCAST_FILES else constants
        df = df.join(constants, F.col("__file") == F.col("__key"))
    if mode == "none" and not virtual and df.columns == names:
        return df
    columns = names if mode == "none" and not any("`" in n or "." in n for n in names) else S.logical_columns(snapshot.schema, mode)
    return df.select(*columns, *[_virtual(v, constant_file_number).alias(v) for v in virtual])


def _nullable(t: T.DataType) -> T.DataType:
    return S._map_type(t, "none")


def _read(spark: SparkSession, snapshot: Snapshot, schema: T.StructType, paths: list[str], hive: bool) -> DataFrame:
    for p in paths:
        if ":" in p.rsplit("/", 1)[-1]:
            raise LogError("ObjectStorePathError", f"file names with a colon can't be read: {p}")
    out = None
    for k in range(0, len(paths), READER_FILES):
        reader = spark.read.schema(schema)
        if hive:
            reader = reader.option("basePath", glob_escaped(snapshot.root))
        # files are named one by one; partition folders above them aren't discovered without a base path
        part = reader.parquet(*[glob_escaped(p) for p in paths[k : k + READER_FILES]])
        out = part if out is None else out.unionByName(part)
    return out


def _constants(snapshot: Snapshot, fs: Fs, rows: Sequence, parts: list[str]) -> DataFrame:
    """(file, file number, typed partition values) of the files that are read."""
    fields = {f.name: f for f in snapshot.schema.fields}
    names = [S.physical_name(fields[c], snapshot.mapping_mode) for c in parts]
    own = [(_uri(fs, join(snapshot.root, r["path"])), k, *[r["partition_values"].get(n) or None for n in names]) for k, r in enumerate(rows)]
    df = snapshot.spark.createDataFrame(own, ", ".join(["__key string, __number bigint", *[f"`__p{k}` string" for k in range(len(names))]]))
    return df.select("__key", "__number", *[F.col(f"__p{k}").cast(fields[c].dataType).alias(n) for k, (c, n) in enumerate(zip(parts, names))])


def _virtual(name: str, constant_file_number: bool) -> Column:
    if name == "filename":
        return F.regexp_replace(F.url_decode(F.replace(F.col("__file"), F.lit("+"), F.lit("%2B"))), "^file:", "")
    if name == "file_row_number":
        return F.col("__row")
    if name == "rowid":
        return F.shiftleft(F.col("__number"), 40) + F.col("__row")
    return F.lit(7).cast("long") if constant_file_number and name == "delta_file_number" else F.col("__number")


def _deleted(snapshot: Snapshot, rows: Sequence) -> DataFrame:
    """(file_key, row_index) of deleted rows; vectors are decoded on the executors."""
    spark, fs = snapshot.spark, Fs(snapshot.spark)
    inline, stored = [], []
    for r in rows:
        key, dv = _uri(fs, join(snapshot.root, r["path"])), r["dv"]
        if dv["storageType"] == "i":
            inline.append((key, dv["pathOrInlineDv"], None, None))
        else:
            stored.append((key, _uri(fs, DV.file_of(snapshot.root, dv["storageType"], dv["pathOrInlineDv"])), dv["offset"] or 0, dv["sizeInBytes"]))
    schema = "file_key string, inline string, content binary, offset int"
    vectors = spark.createDataFrame(inline, schema)
    if stored:
        wanted = spark.createDataFrame(stored, "file_key string, __dv string, offset int, size int")
        files = sorted({s[1] for s in stored})
        content = spark.read.format("binaryFile").load([glob_escaped(f) for f in files]).select(_file_key(F.col("path")).alias("__dv"), "content")
        # a file holds many vectors: each takes its own bytes of it, between its size and its checksum
        own = F.substring("content", F.col("offset") + 1, F.col("size") + 8)
        taken = wanted.join(content, "__dv").select("file_key", F.lit(None).cast("string").alias("inline"), own.alias("content"), F.lit(0).alias("offset"))
        vectors = vectors.unionByName(taken)
    return vectors.mapInArrow(DV.positions, "file_key string, row_index bigint")


def scan(
    spark: SparkSession,
    path: str,
    version: int | None = None,
    where: str | None = None,
    pushdown_filters: str = "all",
    log_tail: Sequence[dict] = (),
    **options,
) -> DataFrame:
    """Rows of the table at ``path``: ``where`` skips files and filters rows.

    Options are those of :func:`scan_snapshot`; ``filename`` and
    ``file_row_number`` set to true add these virtual columns, ``binary_as_string`` gives binary
    columns as strings, and other options of parquet readers are taken without effect.
    """
    as_string = bool(options.pop("binary_as_string", False))
    unknown = set(options) - {"virtual", "filename", "file_row_number", "pushdown_partition_info", "constant_file_number"} - PARQUET_OPTIONS
    if unknown:
        raise InvalidInput(f"unknown options: {sorted(unknown)}")
    options = {k: v for k, v in options.items() if k not in PARQUET_OPTIONS}
    virtual = [*options.pop("virtual", ()), *[v for v in ("filename", "file_row_number") if options.pop(v, False)]]
    mode = mode_of(pushdown_filters)
    snapshot = Snapshot.load(spark, path, version, log_tail=log_tail)
    predicate = catalyst.parse(spark, where) if where and mode in ("all", "constant_only") else And(())
    df = scan_snapshot(snapshot, predicate, virtual=list(dict.fromkeys(virtual)), **options)
    df = df.filter(where) if where else df
    if as_string:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if isinstance(t, T.BinaryType) else F.col(f"`{c}`") for c, t in kinds.items()])
    return df
