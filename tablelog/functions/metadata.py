"""Table functions over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelog import schema as S
from tablelog.sources.fs import plain
from tablelog.sources.snapshot import Snapshot


def list_files(snapshot: Snapshot, delete_count: bool = False, transform_expression: bool = False) -> DataFrame:
    """One row for each live file: data_file, cardinality, partitions, have_deletes, and what is asked for.

    Cardinality is null where the log has no statistics.  The transform tells
    which constants a reader inserts, by column position.
    """
    root = snapshot.root
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    absolute = F.when(path.rlike("^(/|file:|[A-Za-z0-9+.-]+://)"), path).otherwise(F.concat(F.lit(plain(root) + "/"), path))
    parts = snapshot.partition_columns
    fields = {f.name: f for f in snapshot.schema.fields}
    pairs = [F.struct(F.lit(c), F.element_at("partition_values", F.lit(S.physical_name(fields[c], snapshot.mapping_mode)))) for c in parts]
    columns = [
        absolute.alias("data_file"),
        F.from_json("stats", "numRecords bigint")["numRecords"].alias("cardinality"),
        (F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,string>")).alias("partitions"),
        F.col("dv").isNotNull().alias("have_deletes"),
    ]
    if delete_count:
        columns.append(F.coalesce("dv.cardinality", F.lit(0)).cast("long").alias("delete_count"))
    if transform_expression:
        names = [f.name for f in snapshot.schema.fields]
        own = [F.concat(F.lit(f"insert {c} at {names.index(c)}: "), F.coalesce(F.nullif(F.element_at("partition_values", F.lit(S.physical_name(fields[c], snapshot.mapping_mode))), F.lit("")), F.lit("NULL"))) for c in parts]
        columns.append((F.array(*own) if own else F.array().cast("array<string>")).alias("transform_expression"))
    return snapshot.files.select(*columns)


def domain_metadata(snapshot: Snapshot) -> DataFrame:
    """(domain, configuration) of the user domains at the snapshot."""
    return snapshot.spark.createDataFrame(list(snapshot.domains.items()), "domain string, configuration string")


def app_version(snapshot: Snapshot, app_id: str) -> DataFrame:
    return snapshot.spark.createDataFrame([(snapshot.app_version(app_id),)], "version bigint")


def estimate(snapshot: Snapshot, predicate=None) -> int | None:
    """Rows by the statistics of the files that skipping keeps; deleted rows count.  None if some file has none."""
    from tablelog.plans.skipping import Bounds, keep

    files, bounds = snapshot.files, Bounds(snapshot.schema, snapshot.partition_columns, snapshot.mapping_mode)
    if predicate is not None and (test := keep(predicate, bounds)) is not None:
        files = bounds.files(files, test)
    n = F.from_json("stats", "numRecords bigint")["numRecords"]
    files_n, known, total = files.agg(F.count("*"), F.count(n), F.sum(n)).first()
    return 0 if not files_n else int(total) if known == files_n else None


def describe(snapshot: Snapshot) -> DataFrame:
    """(column, type, nullable, partition) in order."""
    parts = set(snapshot.partition_columns)
    rows = [(f.name, f.dataType.simpleString(), f.nullable, f.name in parts) for f in snapshot.schema.fields]
    return snapshot.spark.createDataFrame(rows, "column_name string, column_type string, nullable boolean, is_partition boolean")
