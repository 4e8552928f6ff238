"""Shared folders, table access and small column helpers for the operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelog.workspace import check_local

#: Word separators of the contracts: space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Setting by which the shuffles of a query are deleted when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is set in local mode (tests, a laptop) a temporary folder is made
    once for the session; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("tablelog.shared.dir", None)
    if not named:
        check_local(spark)
        named = "file://" + tempfile.mkdtemp(prefix="tablelog-")
        spark.conf.set("tablelog.shared.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor.  The shuffles that
    made them are no longer needed; Spark frees their disk at the end of the write,
    and that of others when the driver's garbage is collected, which is asked for here.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`stored` made, once nothing reads them."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, id_col: str, text_col: str, row: str = "doc") -> tuple[DataFrame, bool]:
    """(``df`` with a long column ``row`` that tells its rows apart in the order of their ids, whether it is the id).

    Integer ids that are distinct and never null serve as they are.  Else the rows
    are numbered by id (nulls first) and text hash and stored, since numbers must not
    change between two readings.
    """
    if isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        ids = df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
        if ids.filter("n > 1 or id is null").isEmpty():
            return df.withColumn(row, F.col(id_col).cast("long")), True
    order = [F.col(id_col), F.xxhash64(text_col)]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.withColumn(row, F.monotonically_increasing_id()), "numbered"), False


def with_ids(rows: DataFrame, source: DataFrame, same: bool, id_col: str, row: str = "doc") -> DataFrame:
    """``rows`` with the ids of ``source``, whose rows :func:`numbered` told apart, in place of ``row``."""
    if same:
        return rows.withColumn(row, F.col(row).cast(source.schema[id_col].dataType)).withColumnRenamed(row, id_col)
    return rows.join(source.select(row, id_col), row).drop(row)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of an Arrow batch, so that long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``: a let-binding for expressions.

    Inside lambdas Catalyst would otherwise repeat ``value`` for each element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


#: Bits of the bitmap of :func:`maybe_in`, whatever the number of keys.
BITMAP_BITS = 1 << 21


def key_bit(key: str) -> Column:
    """Place of a key in the bitmap of :func:`key_bitmap`."""
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)).cast("int")


def key_bitmap(wanted: DataFrame, key: str):
    """Broadcast bitmap of fixed size with the bits of all keys of ``wanted``; see :func:`has_bit`."""
    rows = wanted.select(key_bit(key).alias("h")).select(F.shiftright("h", 3).alias("byte"), (F.col("h") % 8).alias("bit"))
    rows = rows.groupBy("byte").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("v")).toPandas()
    bits = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    bits[rows["byte"].to_numpy(np.int64)] = rows["v"].to_numpy(np.uint8)
    return wanted.sparkSession.sparkContext.broadcast(bits)


def has_bit(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7)) & 1 == 1


def maybe_in(wanted: DataFrame, key: str) -> Column:
    """Filter on a column of the same name: true for all keys of ``wanted``, and for few others.

    So a join that follows moves few rows; with more keys than bits it merely
    spares fewer.
    """
    bitmap = key_bitmap(wanted, key)

    @F.pandas_udf("boolean")
    def listed(h: pd.Series) -> pd.Series:
        return pd.Series(has_bit(bitmap.value, h.to_numpy()))

    return listed(key_bit(key))


def without(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key isn't in ``removed`` (one column, of that name); null keys stay.

    Only rows whose key may be in it are moved.
    """
    maybe = F.coalesce(maybe_in(removed, key), F.lit(False))
    return df.filter(~maybe).unionByName(df.filter(maybe).join(removed.distinct(), key, "left_anti"))
