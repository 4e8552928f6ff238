"""Joins that Spark has no single operator for, out of those it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """Each left row with the ``values`` of the last right row of equal ``by`` at or before it.

    One shuffle and one sort of both sides by (by, on): a union and a running
    last value, whatever the number of right rows for a key.  Ties in ``on``
    take the largest values.
    """
    keys = [*by, on]
    columns = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.struct(*columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__r"), F.lit(1).alias("__side"))
    r = right.select(*keys, F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(*values).alias("__r"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(on, "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = l.unionByName(r).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    return out.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in columns], *[F.col(f"__last.{v}").alias(v) for v in values])


#: Rows of a side that meet at once, pairs for a task, and tasks at most.
BLOCK_ROWS, TASK_PAIRS, MOST_TASKS = 2048, 1 << 25, 20_000


def range_join(left: DataFrame, right: DataFrame, point: Column, low: Column, high: Column, width: float, block_rows: int = BLOCK_ROWS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Left rows with right rows for which low <= point < high, by equal buckets of ``width``.

    An interval has a row for each bucket that it touches, so ``width`` should be
    near the usual length of one; the join itself is an equi-join.

    Pairs may grow with the square of a bucket's rows.  The rows of each bucket are counted first:
    both sides of a large one are cut into blocks of some ``block_rows``, each block of one side
    meets each of the other in a group of its own, and groups go to as many tasks as there are
    ``task_pairs`` pairs to look at.  A task's time and memory stay the same however large a bucket is.
    """
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    l = left.withColumn("__b", bucket(point))
    r = right.filter(low < high).withColumn("__rb", F.explode(F.sequence(bucket(low), bucket(high))))
    sizes = l.groupBy("__b").agg(F.count("*").alias("__l")).join(r.groupBy("__rb").agg(F.count("*").alias("__r")), F.col("__b") == F.col("__rb"))
    pairs = sizes.agg(F.sum(F.col("__l").cast("double") * F.col("__r"))).first()[0] or 0
    tasks = int(min(pairs // task_pairs + 1, MOST_TASKS))
    blocks = lambda c: F.ceil(F.col(c) / block_rows)
    # a row for each bucket that is cut: there are fewer than rows by the size of a block
    cut = F.broadcast(sizes.filter((F.col("__l") > block_rows) | (F.col("__r") > block_rows)).select(F.col("__b").alias("__cut"), blocks("__l").alias("__ls"), blocks("__r").alias("__rs")))

    def dealt(side: DataFrame, columns: list[str], key: str, own: str, others: str, names: tuple[str, str]) -> DataFrame:
        """A row's block by a hash of it, and a copy for each block of the other side."""
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(others, F.lit(1)) - 1))
        side = side.join(cut, F.col(key) == F.col("__cut"), "left")
        side = side.withColumn(names[0], F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.coalesce(own, F.lit(1)))).withColumn(names[1], copies)
        return side.drop("__cut", "__ls", "__rs").repartition(tasks, key, *sorted(names))

    l = dealt(l, _hashable(left), "__b", "__ls", "__rs", ("__1", "__2"))
    r = dealt(r, _hashable(right), "__rb", "__rs", "__ls", ("__r2", "__r1"))
    same = (F.col("__b") == F.col("__rb")) & (F.col("__1") == F.col("__r1")) & (F.col("__2") == F.col("__r2"))
    # merged: copies aren't in Spark's estimates, by which a side may look small enough to be broadcast
    return l.join(r.hint("merge"), same & (low <= point) & (point < high)).drop("__b", "__rb", "__1", "__2", "__r1", "__r2")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
