"""File skipping: predicates of a query to a filter over the files of a snapshot.

``keep`` is null or true wherever a file may hold a matching row; only a proven
false skips it.  Partition columns are compared as their typed values; others by
the bounds and null counts that the log has.  Anything else keeps the file.
"""

from __future__ import annotations

import datetime
import decimal
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelog import schema as S

#: Values of the option pushdown_filters.
MODES = ("all", "none", "constant_only", "dynamic_only")
#: String bounds at least this long may be cut short.
CUT_LENGTH = 32


@dataclass(frozen=True)
class Compare:
    """column path, operator (< <= > >= = != in null not_null), value(s)."""

    path: tuple[str, ...]
    op: str
    value: object = None

    def __str__(self) -> str:
        name = ".".join(self.path)
        if self.op == "null":
            return f"{name} IS NULL"
        if self.op == "not_null":
            return f"{name} IS NOT NULL"
        return f"{name} IN ({', '.join(map(str, self.value))})" if self.op == "in" else f"{name}{self.op}{self.value}"


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


class Bounds:
    """Expressions over the files of a snapshot that give statistics and partition values, as SQL text.

    Text is one call into the JVM however long it is.  ``files`` parses the
    statistics that were asked for, all in one pass over each file's JSON.
    """

    def __init__(self, schema: T.StructType, partition_columns: list[str], mode: str):
        self.mode, self.schema = mode, schema
        self.partitions = {c.lower() for c in partition_columns}
        self.asked: dict = {}

    def resolve(self, path: tuple[str, ...]) -> tuple[list[T.StructField], bool] | None:
        """Fields along a path, and whether it is a partition column; names match in any case."""
        t, found = self.schema, []
        for name in path:
            if not isinstance(t, T.StructType):
                return None
            f = next((f for f in t.fields if f.name.lower() == name.lower()), None)
            if f is None:
                return None
            found.append(f)
            t = f.dataType
        return found, len(path) == 1 and path[0].lower() in self.partitions

    def partition(self, f: T.StructField) -> str:
        return f"cast(nullif(element_at(partition_values, {_text(S.physical_name(f, self.mode))}), '') AS {f.dataType.simpleString()})"

    def stat(self, kind: str, fields: list[T.StructField], t: T.DataType) -> str:
        """A value from the statistics' JSON, typed; null where there is none."""
        path = [kind, *(S.physical_name(f, self.mode) for f in fields)]
        at = self.asked
        for name in path[:-1]:
            at = at.setdefault(name, {})
        at[path[-1]] = t
        return ".".join(_name(n) for n in ("__stats", *path))

    def flag(self, name: str, t: T.DataType) -> str:
        return self.stat(name, [], t)

    def files(self, files: DataFrame, test: str) -> DataFrame:
        """The files that a test doesn't rule out."""
        if self.asked:
            files = files.withColumn("__stats", F.from_json("stats", _struct(self.asked)))
        return files.filter(f"coalesce({test}, true)").drop("__stats")


def _struct(asked: dict) -> T.StructType:
    return T.StructType([T.StructField(n, _struct(x) if isinstance(x, dict) else x) for n, x in asked.items()])


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    """A string literal, whatever characters it has."""
    plain = value.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + "".join(c if c.isprintable() else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}" for c in plain) + "'"


_SKIPPED_TYPES = (T.TimestampType, T.TimestampNTZType, T.BinaryType, T.VariantType, T.StructType, T.ArrayType, T.MapType)
_SWAP = {"<": "minValues", "<=": "minValues", ">": "maxValues", ">=": "maxValues"}


def _literal(v: object) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v) if -(1 << 63) < v < 1 << 63 else f"{v}BD"
    if isinstance(v, decimal.Decimal):
        return f"{v:f}BD"
    if isinstance(v, float):
        return f"cast('{v!r}' AS DOUBLE)"
    if isinstance(v, datetime.date):
        return f"DATE '{v.isoformat()}'"
    return _text(str(v))


def _compared(a: str, op: str, b: str) -> str:
    return f"({a} {op} {b})"


def _literal_fits(v: object, t: T.DataType) -> bool:
    """Only comparisons within a kind are decided; casts are left to the query."""
    if isinstance(v, bool):
        return isinstance(t, T.BooleanType)
    if isinstance(v, (int, float, decimal.Decimal)):
        return isinstance(t, T.NumericType) and v == v  # not NaN
    if isinstance(v, datetime.datetime):
        return False
    if isinstance(v, datetime.date):
        return isinstance(t, T.DateType)
    return isinstance(v, str) and isinstance(t, T.StringType)


def _keep_compare(c: Compare, b: Bounds) -> str | None:
    found = b.resolve(c.path)
    if found is None:
        return None
    fields, partition = found
    t = fields[-1].dataType
    values = c.value if c.op == "in" else (c.value,)
    if partition:
        value = b.partition(fields[-1])
        if c.op in ("null", "not_null"):
            return f"({value} IS {'NOT ' * (c.op == 'not_null')}NULL)"
        if isinstance(t, _SKIPPED_TYPES) or not all(_literal_fits(v, t) for v in values):
            return None
        return f"coalesce({_any(_compared(value, '=' if c.op == 'in' else c.op, _literal(v)) for v in values)}, false)"
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return None
    nulls, rows = b.stat("nullCount", fields, T.LongType()), b.flag("numRecords", T.LongType())
    loose = f"NOT coalesce({b.flag('tightBounds', T.BooleanType())}, true)"
    if c.op == "null":
        return f"({loose} OR {nulls} > 0)"
    if c.op == "not_null":
        return f"({loose} OR {nulls} < {rows})"
    if isinstance(t, _SKIPPED_TYPES) or not all(_literal_fits(v, t) for v in values):
        return None
    low, high = b.stat("minValues", fields, t), b.stat("maxValues", fields, t)
    if c.op in _SWAP:
        test = _compared(low if _SWAP[c.op] == "minValues" else high, c.op, _literal(c.value))
    elif c.op == "!=":
        v = _literal(c.value)
        test = f"NOT ({low} = {v} AND {high} = {v})" + (f" OR length({low}) >= {CUT_LENGTH}" if isinstance(t, T.StringType) else "")
    else:
        test = _any(f"({low} <= {_literal(v)} AND {high} >= {_literal(v)})" for v in values)
    # no comparison holds where all is null
    return f"(coalesce({nulls} < {rows}, true) AND ({test}))"


def _any(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def keep(predicate, bounds: Bounds) -> str | None:
    """Expression that is false for files without a match, or None if nothing can be skipped."""
    if isinstance(predicate, Compare):
        return _keep_compare(predicate, bounds)
    parts = [keep(p, bounds) for p in predicate.parts]
    if isinstance(predicate, Or):
        if any(p is None for p in parts) or not parts:
            return None
        return _any(f"coalesce({p}, true)" for p in parts)
    own = [f"coalesce({p}, true)" for p in parts if p is not None]
    return f"({' AND '.join(own)})" if own else None


def stats_json(n: int, nulls: dict, lows: dict, highs: dict, has_stats: bool = True) -> str:
    """Statistics of a file as the log writes them."""
    out: dict = {"numRecords": n}
    if has_stats:
        out |= {"nullCount": nulls, "minValues": lows, "maxValues": highs}
    return json.dumps(out | {"tightBounds": True}, separators=(",", ":"), ensure_ascii=False)
