"""Schemas of the log: physical names, and fields that may not be null."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelog.errors import LogError

# Keys of field metadata and table properties.
PHYSICAL_NAME = "delta.columnMapping.physicalName"
FIELD_ID = "delta.columnMapping.id"
MAPPING_MODE = "delta.columnMapping.mode"
PARQUET_ID = "parquet.field.id"


def parse(schema_string: str) -> T.StructType:
    try:
        return T.StructType.fromJson(json.loads(schema_string))
    except Exception as e:
        raise LogError("SchemaError", f"schema can't be read: {e}") from None


def physical_name(f: T.StructField, mode: str) -> str:
    return f.metadata.get(PHYSICAL_NAME, f.name) if mode != "none" else f.name


def _map_type(t: T.DataType, mode: str) -> T.DataType:
    if isinstance(t, T.StructType):
        return physical(t, mode)
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_map_type(t.elementType, mode), True)
    if isinstance(t, T.MapType):
        return T.MapType(_map_type(t.keyType, mode), _map_type(t.valueType, mode), True)
    return t


def physical(schema: T.StructType, mode: str) -> T.StructType:
    """The schema as data files have it: physical names, everything nullable."""
    return T.StructType([T.StructField(physical_name(f, mode), _map_type(f.dataType, mode), True) for f in schema.fields])


def _logical(c: Column, t: T.DataType, mode: str) -> Column:
    """Rename the fields of a nested value back."""
    if not _renamed(t, mode):
        return c
    if isinstance(t, T.StructType):
        own = F.struct(*[_logical(c.getField(physical_name(f, mode)), f.dataType, mode).alias(f.name) for f in t.fields])
        return F.when(c.isNotNull(), own)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _logical(x, t.elementType, mode))
    if isinstance(t, T.MapType):
        c = F.transform_keys(c, lambda k, v: _logical(k, t.keyType, mode)) if _renamed(t.keyType, mode) else c
        return F.transform_values(c, lambda k, v: _logical(v, t.valueType, mode))
    return c


def _renamed(t: T.DataType, mode: str) -> bool:
    if isinstance(t, T.StructType):
        return any(physical_name(f, mode) != f.name or _renamed(f.dataType, mode) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _renamed(t.elementType, mode)
    if isinstance(t, T.MapType):
        return _renamed(t.keyType, mode) or _renamed(t.valueType, mode)
    return False


def logical_columns(schema: T.StructType, mode: str) -> list[Column]:
    return [_logical(F.col(f"`{physical_name(f, mode)}`"), f.dataType, mode).alias(f.name) for f in schema.fields]


def not_null_paths(schema: T.StructType) -> Iterator[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(path, nullable parents' path) of each field that may not be null, through structs.

    Raises for such fields below arrays or maps, which inserts can't check.
    """

    def inside(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return any(not f.nullable or inside(f.dataType) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return inside(t.elementType)
        return isinstance(t, T.MapType) and inside(t.valueType)

    def walk(fields, path: tuple[str, ...], parent: tuple[str, ...]):
        for f in fields:
            own = (*path, f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType)) and (not f.nullable and isinstance(f.dataType, T.ArrayType) or inside(f.dataType)):
                raise LookupError(".".join(own))
            if not f.nullable:
                yield own, parent
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, own, own if f.nullable else parent)

    yield from walk(schema.fields, (), ())


def column(path: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    """Paths of the leaves that statistics cover: none below arrays, maps and variants."""
    for f in schema.fields:
        own = (*path, f.name)
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, own)
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType, T.VariantType)):
            yield own, f.dataType
