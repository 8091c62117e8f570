"""Row identity: equal rows have equal keys, nulls included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegrain.functions.missing import ref

_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_NARROW = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _varies(dtype: T.DataType) -> bool:
    """Whether equal values of the type may look different: maps, and -0.0 at any depth."""
    if isinstance(dtype, T.ArrayType):
        return _varies(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_varies(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.FloatType, T.DoubleType))


def canonical(value: Column, dtype: T.DataType) -> Column:
    """Same value, one form: map entries sorted, -0.0 as 0.0, also inside arrays, structs and maps."""
    if not _varies(dtype):
        return value
    if isinstance(dtype, T.MapType):
        key, of = canonical, dtype
        entries = F.transform(
            F.map_entries(value), lambda e: F.struct(key(e["key"], of.keyType).alias("key"), key(e["value"], of.valueType).alias("value"))
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [canonical(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value + F.lit(0.0).cast(dtype)


def canonical_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[Column]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [canonical(ref(c), types[c]).alias(c) for c in (cols or df.columns)]


def row_json(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    return F.to_json(F.struct(*canonical_columns(df, cols)), _JSON)


def row_digest(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """SHA-256 of the whole row with its nulls spelled out, as 32 bytes."""
    return F.unhex(F.sha2(row_json(df, cols), 256))


def group_key(df: DataFrame, cols: Sequence[str] | None = None) -> list[Column]:
    """What to group rows by: the columns themselves when all are fixed-width, else their digest.

    With text or nested columns a shuffle then moves 32 bytes per row instead of the values.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(cols or df.columns)
    if len(names) <= 4 and all(isinstance(types[c], _NARROW) for c in names):
        return [canonical(ref(c), types[c]).alias(f"_k{i}") for i, c in enumerate(names)]
    return [row_digest(df, names).alias("_k0")]


def cell_hashes(df: DataFrame, cols: Sequence[str] | None = None) -> list[tuple[Column, Column]]:
    """Two 64-bit hashes of each cell, which tell its column and nulls apart.

    A row, or any choice of its columns, is named by the exclusive or of its cells' hashes: taking a
    column out is one more exclusive or, and no row is digested once per choice.
    """
    out = []
    for i, c in enumerate(canonical_columns(df, cols)):
        out.append(tuple(F.xxhash64(F.lit(2 * i + k), c.isNull(), c) for k in (0, 1)))
    return out
