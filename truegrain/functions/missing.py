"""The one definition of a missing value that every completeness operator uses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters a blank string may consist of.
WHITESPACE = " \t\n\x0b\f\r"


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(op: Callable[[Column, Column], Column], cols: Sequence[Column]) -> Column:
    """Combine columns as a balanced tree, so that wide tables stay shallow expressions."""
    cols = list(cols)
    while len(cols) > 1:
        pairs = [op(cols[i], cols[i + 1]) for i in range(0, len(cols) - 1, 2)]
        cols = pairs + ([cols[-1]] if len(cols) % 2 else [])
    return cols[0]


def total_of(cols: Sequence[Column]) -> Column:
    return fold(lambda a, b: a + b, cols)


def any_of(cols: Sequence[Column]) -> Column:
    return fold(lambda a, b: a | b, cols)


def all_of(cols: Sequence[Column]) -> Column:
    return fold(lambda a, b: a & b, cols)


def is_missing(value: Column, dtype: T.DataType, sentinels: Iterable[str] = ()) -> Column:
    """Null, blank text, NaN, or one of the given sentinel texts. Never null itself."""
    test = value.isNull()
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        stripped = F.btrim(value, F.lit(WHITESPACE))
        test = test | (stripped == "")
        sentinels = list(sentinels)
        if sentinels:
            test = test | stripped.isin(sentinels)
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        test = test | F.isnan(value)
    return test


def missing_tests(
    df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()
) -> dict[str, Column]:
    """Missing test per column name, in table order."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(types) if cols is None else list(cols)
    unknown = [c for c in names if c not in types]
    if unknown:
        raise ValueError(f"no such columns: {unknown}; the table has {list(types)}")
    if not names:
        raise ValueError("at least one column is needed")
    return {c: is_missing(ref(c), types[c], sentinels) for c in names}


def missing_count(tests: Iterable[Column]) -> Column:
    return total_of([t.cast("int") for t in tests])
