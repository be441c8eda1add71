"""The five-type value domain: widening, equality across stores, and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

LONG, DOUBLE, TEXT, BYTES = T.LongType(), T.DoubleType(), T.StringType(), T.BinaryType()

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TWO_63 = 9223372036854775808.0


def normal_type(dtype: T.DataType) -> T.DataType:
    """The domain type a column widens to; other types are refused while planning."""
    if isinstance(dtype, _WHOLE) or isinstance(dtype, T.BooleanType):
        return LONG
    if isinstance(dtype, T.DecimalType):
        return LONG if dtype.scale == 0 else DOUBLE
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return DOUBLE
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(dtype, T.BinaryType):
        return BYTES
    raise TypeError(f"log tables hold no values of type {dtype.simpleString()}")


def normal(col: Column, dtype: T.DataType) -> Column:
    target = normal_type(dtype)
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("bigint")
    return col if dtype == target else col.cast(target)


def normalize(df: DataFrame) -> DataFrame:
    """Every column in its widened type. A whole decimal beyond 64 bits fails the job (ANSI cast)."""
    return df.select(*[normal(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def whole_equals(whole: Column, fraction: Column) -> Column:
    """Exact equality of a long and a double; widening the long would round it."""
    in_range = (fraction >= F.lit(-_TWO_63)) & (fraction < F.lit(_TWO_63))
    return F.coalesce(in_range & (F.floor(fraction).cast("double") == fraction)
                      & (fraction.try_cast("bigint") == whole), F.lit(False))


def same(a: Column, b: Column, a_type: T.DataType, b_type: T.DataType) -> Column:
    """Whether two values hold the same data, whichever store typed them. Never null."""
    left, right = normal_type(a_type), normal_type(b_type)
    a, b = normal(a, a_type), normal(b, b_type)
    both_null = a.isNull() & b.isNull()
    if left == right:
        return a.eqNullSafe(b)
    kinds = {type(left), type(right)}
    if kinds == {T.StringType, T.BinaryType}:
        return a.cast("binary").eqNullSafe(b.cast("binary"))
    if kinds == {T.LongType, T.DoubleType}:
        whole, fraction = (a, b) if left == LONG else (b, a)
        return both_null | whole_equals(whole, fraction)
    return both_null


def comparable(col: Column, dtype: T.DataType) -> Column:
    """Text that is equal for two values exactly when `same` holds: a tag and one spelling per value."""
    kind, value = normal_type(dtype), normal(col, dtype)
    if kind == LONG:
        text = F.concat(F.lit("n"), value.cast("string"))
    elif kind == DOUBLE:
        whole = (value >= F.lit(-_TWO_63)) & (value < F.lit(_TWO_63)) & (F.floor(value).cast("double") == value)
        # Whole doubles spell like longs, which also folds -0.0 into 0
        text = F.concat(F.lit("n"), F.when(whole, value.try_cast("bigint").cast("string"))
                        .otherwise(value.cast("string")))
    else:
        text = F.concat(F.lit("b"), F.hex(value.cast("binary")))
    return F.coalesce(text, F.lit("-"))


def describe(col: Column, dtype: T.DataType) -> Column:
    """A short form for reports."""
    kind, value = normal_type(dtype), normal(col, dtype)
    if kind == BYTES:
        text = F.concat(F.length(value).cast("string"), F.lit(" bytes"))
    elif kind == TEXT:
        cut = F.when(F.length(value) > 40, F.concat(F.substring(value, 1, 40), F.lit("…"))).otherwise(value)
        text = F.concat(F.lit("'"), cut, F.lit("'"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def render(col: Column, dtype: T.DataType) -> Column:
    """A value's engine-neutral text in a digest: NULL, x and hex, a number, or quoted text."""
    kind, value = normal_type(dtype), normal(col, dtype)
    if kind == BYTES:
        text = F.concat(F.lit("x"), F.lower(F.hex(value)))
    elif kind == TEXT:
        text = F.concat(F.lit("'"), value, F.lit("'"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def render_row(df: DataFrame, id: str, columns: list[str] | None = None) -> Column:
    """The line a row contributes to a digest: its id, then `name=value` by column name."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(name for name in (columns or df.columns) if name != id)
    parts = [F.col(id).cast("string")]
    for name in names:
        parts += [F.lit(f"|{name}="), render(F.col(f"`{name}`"), types[name])]
    return F.concat(*parts, F.lit("\n"))


def value_size(col: Column, dtype: T.DataType) -> Column:
    """About how many bytes a value takes in memory: bytes + 16, 2 x characters + 40, else 16."""
    kind = normal_type(dtype)
    if kind == BYTES:
        size = F.length(col) + 16
    elif kind == TEXT:
        # UTF-16 units: characters outside the basic plane count twice
        size = F.octet_length(F.encode(col, "UTF-16BE")) + 40
    else:
        size = F.lit(16)
    return F.coalesce(size, F.lit(16)).cast("bigint")


def row_size(df: DataFrame) -> Column:
    total = F.lit(16).cast("bigint")
    for f in df.schema.fields:
        total = total + value_size(F.col(f"`{f.name}`"), f.dataType)
    return total
