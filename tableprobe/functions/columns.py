"""Small expression helpers: quoting, type classes, missing values, guarded arithmetic.

Expressions that are built once per column of a table are SQL text: on wide tables that is far quicker to put
together than chains of column calls, and it compiles to the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def identifier(name: str) -> str:
    """The name as SQL text, dots and backticks in it included."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """The column called ``name``."""
    return F.col(identifier(name))


def is_numeric(data_type: T.DataType) -> bool:
    """Integers, floats and decimals of any precision."""
    return isinstance(data_type, T.NumericType)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def is_groupable(data_type: T.DataType) -> bool:
    """Whether Spark can group by the type; maps, variants and calendar intervals cannot be compared."""
    if isinstance(data_type, T.ArrayType):
        return is_groupable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(is_groupable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType, T.CalendarIntervalType))


def present(name: str, data_type: T.DataType) -> str:
    """SQL that is true where the column is neither null nor NaN."""
    column = identifier(name)
    return f"{column} IS NOT NULL AND NOT isnan({column})" if is_floating(data_type) else f"{column} IS NOT NULL"


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows that hold a null or NaN in any of ``columns``.

    Keeps the same rows as ``dropna(subset=columns)``, but as plain ``IsNotNull`` predicates, which reach the
    file scan; ``dropna`` compiles to one opaque predicate that does not.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.where(" AND ".join(present(c, types[c]) for c in columns)) if columns else df


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, or 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def total(name: str, data_type: T.DataType, exact_scale: int | None = None) -> str:
    """SQL for the sum of a numeric column as double.

    With ``exact_scale``, the number of decimals the data has, the sum does not depend on the order of the rows:
    floats are rounded to that many decimals and summed as whole units. Going through bigint keeps the
    conversion to decimal cheap; the sum itself is a decimal and has room for far more rows than a bigint.
    Floats that are no such units (NaN, infinities, values past a bigint) are summed as doubles and added.
    """
    column = identifier(name)
    if exact_scale is None:
        return f"sum(double({column}))"
    if isinstance(data_type, T.DecimalType):
        return f"double(sum({column}))"
    if not is_floating(data_type):
        return f"double(sum(cast(bigint({column}) AS decimal(19, 0))))"
    factor = 10 ** exact_scale
    fits = f"abs(double({column}) * {factor}D) < 9.2e18D"
    units = f"sum(CASE WHEN {fits} THEN cast(bigint(rint(double({column}) * {factor}D)) AS decimal(19, 0)) END)"
    rest = f"sum(CASE WHEN NOT {fits} THEN double({column}) END)"
    exact = f"double({units} / cast({factor} AS decimal({exact_scale + 1}, 0)))"
    return f"CASE WHEN count({column}) > 0 THEN coalesce({exact}, 0D) + coalesce({rest}, 0D) END"


def mean(name: str, data_type: T.DataType, exact_scale: int | None = None) -> str:
    """SQL for the mean as double, null when there are no values; see `total` for ``exact_scale``."""
    column = identifier(name)
    if exact_scale is None:
        return f"avg(double({column}))"
    return f"CASE WHEN count({column}) > 0 THEN {total(name, data_type, exact_scale)} / count({column}) END"


def canonical(expression: str, data_type: T.DataType, depth: int = 0) -> str:
    """SQL that writes a value as text, so that two texts are equal exactly if Spark counts the values as one.

    Every part carries its length or number of elements; null, NaN and zeros of either sign each have one form.
    """
    if isinstance(data_type, T.ArrayType):
        element = f"e{depth}"
        inner = canonical(element, data_type.elementType, depth + 1)
        text = f"concat('[', size({expression}), ':', array_join(transform({expression}, {element} -> {inner}), ''))"
    elif isinstance(data_type, T.StructType):
        parts = [canonical(f"{expression}.{identifier(f.name)}", f.dataType, depth) for f in data_type.fields]
        text = f"concat('(', {', '.join(parts)})" if parts else "'('"
    else:
        if is_floating(data_type):
            leaf = f"string(double({expression}) + 0D)"
        elif isinstance(data_type, T.BinaryType):
            leaf = f"hex({expression})"
        elif isinstance(data_type, T.TimestampType):
            leaf = f"string(unix_micros({expression}))"
        elif isinstance(data_type, T.StringType) and not data_type.isUTF8BinaryCollation():
            leaf = f"hex(collation_key({expression}))"
        else:
            leaf = f"string({expression})"
        text = f"concat(octet_length({leaf}), ':', {leaf})"
    return f"CASE WHEN {expression} IS NULL THEN 'n' ELSE {text} END"


def finite_or_none(value: float | None) -> float | None:
    """A driver-side number as a report may hold it: NaN and infinities become null."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return None
    return float(value)
