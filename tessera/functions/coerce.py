"""Typed access to fields whose presence and type vary from file to file.

Each function looks at the schema when the plan is built and returns one built-in
expression: an absent field is a typed null, a bad value takes the default. Nothing
here raises on data, whatever ``spark.sql.ansi.enabled`` says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TEXT = r"^[+-]?[0-9]+$"


def has_field(df: DataFrame, name: str) -> bool:
    """Exact, case-sensitive test for a top-level field."""
    return name in df.columns


def _field(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    kind = next((f.dataType for f in df.schema.fields if f.name == name), T.NullType())
    return (F.col(f"`{name}`") if has_field(df, name) else F.lit(None)), kind


def get_string(df: DataFrame, name: str) -> Column:
    """The value as text; null if absent or null."""
    value, _ = _field(df, name)
    return value.cast("string")


def get_double(df: DataFrame, name: str, default: float | None = 0.0) -> Column:
    """A number as double; text is parsed; anything else is the default."""
    value, kind = _field(df, name)
    if isinstance(kind, T.NumericType):
        read = value.cast("double")
    elif isinstance(kind, T.StringType):
        read = value.try_cast("double")
    else:
        read = F.lit(None).cast("double")
    return F.coalesce(read, F.lit(default).cast("double"))


def _integer(df: DataFrame, name: str, default: int | None, to: str) -> Column:
    value, kind = _field(df, name)
    if isinstance(kind, T.NumericType):
        read = value.try_cast(to)
    elif isinstance(kind, T.StringType):
        read = F.when(value.rlike(INTEGER_TEXT), value).try_cast(to)
    else:
        read = F.lit(None).cast(to)
    return F.coalesce(read, F.lit(default).cast(to))


def get_long(df: DataFrame, name: str, default: int | None = 0) -> Column:
    """A number truncated to bigint; text only if it is an integer without blanks."""
    return _integer(df, name, default, "bigint")


def get_int(df: DataFrame, name: str, default: int | None = 0) -> Column:
    """As ``get_long`` with int; a value out of range takes the default."""
    return _integer(df, name, default, "int")


def get_boolean(df: DataFrame, name: str, default: bool = False) -> Column:
    """True for a true boolean and for the text "true" in any case; null takes the default."""
    value, kind = _field(df, name)
    read = value if isinstance(kind, T.BooleanType) else F.lower(value.cast("string")) == "true"
    return F.coalesce(read, F.lit(default))


def first_string(df: DataFrame, *names: str) -> Column:
    """The first of several alternative fields that is not null."""
    return F.coalesce(*[get_string(df, n) for n in names])
