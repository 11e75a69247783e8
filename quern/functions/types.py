"""INT, FLOAT and CHAR(n) against Spark's types, and strict checks of literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IncompatibleType, StringOverflow
from ..plans.lang import ColumnDef, Plus, Value

FAMILY = {"INT": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "FLOAT": (T.FloatType, T.DoubleType, T.DecimalType), "CHAR": (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)}


def spark_field(c: ColumnDef) -> T.StructField:
    kind = {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "CHAR": T.StringType()}[c.kind]
    return T.StructField(c.name, kind, True, {"length": c.length} if c.length else {})


def kind_of(field: T.StructField) -> tuple[str, int | None]:
    """INT, FLOAT or CHAR and a string's length limit; dates and timestamps compare with CHAR literals."""
    for kind, classes in FAMILY.items():
        if isinstance(field.dataType, classes):
            return kind, field.metadata.get("length")
    raise IncompatibleType(f"{field.name} has the unsupported type {field.dataType.simpleString()}")


def check_value(value: Value, field: T.StructField) -> None:
    kind, length = kind_of(field)
    if kind != value.kind:
        raise IncompatibleType(f"{field.name} is {kind}, the value {value.value!r} is {value.kind}")
    if length is not None and value.kind == "CHAR" and len(value.value.encode()) > length:
        raise StringOverflow(f"{value.value!r} is longer than {field.name}, CHAR({length})")


def assigned(value: Value | Plus, field: T.StructField, scope, table: str) -> Column:
    """What SET gives a column: a literal, or another column (or the same) plus or minus a literal of its kind."""
    if isinstance(value, Value):
        check_value(value, field)
        return literal(value, field)
    left = scope.resolve(value.left)
    other = scope.field(left)
    kinds = {kind_of(field)[0], kind_of(other)[0], value.right.kind}
    if len(kinds) > 1 or kinds == {"CHAR"}:
        raise IncompatibleType(f"{field.name} can't be {left} {value.op} {value.right.value!r}")
    here, there = F.col(f"`{table}.{other.name}`"), literal(value.right, other)
    return (here + there if value.op == "+" else here - there).cast(field.dataType)


def literal(value: Value, field: T.StructField) -> Column:
    return F.lit(value.value).cast(field.dataType)
