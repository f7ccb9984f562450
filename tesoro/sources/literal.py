"""Small tables from Python rows, built as JVM-side literals.

``spark.createDataFrame(list)`` ships rows through a Python RDD, so every job on
the result starts Python workers. For the handful of rows of a rule set, a
draft or an approval, one ``inline(array(named_struct(...)))`` expression is
planned and executed entirely in the JVM; it is built as SQL text so that a
whole table costs one parse instead of one py4j call per value.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quote(text: str) -> str:
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_literal(value, data_type: T.DataType) -> str:
    """SQL text of a literal of exactly ``data_type`` (nested types included)."""
    type_sql = data_type.simpleString()
    if value is None:
        return f"CAST(NULL AS {type_sql})"
    if isinstance(data_type, T.StructType):
        if isinstance(value, dict):
            get = value.get
        else:
            get = dict(zip(data_type.names, value)).get
        parts = ", ".join(f"{_quote(f.name)}, {sql_literal(get(f.name), f.dataType)}"
                          for f in data_type.fields)
        return f"named_struct({parts})"
    if isinstance(data_type, T.ArrayType):
        if not value:
            return f"CAST(array() AS {type_sql})"
        return "array(" + ", ".join(sql_literal(v, data_type.elementType) for v in value) + ")"
    if isinstance(data_type, T.TimestampType):
        text = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else str(value)
        return f"CAST({_quote(text)} AS TIMESTAMP)"
    if isinstance(data_type, T.BooleanType):
        return "TRUE" if value else "FALSE"
    return f"CAST({_quote(value)} AS {type_sql})"


def typed_lit(value, data_type: T.DataType) -> Column:
    """A literal Column of exactly ``data_type``."""
    return F.expr(sql_literal(value, data_type))


def literal_frame(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A DataFrame of ``rows`` (tuples or dicts) with exactly ``schema``."""
    rows = list(rows)
    if not rows:
        return spark.range(0, numPartitions=1).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    structs = ", ".join(sql_literal(r, schema) for r in rows)
    return (spark.range(1, numPartitions=1)
                 .select(F.expr(f"inline(array({structs}))"))
                 .select(*schema.names))
