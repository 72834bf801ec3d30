"""Types of feature values, requests, responses and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The alternatives of a feature value, in their order.
FIELDS: dict[str, T.DataType] = {
    "double_value": T.DoubleType(),
    "float_value": T.FloatType(),
    "integer_value": T.IntegerType(),
    "long_value": T.LongType(),
    "string_value": T.StringType(),
    "double_array": T.ArrayType(T.DoubleType()),
    "float_array": T.ArrayType(T.FloatType()),
    "integer_array": T.ArrayType(T.IntegerType()),
    "long_array": T.ArrayType(T.LongType()),
    "string_array": T.ArrayType(T.StringType()),
}

FEATURE_VALUE = T.StructType([T.StructField(k, v) for k, v in FIELDS.items()])
FEATURES = T.MapType(T.StringType(), FEATURE_VALUE)
INPUT_ROW = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("features", FEATURES)])
REQUEST = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("inputs", T.ArrayType(INPUT_ROW))])
OUTPUT_ROW = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("scores", T.ArrayType(T.FloatType()))])
RESPONSE = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("outputs", T.ArrayType(OUTPUT_ROW))])
LOG_ROW = T.StructType([*INPUT_ROW.fields, T.StructField("scores", T.ArrayType(T.FloatType()))])
LOG_BATCH = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("model_id", T.StringType()), T.StructField("inference_log_rows", T.ArrayType(LOG_ROW))])
METRIC = T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())])


def field_of(dtype: T.DataType) -> str | None:
    """The alternative that holds a column of this type; small integers are widened. None: no alternative does."""
    if isinstance(dtype, (T.ByteType, T.ShortType)):
        return "integer_value"
    array = isinstance(dtype, T.ArrayType)
    inner = dtype.elementType if array else dtype
    for name, known in FIELDS.items():
        if array == isinstance(known, T.ArrayType) and type(known.elementType if array else known) is type(inner):
            return name
    return None


def value(field: str, column: Column) -> Column:
    """A feature value with one alternative set."""
    return F.struct(*[(column.cast(t) if name == field else F.lit(None).cast(t)).alias(name) for name, t in FIELDS.items()]).cast(FEATURE_VALUE)


def kind(feature: Column) -> Column:
    """The alternative that is set; null for an unset or missing value."""
    return F.coalesce(*[F.when(feature[name].isNotNull(), F.lit(name)) for name in FIELDS])
