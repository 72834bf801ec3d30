"""Any table as rows of features: the source of everything that is not a stored request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import FEATURES, REQUEST, field_of, value


def rows_from_table(df: DataFrame, request_id: Column, row_id: Column, features: dict[str, Column]) -> DataFrame:
    """Wide rows (request_id, row_id, a typed column per feature)."""
    return df.select(request_id.cast("string").alias("request_id"), row_id.cast("string").alias("row_id"), *[c.alias(n) for n, c in features.items()])


def to_map(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """df with the columns of names gathered in a map of typed values; a null column is an unset value."""
    values = []
    for n in names:
        field = field_of(df.schema[n].dataType)
        if field is None:
            raise TypeError(f"column {n} has the type {df.schema[n].dataType.simpleString()}, which no feature value holds")
        values.append(value(field, F.col(n)))
    return df.withColumn(out, F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values)).cast(FEATURES))


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(REQUEST).format(fmt).load(path)


#: Bytes of stored requests of a micro-batch, about (a file at least). A task keeps its rows of a batch in memory, about 20 times as large as they are stored.
TRIGGER_BYTES = 128 << 20


def stream_requests(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = REQUEST, trigger_bytes: int | None = None) -> DataFrame:
    """A folder of requests as a stream in micro-batches of bounded size, so that no task's share grows with the folder."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", trigger_bytes or TRIGGER_BYTES).format(fmt).load(path)
