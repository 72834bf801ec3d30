"""Lookups of keys in tables of vectors, as joins: one row per key, a default for unknown keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import stored, unused
from .transforms import Lookup

#: Numbers in a table that is sent to every task at most (4 bytes each); larger ones are left to Spark's own choice.
SENT_NUMBERS = 8_000_000
#: A key with this share of the rows is hot; counters of the sketch that finds such keys.
HOT_SHARE, SKETCH = 0.01, 10_000


def sent_lookup(spark: SparkSession, lookup: Lookup, keys: Column) -> Column | None:
    """The vectors of the elements of an array column, end to end, from a table that is sent to every executor; null for null.

    A row is looked up where it is, so it works on streams and shuffles nothing. None: the table is too large for that.
    """
    table = lookup.table()
    if sum(map(len, table.values())) > SENT_NUMBERS:
        return None
    # the default comes after the known keys
    vectors = [np.asarray(v, dtype=np.float32) for v in (*table.values(), lookup.default_val)]
    ends = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    shared = spark.sparkContext.broadcast((list(table), np.concatenate(vectors), ends))

    def run(column: pa.Array) -> pa.Array:
        names, numbers, ends = shared.value
        flat = column.flatten()
        at = pc.fill_null(pc.index_in(flat, pa.array(names, pa.string())), len(names)).to_numpy(zero_copy_only=False)
        sizes = (ends[1:] - ends[:-1])[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        # the place in numbers of each number of the result
        place = np.repeat(ends[at] - upto[:-1], sizes) + np.arange(upto[-1])
        rows = np.concatenate([[0], np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(upto[rows].astype(np.int32)), pa.array(numbers[place]), mask=column.is_null())

    return F.arrow_udf(run, "array<float>")(keys)


def dictionary(spark: SparkSession, lookup: Lookup) -> DataFrame:
    """The table of a configuration as rows (key, vec), broadcast if its size allows."""
    table = lookup.table()
    rows = spark.createDataFrame([(k, list(v)) for k, v in table.items()], "key string, vec array<float>")
    return F.broadcast(rows) if sum(map(len, table.values())) <= SENT_NUMBERS else rows


def lookup_join(df: DataFrame, key: Column, table: DataFrame, default: Column, out: str) -> DataFrame:
    """df with the column out: the vec of table (key, vec; keys unique) for key, or default."""
    known = table.select(F.col("key").alias("__key"), F.col("vec").alias("__vec"))
    return df.join(known, key == F.col("__key"), "left").withColumn(out, F.coalesce("__vec", default)).drop("__key", "__vec")


def hot_keys(df: DataFrame, key: Column, share: float = HOT_SHARE) -> DataFrame:
    """Rows (key): the keys that fill about that share of df or more, by a sketch; at most a few over 1 / share."""
    top = df.where(key.isNotNull()).agg(F.call_function("approx_top_k", key, F.lit(int(2 / share)), F.lit(SKETCH)).alias("top"), F.count("*").alias("n"))
    return top.select("n", F.explode("top").alias("t")).where(F.col("t.count") >= share * F.col("n")).select(F.col("t.item").alias("key"))


def skewed_lookup_join(df: DataFrame, key: Column, table: DataFrame, default: Column, out: str, share: float = HOT_SHARE) -> DataFrame:
    """As lookup_join, for large stored tables and keys of which a few fill much of df.

    Rows of hot keys meet a broadcast slice of the table, a row for each hot key; rows without a key meet nothing; only the
    others are shuffled, so none of their keys fills a task. df is read by the sketch and by each of the three joins.
    """
    (probe,) = unused(df, "__probe")
    hot = stored(hot_keys(df, key, share), "hot-keys")
    rows = df.withColumn(probe, key)
    slice_ = table.join(F.broadcast(hot), "key", "left_semi")
    marked = rows.join(F.broadcast(hot.select(F.col("key").alias(f"{probe}h"))), F.col(probe) == F.col(f"{probe}h"), "left")
    warm = lookup_join(marked.where(F.col(f"{probe}h").isNotNull()).drop(f"{probe}h"), F.col(probe), F.broadcast(slice_), default, out)
    none = marked.where(F.col(probe).isNull()).drop(f"{probe}h").withColumn(out, default)
    cold = lookup_join(marked.where(F.col(probe).isNotNull() & F.col(f"{probe}h").isNull()).drop(f"{probe}h"), F.col(probe), table, default, out)
    return warm.unionByName(none).unionByName(cold).drop(probe)


def array_lookup_join(df: DataFrame, row: list[str], keys: str, table: DataFrame, default: Column, out: str) -> DataFrame:
    """Rows (row.., out): the vectors of the elements of keys, in order, end to end. row names the columns that tell rows apart."""
    items = df.select(*row, F.posexplode_outer(keys).alias("__pos", "__item"))
    found = lookup_join(items, F.col("__item"), table, default, "__one").where("__pos is not null")
    joined = found.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("__pos", "__one"))).alias("__all"))
    whole = joined.select(*row, F.flatten(F.transform("__all", lambda x: x["__one"])).alias(out))
    return df.select(*row).join(whole, row, "left").withColumn(out, F.coalesce(out, F.array().cast("array<float>")))


def array_lookup(df: DataFrame, keys: Column, table: DataFrame, default: Column, out: str) -> DataFrame:
    """df with the column out: the vectors of the elements of the array keys, end to end; null for a null array.

    For tables too large for sent_lookup. Rows are told apart by their place in df, so df must give the same rows in the same order when it is read again. Only
    rows that have keys are exploded, and only their numbers and vectors are shuffled back.
    """
    rows = df.withColumn("__place", F.monotonically_increasing_id())
    some = rows.select("__place", keys.alias("__keys")).where("size(__keys) > 0")
    whole = array_lookup_join(some, ["__place"], "__keys", table, default, "__whole")
    none = F.when(F.size(keys) == 0, F.array().cast("array<float>"))
    return rows.join(whole, "__place", "left").withColumn(out, F.coalesce("__whole", none)).drop("__place", "__whole")
