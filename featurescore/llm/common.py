"""Helpers shared by the corpus operators: shared storage, Arrow slices and vectorised byte hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts are long, so the batches of Spark's default (10,000 rows) would hold far more memory.
ARROW_ROWS = 500
#: Bytes of text that the vectorised code handles at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_CODES = np.random.default_rng(20240607).integers(1, 2**63, size=(2, 256), dtype=np.uint64)
#: Multipliers of the two polynomial hashes, and their inverses modulo 2**64.
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, so that later stages do not repeat its work.

    The shuffle files of the write go as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, column: str = "row") -> DataFrame:
    """df, stored with a number for each row.

    The number is written beside the row, so that later jobs find the same one, whatever the files of df are split into
    then: the splits depend on the cores that the cluster has at the time.
    """
    return materialise(df.withColumn(column, F.monotonically_increasing_id()), name)


def whole_rows(df: DataFrame, without: tuple[str, ...] = ()) -> F.Column:
    """The columns of df as one struct, so that no name can clash with those of a step."""
    kept = [c for c in df.columns if c not in without]
    return F.struct(*[df[c] for c in kept]) if kept else F.struct(F.lit(True).alias("none"))


def unused(df: DataFrame, name: str) -> str:
    """A name for a column of a step that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Empties the table of materialise() that df is, once no later step reads it."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        spark.range(0).write.mode("overwrite").parquet(folder)


#: Rows of which the numbers are sent to every task at most (8 bytes each); more are joined.
SENT_ROWS = 1 << 20


def only(df: DataFrame, need: DataFrame, key: str = "row", at_most: int | None = None) -> DataFrame:
    """The rows of df whose key, a number, is in need, a stored table; at_most is how many rows need has, if known.

    Few numbers are sent to every task, so that the other rows of df, with their texts, are not shuffled.
    """
    n = need.count() if at_most is None else at_most
    keys = need.select(key).distinct()
    return df.join(F.broadcast(keys) if n <= SENT_ROWS else keys, key, "left_semi")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it the session's setting has that value; after it the one it had before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows of an Arrow batch for tables of a few numbers.
NARROW_ROWS = 10_000


def narrow(spark: SparkSession):
    """Within it steps that are run have Arrow batches for tables of a few numbers, without texts."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(NARROW_ROWS))


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with batches sized for long texts."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(fn, schema)


def in_train(doc_id) -> F.Column:
    """The fold rule of labelled rows: crc32 of the id as text, modulo 4, is not 2 (null ids are never trained on)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    key = (which, inverse)
    if key not in _POWERS or len(_POWERS[key]) < n:
        size = max(n, SLICE_BYTES + 1)
        base = pow(_BASES[which], -1, 2**64) if inverse else _BASES[which]
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[key] = np.cumprod(steps)
    return _POWERS[key][:n]


class Rolling:
    """Polynomial hashes of any substring of a byte array; which picks one of two independent hashes."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which, n = which, len(data)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_CODES[which][data] * powers(n, which), out=sums[1:])
        self.sums = sums

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(len(self.sums), self.which, True)
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _MULT)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, end to end, and the row offsets; nulls are empty."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n, first = len(column), column.offset
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[first : first + n + 1] if n else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows with about SLICE_BYTES of text each; gives the rows, their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = as_bytes(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the table inside marks, none across rows; first run of each row."""
    n = len(data)
    on = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at[:-1]] = True
    edge[n] = True
    start = on.copy()
    start[1:] &= ~on[:-1] | edge[1:n]
    end = on.copy()
    end[:-1] &= ~on[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """For each row its sorted distinct word shingles, as 64-bit hashes; fewer words than asked for make one shingle."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, at, ~SPACE)
    token = Rolling(data).of(starts, ends)
    grams = np.zeros(max(0, len(token) - words + 1), dtype=np.uint64)
    for k in range(words):
        grams = mix(grams * _MULT + token[k : k + len(grams)])
    out = []
    for i in range(len(at) - 1):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= words:
            out.append(np.unique(grams[lo : hi - words + 1]))
        elif hi > lo:
            whole = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for t in token[lo:hi]:
                    whole = mix(np.array([whole * _MULT + t + np.uint64(77)], dtype=np.uint64))[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Connected components of the links (a, b) as rows (node, root), root being the least node of the component.

    Large-star and small-star rounds: every round is a grouped minimum and a join, so that no component is ever held by
    one task, and the number of rounds grows with the logarithm of the longest chain. A round's tables go after the next;
    the least neighbours are written before they are joined with, so that the links of one node can be split among tasks.
    """
    links = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{name}-links")
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialise(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}-links")
        discard(links)
        discard(low)
        links = new
        now = links.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
