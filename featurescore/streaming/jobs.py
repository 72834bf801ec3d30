"""Streaming jobs: the batch functions over unbounded tables, with checkpointed sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VectorizationConfig
from ..operators.requests import assemble_responses, explode_requests, reject_requests
from ..operators.scoring import Scorer, score
from ..operators.vectorize import vectorize
from ..sources.logs import FILE_BATCHES, FILE_ROWS, PARTITIONS, log_batches, log_rows, stage_metrics, with_partitions, write_metrics
from ..sources.protobuf import write_flushes
from .stateful import count_flushes, state_store


def drain(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None, file_rows: int = FILE_ROWS) -> None:
    """Writes what a stream in append mode has available as Parquet under path, each row once, and ends."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("maxRecordsPerFile", file_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()


def log_stream(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream of log rows to partitions of the minute in which each micro-batch runs."""
    drain(with_partitions(rows, F.current_timestamp()), path, checkpoint, list(PARTITIONS))


def flush_job(batches: DataFrame, path: str, checkpoint: str, size: int = FILE_BATCHES, idle_ms: int = 0) -> None:
    """Collects a stream of encoded log batches (lane, item) to flushes of size batches, and writes each as a file of logs.

    What is left of a lane stays in the checkpoint and is flushed when later batches fill it up. A micro-batch that comes
    again has the same flushes, which are not written twice.
    """
    with state_store(batches.sparkSession):
        flushes = count_flushes(batches, size, idle_ms)
        writer = flushes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.foreachBatch(lambda rows, number: write_flushes(rows, path, checkpoint)).start().awaitTermination()


def foreach_scored(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sinks: list[Callable[[DataFrame, int], None]], checkpoint: str) -> None:
    """Scores each micro-batch once and hands it with its number to several sinks, so that responses and logs do not score twice.

    A micro-batch may come again after a failure, with the same number and rows: sinks write to a place of its number.
    """

    def handle(batch: DataFrame, number: int) -> None:
        out = transform(batch).persist()
        try:
            for sink in sinks:
                sink(out, number)
        finally:
            out.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()


def score_requests(requests: DataFrame, config: VectorizationConfig, scorer: Scorer) -> DataFrame:
    """Rows of nested requests with vector, error, scores and the micros of their stages, all in one pass.

    vec_micros is how long the batch of a row waited for its vectors after the one before it was scored.
    """
    return score(vectorize(explode_requests(requests), config, scorer.input_width, features="features"), scorer, timings=True)


def request_job(requests: DataFrame, config: VectorizationConfig, scorer: Scorer, model_id: str, path: str, checkpoint: str) -> None:
    """Scores a stream of requests to path/responses, path/logs (a row per accepted request, as many in a file as a flush has) and path/metrics."""

    def responses(scored: DataFrame, number: int) -> None:
        assemble_responses(scored).write.mode("overwrite").parquet(f"{path}/responses/batch={number}")

    def logs(scored: DataFrame, number: int) -> None:
        accepted, _ = reject_requests(scored.where("pos is not null"))
        batches = with_partitions(log_batches(log_rows(accepted, model_id)), F.current_timestamp())
        batches.write.mode("overwrite").partitionBy(*PARTITIONS).option("maxRecordsPerFile", FILE_BATCHES).parquet(f"{path}/logs/batch={number}")

    def metrics(scored: DataFrame, number: int) -> None:
        stages = scored.groupBy("request_id").agg(*[F.max(c).alias(c) for c in ("infer_micros", "tensor_micros", "vec_micros")])
        write_metrics(stage_metrics(stages, ["request_id"]), f"{path}/metrics/batch={number}", mode="overwrite")

    foreach_scored(requests, lambda batch: score_requests(batch, config, scorer), [responses, logs, metrics], checkpoint)


def read_events(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table of the test data as a stream; the pattern matches a file as well as a folder of that name."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")
