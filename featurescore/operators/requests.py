"""Nested requests: exploded to rows, rejected as a whole on any error, and assembled to responses in input order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import number_rows, unused


def explode_requests(requests: DataFrame) -> DataFrame:
    """Rows (request_id, pos, row_id, features); a request without inputs is one row with a null pos."""
    return requests.select("request_id", F.posexplode_outer("inputs").alias("pos", "input")).select("request_id", "pos", "input.row_id", "input.features")


def reject_requests(rows: DataFrame, scope: str = "request") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected (request_id, error)): any row with an error rejects its request, with the error of its first bad row.

    scope "row" rejects single rows only. Bad rows alone are gathered by request, and the others look their request up in
    that table: rows pass through, none is sorted or kept in memory. rows is read once for either.
    """
    if scope == "row":
        return rows.where("error is null"), rows.where("error is not null").select("request_id", "error")
    (bad,) = unused(rows, "__bad")
    known = rows.where("error is not null").groupBy("request_id").agg(F.min_by("error", "pos").alias("error")).where("error is not null")
    ids = known.select(F.col("request_id").alias(bad)).hint("shuffle_hash")
    return rows.join(ids, F.col("request_id").eqNullSafe(F.col(bad)), "left_anti"), known


def assemble_responses(scored: DataFrame) -> DataFrame:
    """Rows (request_id, outputs) with outputs in the order of pos; a request whose only row has a null pos has none.

    Where scored has a column error, a request with an error has null outputs and the error of its first bad row.
    """
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "row_id", "scores"))
    found = [F.array_sort(F.collect_list(item)).alias("o")]
    if "error" in scored.columns:
        found.append(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"))
    rows = scored.groupBy("request_id").agg(*found)
    outputs = F.transform("o", lambda x: F.struct(x["row_id"].alias("row_id"), x["scores"].alias("scores")))
    if "error" not in scored.columns:
        return rows.select("request_id", outputs.alias("outputs"))
    return rows.select("request_id", F.when(F.col("error").isNull(), outputs).alias("outputs"), "error")


#: Outputs of a part of a response, and rows of a part of a log batch, at most.
PART_ROWS = 10_000


def response_parts(scored: DataFrame, size: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows (request_id, part, outputs), manifest (request_id, parts, n_outputs, error)) for requests of any length.

    A part has the outputs of size places of the request in their order, so no request meets in one array: parts are
    counted and checked in the manifest, a row for each request. A request with an error has no parts, and the error of
    its first bad row; one without inputs is in the manifest only.
    """
    part = F.floor(F.col("pos") / size).cast("int")
    bad = F.col("error") if "error" in scored.columns else F.lit(None).cast("string")
    rows = scored.select("request_id", "pos", "row_id", "scores", part.alias("part"), bad.alias("error"))
    packed = rows.groupBy("request_id", "part").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "row_id", "scores")))).alias("o"), F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "error"))).alias("first"),
    )
    sums = rows.groupBy("request_id").agg(F.count("pos").alias("n"), (F.max("part") + 1).alias("parts"), F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "error"))).alias("first"))
    manifest = sums.select("request_id", F.when(F.col("first").isNull(), F.coalesce("parts", F.lit(0))).otherwise(0).alias("parts"), F.when(F.col("first").isNull(), F.col("n")).otherwise(0).alias("n_outputs"), F.col("first.error").alias("error"))
    accepted = packed.where("part is not null").join(manifest.where("error is not null").select("request_id"), "request_id", "left_anti")
    outputs = F.transform("o", lambda x: F.struct(x["row_id"].alias("row_id"), x["scores"].alias("scores")))
    return accepted.select("request_id", "part", outputs.alias("outputs")), manifest


def chunk_numbers(df: DataFrame, partition: list[str], order: list, size: int, out: str = "chunk") -> DataFrame:
    """df with the number of the chunk of size rows that each row falls in, within each partition; no partition is one task's."""
    (n,) = unused(df, "__n")
    numbered = number_rows(df, partition, order, n)
    return numbered.withColumn(out, F.floor(F.col(n) / size).cast("long")).drop(n)
