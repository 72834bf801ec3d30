"""A training corpus in five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Columns beside those of
documents pass through all stages, whatever their names; the last adds the number of the copy. Repeated rows and rows
without an id, text, language or source are rows as others; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescore.llm.common import materialise
from featurescore.llm.decontaminate import drop_leaks
from featurescore.llm.jaccard_join import keep_one_of_each
from featurescore.llm.language_id import UNKNOWN, has_letter, identify, train
from featurescore.llm.mixing import mix, repeated
from featurescore.llm.secret_scan import scan_secrets

#: Least mean probability of the predicted language.
SURE = 0.5


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows of docs whole, in the column doc, beside the columns that a stage works on; so no name can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), *[docs[c] for c in columns])


def unpacked(rows: DataFrame, columns: list[str], changed: dict | None = None) -> DataFrame:
    return rows.select(*[(changed or {}).get(c, F.col("doc").getField(c)).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows and is sure of; the others go.

    A text that is null, empty or without a letter goes. Where no row of the training folds has a language, nothing can
    be learned, and all texts with a letter stay. Ties between languages go to the first in code point order.
    """
    model = train(docs)
    if not model.languages:
        return docs.where(has_letter(docs["text"]))
    known = identify(packed(docs, "text"), model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE))
    return unpacked(known, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the least id, null ids last, then the first read.

    Texts that are null, empty or blank are linked with nothing and stay.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts hold none and stay."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the secret scan reports replaced; n_chars, where there is such a column, follows the text where it changed.

    Null and empty texts stay as they are.
    """
    found = scan_secrets(packed(docs, "text"), clean="clean")
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("secrets") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc").getField("n_chars"))
    return unpacked(found, docs.columns, changed)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them, numbered by the column copy (copy_ and so on, where docs has a copy).

    Null and empty texts have no words and are never taken; a null source is a source of its own.
    """
    number = "copy"
    while number in docs.columns:
        number += "_"
    taken = repeated(mix(packed(docs, "doc_id", "text", "source")))
    return taken.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], F.col("copy").alias(number))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture)]

#: The network of the first stage has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
