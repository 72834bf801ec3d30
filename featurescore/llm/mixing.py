"""Mixing of sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

All sources share the words of the whole table by weight. A source whose share is above `max_epochs` times its own size
is clamped there, and the excess goes to the others by weight, until none is above. Of each source every document is
then taken target/size times: the whole part for all of them, the fraction as one more copy of the first documents in a
seeded order, up to the budget (to within half of one document).

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, ordered last;
a row without an id is hashed by its text; repeated rows are counted and taken alike; an empty table gives an empty result.
The order of sources and documents depends on their values only, so reruns agree; documents with equal keys (repeated rows)
are taken alike, so that ties are not cut. A text of any length is counted whole in one task; other columns pass through, but
for those named like results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, whole_rows

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mixture-1"
#: Hex digits of the seeded hash that split a source into buckets, so that no task needs all rows of a source.
DIGITS = 3


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size long, weight long), one row each; adds target (double)."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("cap", F.col("source_size") * max_epochs)
    # The first to be clamped is the one with the least room for its weight: with sources in that order, the clamped ones come first.
    order = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(after))
    full = ranked.withColumn("full", F.col("cap") * F.col("open") <= F.col("weight") * (F.col("total") - F.col("spent")))
    full = full.withColumn("left", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)).withColumn("share", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(everything))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("left")).cast("double") / F.nullif(F.col("share"), F.lit(0)))
    return full.select("source", "source_size", "weight", target.alias("target"))


def source_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: (source, source_size, target, whole, cut), cut being the last key that gets one more copy.

    sized has (source, key, size), key being the seeded order of documents.
    """
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((nth - 1) % len(weights) + 1).cast("int")))
    filled = water_fill(sources, max_epochs)
    filled = filled.withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
    filled = filled.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # Running sizes in seeded order: sums of buckets first, then inside each bucket.
    keys = sized.where("size > 0").groupBy("source", "key").agg(F.sum("size").alias("size")).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = keys.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    base = sums.withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = base.select(F.col("source").alias("src"), F.col("bucket").alias("b"), "base", "s")
    # only the bucket in which the budget ends needs its own running sum
    edge = base.join(filled.select(F.col("source").alias("fs"), "rest"), F.col("src").eqNullSafe(F.col("fs"))).where((F.col("base") <= F.col("rest")) & (F.col("base") + F.col("s") > F.col("rest")))
    inside = keys.join(edge, F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("b")))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("src", "b").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("base")
    passed = inside.withColumn("before", before).where(2 * F.col("before") + F.col("size") <= 2 * F.col("rest")).groupBy("src").agg(F.max("key").alias("cut"))
    edges = edge.select(F.col("src").alias("es"), F.col("b").alias("edge"))
    out = filled.join(edges, F.col("source").eqNullSafe(F.col("es")), "left").join(passed, F.col("source").eqNullSafe(F.col("src")), "left")
    # without a key in the last bucket all earlier buckets still pass; a prefix of a key is under every key of its bucket
    return out.select("source", "source_size", "target", "whole", F.when(F.col("edge").isNull(), F.when(F.col("rest") > 0, F.lit("g"))).otherwise(F.coalesce("cut", "edge")).alias("cut"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of docs with size, source_size, target, copies and taken (words); columns of these names are replaced."""
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))))
    made = ("size", "source_size", "target", "copies", "taken")
    rows = docs.select(whole_rows(docs, made).alias("doc"), docs[source].alias("source"), n_words(text).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary")).alias("key"))
    # words are counted once for the plan, which reads sizes more than once, and once for the result
    sized = materialise(rows.select("source", "key", "size"), "mixture-sizes")
    plan = materialise(source_plan(sized, weights, max_epochs), "mixture")
    discard(sized)
    plan = plan.select(F.col("source").alias("of"), "source_size", "target", "whole", "cut")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)).cast("long")
    counted = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return counted.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in made], *made)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as it is taken, with its number in the column copy."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("size", "source_size", "target", "copies", "taken")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mixture-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
         (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_w FROM s1),
s3 AS (SELECT *, cap * open_w <= w * (total - spent) AS is_full FROM s2),
s4 AS (SELECT *, (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::BIGINT AS rem,
         (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::BIGINT AS share FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (w * rem)::DOUBLE / share END AS target FROM s4),
s6 AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM s5),
k1 AS (SELECT source, k, sum(size)::BIGINT AS ks FROM d WHERE size > 0 GROUP BY source, k),
k2 AS (SELECT *, coalesce(sum(ks) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k1),
k3 AS (SELECT k2.source, k2.k, 2 * k2.before + k2.ks <= 2 * (s6.target - s6.whole * s6.source_size) AS more
       FROM k2 JOIN s6 ON k2.source IS NOT DISTINCT FROM s6.source)
SELECT d.doc_id, d.size, s6.source_size, s6.target,
       (d.size * (s6.whole + CASE WHEN coalesce(k3.more, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
LEFT JOIN k3 ON d.source IS NOT DISTINCT FROM k3.source AND d.k = k3.k
"""
