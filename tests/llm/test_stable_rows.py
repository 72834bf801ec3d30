"""Rows keep their numbers, and columns their names, whatever the cluster and the table are like."""

import functools

import pytest
from pyspark.sql import functions as F

from featurescore.llm import common, decontaminate, jaccard_join, language_id, license_scan, mixing, quality_rules, secret_scan, suffix_dedup, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(i, n=60):
    return " ".join(WORDS[(i * 7 + k * (i % 5 + 1) + k * k) % len(WORDS)] + str((i * k) % 9) for k in range(n))


@pytest.fixture
def unsteady(spark, monkeypatch):
    """Another parallelism for each table that a step stores, as on a cluster that gains and loses executors."""
    count, write = [0], common.materialise

    @functools.wraps(write)
    def moved(df, name):
        out = write(df, name)
        count[0] += 1
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + count[0] * 5 % 23))
        return out

    for module in (common, decontaminate, jaccard_join, suffix_dedup, warc):
        monkeypatch.setattr(module, "materialise", moved)
    yield count
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


@pytest.fixture
def docs(spark, tmp_path):
    # many row groups, so that the splits depend on the parallelism
    rows = [(i % 90, text(i % 120)) for i in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(3).write.option("parquet.block.size", "1024").parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("run", [
    lambda docs, bench: suffix_dedup.remove_repeats(docs, length=60, keep_text=False),
    lambda docs, bench: jaccard_join.linked_components(docs),
    lambda docs, bench: jaccard_join.keep_one_of_each(docs),
    lambda docs, bench: decontaminate.find_leaks(docs, bench).select("doc_id", "item_id", "n_matched"),
    lambda docs, bench: decontaminate.drop_leaks(docs, bench),
])
def test_equal_results_when_the_parallelism_changes(spark, docs, run, request, table):
    bench = table([(k, text(k)[:200]) for k in (3, 50, 51)], "item_id long, text string")
    steady = rows_of(run(docs, bench))
    moves = request.getfixturevalue("unsteady")
    assert rows_of(run(docs, bench)) == steady and moves[0] > 1


def test_archives_when_the_parallelism_changes(spark, docs, unsteady, tmp_path):
    pages = docs.select(F.monotonically_increasing_id().alias("page_id"), F.lit("http://a").alias("url"), F.repeat("text", 4).alias("html"))
    pages.write.option("parquet.block.size", "1024").parquet(str(tmp_path / "p"))
    stored, path = spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "w")
    warc.write_archive(stored, path)
    got = {int(r.page_id): r for r in warc.described(warc.read_archive(spark, path)).collect()}
    last = {}
    for r in stored.collect():
        last[r.html] = max(last.get(r.html, -1), r.page_id)
    for r in stored.collect():
        assert got[r.page_id].payload_bytes == len(r.html)
        assert (got[r.page_id].refers_to is None) == (last[r.html] == r.page_id) and int(got[r.page_id].refers_to or last[r.html]) == last[r.html]


NAMES = ["row", "key", "doc", "own", "id", "bad", "cut", "whole", "of", "rule", "__row", "__id", "n", "at", "runs", "labelled"]
#: What steps name their own columns before they look for a name that is free.
NAMES += ["__near", "__other", "__tox", "__language", "__scan", "__words", "Toxicity_Row", "toxicity_near", "toxicity_rest", "toxicity_voted", "toxicity_voted_", "language_read", "scan_both", "SCAN_both_", "quality_words", "quality_lines"]


def test_columns_of_any_name_pass(spark, table):
    plain = [(i, text(i), f"s{i % 2}") for i in range(60)]
    docs = table(plain, "doc_id long, text string, source string")
    more = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in NAMES])
    bench, labels = table([(1, text(5)[:200])], "item_id long, text string"), table([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    network = language_id.train(docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 2)))
    known = toxicity.train(docs, labels)
    for run in (
        lambda d: suffix_dedup.remove_repeats(d, length=60), lambda d: jaccard_join.keep_one_of_each(d), lambda d: decontaminate.drop_leaks(d, bench),
        lambda d: mixing.mix(d), lambda d: quality_rules.judge(d, labels)[0], lambda d: quality_rules.with_features(d), lambda d: secret_scan.scan_secrets(d), lambda d: secret_scan.scan_secrets(d, clean="clean"),
        lambda d: license_scan.scan_licenses(d), lambda d: language_id.identify(d, network), lambda d: toxicity.score_toxicity(d, known),
    ):
        want, got = run(docs), run(more)
        names = [c for c in NAMES if c not in want.columns]
        assert set(got.columns) == set(want.columns) | set(names)
        assert rows_of(got.select(*want.columns)) == rows_of(want)
        assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in names)


def test_rows_without_an_id_are_cut_by_their_text(spark, table):
    docs = table([(None, f"{i} " + "w " * 9, None) for i in range(300)] + [(i, "x y z", "b") for i in range(10)], "doc_id long, text string, source string")
    out = mixing.mix(docs, weights=(1, 1)).where("source is null").groupBy().agg(F.sum("taken").alias("t"), F.max("target").alias("target")).first()
    assert abs(out.t - out.target) <= 10


def test_very_many_segments(spark, table, tmp_path):
    page = "z" * 3_000_000
    warc.write_archive(table([(1, "u", page)], "page_id long, url string, html string"), str(tmp_path / "w"), segment=2_000)
    r = warc.read_archive(spark, str(tmp_path / "w")).first()
    assert r.status == "whole" and r.payload == page.encode()
