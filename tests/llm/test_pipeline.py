import corpus_pipeline as cp
from featurescore.llm.mixing import mix

from .test_decontaminate import brute as leaks
from .test_jaccard_join import shingles

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, docs_of, kept = docs.columns, {}, {}
    for name, stage in cp.STAGES[:-1]:
        docs_of[name] = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert len(kept["language"]) >= 0.97 * len(docs_of["language"])
    before, after = docs_of["near_duplicates"], kept["near_duplicates"]
    s = {i: shingles(r.text) for i, r in before.items()}
    near = lambda a, b: bool(s[a]) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])
    for i in before:
        least = min(j for j in before if j == i or near(i, j))
        assert (i in after) or least < i
    assert not any(near(i, j) for i in after for j in after if i < j)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    gone = set(docs_of["decontamination"]) - set(kept["decontamination"])
    assert gone == {x[0] for x in leaks([(i, docs_of["decontamination"][i].text) for i in [*gone, *list(kept["decontamination"])[:15]]], items)}
    assert set(kept["secrets"]) == set(docs_of["secrets"])
    changed = [i for i, r in kept["secrets"].items() if r.text != docs_of["secrets"][i].text]
    assert all("[SECRET]" in kept["secrets"][i].text and kept["secrets"][i].n_chars == len(kept["secrets"][i].text) for i in changed)
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert last.columns == [*columns, "copy"]
    assert last.count() == sum(r.copies for r in mix(docs).collect())


def test_run_keeps_extra_columns_nulls_and_empty_tables(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["score", "secrets", "clean", "doc", "size", "source_size", "target", "copies", "taken", "copy", "lang_pred", "row", "__row", "__n", "id", "cells"]
    extra = base.selectExpr("*", *[f"concat('{n} of ', coalesce(cast(doc_id AS string), 'none')) AS {n}" for n in names])
    extra = extra.union(extra.limit(3).selectExpr("doc_id", "cast(null AS string)", "cast(null AS string)", "cast(null AS string)", "cast(null AS bigint)", *names))
    extra = extra.union(extra.limit(2).selectExpr("cast(null AS bigint)", "array_join(reverse(split(text, ' ')), ' ')", "lang", "source", "n_chars", *[f"'{n} of none'" for n in names]))
    for name, docs in (("full", extra), ("no_n_chars", extra.drop("n_chars")), ("empty", extra.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for k, (_, f) in enumerate(cp.STAGES):
            f(spark, docs, SF).write.parquet(f"{tmp_path}/{name}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            assert set(names) <= set(docs.columns)
            for r in docs.collect():
                assert {n: r[n] for n in names} == {n: f"{n} of {"none" if r.doc_id is None else r.doc_id}" for n in names}
        assert (docs.count() > 0) == (name != "empty") and "copy_" in docs.columns
        if name == "full":
            assert docs.where("doc_id is null").count() > 0


def test_languages_that_cannot_be_learned(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "if(doc_id % 10 = 0, '12 --', text) AS text", "cast(null AS string) AS lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert cp.language(spark, docs, SF).count() == docs.where("doc_id % 10 <> 0").count()


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
