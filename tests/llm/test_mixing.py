import random

from featurescore.llm.mixing import OP3_SQL, mix, op3_mixing, repeated

from .sqlcheck import same

SF = "/root/testdata/sf0.001"


def test_equals_sql_on_documents(spark):
    same(op3_mixing(spark, SF), OP3_SQL, SF)


def test_edges_equal_sql(table, tmp_path):
    r = random.Random(5)
    rows = [(i, "w " * r.choice([0, 1, 5, 40]), r.choice(["a", "b", "ü", "B", None, "c", "z"]), 3) for i in range(300)]
    rows += [(None, None, None, 1), (None, "x y", "a", 1), (7, "", "only-empty", 0), (5, "q " * 9, "a", 2), (5, "q " * 9, "a", 2), (999, "q " * 4000, "c", 2)]
    df = table(rows, "doc_id long, text string, source string, size int")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    mixed = mix(df)
    same(mixed.select("doc_id", "size", "source_size", "target", "taken"), OP3_SQL, SF, documents=f"{path}/*.parquet")
    by = {}
    for x in mixed.collect():
        assert x.taken <= 3 * x.size
        by.setdefault(x.source, [x.target, 0])[1] += x.taken
    assert all(abs(t - n) <= 4000 if s == "c" else abs(t - n) <= 40 for s, (t, n) in by.items())
    assert repeated(mixed).count() == sum(x.copies for x in mixed.collect())


def test_empty_table(table):
    assert mix(table([], "doc_id long, text string, source string", 1)).count() == 0
