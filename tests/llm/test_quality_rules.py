import re

from pyspark.sql import functions as F

from featurescore.llm.quality_rules import judge, learn, op8_quality_rules, verdict, with_features

SF = "/root/testdata/sf0.01"


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, twice = set(), set()
    for g in grams:
        (twice if g in seen else seen).add(g)
    inside = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    lines, before, dup = (t or "").split("\n"), set(), 0
    for line in lines:
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in before
        before.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op8_quality_rules(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.kept for r in out if labels.get(r.doc_id) == 1 and not r.base_failed]
    poor = [r.kept for r in out if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.3 * len(poor)


def test_edges(table):
    cases = [None, "", " \n\t", "a b c", "a b c a b c", "a b a b a b", "x y z w " * 5000, "line\nline\n\n \nline", "é € 𝄞 #*$%&|<>", "a\x0bb\x1fc\x85d e", "q " * 3]
    df = table([(i, t, 5) for i, t in enumerate(cases)], "i int, text string, n_words int")
    for r in with_features(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(cases[r.i])[:5], cases[r.i]
    none = table([], "doc_id int, quality int", 1)
    docs = table([(1, "word " * 60 + "end"), (None, None)], "doc_id int, text string", 1)
    out, rules = judge(docs, none)
    assert rules == [] and sorted(r.kept for r in out.collect()) == [False, False]
    assert judge(table([], "doc_id int, text string", 1), none)[0].count() == 0


def test_list_finds_the_planted_rule(spark):
    rows = spark.range(6000).select(F.xxhash64("id").alias("key"), (F.col("id") % 97 / 97).alias("a"), (F.col("id") % 89 / 89).alias("b"))
    rows = rows.withColumn("bad", ((F.col("a") > 0.8) & (F.col("b") <= 0.5)).cast("int"))
    rules = learn(rows, features=("a", "b"))
    assert {(c.feature, c.above) for c in rules[0]} == {("a", True), ("b", False)}
    hit = rows.withColumn("rule", verdict(rules))
    wrong = hit.where(F.col("rule").isNotNull() != (F.col("bad") == 1)).count()
    assert wrong < 0.03 * 6000
