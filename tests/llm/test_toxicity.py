import re
import zlib
from collections import Counter

import numpy as np

from featurescore.llm.toxicity import K, PRIOR, Index, isotonic, op4_toxicity, score_toxicity, train

SF = "/root/testdata/sf0.1"
#: Words of lowered texts.
WORD = r"[a-z\x80-\U0010ffff]+"


def test_search_equals_brute_force():
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 5, 40)
    blank = Index(idf, 0, [], np.zeros((0, 1), np.int64), np.zeros((0, 0)))
    draw = lambda: np.unique(rng.choice(40, rng.integers(1, 6)), return_counts=True)
    sparse = [draw() for _ in range(700)]
    index = Index.build(idf, [(t, blank.unit(t, c)) for t, c in sparse])
    dense = np.zeros((700, 40))
    for i, (t, c) in enumerate(sparse):
        dense[i, t] = blank.unit(t, c)
    for i in range(200):
        t, c = draw()
        q = np.zeros(40)
        q[t] = index.unit(t, c)
        cos = dense @ q
        got = index.nearest(t, index.unit(t, c), 15)
        want = np.sort(cos[cos > 0])[::-1][:15]
        assert np.allclose([s for s, _ in got], want) and all(abs(cos[j] - s) < 1e-9 for s, j in got)
        assert all(j != i for _, j in index.nearest(*((sparse[i][0]), index.unit(*sparse[i])), 15, without=i))


def test_isotonic():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [r for r in op4_toxicity(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    caught = [r.predicted for r in out if labels[r.doc_id]]
    clean = [r.predicted for r in out if not labels[r.doc_id]]
    print(len(caught), sum(caught), len(clean), sum(clean))
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.03 * len(clean)


def test_edges(table):
    docs = table([(i, f"word{i % 7} idiot" if i % 3 == 0 else "calm words here", 1) for i in range(400)] + [(1000, None, 1), (1001, "", 1), (None, "idiot " * 50_000, 1)], "doc_id long, text string, score int")
    labels = table([(i, int(i % 3 == 0)) for i in range(400)] + [(3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in score_toxicity(docs, train(docs, labels)).collect()}
    assert out[0].predicted == 1 and out[1].predicted == 0 and out[None].predicted == 1 and out[1000].score == out[1001].score < 0.5 and out[0].evidence[0].label == 1
    none = table([], "doc_id long, toxic int", 1)
    assert {r.score for r in score_toxicity(docs, train(docs, none)).collect()} == {0.0}
    assert score_toxicity(table([], "doc_id long, text string", 1), train(docs, labels)).count() == 0


def test_search_is_over_all_words(table):
    """Neighbours and cosines of whole texts, against brute force; words of a few examples count, and so do words of none."""
    rng = np.random.default_rng(11)
    texts = [" ".join([f"w{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (12, 2))] + ["idiot"] * (i % 4 == 0)) for i in range(160)]
    docs = table(list(enumerate(texts)) + [(500, "qqx qqy qqx"), (501, texts[5] + " qqx zzq zzq")], "doc_id long, text string")
    model = train(docs, table([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int"))
    assert len(model.hashes) == len({w for i in map(int, model.ids) for w in texts[i].split()})
    all_texts = {i: t for i, t in enumerate(texts)} | {500: "qqx qqy qqx", 501: texts[5] + " qqx zzq zzq"}
    held = {i: Counter(t.split()) for i, t in all_texts.items()}
    df = Counter(w for c in held.values() for w in c)
    some, toxic = [held[int(i)] for i in model.ids], model.labels > 0
    n, n1 = len(some), int(toxic.sum())

    def factor(w):
        ab, a = sum(w in c for c in some), sum(w in c for c, y in zip(some, toxic, strict=True) if y)
        return 1 + (n * (a * (n - n1 - ab + a) - (n1 - a) * (ab - a)) ** 2 / (n1 * (n - n1) * ab * (n - ab)) if 0 < ab < n else 0)

    factors = {w: factor(w) for w in df}
    vectors = {i: {w: (1 + np.log(x)) * (np.log((len(held) + 1) / (df[w] + 1)) + 1) * factors[w] for w, x in c.items()} for i, c in held.items()}
    norm = {i: np.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    out = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(out) == len(held)
    for i, v in vectors.items():
        want = sorted((sum(x * vectors[int(e)].get(w, 0) for w, x in v.items()) / norm[i] / norm[int(e)] for e in model.ids), reverse=True)[:K]
        got = [e.cosine for e in out[i].evidence]
        assert np.allclose(got, [x for x in want if x > 0])
        assert all(np.isclose(e.cosine, sum(x * vectors[int(e.id)].get(w, 0) for w, x in v.items()) / norm[i] / norm[int(e.id)]) for e in out[i].evidence)
    assert out[500].evidence == [] and 0 <= out[500].score <= 1


def test_query_equals_brute_force(spark):
    """Cosines with all examples, votes and scores of the whole tables, from words and formulas."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts, toxic = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    model = train(docs.select("doc_id", "text"), labels)
    words = lambda t: re.findall(WORD, t.translate({c: c + 32 for c in range(65, 91)}))
    held = {i: Counter(words(t)) for i, t in texts.items()}
    df = Counter(w for c in held.values() for w in c)
    examples = {int(i): int(y) for i, y in zip(model.ids, model.labels, strict=True)}
    # the sample is the whole of so small a table, without the held-out rows
    assert set(examples) == {i for i in toxic if i in texts and zlib.crc32(str(i).encode()) % 4 != 2} and all(examples[i] == (toxic[i] > 0) for i in examples)
    n, n1 = len(examples), sum(examples.values())
    seen, bad = Counter(w for i in examples for w in held[i]), Counter(w for i, y in examples.items() if y for w in held[i])
    chi = {w: n * (bad[w] * (n - n1 - ab + bad[w]) - (n1 - bad[w]) * (ab - bad[w])) ** 2 / (n1 * (n - n1) * ab * (n - ab)) if ab < n else 0.0 for w, ab in seen.items()}
    vectors = {i: {w: (1 + np.log(x)) * (np.log((len(held) + 1) / (df[w] + 1)) + 1) * (1 + chi.get(w, 0.0)) for w, x in c.items()} for i, c in held.items()}
    norm = {i: np.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    weight = {int(i): w for i, w in zip(model.ids, model.weights, strict=True)}
    out = {r.doc_id: r for r in op4_toxicity(spark, sf).collect()}
    assert len(out) == len(texts)
    for i, v in vectors.items():
        cos = {e: sum(x * vectors[e].get(w, 0.0) for w, x in v.items()) / norm[i] / norm[e] for e in examples if v and vectors[e]}
        want = sorted((x for x in cos.values() if x > 0), reverse=True)[:K]
        near = [(int(e.id), e.cosine, e.label) for e in out[i].evidence]
        assert np.allclose([s for _, s, _ in near], want, atol=1e-9) and all(np.isclose(cos[e], s) and y == examples[e] for e, s, y in near)
        if v:
            vote = (sum(s * weight[e] * y for e, s, y in near) + PRIOR * model.base) / (sum(s * weight[e] for e, s, _ in near) + PRIOR)
            assert np.isclose(out[i].score, np.clip(np.interp(vote, *model.knots), 0, 1), atol=1e-6)
        else:
            assert out[i].score == model.empty


def test_ties_and_repeated_rows(table):
    docs = table([(i, "idiot words" if i < 40 else "calm words") for i in range(120)] + [(200, "idiot words"), (200, "idiot words")], "doc_id long, text string")
    out = score_toxicity(docs, train(docs, table([(i, int(i < 40)) for i in range(120)], "doc_id long, toxic int"))).collect()
    assert len(out) == 122
    # all copies of an example are equally near: which of them vote does not change a score
    assert len({round(r.score, 9) for r in out if r.doc_id < 40 or r.doc_id == 200}) == 1
    assert all(len({round(e.cosine, 9) for e in r.evidence}) == 1 and {e.label for e in r.evidence} == {1} for r in out if r.doc_id == 200)
