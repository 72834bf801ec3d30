import numpy as np

from featurescore.llm import language_id as li

SF = "/root/testdata/sf0.01"


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    cell = (rng.standard_normal((9, 256)) * 0.3, rng.standard_normal((9, 3)) * 0.3, rng.standard_normal((3, 1)) * 0.1)
    data, weight = rng.integers(0, 5, (6, 4)).astype(np.uint8), rng.standard_normal((6, 3, 4)).astype(np.float32)

    def loss():
        return float((li._read(cell, data)[0] * weight).sum())

    _, steps = li._read(cell, data, True)
    for p, g in zip(cell, li._backward(cell, data, steps, weight), strict=True):
        for k in [(0, 0), (p.shape[0] - 1, p.shape[1] - 1), (p.shape[0] // 2, min(2, p.shape[1] - 1))]:
            old = p[k]
            p[k] = old + 1e-2
            up = loss()
            p[k] = old - 1e-2
            down = loss()
            p[k] = old
            assert abs((up - down) / 2e-2 - g[k]) < 2e-2


def naive(model, text):
    """Mean probabilities of a text, byte by byte in one reading of the whole, in plain formulas."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    data, states = text.encode(), []
    for cell, order in zip(model.cells, (range(len(data)), range(len(data) - 1, -1, -1)), strict=True):
        w, u, c = (x.astype(np.float64) for x in cell)
        k = u.shape[1]
        h, out = np.zeros(k), {}
        for i in order:
            x, s = w[:, data[i]], u @ h
            z, r = sigmoid(x[:k] + s[:k]), sigmoid(x[k : 2 * k] + s[k : 2 * k])
            h = z * h + (1 - z) * np.tanh(x[2 * k :] + r * (s[2 * k :] + c[:, 0]))
            out[i] = h
        states.append(out)
    wa, wb, b = model.out
    p = []
    for i in range(len(data)):
        e = np.exp(wa @ states[0][i] + wb @ states[1][i] + b[:, 0])
        p.append(e / e.sum())
    return np.mean(p, axis=0), np.bincount(np.argmax(p, axis=1), minlength=len(b)) / len(p)


def test_reading_equals_naive_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.train(docs)
    texts = [r.text for r in docs.where("text <> ''").orderBy("doc_id").limit(40).collect()]
    texts = ["a", "é", "the thing", texts[0][:200], *[t[:256] for t in texts[1:20]], *[t[:2500] for t in texts[20:]], texts[3][:700] + texts[30][:900] + texts[7][:800]]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    means, shares = li.probabilities(model, data, at)
    near = []
    for i, t in enumerate(texts):
        mean, share = naive(model, t)
        if len(t.encode()) <= li.LENGTH:
            assert np.abs(means[i] - mean).max() < 1e-4 and np.abs(shares[i] - share).max() < 1e-4 + 1 / len(t), (i, len(t))
        else:
            near.append(np.abs(means[i] - mean).max() < 0.01 and np.abs(shares[i] - share).max() < 0.02)
    # windows get their states from WARM bytes; a few texts keep a state for longer
    assert len(near) > 15 and sum(near) >= 0.9 * len(near)


def by_windows(model, text):
    """As naive(), but with the states of each window from WARM bytes before and after it."""
    data, total = text.encode(), np.zeros(len(model.languages))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    wa, wb, b = (x.astype(np.float64) for x in model.out)
    for start in range(0, len(data), li.LENGTH):
        end, states = min(len(data), start + li.LENGTH), []
        for cell, order in zip(model.cells, (range(max(0, start - li.WARM), end), range(min(len(data), end + li.WARM) - 1, start - 1, -1)), strict=True):
            w, u, c = (x.astype(np.float64) for x in cell)
            k = u.shape[1]
            h, out = np.zeros(k), {}
            for i in order:
                x, s = w[:, data[i]], u @ h
                z, r = sigmoid(x[:k] + s[:k]), sigmoid(x[k : 2 * k] + s[k : 2 * k])
                h = z * h + (1 - z) * np.tanh(x[2 * k :] + r * (s[2 * k :] + c[:, 0]))
                out[i] = h
            states.append(np.array([out[i] for i in range(start, end)]))
        e = np.exp(states[0] @ wa.T + states[1] @ wb.T + b[:, 0])
        total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
    return total / max(1, len(data))


def test_query_equals_naive_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts, model = {r.doc_id: r.text for r in docs.collect()}, li.train(docs)
    out = li.op10_language_id(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        mean = by_windows(model, text)
        # 32-bit states against 64-bit ones; of languages as likely as each other either may be named
        assert abs(r.score - mean.max()) < 1e-4 and mean[model.languages.index(r.lang_pred)] > mean.max() - 1e-4


def test_repeated_rows_and_ties_of_languages(spark, table):
    model = li.train(spark.read.parquet(f"{SF}/documents.parquet"))
    out = li.identify(table([(1, "the thing of the nation")] * 3 + [(2, "la nation")], "i int, text string"), model).collect()
    assert len(out) == 4 and len({(r.lang_pred, r.score) for r in out if r.i == 1}) == 1
    k = len(model.languages)
    flat = li.Model(model.languages, model.cells, tuple(np.zeros_like(x) for x in model.out))
    tied = li.identify(table([(1, "abc")], "i int, text string", 1), flat).first()
    assert tied.lang_pred == model.languages[0] and abs(tied.score - 1 / k) < 1e-6


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = li.op10_language_id(spark, SF).collect()
    assert len(out) == len(truth) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edges(spark, table):
    model = li.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, None, "a"), (2, "", "b"), (3, "123 -- !", "c"), (4, "the thing of the nation is here and that was it", "d"), (5, "the and of " * 30_000, "e")]
    out = {r.i: r for r in li.identify(table(rows, "i int, text string, score string"), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[5].lang_pred == "en" and 0 < out[4].score <= 1
    assert li.identify(table([], "text string", 1), model).count() == 0
    nothing = li.train(table([(1, "text", None)], "doc_id int, text string, lang string", 1))
    assert [r.lang_pred for r in li.identify(table([(1, "text")], "i int, text string", 1), nothing).collect()] == ["und"]
    runs = li.label_runs(model, "the and of the " * 40)
    assert runs[0][0] == 0 and runs[-1][1] == 600
