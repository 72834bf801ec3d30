"""Language identification by a bidirectional gated recurrent network over bytes.

Two small recurrent layers read the UTF-8 bytes of each window forwards and backwards, and a softmax over both states
labels every byte. The network is trained here, in numpy, by backpropagation through time with the label of the text at
every position. It is fitted on a bounded sample of labelled rows (`PER_LANGUAGE` texts of each language, picked by a
hash of the id, `WINDOWS` windows spread over each text); all bytes of all texts are then read. The probabilities of a
text are the means over its positions. Windows of `LENGTH` bytes are read side by side, each with `WARM` bytes of its text
before it (and after it, backwards), from which it gets its states. For most texts these are the states of one reading of
the whole (probabilities within 0.01 for 95 % of long texts); the rest are texts in which a single reading would keep to a
language once entered. So the work is linear in bytes and the memory of a task is bounded.

Defined results: a null text or one without a letter gets `und` with score 0, as do all texts where nothing could be
learned; ties go to the language that is first in code point order; a text of any length is read whole in one task;
repeated rows are rows of their own; an empty table gives no rows; other columns stay, but for lang_pred, score and
agreement, which are replaced. The languages are the values of the labels, of which there are few by nature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, arrow_map, as_bytes, in_train, slices, unused

PER_LANGUAGE = 250
WINDOWS = 4
HIDDEN = 8
TRAIN_LENGTH = 64
STEPS = 400
BATCH = 128
#: Bytes of a window of the reading, bytes read before it for its state, and windows read side by side.
LENGTH = 256
WARM = 32
LANES = 768
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    #: For each direction: gate rows by byte (3H, 256), recurrent weights (3H, H), bias of the candidate (H, 1); gates are update, reset, candidate.
    cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    out: tuple[np.ndarray, np.ndarray, np.ndarray]


def _read(cell, data: np.ndarray, keep: bool = False, inside: np.ndarray | None = None):
    """States after each byte of data (T, N), zero where inside is false; with keep also what the backward pass needs."""
    w, u, c = cell
    hidden = u.shape[1]
    h = np.zeros((hidden, data.shape[1]), dtype=w.dtype)
    states, steps = np.empty((len(data), *h.shape), dtype=w.dtype), []
    x, s = np.empty((2, 3 * hidden, data.shape[1]), dtype=w.dtype)
    partial = inside is not None and ~inside.all(axis=1)
    for t, byte in enumerate(data):
        np.take(w, byte.astype(np.intp), axis=1, out=x, mode="clip")
        np.matmul(u, h, out=s)
        gates = x[: 2 * hidden]
        gates += s[: 2 * hidden]
        # the sigmoid, by way of the hyperbolic tangent
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        un, n = s[2 * hidden :], x[2 * hidden :]
        un += c
        if keep:
            steps.append((h, gates[:hidden].copy(), gates[hidden:].copy(), un.copy()))
        un *= gates[hidden:]
        n += un
        np.tanh(n, out=n)
        h = h - n
        h *= gates[:hidden]
        h += n
        if inside is not None and partial[t]:
            h *= inside[t]
        states[t] = h
        if keep:
            steps[-1] += (n.copy(),)
    return states, steps


def _backward(cell, data, steps, grads):
    """Gradients of a cell from those of its states, back through time."""
    w, u, c = cell
    hidden = u.shape[1]
    du, dc, dx = np.zeros_like(u), np.zeros_like(c), np.empty((len(data), 3 * hidden, data.shape[1]), dtype=np.float32)
    carry = np.zeros((hidden, data.shape[1]), dtype=np.float32)
    for t in range(len(data) - 1, -1, -1):
        h, z, r, un, n = steps[t]
        dh = grads[t] + carry
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn])
        ds = np.concatenate([dz, dr, dn * r])
        du += ds @ h.T
        dc += ds[2 * hidden :].sum(axis=1, keepdims=True)
        carry = dh * z + u.T @ ds
    flat = data.ravel()
    dw = np.stack([np.bincount(flat, dx[:, k].ravel(), minlength=256) for k in range(3 * hidden)])
    return [dw.astype(np.float32), du, dc]


def _softmax(x, axis):
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 11) -> Model:
    """Trains on windows (bytes, n by T), each with the number of its language, by Adam on the mean loss of all positions."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
    k = len(languages)
    params = [p for _ in range(2) for p in (small(3 * hidden, 256), small(3 * hidden, hidden), np.zeros((hidden, 1), np.float32))]
    params += [small(k, hidden), small(k, hidden), np.zeros((k, 1), np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = [np.flatnonzero(labels == i) for i in range(k)]
    for step in range(1, steps + 1):
        # languages in equal parts, whatever their share of the sample
        pick = np.concatenate([rng.choice(o, BATCH // k + 1) for o in order])
        data, y = windows[pick].T, labels[pick]
        cells = [tuple(params[:3]), tuple(params[3:6])]
        ahead, ka = _read(cells[0], data, True)
        behind, kb = _read(cells[1], data[::-1], True)
        behind = behind[::-1]
        wa, wb, b = params[6:]
        p = _softmax(wa @ ahead + wb @ behind + b, 1)
        g = p.copy()
        g[:, y, np.arange(len(y))] -= 1
        g /= g.shape[0] * g.shape[2]
        grads = _backward(cells[0], data, ka, wa.T @ g) + _backward(cells[1], data[::-1], kb, (wb.T @ g)[::-1])
        grads += [np.einsum("tkn,thn->kh", g, ahead), np.einsum("tkn,thn->kh", g, behind), g.sum(axis=(0, 2))[:, None]]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            params[i] = params[i] - (0.03 * (1 - step / (steps + 1)) + 0.001) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    params = [p.astype(np.float32) for p in params]
    return Model(languages, [tuple(params[:3]), tuple(params[3:6])], tuple(params[6:]))


def _positions(model: Model, data: np.ndarray, at: np.ndarray):
    """Probabilities of every position of some texts, end to end, by lanes of windows.

    Gives the text, start and which steps are inside, for each lane, and the probabilities (step, language, lane).
    """
    n = len(at) - 1
    counts = -(-np.diff(at) // LENGTH)
    text = np.repeat(np.arange(n), counts)
    start = at[text] + LENGTH * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    size = np.minimum(LENGTH, at[text + 1] - start)
    before, after = np.minimum(WARM, start - at[text]), np.minimum(WARM, at[text + 1] - start - size)
    padded = np.concatenate([np.full(WARM, 32, dtype=np.uint8), data, np.full(LENGTH + WARM, 32, dtype=np.uint8)])
    wa, wb, b = model.out
    by_size = np.argsort(-size, kind="stable")
    for lo in range(0, len(text), LANES):
        lanes = by_size[lo : lo + LANES]
        longest = int(size[lanes[0]])
        ahead, behind = np.arange(-WARM, longest)[:, None], np.arange(longest + WARM - 1, -1, -1)[:, None]
        block = lambda steps: padded[start[lanes] + steps + WARM]  # noqa: B023, E731
        front, _ = _read(model.cells[0], block(ahead), inside=(ahead >= -before[lanes]) & (ahead < size[lanes]))
        back, _ = _read(model.cells[1], block(behind), inside=behind < size[lanes] + after[lanes])
        scores = wa @ front[WARM:] + wb @ back[WARM:][::-1] + b
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        yield text[lanes], start[lanes], np.arange(longest)[:, None] < size[lanes], scores


def probabilities(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean label probabilities of each text, and the share of its positions with each label of their own (rows by languages)."""
    k, n = len(model.languages), len(at) - 1
    sums, votes = np.zeros((n, k)), np.zeros((n, k))
    for text, _, inside, scores in _positions(model, data, at):
        best = scores.argmax(axis=1)
        scores *= inside[:, None, :]
        total = scores.sum(axis=0)
        for j in range(k):
            sums[:, j] += np.bincount(text, total[j], minlength=n)
            votes[:, j] += np.bincount(text, ((best == j) & inside).sum(axis=0), minlength=n)
    length = np.maximum(np.diff(at), 1)[:, None]
    return sums / length, votes / length


def label_runs(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Byte runs (start, end, language) of the positions' own labels, for one text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data) or not model.languages:
        return []
    label = np.zeros(len(data), dtype=np.int64)
    for _, start, inside, scores in _positions(model, data, np.array([0, len(data)])):
        step, lane = np.nonzero(inside)
        label[start[lane] + step] = scores.argmax(axis=1)[step, lane]
    edge = np.flatnonzero(np.diff(label)) + 1
    return [(int(s), int(e), model.languages[label[s]]) for s, e in zip([0, *edge], [*edge, len(label)], strict=True)]


def _windows(batches):
    for rows, data, at in slices(batches, "text"):
        out = []
        for i, (key, lang) in enumerate(zip(rows.column("key").to_pylist(), rows.column("lang").to_pylist(), strict=True)):
            n = int(at[i + 1] - at[i])
            for k in range(min(WINDOWS, -(-n // TRAIN_LENGTH))):
                s = at[i] + max(0, n - TRAIN_LENGTH) * k // max(1, WINDOWS - 1)
                out.append((key, k, lang, data[s : min(s + TRAIN_LENGTH, at[i + 1])].tobytes().ljust(TRAIN_LENGTH, b" ")))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], names=["key", "k", "lang", "window"])


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model learned from labelled rows of the training folds; the sample it is fitted on is bounded by per_language."""
    rows = docs.where(in_train(id_col) & F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return Model([], [], ())
    share = F.coalesce(*[F.when(F.col(lang) == name, F.lit(int(min(1.0, per_language / n) * 1_000_000))) for name, n in counts.items()])
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit("language"))
    sample = rows.where(F.pmod(key, F.lit(1_000_000)) < share).select(key.alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    got = arrow_map(sample, _windows, "key long, k int, lang string, window binary").collect()
    got.sort(key=lambda r: (r.lang, r.key, r.k, bytes(r.window)))
    languages = sorted({r.lang for r in got})
    if not languages:
        return Model([], [], ())
    data = np.frombuffer(b"".join(bytes(r.window) for r in got), dtype=np.uint8).reshape(-1, TRAIN_LENGTH)
    return fit(data, np.array([languages.index(r.lang) for r in got]), languages)


def _predictor(model: Model):
    def run(texts: pa.Array) -> pa.Array:
        names, scores, shares = [], [], []
        batch = pa.record_batch([texts], names=["text"])
        for _, data, at in slices(iter([batch]), "text"):
            p, own = probabilities(model, data, at)
            best = p.argmax(axis=1)
            names += [model.languages[i] for i in best]
            scores.append(p[np.arange(len(best)), best])
            shares.append(own[np.arange(len(best)), best])
        flat = [pa.array(np.clip(np.concatenate(x), 0, 1) if x else np.zeros(0), pa.float64()) for x in (scores, shares)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), *flat], names=["lang", "score", "agreement"])

    return run


def has_letter(text) -> F.Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (its mean probability) and agreement (the share of positions labelled so themselves)."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "agreement": F.lit(0.0)})
    words = has_letter(F.col(text))
    made = F.arrow_udf(_predictor(model), "struct<lang:string,score:double,agreement:double>")(F.col(text).cast("string"))
    own = unused(docs, "language_read")
    number = lambda name: F.when(words, F.col(own).getField(name)).otherwise(0.0)
    out = docs.withColumn(own, made)
    out = out.withColumns({"lang_pred": F.when(words, F.col(own).getField("lang")).otherwise(UNKNOWN), "score": number("score"), "agreement": number("agreement")})
    return out.drop(own)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out, "lang_pred", "score", "agreement")
