"""Toxicity scores by nearest labelled examples.

Examples are a bounded sample of labelled rows (`PER_CLASS` of each label, picked by a hash of the id). Terms are all
words; their document frequencies are counted over all documents. A word of the examples weighs its TF-IDF times 1 plus
its chi-squared with the label in the sample, so that words that go with the label decide, and none is left out. Every
text with words is searched against the examples by the exact cosine of these weights; words that no example holds
weigh their TF-IDF and enter the norm of the text only, by a join with the table of document frequencies. The inverted
index of the examples is cut into blocks of `BLOCK` like examples (by k-means over the same weights) and keeps the largest weight of each term and block: blocks
are visited by their bound, until none can hold a nearer example than the `K` found.

Votes are weighted by cosine and by how many rows an example stands for, and mapped to probabilities by isotonic
regression over the examples themselves, each searched without itself. Texts with no word get the share of label 1 among
examples with no word.

Defined results: null and empty texts score as texts with no word; repeated rows are rows of their own; without labels of
both kinds every score is the share of label 1 (0 if there are no labels); of equally near examples the first in the order of
blocks votes; a text of any length is read whole in one task; an empty table gives no rows; rows with conflicting labels count as label 1;
other columns stay, but for score, predicted and evidence, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, LOWER, Rolling, arrow_map, in_train, materialise, slices, unused, word_bounds

PER_CLASS = 3000
K = 15
BLOCK = 64
CUT = 0.3
#: Votes for the base rate, in cosines, so that one far example decides little.
PRIOR = 0.2
#: Centres by which like examples are put into the same blocks.
GROUPS = 32
#: Blocks that are visited before the bounds of the others are compared.
AHEAD = 4
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x61:0x7B] = True
_LETTERS[0x80:] = True


def _words(data: np.ndarray, at: np.ndarray):
    low = LOWER[data]
    starts, ends, first = word_bounds(low, at, _LETTERS)
    return low, starts, ends, Rolling(low).of(starts, ends), first


class Lookup:
    """Numbers of the vocabulary's words among word hashes."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.flags = np.zeros(1 << 20, dtype=bool)
        self.flags[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def terms(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the numbers of its terms and how often each occurs."""
        k = np.flatnonzero(self.flags[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[k]), max(0, len(self.sorted) - 1))
        ok = self.sorted[at] == hashes[k] if len(self.sorted) else np.zeros(0, dtype=bool)
        k, term = k[ok], self.order[at[ok]]
        text = np.searchsorted(first, k, side="right") - 1
        cut = np.searchsorted(text, np.arange(len(first)))
        return [np.unique(term[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def outside(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are none of the vocabulary's."""
        if not len(self.sorted):
            return np.ones(len(hashes), dtype=bool)
        return self.sorted[np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)] != hashes


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo to hi, end to end, and how many each range has."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()), n


@dataclass
class Index:
    """Block-max inverted index of unit vectors."""

    idf: np.ndarray
    n: int
    #: Examples that hold a term and their weights, by term and example; starts of the runs of a term and block in them,
    #: the largest weight of each run, its block, and the first run of each term.
    postings: tuple[np.ndarray, np.ndarray] | list
    starts: np.ndarray
    most: np.ndarray
    block: np.ndarray | None = None
    runs: np.ndarray | None = None

    @classmethod
    def build(cls, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Index:
        lengths = [len(t) for t, _ in vectors]
        term = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in vectors]])
        order = np.argsort(term, kind="stable")
        term, ids = term[order], np.repeat(np.arange(len(vectors)), lengths)[order]
        weights = np.concatenate([np.zeros(0), *[w for _, w in vectors]])[order]
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (ids[1:] // BLOCK != ids[:-1] // BLOCK)
        first = np.flatnonzero(new)
        most = np.maximum.reduceat(weights, first) if len(first) else np.zeros(0)
        return cls(idf, len(vectors), (ids.astype(np.int32), weights), np.append(first, len(term)), most, ids[first] // BLOCK, np.searchsorted(term[first], np.arange(len(idf) + 1)))

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.idf[terms]

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = self.weights(terms, counts)
        norm = np.sqrt((w * w).sum())
        return w / norm if norm > 0 else w

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, ties by number; exact."""
        if not self.n or not len(terms):
            return []
        ids, weights = self.postings
        run, n = _ranges(self.runs[terms], self.runs[terms + 1])
        x, block = np.repeat(w, n), self.block[run]
        bound = np.bincount(block, x * self.most[run], minlength=-(-self.n // BLOCK))
        order = np.argsort(-bound, kind="stable")

        def visit(blocks: np.ndarray) -> list[tuple[float, int]]:
            some = np.zeros(len(bound), dtype=bool)
            some[blocks] = True
            pick = np.flatnonzero(some[block])
            at, m = _ranges(self.starts[run[pick]], self.starts[run[pick] + 1])
            sums = np.bincount(ids[at], np.repeat(x[pick], m) * weights[at], minlength=self.n)
            if without >= 0:
                sums[without] = 0
            near = np.flatnonzero(sums > 0)
            if len(near) > k:
                near = near[sums[near] >= np.partition(sums[near], -k)[-k]]
            return [(float(sums[i]), i) for i in near.tolist()]

        best = sorted(visit(order[:AHEAD]), key=lambda s: (-s[0], s[1]))[:k]
        # a bound is a sum in another order than the cosine, so it gets a margin
        rest = order[AHEAD:]
        rest = rest[bound[rest] > 0] if len(best) < k else rest[bound[rest] >= best[k - 1][0] - 1e-9]
        return sorted(best + visit(rest), key=lambda s: (-s[0], s[1]))[:k] if len(rest) else best


def grouped(vectors: list[tuple[np.ndarray, np.ndarray]], size: int, groups: int = GROUPS, rounds: int = 8) -> np.ndarray:
    """An order of unit vectors in which like ones are near each other: by the nearest of some centres (spherical k-means).

    A block of like examples holds few terms of other kinds of text (say, of other languages), so that it is bounded well.
    """
    lengths = np.array([len(t) for t, _ in vectors], dtype=np.int64)
    if not lengths.sum():
        return np.arange(len(vectors))
    term, weight = np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors]).astype(np.float32)
    owner = np.repeat(np.arange(len(vectors)), lengths)
    # the first centres are examples at even steps
    group = np.full(len(vectors), -1)
    seeds = np.linspace(0, len(vectors) - 1, min(groups, len(vectors))).astype(np.int64)
    group[seeds] = np.arange(len(seeds))
    best = np.zeros(len(vectors), dtype=np.float32)
    for _ in range(rounds):
        sums = np.zeros((len(vectors), len(seeds)), dtype=np.float32)
        for g in range(len(seeds)):
            own = group[owner] == g
            centre = np.bincount(term[own], weight[own], minlength=size).astype(np.float32)
            norm = np.sqrt((centre * centre).sum())
            sums[:, g] = np.bincount(owner, weight * centre[term], minlength=len(vectors)) / norm if norm > 0 else 0
        group, best = sums.argmax(axis=1), sums.max(axis=1)
    return np.lexsort((-best, group))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted isotonic regression of y on x: means of x and of y in each pool."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


@dataclass
class Model:
    hashes: np.ndarray
    index: Index
    ids: list[str]
    labels: np.ndarray
    weights: np.ndarray
    base: float
    empty: float
    knots: tuple[np.ndarray, np.ndarray]
    #: Documents counted, and the stored table (term, n) of the documents that hold each word; None without examples.
    n: int = 0
    words: DataFrame | None = None

    def vote(self, near: list[tuple[float, int]]) -> float:
        sim, at = np.array([s for s, _ in near]), [i for _, i in near]
        w = sim * self.weights[at]
        return float(((w * self.labels[at]).sum() + PRIOR * self.base) / (w.sum() + PRIOR))


def _distinct(batches):
    for rows, data, at in slices(batches, "text"):
        _, _, _, hashes, first = _words(data, at)
        label = rows.column("label").to_pylist()
        parts = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.record_batch([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(label, [len(p) for p in parts]), pa.int32())], names=["term", "label"])


def _frequencies(batches):
    """How many texts of a slice hold each word."""
    for _, data, at in slices(batches, "text"):
        _, _, _, hashes, first = _words(data, at)
        parts = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        term, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.record_batch([pa.array(term.view(np.int64)), pa.array(n, pa.int64())], names=["term", "n"])


def _examples(lookup: Lookup):
    def run(batches):
        for rows, data, at in slices(batches, "text"):
            _, _, _, hashes, first = _words(data, at)
            found = lookup.terms(hashes, first)
            yield pa.record_batch([rows.column("id"), rows.column("label"), pa.array([t for t, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))], names=["id", "label", "terms", "counts"])

    return run


def _strangers(hashes: np.ndarray):
    """Rows (row, term, count) of the words of texts that no example holds."""

    def run(batches):
        lookup = Lookup(hashes)
        for rows, data, at in slices(batches, "text"):
            _, _, _, found, first = _words(data, at)
            k = np.flatnonzero(lookup.outside(found))
            text = np.searchsorted(first, k, side="right") - 1
            order = np.lexsort((found[k], text))
            text, term = text[order], found[k][order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
            at_ = np.flatnonzero(new)
            yield pa.record_batch([rows.column("row").take(pa.array(text[at_])), pa.array(term[at_].view(np.int64)), pa.array(np.diff(np.append(at_, len(k))), pa.int32())], names=["row", "term", "count"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model of the labelled rows in the training folds, fitted on a sample bounded by per_class."""
    known = labels.where(in_train(id_col) & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    base = counts.get(1, 0) / total if total else 0.0
    nothing = Model(np.zeros(0, dtype=np.uint64), Index.build(np.zeros(0), []), [], np.zeros(0), np.zeros(0), base, base, (np.array([0.0]), np.array([base])))
    if len(counts) < 2:
        return nothing
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(int(min(1.0, per_class / n) * 1_000_000))) for k, n in counts.items()])
    ids = known.where(F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("toxicity")), F.lit(1_000_000)) < share)
    # at most about twice per_class ids, so this broadcast is bounded by a parameter
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("text"))
    sample = texts.join(F.broadcast(ids), "__id").select(F.col("__id").cast("string").alias("id"), "label", "text")

    stats = arrow_map(sample, _distinct, "term long, label int").groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("ab"))
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return nothing
    n1, n = float(sizes[1]), float(sum(sizes.values()))
    a, ab = F.col("a").cast("double"), F.col("ab").cast("double")
    chi2 = n * (a * (n - n1 - ab + a) - (n1 - a) * (ab - a)) ** 2 / (n1 * (n - n1) * ab * (n - ab))
    chi2 = F.when(F.col("ab") < n, chi2).otherwise(0.0)
    words = materialise(arrow_map(texts.select("text"), _frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "toxicity-words")
    total_docs = docs.count()
    # as many words as the bounded sample has
    picked = stats.withColumn("chi2", chi2).join(words, "term").select("term", "chi2", "n").orderBy("term").toArrow()
    hashes = picked["term"].to_numpy().view(np.uint64)
    lookup = Lookup(hashes)
    idf = (np.log((total_docs + 1) / (picked["n"].to_numpy() + 1)) + 1) * (1 + picked["chi2"].to_numpy())

    rows = sorted(arrow_map(sample, _examples(lookup), "id string, label int, terms array<long>, counts array<long>").collect(), key=lambda r: (r.id, r.label, r.terms, r.counts))
    sparse = [(np.array(r.terms, dtype=np.int64), np.array(r.counts, dtype=np.int64)) for r in rows]
    blank = Index(idf, 0, [], np.zeros(0), np.zeros(0))
    order = grouped([(t, blank.unit(t, c)) for t, c in sparse], len(idf)).tolist()
    rows, sparse = [rows[i] for i in order], [sparse[i] for i in order]
    y = np.array([r.label for r in rows], dtype=float)
    w = np.where(y > 0, counts[1] / max(1.0, y.sum()), counts[0] / max(1.0, (1 - y).sum()))
    w /= w.mean()
    index = Index.build(idf, [(t, blank.unit(t, c)) for t, c in sparse])
    none = np.array([not len(t) for t, _ in sparse])
    empty = float(((w * y)[none].sum() + base) / (w[none].sum() + 1))
    model = Model(hashes, index, [r.id for r in rows], y, w, base, empty, (np.array([0.0]), np.array([base])), total_docs, words)
    # each example is searched without itself
    votes, own = [], np.flatnonzero(~none)
    for i in own.tolist():
        votes.append(model.vote(index.nearest(sparse[i][0], index.unit(*sparse[i]), K, without=i)))
    if votes:
        model.knots = isotonic(np.array(votes), y[own], w[own])
    return model


_NEAR = pa.struct([("at", pa.list_(pa.int32())), ("cosine", pa.list_(pa.float64())), ("square", pa.float64())])
_OUT = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())])))])


def _searcher(hashes: np.ndarray, index: Index):
    """The nearest examples by the cosine over words of the examples, and the square of the norm over these words."""

    def run(texts: pa.Array) -> pa.Array:
        lookup, out = Lookup(hashes), []
        for _, data, at in slices(iter([pa.record_batch([texts], names=["text"])]), "text"):
            _, _, _, found, first = _words(data, at)
            for terms, counts in lookup.terms(found, first):
                near = index.nearest(terms, index.unit(terms, counts), K)
                out.append({"at": [i for _, i in near], "cosine": [s for s, _ in near], "square": float((index.weights(terms, counts) ** 2).sum())})
        return pa.array(out, _NEAR)

    return run


def _voter(model: Model):
    """Scores from the nearest examples and the squares of the norms over known and over other words."""
    rest = replace(model, hashes=None, index=None, words=None)

    def run(nearest: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for r, other in zip(nearest.to_pylist(), others.to_pylist(), strict=True):
            share = np.sqrt(r["square"] / (r["square"] + other)) if r["square"] > 0 else 0.0
            near = [(float(s * share), i) for s, i in zip(r["cosine"], r["at"], strict=True)]
            score = float(np.clip(np.interp(rest.vote(near), *rest.knots), 0, 1)) if r["square"] + other > 0 else rest.empty
            out.append({"score": score, "evidence": [{"id": rest.ids[i], "label": int(rest.labels[i]), "cosine": s} for s, i in near]})
        return pa.array(out, _OUT)

    return run


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, predicted (int) and evidence: the nearest examples, all that vote, with their labels and cosines."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    near = F.arrow_udf(_searcher(model.hashes, model.index), "struct<at:array<int>,cosine:array<double>,square:double>")
    row, found, rest, voted = (unused(docs, c) for c in ("toxicity_row", "toxicity_near", "toxicity_rest", "toxicity_voted"))
    out = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(found, near(F.col(text).cast("string")))
    if model.words is not None:
        texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
        strange = arrow_map(texts, _strangers(model.hashes), "row long, term long, count int").join(model.words, "term", "left")
        weight = (1 + F.log("count")) * (F.log((model.n + 1) / (F.coalesce("n", F.lit(0)) + 1)) + 1)
        squares = strange.groupBy("row").agg(F.sum(weight * weight).alias(rest)).withColumnRenamed("row", row)
        out = out.join(squares, row, "left")
    else:
        out = out.withColumn(rest, F.lit(0.0))
    made = F.arrow_udf(_voter(model), "struct<score:double,evidence:array<struct<id:string,label:int,cosine:double>>>")(F.col(found), F.coalesce(rest, F.lit(0.0)))
    out = out.withColumn(voted, made).withColumns({"score": F.col(voted).getField("score"), "evidence": F.col(voted).getField("evidence")})
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int")).drop(voted, row, found, rest)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held_out, "score", "predicted", "evidence")
