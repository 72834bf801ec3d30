"""Ranked search of all documents for a set of items, by dense blocked multiplication of term weights and impacts.

1. Items become weighted bags of terms, stored with a number for each item. Bags of up to ITEM_TERMS terms go to every
   task; where the items have more, the documents are gone over once for each lot of items.
2. Each document becomes its length and its counts of the terms that a lot has: read once, stored, and small.
3. Collection statistics are sums over those stored rows, of all documents.
4. Each task multiplies tiles: a block of items against the terms of a vocabulary tile, in float64, times the impacts of a
   batch of documents for the same terms. All numbers are integers, and a tile ends before the sums that it could make reach
   2 ** 53, so every partial sum is exact in any order of addition; tiles are added up as 64-bit integers. A term whose own
   products could reach that bound is multiplied as integers.
5. Of each tile the k best documents of an item stay, with all that tie with the last of them until ids decide, and so
   do those of the task. Tasks hand on k rows for each item at most, which are ranked in two steps.

Terms are told apart by two 64-bit hashes. Defined results: a null or empty text has no terms and is never found, as an item or
as a document; N and L count documents with terms only; equal scores go by ascending id, a null id after all others;
repeated rows are documents of their own, and each takes a rank; items with a null or repeated id are items of their own,
so an id that repeats has each rank as often; an empty table of items or documents gives no rows. Only the named columns
are read, so others cannot clash. A text of any length is read whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Rolling, arrow_map, discard, materialise, slices, word_bounds

K = 10
#: Terms of items, repeats in one item not counted, that are sent to every task at most (about 30 bytes each).
ITEM_TERMS = 1 << 19
#: Items of a block and terms of a tile: a tile of weights is 8 MB, one of impacts 16 MB for 500 documents.
ITEM_BLOCK, TERM_TILE = 256, 4096
#: Weights (8 bytes each) that a task keeps from one batch of documents to the next.
KEPT_CELLS = 1 << 23
#: An impact is at most SCALE / 1000, which it would reach for a document of this term only, without end.
SCALE = 1_000_000_000
MOST_IMPACT = SCALE // 1000
EXACT = float(1 << 53)
#: Lots that rows of one item are dealt to before its last ranking.
SALT = 64

TERM = np.zeros(256, dtype=bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling, np.ndarray]:
    """Of the texts in data: row, start and end of each term, hashes of the lowered bytes, and the terms of each row."""
    low = LOWER[data]
    starts, ends, first = word_bounds(low, at, TERM)
    sizes = np.diff(np.append(first[:-1], len(starts)))
    return np.repeat(np.arange(len(at) - 1), sizes), starts, ends, low, sizes


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (nth, item, terms, others, counts): the two hashes of each different term of an item, and how often it occurs."""
    for batch, data, at in slices(batches, "text"):
        row, starts, ends, low, _ = _terms(data, at)
        one, two = (Rolling(low, k).of(starts, ends) for k in (0, 1))
        order = np.lexsort((two, one, row))
        row, one, two = row[order], one[order], two[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        head = np.flatnonzero(new)
        counts = np.diff(np.append(head, len(row)))
        offsets = pa.array(np.searchsorted(row[head], np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (one[head].view(np.int64), two[head].view(np.int64), counts.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column("nth"), *lists], names=["nth", "terms", "others", "counts"])


class Lot:
    """Items that are searched together: their numbers, the different terms by hash, and (item, term, count) entries by item."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.nth)
        self.nth = np.array([r.nth for r in rows], dtype=np.int64)
        sizes = np.array([len(r.terms) for r in rows], dtype=np.int64)
        flat = [np.concatenate([np.array(r[name], dtype=np.int64) for r in rows] or [np.zeros(0, dtype=np.int64)]) for name in ("terms", "others", "counts")]
        pairs = np.stack([flat[0].view(np.uint64), flat[1].view(np.uint64)], axis=1)
        known, self.term = np.unique(pairs, axis=0, return_inverse=True) if len(pairs) else (pairs, np.zeros(0, dtype=np.int64))
        self.one, self.two = np.ascontiguousarray(known[:, 0]), np.ascontiguousarray(known[:, 1])
        self.item, self.count = np.repeat(np.arange(len(rows)), sizes), flat[2]

    def find(self, one: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in starts, numbers of terms) of the terms that the lot has."""
        lo, hi = np.searchsorted(self.one, one, side="left"), np.searchsorted(self.one, one, side="right")
        there = np.flatnonzero(hi > lo)
        if not len(there):
            return there, there
        two = Rolling(low, 1).of(starts[there], ends[there])
        # terms that share the first hash are told apart by the second, in order
        number = np.full(len(there), -1, dtype=np.int64)
        for step in range(int((hi - lo)[there].max())):
            at = lo[there] + step
            same = at < hi[there]
            same[same] = self.two[at[same]] == two[same]
            number[same] = at[same]
        return there[number >= 0], number[number >= 0]


def _postings(lot: Lot):
    """Rows (doc_id, n, terms, tfs): all terms of a document counted, and its counts of the lot's terms."""

    def run(batches):
        for batch, data, at in slices(batches, "text"):
            row, starts, ends, low, sizes = _terms(data, at)
            place, term = lot.find(Rolling(low, 0).of(starts, ends), low, starts, ends)
            keys, tf = np.unique(row[place] * len(lot.one) + term, return_counts=True) if len(place) else (np.zeros(0, dtype=np.int64),) * 2
            owner = keys // max(1, len(lot.one))
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % max(1, len(lot.one)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


class Best:
    """The k best documents so far of each item: by score, then id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, dtype=np.int64)
        self.item = self.score = self.doc = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)

    def add(self, first: int, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """scores (items from first on, documents) of a tile."""
        floor = self.floor[first : first + len(scores)]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, place = np.nonzero(scores >= floor[:, None])
        if not len(item):
            return
        self.item = np.concatenate([self.item, item + first])
        self.score = np.concatenate([self.score, scores[item, place]])
        self.doc, self.null = np.concatenate([self.doc, doc[place]]), np.concatenate([self.null, null[place]])
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        owner = self.item[order]
        head = np.searchsorted(owner, owner)
        rank = np.arange(len(owner)) - head
        keep = order[rank < self.k]
        last = order[rank == self.k - 1]
        self.floor[self.item[last]] = self.score[last]
        self.item, self.score, self.doc, self.null = self.item[keep], self.score[keep], self.doc[keep], self.null[keep]


def _tiles(lot: Lot, weight: np.ndarray, first: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Tiles (terms, weights of the n items from first on, whether float64 is exact) of the terms that these items have."""
    own = (lot.item >= first) & (lot.item < first + n) & (weight[lot.term] > 0)
    item, term, value = lot.item[own] - first, lot.term[own], weight[lot.term[own]] * lot.count[own]
    terms, column = np.unique(term, return_inverse=True)
    most = np.zeros(len(terms), dtype=np.int64)
    np.maximum.at(most, column, value)
    bound = most.astype(np.float64) * MOST_IMPACT
    small, large = np.flatnonzero(bound < EXACT / 2), np.flatnonzero(bound >= EXACT / 2)
    groups = [(large[k : k + TERM_TILE], False) for k in range(0, len(large), TERM_TILE)]
    upto, lo = np.cumsum(bound[small]), 0
    while lo < len(small):
        before = upto[lo - 1] if lo else 0.0
        hi = min(lo + TERM_TILE, max(lo + 1, int(np.searchsorted(upto, before + EXACT, side="left"))))
        groups.append((small[lo:hi], True))
        lo = hi
    for columns, exact in groups:
        there = np.flatnonzero(np.isin(column, columns))
        block = np.zeros((n, len(columns)), dtype=np.float64 if exact else np.int64)
        block[item[there], np.searchsorted(columns, column[there])] = value[there]
        yield terms[columns], block, exact


def _search(lot: Lot, weight: np.ndarray, docs: int, total: int, k: int):
    """Rows (item, doc_id, score, part): of each task the k best documents of each item."""

    def run(batches):
        from pyspark import TaskContext

        best = Best(len(lot.nth), k)
        blocks = [(first, min(ITEM_BLOCK, len(lot.nth) - first)) for first in range(0, len(lot.nth), ITEM_BLOCK)]
        # tiles of weights are made again for every batch of documents where all of them would not fit
        few = len(lot.nth) * len(lot.one) <= KEPT_CELLS
        tiles = {first: list(_tiles(lot, weight, first, items)) for first, items in blocks} if few else {}
        for batch in batches:
            n, id_ = batch.column("n").to_numpy(zero_copy_only=False), batch.column("doc_id")
            sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), sizes)
            term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
            m = 25 + (75 * n * docs) // total
            impact = (SCALE * tf) // (1000 * tf + 8 * m[row])
            by_term = np.argsort(term, kind="stable")
            row, term, impact = row[by_term], term[by_term], impact[by_term]
            null, doc = id_.is_null().to_numpy(zero_copy_only=False), id_.fill_null(0).to_numpy(zero_copy_only=False)
            for first, items in blocks:
                scores = np.zeros((items, len(n)), dtype=np.int64)
                for terms, block, _ in tiles[first] if few else _tiles(lot, weight, first, items):
                    at = np.searchsorted(terms, term)
                    at[at == len(terms)] = 0
                    here = np.flatnonzero(terms[at] == term)
                    # only columns that a document of the batch has
                    used, column = np.unique(at[here], return_inverse=True)
                    if not len(used):
                        continue
                    held = np.zeros((len(used), len(n)), dtype=block.dtype)
                    held[column, row[here]] = impact[here]
                    scores += (block[:, used] @ held).astype(np.int64)
                best.add(first, scores, doc, null)
        part = np.full(len(best.item), TaskContext.get().partitionId() % SALT, dtype=np.int32)
        names = ["nth", "doc_id", "score", "part"]
        yield pa.RecordBatch.from_arrays([pa.array(lot.nth[best.item]), pa.array(best.doc, mask=best.null), pa.array(best.score), pa.array(part)], names=names)

    return run


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item; ids are numbers."""
    spark = docs.sparkSession
    named = materialise(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).withColumn("nth", F.monotonically_increasing_id()), "search-items")
    bags = materialise(arrow_map(named.select("nth", "text"), _bags, "nth long, terms array<long>, others array<long>, counts array<long>").where("size(terms) > 0"), "search-bags")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lots = -(-(bags.agg(F.sum(F.size("terms"))).first()[0] or 0) // ITEM_TERMS)
    found = spark.createDataFrame([], "nth long, doc_id long, score long, part int")
    for number in range(lots):
        lot = Lot(bags.where(F.pmod(F.xxhash64("nth"), F.lit(lots)) == number).collect())
        shared = spark.sparkContext.broadcast(lot)
        postings = materialise(arrow_map(texts, lambda batches, shared=shared: _postings(shared.value)(batches), "doc_id long, n long, terms array<int>, tfs array<int>"), "search-postings")
        docs_n, total = postings.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not docs_n:
            break
        holders = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        # a row for each term of the lot at most
        rated = holders.select("term", F.floor(1000 * F.ln((2 * F.lit(docs_n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("w")).collect()
        weight = np.zeros(len(lot.one), dtype=np.int64)
        weight[[r.term for r in rated]] = [r.w for r in rated]
        weights = spark.sparkContext.broadcast(weight)
        rows = arrow_map(postings.where("size(terms) > 0"), lambda batches, shared=shared, weights=weights, docs_n=docs_n, total=total: _search(shared.value, weights.value, docs_n, total, k)(batches), "nth long, doc_id long, score long, part int")
        found = found.union(materialise(_ranked(rows, ["nth", "part"], k).drop("rank"), "search-best"))
        discard(postings)
    return _ranked(found, ["nth"], k).join(named.select("nth", "item_id"), "nth").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS t FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_SPLIT}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term),
m AS (SELECT r, doc_id, 25 + (75 * len(t) * n_docs) // n_terms AS m FROM d, s),
c AS (SELECT i, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM c QUALIFY rank <= 10
"""
