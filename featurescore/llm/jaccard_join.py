"""Exact self-join of documents on the Jaccard similarity of their word shingles, as components of linked documents.

Grouped prefix join. A document is the set of its distinct shingles. All sets are ordered by one rule: frequent shingles
last (by a sketch of fixed size that counts the whole table), else by hash. Two sets that are similar enough share a
shingle among the first n - ceil(t n) + 1 of each, their prefixes.

1. Equal sets are one class. Classes with equal prefixes and equal size are one group; only groups are joined.
2. Prefix shingles are dealt out by shingle, sorted and streamed; those of a single group are dropped on the way.
3. Groups are expanded to classes. A class has two signs: for each slot of a fixed number, whether an odd number of its
   shingles fall there, and for slots as many as an eighth of its shingles or more, how many do. Two sets differ in as
   many shingles as their signs differ in all slots, at least, so pairs whose signs differ too much are no links; the
   first sign prunes pairs as they are made, the second those left. Every prefix shingle names three of its classes: two
   picked by hash, and the one with the fewest rarer shingles before it, which of near copies is that with the fewest
   changes of its own; each class is verified, on whole sets, against those with the nearest signs (links instead of
   all pairs of a group). Sets are made anew for the classes that are in pairs only.
4. Where a shingle still joins different components, all pairs between them that pass the size, position and sign
   filters are verified: those of the shingle's largest component with the rest, and of the rest. So no link between two
   components is lost, and pairs inside one component are never made.

What a shingle or a class gathers is written before it is joined with, so that a join that one key fills can be split.
Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text with fewer words than
a shingle has its whole word sequence as its one shingle; repeated rows and ids are rows of their own, with equal texts
linked; rows with a null id take part, and a component has the least of its ids that are not null; empty tables give no
rows; a text of any length is one set, held by one task; ties (pairs at the limit itself) are links; other columns are not read
by linked_components and pass through keep_one_of_each, whatever their names. The table is read more than once, so it must be a stored table.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, discard, materialise, narrow, numbered, only, shingle_sets, slices, whole_rows

WORDS = 5
#: Least similarity, in hundredths.
THRESHOLD = 80
#: Counters of the frequency sketch; the sketch is what is sent to every task, so its size is fixed.
SLOTS = 1 << 16
#: Sets are compared in this many parts of the hash space, one after the other, so that only a part is shuffled at a time.
PARTS = 4
#: Words of 64 slots of a sign.
SIGN = [f"s{k}" for k in range(8)]
_BOUNDS = [np.uint64(k * 2**64 // PARTS) for k in range(PARTS)]


def _sketch(words: int):
    def run(batches):
        counts = np.zeros(SLOTS, dtype=np.int64)
        for _, data, at in slices(batches, "text"):
            sets = shingle_sets(data, at, words)
            counts += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(slot.astype(np.int32)), pa.array(counts[slot])], names=["slot", "n"])

    return run


def _levels(texts: DataFrame, words: int) -> np.ndarray:
    """For each slot 0, or the binary logarithm of what it counts over the usual, where that is no chance."""
    counts = np.zeros(SLOTS)
    for r in arrow_map(texts, _sketch(words), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r.slot] = r.n
    usual = float(np.median(counts))
    over = counts - usual
    return np.where(over > 8 * np.sqrt(usual) + 8, np.log2(np.maximum(over, 1)).astype(int) + 1, 0).astype(np.uint8)


def _signs(sets: list[np.ndarray]) -> np.ndarray:
    """For each set len(SIGN) words; a bit is the parity of the shingles in its slot."""
    slots = 64 * len(SIGN)
    slot = (np.concatenate(sets) >> np.uint64(20)) % np.uint64(slots)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    odd = np.bincount(owner * slots + slot.astype(np.int64), minlength=len(sets) * slots) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sets), len(SIGN))


def _counts(sets: list[np.ndarray]) -> pa.Array:
    """For each set a byte for each slot of its own number of them, a power of two: how many shingles fall there, 255 at most."""
    slots = np.array([64 << max(0, (len(s) - 1).bit_length() - 9) for s in sets], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(slots)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    slot = ((np.concatenate(sets) >> np.uint64(20)) & (slots[owner] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(at[owner] + slot, minlength=at[-1]), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(counts)])


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two sets differ in at least, by their counts; the longer ones are folded to the slots of the shorter."""
    if len(x) < len(y):
        x, y = y, x
    x = np.minimum(x.reshape(-1, len(y)).sum(axis=0, dtype=np.int64), 255)
    return int(np.abs(x - y).sum())


def _alike(threshold: int):
    """Of pairs (a, b, na, nb, x, y) with sizes and counts of both those that may be links."""

    def run(batches):
        for batch in batches:
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            x, y = (batch.column(c).to_pylist() for c in "xy")
            apart = np.array([_apart(np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)) for u, v in zip(x, y, strict=True)], dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + threshold) * apart <= (100 - threshold) * both))

    return run


def _prefixes(words: int, threshold: int, levels: np.ndarray):
    def run(batches):
        for rows, data, at in slices(batches, "text"):
            out, sets = [], shingle_sets(data, at, words)
            signs = _signs(sets)
            for row, s in zip(rows.column("row").to_pylist(), sets, strict=True):
                n = len(s)
                if not n:
                    out.append((row, 0, None, None, None))
                    continue
                first = n - -(-threshold * n // 100) + 1
                level = levels[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
                prefix = s[np.lexsort((s, level))[:first]]
                group = int.from_bytes(hashlib.md5(n.to_bytes(8, "little") + prefix.tobytes()).digest()[:8], "little", signed=True)
                out.append((row, n, hashlib.md5(s.tobytes()).digest(), group, prefix.view(np.int64)))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.int64())), _counts(sets), *[pa.array(signs[:, k].copy()) for k in range(len(SIGN))]], names=["row", "n", "class", "grp", "prefix", "counts", *SIGN])

    return run


def _shared(batches):
    """Of rows sorted by token, those whose token occurs again; holds one row back at most."""
    held, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token = batch.column("token").to_numpy()
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= last is not None and token[0] == last
        held = None if keep[-1] else batch.slice(len(token) - 1)
        last = token[-1] if keep[-1] else None
        yield batch.filter(pa.array(keep))


def _sets(words: int):
    def run(batches):
        for rows, data, at in slices(batches, "text"):
            sets = shingle_sets(data, at, words)
            cuts = [[*np.searchsorted(s, _BOUNDS), len(s)] for s in sets]
            parts = [pa.array([s[c[k] : c[k + 1]].view(np.int64) for s, c in zip(sets, cuts, strict=True)], pa.list_(pa.int64())) for k in range(PARTS)]
            yield pa.record_batch([rows.column("row"), *parts], names=["row", *[f"part{k}" for k in range(PARTS)]])

    return run


def _common(batches):
    """Sizes of the intersections of two columns of sorted sets."""
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        xv, yv, xo, yo = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), x.offsets.to_numpy(), y.offsets.to_numpy()
        both = np.zeros(batch.num_rows, dtype=np.int64)
        for i in range(batch.num_rows):
            a, b = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
            if len(a) and len(b):
                k = np.searchsorted(b, a)
                both[i] = (b[np.minimum(k, len(b) - 1)] == a).sum()
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(both)], names=["a", "b", "both"])


def linked_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: (id, n_shingles, component_id); the id keeps its name."""
    # rows are numbered once, and the numbers are stored with the texts: the steps below are many jobs
    rows = numbered(docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text")), "jaccard-texts")
    return _components_of(rows, words, threshold).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _components_of(stored: DataFrame, words: int, threshold: int) -> DataFrame:
    """Rows (id, n_shingles, component_id) of a stored table of rows (row, id, text)."""
    texts = stored.select("row", "text")
    levels = _levels(texts.select("text"), words)
    sets = materialise(arrow_map(texts, _prefixes(words, threshold, levels), "row long, n long, class binary, grp long, prefix array<long>, counts binary, " + ", ".join(f"{c} long" for c in SIGN)), "jaccard-prefixes")

    # from here on the least row of a class stands for it
    heads = materialise(sets.where("n > 0").groupBy("class").agg(F.min("row").alias("head"), F.min("grp").alias("grp"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in SIGN]), "jaccard-classes")
    groups = sets.where("n > 0").groupBy("grp", "n").agg(F.first("prefix").alias("prefix"))
    tokens = groups.select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
    with narrow(stored.sparkSession):
        postings = materialise(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_shared, "grp long, n long, pos int, token long"), "jaccard-postings")

    members = heads.select("grp", "head", *SIGN)
    crowded = heads.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    whole = heads.join(crowded, "grp", "left_semi").select(F.xxhash64("grp", F.lit("group")).alias("token"), "head", "n", F.lit(0).alias("pos"), *SIGN)
    posts = materialise(postings.join(members, "grp").select("token", "head", "n", "pos", *SIGN).union(whole), "jaccard-posts")
    discard(postings)
    rows = materialise(sets.join(heads.select("class", "head"), "class", "left").select("row", "n", "head", F.when(F.col("row") == F.col("head"), F.col("counts")).alias("counts")), "jaccard-numbers")
    discard(sets)
    discard(heads)

    def needed(df: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows of df that are in pairs."""
        return only(df, pairs.select(F.col("a").alias("row")).union(pairs.select("b")), at_most=2 * pairs.count())

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialise(pairs, f"{name}-pairs")
        signs = needed(rows.where("row = head"), pairs)
        side = lambda c, n, out: signs.select(F.col("row").alias(c), F.col("n").alias(n), F.col("counts").alias(out))
        met = pairs.join(side("b", "nb", "y"), "b").join(side("a", "na", "x"), "a").select("a", "b", "na", "nb", "x", "y")
        near = materialise(arrow_map(met, _alike(threshold), "a long, b long"), f"{name}-near")
        discard(pairs)
        items = materialise(arrow_map(needed(texts, near), _sets(words), "row long, " + ", ".join(f"part{k} array<long>" for k in range(PARTS))), f"{name}-sets")
        counts = []
        for k in range(PARTS):
            part = lambda c, out: items.select(F.col("row").alias(c), F.col(f"part{k}").alias(out))  # noqa: B023, E731
            met = near.join(part("b", "y"), "b").join(part("a", "x"), "a").select("a", "b", "x", "y")
            counts.append(materialise(arrow_map(met, _common, "a long, b long, both long"), f"{name}-{k}"))
        discard(items)
        total = reduce(DataFrame.union, counts).groupBy("a", "b").agg(F.sum("both").alias("both"))
        size = needed(rows, near).select("row", "n")
        total = total.join(size.select(F.col("row").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("row").alias("b"), F.col("n").alias("nb")), "b")
        links = materialise(total.where(100 * F.col("both") >= threshold * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), name)
        for table in (near, *counts):
            discard(table)
        return links

    col = lambda side, name: F.col(f"{side}.{name}")
    apart = reduce(F.Column.__add__, [F.bit_count(col("one", c).bitwiseXOR(col("two", c))) for c in SIGN])
    both = col("one", "n") + col("two", "n")
    # Similar enough pairs are of like size, differ in few shingles and, with both sizes known, share an early one.
    early = lambda side: (100 + threshold) * (col(side, "n") - col(side, "pos")) >= threshold * both
    sizes = 100 * F.least("one.n", "two.n") >= threshold * F.greatest("one.n", "two.n")
    likely = sizes & early("one") & early("two") & ((100 + threshold) * apart <= (100 - threshold) * both)

    one = F.struct(F.xxhash64("head", "token"), "head", "n", "pos", *SIGN)
    inner = F.min_by(one, F.struct("pos", F.xxhash64("head", "token"), "head"))
    named = materialise(posts.groupBy("token").agg(F.max(one).alias("high"), F.min(one).alias("low"), inner.alias("inner")).where("high <> low"), "jaccard-named")
    picks = named.select("token", F.posexplode(F.array("high", "low", "inner")).alias("pick", "two"))
    met = posts.alias("one").join(picks, "token").where(likely & (F.col("one.head") != F.col("two.head")))
    best = met.groupBy(F.col("one.head").alias("head"), "pick").agg(F.min(F.struct(apart.alias("apart"), F.col("two.head").alias("end"))).alias("best"))
    links = verified(best.select(F.least("head", "best.end").alias("a"), F.greatest("head", "best.end").alias("b")).distinct(), "jaccard-first")
    discard(named)
    part = components(links, "a", "b", "jaccard-first")
    placed = posts.join(part.select(F.col("node").alias("head"), "root"), "head", "left").withColumn("root", F.coalesce("root", "head"))

    shares = placed.groupBy("token", "root").agg(F.count("*").alias("k"))
    largest = materialise(shares.groupBy("token").agg(F.max(F.struct("k", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("token", F.col("most.root").alias("main")), "jaccard-largest")
    open_posts = materialise(placed.join(largest, "token"), "jaccard-open")
    discard(posts)
    discard(largest)
    one, two = open_posts.where("root <> main").alias("one"), open_posts.alias("two")
    apart_roots = (F.col("one.root") < F.col("two.root")) | (F.col("two.root") == F.col("two.main"))
    meet = one.join(two, (F.col("one.token") == F.col("two.token")) & apart_roots & likely)
    more = verified(meet.select(F.least("one.head", "two.head").alias("a"), F.greatest("one.head", "two.head").alias("b")).distinct(), "jaccard-cross")
    discard(open_posts)
    final = components(links.union(more), "a", "b", "jaccard-all")

    keyed = stored.select("row", "id").join(rows.select("row", "n", "head"), "row")
    keyed = keyed.join(final.select(F.col("node").alias("head"), "root"), "head", "left").withColumn("root", F.coalesce("root", "head"))
    keyed = materialise(keyed.select("id", "n", "root"), "jaccard-rows")
    discard(rows)
    least = materialise(keyed.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id")), "jaccard-least")
    out = keyed.join(least, "root", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs without those that are linked to a row with a lesser id; all columns and names stay.

    Texts without words are linked with nothing and stay; of rows with equal ids that are linked, one stays (the first
    read), as of linked rows without an id.
    """
    rows = numbered(docs.select(whole_rows(docs).alias("doc")), "jaccard-texts")
    own = F.col("doc").getField(id_col)
    key = F.struct(own.isNull().alias("none"), own.alias("id"), F.col("row").alias("n")).alias("id")
    parts = _components_of(rows.select("row", key, F.col("doc").getField(text).cast("string").alias("text")), words, threshold)
    kept = parts.where("id = component_id").select(F.col("id.n").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
