"""Removal of long repeated byte strings, by sorting names of covered suffix samples and comparing neighbours.

A string of `length` bytes is a repeat if it also starts somewhere else, in the same text or in another. Every byte that
a repeat covers is removed. The steps are those of a difference-cover suffix sort, cut off at `length` bytes:

* Sample. A difference cover makes any two equal strings hold a sampled position at the same offset. Here the cover is
  chosen by content: a position is sampled where the hash of its next 8 bytes is least among its neighbours. Equal
  strings then hold the same samples, with 1 byte in 129 sampled instead of 2 in 3.
* Name. A sampled suffix stands for the strings around it, in cells of a block of offsets. The name of a cell is a triple:
  its offset and its core (bytes that all strings of the cell share), both in one hash, and its hull (bytes that any of
  its strings holds).
* Sort the names over all texts and compare neighbours. A cell with the name of a neighbour is a repeat throughout. One
  whose core no neighbour has holds no repeat. Where neighbours share the core only, the cells of each hull are undecided;
  one or two stand for the copies of a hull.
* Recurse on the undecided with smaller blocks; in the last round a block is one string, so that nothing is undecided.

The sort deals rows out by ranges of (name, row, offset), so that a name which fills a third of the table is spread over
many tasks; only the first and last rows of the ranges are compared apart, two of each.

Texts are stored with the numbers of their rows before the first step, so later steps may find other cores than earlier ones.
Names are pairs of independent 64-bit hashes. Defined results: a null or empty text has 0 bytes and nothing removed;
repeated rows are separate texts, so they remove each other (ties: all go, none is preferred); strings never cross texts;
an empty table gives no rows; a text of any length is held by one task, with about 100 times its bytes of numpy arrays at
the most where it is longer than a slice (SLICE_BYTES); extra columns pass through, those named like results are replaced.

Passages counted in words, which may be shorter than `length` bytes, are found apart and removed nowhere (shared_words). A
window of words belongs to its least gram; grams that one text only holds are left out, and of the others the windows with
one owner are compared as a whole first, and one by one where wholes differ.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Rolling, arrow_map, discard, materialise, mix, narrow, numbered, only, powers, slices, whole_rows, word_bounds

LENGTH = 400
#: Offsets of a cell in each round.
BLOCKS = (256, 16, 1)
GRAM = 8
#: Neighbourhoods of a sampled position on either side: the first that has a sample inside a string decides.
REACH = (64, 16)
#: Words that a passage shared with another text must exceed, and words of a gram.
PASSAGE_WORDS = 50
GRAM_WORDS = 8


def _least(v: np.ndarray, reach: int) -> np.ndarray:
    """For each i the least of v[i : i + reach], as far as v goes on."""
    out, width = v, 1
    while width < reach:
        step = min(width, reach - width)
        nxt = out.copy()
        nxt[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else nxt[:0]
        out, width = nxt, width + step
    return out


def _samples(v: np.ndarray, reach: int) -> np.ndarray:
    """Positions with a value under all of the `reach` before and not over any of the `reach` after."""
    n = len(v) - 2 * reach
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = _least(v, reach)
    mid = v[reach : reach + n]
    return np.flatnonzero((mid < low[:n]) & (mid <= low[reach + 1 : reach + 1 + n])) + reach


def _own(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, reach: int, length: int):
    """Owners of the string starts lo..hi of each range among the samples at.

    A start belongs to the first sample that has its neighbourhood inside the string. Gives runs of starts with one owner
    (owner, first start, last start), and the ranges (lo, hi) of starts that have none.
    """
    a = np.searchsorted(at, lo + reach)
    count = np.maximum(np.searchsorted(at, hi + length - reach - GRAM, side="right") - a, 0)
    r = np.repeat(np.arange(len(lo)), count)
    idx = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count) + a[r]
    k = at[idx]
    before = np.where(idx == a[r], lo[r] + reach - 1, at[idx - 1]) if len(idx) else k
    first = np.maximum(np.maximum(before - reach + 1, k + reach + GRAM - length), lo[r])
    last = np.minimum(k - reach, hi[r])
    ok = first <= last
    r, k, first, last = r[ok], k[ok], first[ok], last[ok]
    ranges = np.arange(len(lo))
    order = np.lexsort((np.concatenate([lo - 1, last, hi + 1]), np.concatenate([ranges, r, ranges])))
    starts, ends = np.concatenate([lo, first, hi + 1])[order], np.concatenate([lo - 1, last, hi + 1])[order]
    of = np.concatenate([ranges, r, ranges])[order]
    gap = (of[:-1] == of[1:]) & (ends[:-1] + 1 < starts[1:])
    return k, first, last, ends[:-1][gap] + 1, starts[1:][gap] - 1


def _cells(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, block: int) -> np.ndarray:
    """Cells of the string starts lo..hi of each range: (first start, last start, owner, core from, core to, tag)."""
    if not len(lo):
        return np.zeros((0, 6), dtype=np.int64)
    n = len(data)
    word = np.zeros(n - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        word = (word << np.uint64(8)) | data[k : n - GRAM + 1 + k]
    word = mix(word)
    out = []
    for level, reach in enumerate(REACH):
        if not len(lo):
            break
        owner, first, last, lo, hi = _own(lo, hi, _samples(word, reach), reach, length)
        near, far = (owner - last) // block, (owner - first) // block
        for k in range(int((far - near).max(initial=-1)) + 1):
            ok = near + k <= far
            p, m = owner[ok], (near + k)[ok]
            # every string of the cell starts at `to` or before and from `start` on, and holds the neighbourhood of its sample
            start, to = np.maximum(p - block * m - block + 1, p + reach + GRAM - length), np.minimum(p - block * m, p - reach)
            out.append(np.stack([np.maximum(start, first[ok]), np.minimum(to, last[ok]), p, to, start + length, 1 + m * len(REACH) + level], axis=1))
    if len(lo):
        # strings without a sample inside: each is a cell of its own
        size = hi - lo + 1
        i = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out.append(np.stack([i, i, i, i, i + length, np.zeros_like(i)], axis=1))
    return np.concatenate(out)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cell_rows(length: int, block: int, whole: bool):
    """Names of the cells of whole texts, or of the cells that a round before has left open in them."""

    def run(batches):
        for rows, data, at in slices(batches, "text"):
            if whole:
                lo, hi = at[:-1], at[1:] - length
                lo, hi = lo[hi >= lo], hi[hi >= lo]
                alone = np.ones(len(lo), dtype=bool)
            else:
                cells = rows.column("cells")
                flat, own = cells.flatten(), np.repeat(at[:-1], cells.value_lengths().to_numpy())
                lo, hi, alone = flat.field("first").to_numpy() + own, flat.field("last").to_numpy() + own, flat.field("alone").to_numpy(zero_copy_only=False)
                order = np.argsort(lo, kind="stable")
                lo, hi, alone = lo[order], hi[order], alone[order]
            c = _cells(data, lo, hi, length, block)
            if not len(c):
                continue
            text = np.searchsorted(at, c[:, 0], side="right") - 1
            core = mix(Rolling(data).of(c[:, 3], c[:, 4]) + c[:, 5].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            # where the strings of a cell start, seen from its sample, is part of its name
            ends = ((c[:, 2] - c[:, 0]) + np.int64(1 << 20) * (c[:, 2] - c[:, 1])).astype(np.uint64)
            hull = mix(Rolling(data, 1).of(c[:, 0], c[:, 1] + length) + mix(ends))
            alone = alone[np.searchsorted(lo, c[:, 0], side="right") - 1]
            # names that occur twice here are repeats already; one cell stands for them where names of all texts are compared
            order = np.lexsort((c[:, 0], hull, core))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (core[order[1:]] != core[order[:-1]]) | (hull[order[1:]] != hull[order[:-1]])
            one = np.append(new[1:], True) & new
            stands, found = order[new], np.sort(order[~np.repeat(one[new], np.diff(np.append(np.flatnonzero(new), len(new)))) & alone[order]])
            alone = alone & np.isin(np.arange(len(alone)), order[one])
            yield _rows_of(core[stands], hull[stands], c[stands], text[stands], at, alone[stands], rows, False)
            if len(found):
                found = found[np.argsort(c[found, 0], kind="stable")]
                first, last, of = c[found, 0], c[found, 1], text[found]
                apart = np.ones(len(found), dtype=bool)
                apart[1:] = (first[1:] != last[:-1] + 1) | (of[1:] != of[:-1])
                runs = np.stack([first[apart], last[np.append(np.flatnonzero(apart)[1:], len(found)) - 1]], axis=1)
                none = np.zeros(len(runs), dtype=np.uint64)
                yield _rows_of(none, none, runs, of[apart], at, np.ones(len(runs), dtype=bool), rows, True)

    return run


def _rows_of(core, hull, cells, text, at, alone, rows: pa.RecordBatch, found: bool) -> pa.RecordBatch:
    places = [pa.array((cells[:, k] - at[text]).astype(np.int32)) for k in (0, 1)]
    return pa.record_batch([_i64(core), _i64(hull), rows.column("row").take(pa.array(text)), *places, pa.array(alone), pa.array(np.full(len(text), found))], names=["core", "hull", "row", "first", "last", "alone", "found"])


def _neighbours(batches):
    """Of sorted names those that repeat a neighbour or share a core with one of another hull; the ends of the range as they are.

    Holds one row back. place is 0 for the first row of the range, 1 for the last, 2 for one that is both.
    """
    part, held, before = TaskContext.get().partitionId(), None, None

    def marked(rows: pa.RecordBatch, after: tuple | None) -> pa.RecordBatch:
        core, hull = rows.column("core").to_numpy(), rows.column("hull").to_numpy()
        whole, open_ = np.zeros(len(core), dtype=bool), np.zeros(len(core), dtype=bool)
        for mine, other in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
            same = core[mine] == core[other]
            whole[mine] |= same & (hull[mine] == hull[other])
            open_[mine] |= same & (hull[mine] != hull[other])
        place = np.full(len(core), -1, dtype=np.int32)
        for k, other in ((0, before), (-1, after)):
            if other is None:
                place[k] = 2 if place[k] >= 0 else -k
            elif other[0] == core[k]:
                (whole if other[1] == hull[k] else open_)[k] = True
        alone = rows.column("alone").to_numpy(zero_copy_only=False)
        keep = (whole & alone) | open_ | (place >= 0)
        columns = [rows.column(c) for c in ("row", "first", "last", "alone", "core", "hull")] + [pa.array(x) for x in (whole, open_, np.full(len(core), part, dtype=np.int32), place)]
        return pa.record_batch(columns, names=["row", "first", "last", "alone", "core", "hull", "whole", "open", "part", "place"]).filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield marked(held, tuple(batch.column(c)[0].as_py() for c in ("core", "hull")))
            before = tuple(held.column(c)[-1].as_py() for c in ("core", "hull"))
        held = batch
    if held is not None:
        yield marked(held, None)


def _cut(length: int, keep_text: bool):
    def run(batches):
        for rows, data, at in slices(batches, "text"):
            runs = rows.column("runs")
            # a text without runs has a null list, which holds no values
            flat, lists = runs.flatten(), np.concatenate([[0], np.cumsum(runs.value_lengths().fill_null(0).to_numpy())])
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            text = np.repeat(np.arange(len(at) - 1), np.diff(lists))
            step = np.bincount(at[text] + first, minlength=len(data) + 1) - np.bincount(at[text] + last + length, minlength=len(data) + 1)
            gone = np.cumsum(step[:-1]) > 0
            opening = np.zeros(len(data) + 1, dtype=bool)
            opening[at] = True
            start = np.flatnonzero(gone & (opening[:-1] | ~np.concatenate([[False], gone[:-1]])))
            end = np.flatnonzero(gone & (opening[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
            of = np.searchsorted(start, at)
            own = np.repeat(at[:-1], np.diff(of))
            total = np.concatenate([[0], np.cumsum(gone)])
            kept = [data[a:b] if total[a] == total[b] else data[a:b][~gone[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]
            spans = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - own), pa.array(end - own)], names=["start", "end"]))
            columns = {
                "row": rows.column("row"), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(np.diff(total[at])), "n_spans": pa.array(np.diff(of)),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in map(np.ascontiguousarray, kept)]), "spans": spans,
            }
            if keep_text:
                columns["kept_text"] = pa.array([k.tobytes().decode("utf-8", "ignore") for k in kept])
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def _compared(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (row, first, last, alone) that are repeats throughout (whole), or undecided (open), of a stored table of names.

    Gives also the table that they are read from.
    """
    order = ["core", "hull", "row", "first"]
    with narrow(cells.sparkSession):
        rows = materialise(cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, "row long, first int, last int, alone boolean, core long, hull long, whole boolean, open boolean, part int, place int"), "repeat-neighbours")
    ends = rows.where("place >= 0")
    line = Window.orderBy("part", "place")  # two rows for a range at most
    for step, places in ((F.lag, (0, 2)), (F.lead, (1, 2))):
        other = lambda c: step(c).over(line)  # noqa: B023, E731
        ends = ends.withColumns({"__core": F.col("place").isin(*places) & (F.col("core") == other("core")), "__hull": F.col("hull") == other("hull")})
        ends = ends.withColumns({"whole": F.col("whole") | F.coalesce(F.col("__core") & F.col("__hull"), F.lit(False)), "open": F.col("open") | F.coalesce(F.col("__core") & ~F.col("__hull"), F.lit(False))})
    names = ["row", "first", "last", "alone", "whole", "open"]
    return rows.where("place < 0").select(*names).union(ends.select(*names)), rows


def repeated_runs(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Runs of starts of repeated strings: (row, first, last), for texts (row long, text string)."""
    runs, source = [], texts
    for block in BLOCKS:
        cells = materialise(arrow_map(source, _cell_rows(length, block, source is texts), "core long, hull long, row long, first int, last int, alone boolean, found boolean"), "repeat-cells")
        marked, table = _compared(cells.where("not found").drop("found"))
        places = ["row", "first", "last"]
        runs.append(materialise(cells.where("found").select(*places).union(marked.where("whole and alone").select(*places)), "repeat-runs"))
        if block == 1:
            break
        left = materialise(marked.where("open").groupBy("row").agg(F.collect_list(F.struct("first", "last", (F.col("alone") & ~F.col("whole")).alias("alone"))).alias("cells")), "repeat-open")
        discard(cells)
        discard(table)
        source = only(texts, left).join(left, "row")
    return reduce(DataFrame.union, runs)


class _Tokens(Rolling):
    """Polynomial hashes of any stretch of an array of 64-bit words."""

    def __init__(self, tokens: np.ndarray, which: int = 1):
        self.which = which
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(tokens * powers(len(tokens), which))])


def _windows(data: np.ndarray, at: np.ndarray, size: int):
    """Windows of size words, in cells of those that follow each other and have one owner, the first of their least grams.

    Gives the cells (first window, last window, text, each counted over the slice), the hashes of their owners, those of all
    that they cover, the hashes of stretches of words, and the first word of each text.
    """
    starts, ends, word = word_bounds(data, at, ~SPACE)
    tokens = Rolling(data).of(starts, ends)
    hashes = _Tokens(tokens)
    count = np.maximum(np.diff(word) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    if not len(text):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), hashes, word
    i = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + word[text]
    gram = min(GRAM_WORDS, size)
    grams = np.zeros(len(tokens) - gram + 1, dtype=np.uint64)
    for k in range(gram):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + len(grams)])
    # the low bits make way for the place, so that the least one tells it, and the first of equal ones is least
    low = np.uint64((1 << 26) - 1)
    least = _least((grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low), size - gram + 1)[i]
    owner = i + ((least - i.astype(np.uint64)) & low).astype(np.int64)
    new = np.ones(len(i), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    first, last, owner = i[new], i[np.append(np.flatnonzero(new)[1:], len(i)) - 1], owner[new]
    return first, last, text[new], mix(grams[owner]), mix(hashes.of(first, last + size) + mix((owner - first).astype(np.uint64))), hashes, word


def _owners(size: int):
    def run(batches):
        for rows, data, at in slices(batches, "text"):
            _, _, text, core, _, _, _ = _windows(data, at, size)
            order = np.lexsort((core, text))
            text, core = text[order], core[order]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (core[1:] != core[:-1])
            yield pa.record_batch([_i64(core[new]), rows.column("row").take(pa.array(text[new]))], names=["core", "row"])

    return run


def _shared_cells(size: int):
    """Cells of the owners in the list cores of each text."""

    def run(batches):
        for rows, data, at in slices(batches, "text"):
            first, last, text, core, hull, _, word = _windows(data, at, size)
            cores = rows.column("cores")
            named = lambda c, of: mix(c + mix(of.astype(np.uint64)))
            of = np.repeat(np.arange(len(at) - 1), cores.value_lengths().to_numpy())
            ok = np.isin(named(core, text), named(cores.flatten().to_numpy().view(np.uint64), of))
            first, last, text, core, hull = first[ok], last[ok], text[ok], core[ok], hull[ok]
            places = [pa.array((x - word[text]).astype(np.int32)) for x in (first, last)]
            yield pa.record_batch([_i64(core), _i64(hull), rows.column("row").take(pa.array(text)), *places], names=["core", "hull", "row", "first", "last"])

    return run


def _single_windows(size: int):
    """The windows of the cells that each text has in its list cells, one by one."""

    def run(batches):
        for rows, data, at in slices(batches, "text"):
            starts, ends, word = word_bounds(data, at, ~SPACE)
            hashes, cells = _Tokens(Rolling(data).of(starts, ends)), rows.column("cells")
            flat, text = cells.flatten(), np.repeat(np.arange(len(at) - 1), cells.value_lengths().to_numpy())
            first, last = (flat.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
            count = last - first + 1
            cell = np.repeat(np.arange(len(first)), count)
            off = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
            i = (word[text] + first)[cell] + off
            taken = pa.array(cell)
            columns = {"core": flat.field("core").take(taken), "hull": flat.field("hull").take(taken), "whole": flat.field("whole").take(taken)}
            columns |= {"row": rows.column("row").take(pa.array(text[cell])), "off": pa.array(off.astype(np.int32)), "string": _i64(hashes.of(i, i + size))}
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def _covered(size: int):
    """Words that the windows of each row cover."""

    def run(batches):
        for rows in batches:
            runs = rows.column("runs")
            flat, text = runs.flatten(), np.repeat(np.arange(rows.num_rows), runs.value_lengths().to_numpy())
            first, last = (flat.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
            order = np.lexsort((last, first, text))
            text, first, end = text[order], first[order], last[order] + size
            # texts are set apart, so that the farthest end so far is never that of a text before
            apart = text * np.int64(1 << 32)
            before = np.concatenate([[0], np.maximum.accumulate(end + apart)[:-1]]) if len(end) else end
            n = np.maximum(end + apart - np.maximum(first + apart, before), 0)
            yield pa.record_batch([rows.column("row"), pa.array(np.bincount(text, n, minlength=rows.num_rows).astype(np.int64))], names=["row", "n_shared_words"])

    return run


def shared_words(texts: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """How many words of each text are in passages of over `words` words that another text holds too: (row, n_shared_words).

    For texts (row long, text string); words are runs of characters other than white space, and what is between them does
    not count. Texts without such words have no row.
    """
    size, name = words + 1, ["core", "hull"]
    owners = materialise(arrow_map(texts, _owners(size), "core long, row long"), "passage-owners")
    shared = owners.groupBy("core").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select("core")
    left = materialise(owners.join(shared, "core", "left_semi").groupBy("row").agg(F.collect_list("core").alias("cores")), "passage-texts")
    discard(owners)
    cells = materialise(arrow_map(only(texts, left).join(left, "row"), _shared_cells(size), "core long, hull long, row long, first int, last int"), "passage-cells")
    place = F.struct("row", "first", "last")
    classes = materialise(cells.groupBy(name).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).withColumn("whole", F.col("lo.row") < F.col("hi.row")), "passage-classes")
    # the windows of a class that one text holds are looked for among those of the other classes with the same owner
    mixed = classes.groupBy("core").agg(F.min("lo.row").alias("a"), F.max("hi.row").alias("b"), F.min("whole").alias("all")).where("a < b and not all").select("core")
    both = F.when(F.col("whole"), F.array("lo", "hi")).otherwise(F.array("lo"))
    stand = classes.join(mixed, "core", "left_semi").select(*name, "whole", F.explode(both).alias("at"))
    open_ = materialise(stand.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct(*name, "whole", "at.first", "at.last")).alias("cells")), "passage-open")
    singles = materialise(arrow_map(only(texts, open_).join(open_, "row"), _single_windows(size), "core long, hull long, whole boolean, row long, off int, string long"), "passage-windows")
    found = singles.groupBy("core", "string").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select("core", "string")
    parts = singles.where("not whole").join(found, ["core", "string"]).groupBy(name).agg(F.collect_set("off").alias("offs"))
    verdicts = classes.where("whole").select(*name, F.lit(None).cast("array<int>").alias("offs")).union(parts.select(*name, "offs"))
    one = F.transform("offs", lambda o: F.struct((F.col("first") + o).alias("first"), (F.col("first") + o).alias("last")))
    runs = cells.join(verdicts, name).select("row", F.explode(F.coalesce(one, F.array(F.struct("first", "last")))).alias("run"))
    out = materialise(arrow_map(runs.groupBy("row").agg(F.collect_list("run").alias("runs")), _covered(size), "row long, n_shared_words long"), "passage-words")
    for table in (left, cells, classes, open_, singles):
        discard(table)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, keep_text: bool = True, words: int | None = None) -> DataFrame:
    """The rows of docs with n_bytes, n_removed, n_spans, kept_sha256, spans (array of byte ranges) and kept_text.

    kept_text drops a character that a removal has cut in two. With words, n_shared_words counts the words in passages of
    more words than that which another row holds too; they stay. Columns of docs with these names are replaced.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"]
    # rows are numbered once, and the numbers are stored with the texts: the steps below are many jobs
    rows = numbered(docs.select(whole_rows(docs, (text, *made)).alias("doc"), docs[text].alias("own")), "repeat-texts")
    texts = rows.select("row", F.col("own").cast("string").alias("text"))
    runs = repeated_runs(texts, length).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    schema = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept_text string" * keep_text
    cut = arrow_map(texts.join(runs, "row", "left"), _cut(length, keep_text), schema)
    names = [c for c in docs.columns if c not in [*made, *(["n_shared_words"] if words is not None else [])] and (keep_text or c != text)]
    rest = rows.select("row", "doc", *(["own"] if keep_text else []))
    back = [(F.col("own") if c == text else F.col("doc").getField(c)).alias(c) for c in names]
    results = [F.col(c) for c in made if keep_text or c != "kept_text"]
    if words is None:
        return rest.join(cut, "row").select(*back, *results)
    return rest.join(cut, "row").join(shared_words(texts, words), "row", "left").select(*back, *results, F.coalesce("n_shared_words", F.lit(0).cast("long")).alias("n_shared_words"))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False, words=PASSAGE_WORDS).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words")
