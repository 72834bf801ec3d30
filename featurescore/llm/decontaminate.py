"""Benchmark decontamination by template canonicalisation.

Words are folded to lower case, and numbers, units after a number (or after its square or cubic) and names (capitalised words inside a sentence) become
typed placeholders, so that a question with new numbers or names has the same template. Windows of `WINDOW` template words are
hash-joined between benchmark and documents (an item with fewer words is one window of its own length). Windows of one
document and item that lie at the same offset are one occurrence; it counts if its slots are consistent: equal values of
the item were replaced by equal values everywhere. A document is contaminated by an item if consistent occurrences
cover at least `COVERAGE` of the item's windows. All this is done with two templates, and a document that either finds
is reported (with the figures of the first if that finds it): the second reads a number with separators or decimals as
one word, and takes every capitalised word that is no function word for a name, at the start of a sentence too.
By the second template, a run of `RUN` words of the item that the document has without a gap counts too, whatever share of
the item it is, and items of under `SHORT` words have windows of `SHORT_WINDOW` words, so that one changed word leaves enough
of them. (The first does not see every name, so there short windows would step over names that are not consistent.)

Windows with more placeholders than words say nothing and are left out, as long as the item has others. Hashes of benchmark
windows go to every task only while they number `SENT` at most (8 bytes each); above it the same join is a shuffle.

Defined results: null or empty documents and items match nothing; repeated rows of documents are reported once for each
row; an item is an id with a text, so texts that share an id (or have none) are items of their own, and items that are
repeated throughout are one; an empty benchmark
or table gives no rows; a document of any length is read whole in one task; other columns are not read by find_leaks and
pass through drop_leaks, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, arrow_map, materialise, mix, numbered, slices, whole_rows, word_bounds

WINDOW = 8
COVERAGE = 0.5
#: Words in a row that are a leak by themselves.
RUN = 13
#: Items with fewer words than SHORT have windows of SHORT_WINDOW words in the second template.
SHORT, SHORT_WINDOW = 2 * RUN, 5
#: Benchmark windows whose hashes are sent to every task at most.
SENT = 1 << 20

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'"]] = True
_INSIDE[0x80:] = True
_DIGIT, _END = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_END[[*b".!?\n:;"]] = True
UNITS = "mm cm m km in inch inches ft feet yd yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur mph kmh watt watts kw volt volts hz khz mhz ghz kb mb gb tb bytes degrees celsius fahrenheit pounds ounces grams kilograms meters metres kilometers kilometres centimeters centimetres millimeters millimetres acres hectares".split()
#: Kinds of slots, as numbers.
NUMBER, UNIT, NAME = 1, 2, 3
_UNIT_BYTES = {u.encode() for u in UNITS}
#: Capitalised words that are no names in the second template.
FUNCTION = "a an the this that these those it its he she they we you i his her their our your my if when while after before since because although though as at by for from in into of on to with without during over under until and or but so then thus also each every all both some any many most no not only there here how what which who whom whose where why is are was were be been has have had do does did can could will would shall should may might must let suppose assume given find calculate compute determine".split()
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[*b".,"]] = True


def _function_hashes() -> np.ndarray:
    data = np.frombuffer("".join(FUNCTION).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in FUNCTION])
    return Rolling(data).of(np.append(0, ends[:-1]), ends)


def template(data: np.ndarray, at: np.ndarray, loose: bool = False):
    """Words of some texts, end to end: starts, ends, template hashes, slot kinds (0: a plain word), first word of each text.

    loose is the second template: whole numbers, and names wherever they stand.
    """
    whole = data
    if loose and len(data) > 2:
        inner = np.zeros(len(data), dtype=bool)
        inner[1:-1] = _SEPARATOR[data[1:-1]] & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
        inner[at[:-1][at[:-1] < len(data)]] = inner[at[1:][at[1:] > 0] - 1] = False
        whole = np.where(inner, np.uint8(48), data)
    starts, ends, first = word_bounds(whole, at, _INSIDE)
    low = LOWER[data]
    # capitals of the Latin-1 block
    wide = np.zeros(len(data), dtype=bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = np.where(wide, low + np.uint8(32), low)
    words = Rolling(low).of(starts, ends)
    kind = np.zeros(len(starts), dtype=np.int8)
    if not len(starts):
        return starts, ends, words, kind, first
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[ends] > digits[starts]
    stops = np.concatenate([[0], np.cumsum(_END[data])])
    opening = np.ones(len(starts), dtype=bool)
    opening[1:] = stops[starts[1:]] > stops[ends[:-1]]
    opening[first[:-1][first[:-1] < len(starts)]] = True
    head = data[starts]
    capital = (head >= 65) & (head <= 90)
    two = np.flatnonzero((head == 0xC3) & (ends - starts > 1))
    capital[two] = wide[starts[two] + 1]
    second = data[np.minimum(starts + np.where(head == 0xC3, 2, 1), len(data) - 1)]
    name = ~np.isin(words, _function_hashes()) & (ends - starts > 1) if loose else ~opening & (ends - starts > 2)
    kind[capital & name & ((second >= 97) & (second <= 122) | (second >= 0x80))] = NAME
    kind[number] = NUMBER
    after = np.flatnonzero(number[:-1] & ~number[1:]) + 1
    after = after[~opening[after]]
    spelled = lambda k: low[starts[k] : ends[k]].tobytes()
    after = after.tolist()
    after += [k + 1 for k in after if spelled(k) in (b"square", b"cubic") and k + 1 < len(starts) and not opening[k + 1] and not number[k + 1]]
    kind[[k for k in after if spelled(k) in _UNIT_BYTES]] = UNIT
    return starts, ends, np.where(kind > 0, mix(kind.astype(np.uint64)), words), kind, first


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    out = np.full(max(0, len(words) - size + 1), size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)])
    return out


_SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))


def window_sizes(lengths: np.ndarray, loose: bool) -> np.ndarray:
    """Words of an item's windows, for items of so many words: the whole item where it has fewer."""
    return np.minimum(lengths, np.where(loose & (lengths < SHORT), SHORT_WINDOW, WINDOW))


def _window_rows(sizes: list[int] | None, wanted: np.ndarray | None, loose: bool = False):
    """Rows (row, hash, pos, size, n, slots) of the windows of texts, those in wanted only if it is given.

    Without sizes the texts are items: see window_sizes.
    """
    flags = None
    if wanted is not None:
        flags = np.zeros(1 << 20, dtype=bool)
        flags[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def run(batches):
        for rows, data, at in slices(batches, "text"):
            starts, ends, words, kind, first = template(data, at, loose)
            plain = np.concatenate([[0], np.cumsum(kind == 0)])
            ids, out = rows.column("row"), []
            lengths = np.diff(first)
            for size in sizes if sizes is not None else sorted(set(window_sizes(lengths, loose).tolist()) - {0}):
                hashes = _window_hashes(words, size)
                ok = np.ones(len(hashes), dtype=bool)
                if flags is not None:
                    ok = flags[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
                k = np.flatnonzero(ok)
                if flags is not None:
                    hit = np.searchsorted(wanted, hashes[k])
                    k = k[wanted[np.minimum(hit, len(wanted) - 1)] == hashes[k]]
                text = np.searchsorted(first, k, side="right") - 1
                inside = k + size <= first[text + 1]
                if sizes is None:
                    inside &= window_sizes(lengths[text], loose) == size
                for w, i in zip(k[inside].tolist(), text[inside].tolist(), strict=True):
                    n_plain = int(plain[w + size] - plain[w])
                    slots = [{"at": j, "kind": int(kind[w + j]), "value": data[starts[w + j] : ends[w + j]].tobytes().decode("utf-8", "replace")} for j in range(size) if kind[w + j]] if n_plain < size else []
                    out.append((i, hashes[w], w - int(first[i]), size, n_plain, slots))
            if out:
                i, h, pos, size, n, slots = zip(*out, strict=True)
                yield pa.record_batch([ids.take(pa.array(i)), pa.array(np.array(h, dtype=np.uint64).view(np.int64)), pa.array(pos, pa.int32()), pa.array(size, pa.int32()), pa.array(n, pa.int32()), pa.array(slots, _SLOTS)], names=["row", "hash", "pos", "size", "n_plain", "slots"])

    return run


_ROWS = "hash long, pos int, size int, n_plain int, slots array<struct<at:int,kind:int,value:string>>"


def _longest_run(at: F.Column) -> F.Column:
    """How many numbers in a row follow each other by one, at most, in a sorted array."""
    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: F.Column, x: F.Column) -> F.Column:
        run = F.when(x == state["last"] + 1, state["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(at, zero, step, lambda state: state["best"])


def _hits(texts: DataFrame, items: DataFrame, coverage: float, sent: int, loose: bool) -> DataFrame:
    """Rows (row, item, n_matched, n_windows, slots) by one template, for numbered texts and items (row, text)."""
    windows = arrow_map(items, _window_rows(None, None, loose), f"row long, {_ROWS}")
    # an item made of placeholders only keeps its windows: its slots alone can tell
    useful = windows.groupBy("row").agg(F.max(F.col("n_plain") * 2 >= F.col("size")).alias("any"))
    windows = windows.join(useful, "row").where((F.col("n_plain") * 2 >= F.col("size")) | ~F.col("any")).drop("any")
    windows = materialise(windows, "benchmark-windows")
    counts = windows.groupBy("row").agg(F.countDistinct("pos").alias("n_windows"), F.first("size").alias("size"))
    sizes = [r[0] for r in windows.select("size").distinct().orderBy("size").collect()]
    hashes = windows.select("hash").distinct()
    n = hashes.count()
    wanted = np.array([r[0] for r in hashes.collect()], dtype=np.int64).view(np.uint64) if n <= sent else None
    if wanted is not None:
        wanted.sort()
    found = arrow_map(texts, _window_rows(sizes, wanted if n else None, loose), f"row long, {_ROWS}") if n else texts.sparkSession.createDataFrame([], f"row long, {_ROWS}")
    item = windows.select(F.col("row").alias("item"), "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    met = found.join(item, "hash").select("row", "item", (F.col("pos") - F.col("item_pos")).alias("offset"), "item_pos", F.expr("transform(slots, (s, i) -> struct(s.kind AS kind, item_slots[i].value AS item_value, s.value AS value))").alias("pairs"))
    # an occurrence is bounded by the item, whatever the length of the document
    seen = met.groupBy("row", "item", "offset").agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    seen = seen.where(F.size("pairs") == F.size(F.expr("array_distinct(transform(pairs, p -> struct(p.kind, p.item_value)))")))
    seen = seen.withColumn("run", _longest_run(F.array_sort("at")))
    per = seen.groupBy("row", "item").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots"), F.max("run").alias("run"))
    hits = per.join(counts.withColumnRenamed("row", "item"), "item").withColumn("n_matched", F.size("at").cast("long"))
    return hits.where((F.col("n_matched") >= coverage * F.col("n_windows")) | (F.lit(loose) & (F.col("run") + F.col("size") - 1 >= RUN))).select("row", "item", "n_matched", F.col("n_windows").cast("long").alias("n_windows"), "slots")


def _leaks(texts: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, coverage: float, sent: int) -> DataFrame:
    """Rows (row, item, n_matched, n_windows, slots, item_id) for a stored table of texts (row, text)."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    items = numbered(items, "benchmark-items")
    both = None
    for loose in (False, True):
        some = _hits(texts, items.select("row", "text"), coverage, sent, loose).withColumn("loose", F.lit(loose))
        both = some if both is None else both.union(some)
    hits = both.groupBy("row", "item").agg(F.min_by(F.struct("n_matched", "n_windows", "slots"), "loose").alias("h")).select("row", "item", "h.*")
    return hits.join(items.select(F.col("row").alias("item"), "item_id"), "item")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, sent: int = SENT) -> DataFrame:
    """One row per row of docs and item that contaminates it: (id, item_id, n_matched, n_windows, coverage, exact, slots).

    exact says whether all slots have the item's own values; slots are the replacements found (kind, item value, value).
    """
    rows = numbered(docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text")), "leak-texts")
    hits = _leaks(rows.select("row", "text"), benchmark, item_id, item_text, coverage, sent)
    out = hits.join(rows.select("row", "id"), "row")
    return out.select(
        F.col("id").alias(id_col), F.col("item_id").alias(item_id), "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("coverage"),
        (~F.exists("slots", lambda s: s["item_value"] != s["value"])).alias("exact"), "slots",
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, sent: int = SENT) -> DataFrame:
    """docs without the rows that find_leaks reports; all columns and names stay.

    Rows are stored with their numbers first, so what is found and what is dropped are the same rows.
    """
    rows = numbered(docs.select(whole_rows(docs).alias("doc")), "leak-texts")
    texts = rows.select("row", F.col("doc").getField(text).cast("string").alias("text"))
    leaks = materialise(_leaks(texts, benchmark, item_id, item_text, coverage, sent).select("row").distinct(), "leaks")
    return rows.join(leaks, "row", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
