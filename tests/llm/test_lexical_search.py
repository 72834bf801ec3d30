import math
import re
from collections import Counter

import numpy as np
import pytest

from featurescore.llm import lexical_search as ls

from .sqlcheck import same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n_docs) // total if total else 0
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, n in Counter(TERM.findall((text or "").translate(LOW))).items() if b[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def key(r):
    return [(x is None, x or 0) for x in r]


def check(docs, items, got, k=10):
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items, k), key=key)


WORDS = ["Alpha", "beta", "ÜBER", "über", "x1", "naïve", "7", "b-c", "日本", "the", "THE"]
rng = np.random.default_rng(5)
DOCS = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 40)))) for i in range(60)] + [(100, None), (101, ""), (102, " .,! "), (None, "alpha alpha x1"), (None, "beta"), (7, "the the the"), (7, "the the the"), (103, "long " * 30000 + "needle")]
ITEMS = [(1, "alpha BETA the"), (2, "über über Über"), (3, None), (4, ""), (5, "needle in a haystack"), (5, "x1 x1 7"), (None, "日本 naïve"), (6, "the the " * 500 + "alpha")]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_brute_force(spark, table, k):
    docs, items = table(DOCS, "doc_id long, text string"), table(ITEMS, "item_id long, text string")
    out = ls.search(docs, items, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    check(DOCS, ITEMS, out.collect(), k)


def test_small_tiles_blocks_and_lots(spark, table, monkeypatch):
    docs, items = table(DOCS, "doc_id long, text string"), table(ITEMS, "item_id long, text string")
    for name, value in {"ITEM_TERMS": 5, "ITEM_BLOCK": 2, "TERM_TILE": 2, "KEPT_CELLS": 0}.items():
        monkeypatch.setattr(ls, name, value)
    check(DOCS, ITEMS, ls.search(docs, items, 4).collect(), 4)


def test_bound_of_partial_sums():
    lot = ls.Lot([])
    lot.nth, lot.item, lot.term, lot.count = np.arange(2), np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 0, 2]), np.array([3, 10**9, 2, 1, 1])
    tiles = list(ls._tiles(lot, np.array([5_000_000_000 // 3, 4, 1_000_000_000]), 0, 2))
    assert sorted(t for terms, _, _ in tiles for t in terms) == [0, 1, 2]
    for terms, block, exact in tiles:
        assert not exact or float(block.max(axis=0).sum()) * ls.MOST_IMPACT < ls.EXACT
    assert [list(terms) for terms, _, exact in tiles if not exact] == [[0]]


def test_ties_and_extra_columns(spark, table):
    docs = table([(i, "same words here", "x", 1) for i in range(40)] + [(90, "other words", "x", 1)], "doc_id long, text string, nth string, rank int")
    out = ls.search(docs, table([(1, "same same words", 5)], "item_id long, text string, score int"), 10)
    assert [r.doc_id for r in out.orderBy("rank").collect()] == list(range(10))


def test_empty_tables(spark, table):
    docs, items = table(DOCS, "doc_id long, text string"), table(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    assert ls.search(docs, none).count() == 0 and ls.search(none, items).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(ls.op11_lexical_search(spark, sf), ls.OP11_SQL, sf)
