import hashlib
import random
import re
from collections import Counter

import pytest

from featurescore.llm.suffix_dedup import op1_suffix_dedup, remove_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def words(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(table, seed):
    r = random.Random(seed)
    passage, base = words(r, 110), words(r, 600)
    texts = [None, "", "short", passage, passage, "a" * 1500, "ab" * 700, "xyz" * 130 + "q", ("the " * 120 + "\n") * 4, base, base]
    for _ in range(40):
        w = base.split()
        for _ in range(r.choice([1, 2, 5, 12])):
            w[r.randrange(len(w))] = words(r, 1)
        texts.append(" ".join(w[r.randrange(0, 50) :]))
    for _ in range(30):
        cut = r.randrange(0, 60)
        texts.append(words(r, r.randrange(0, 80)) + passage[cut:] + words(r, r.randrange(0, 80)))
    texts += [base[500:1500] + base[200:1400], "z" * 400, "z" * 399]
    df = table([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_bytes int, spans string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(df).collect()}
    want = dict(enumerate(brute(texts, 400)))
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_empty_table_and_text(table):
    assert remove_repeats(table([], "doc_id int, text string")).count() == 0
    out = remove_repeats(table([(1, "é" * 300 + "tail"), (2, "é" * 300), (None, None)], "doc_id int, text string")).collect()
    assert sorted(x.kept_text for x in out) == ["", "", "tail"]


def brute_words(texts, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    where = {}
    for d, w in enumerate(split):
        for i in range(len(w) - size + 1):
            where.setdefault(tuple(w[i : i + size]), set()).add(d)
    out = []
    for w in split:
        on = {k for i in range(len(w) - size + 1) if len(where[tuple(w[i : i + size])]) > 1 for k in range(i, i + size)}
        out.append(len(on))
    return out


def test_shared_words_equal_brute_force(table):
    r = random.Random(5)
    passage, base = words(r, 150).split(), words(r, 400).split()
    texts = [None, "", "the " * 90, "the " * 51 + "end", "a b " * 60, words(r, 120) + " " + " ".join(base[:60]) + " x " + " ".join(base[:60])]
    texts += [" ".join(passage[:50]), "\n".join(passage[:51]), " ".join(base), " ".join(base)]
    for _ in range(60):
        w = base.copy()
        for _ in range(r.choice([1, 3, 8])):
            w[r.randrange(len(w))] = words(r, 1)
        a, n = r.randrange(100), r.randrange(45, 60)
        texts += [" ".join(w[r.randrange(300) :]), words(r, r.randrange(30)) + " " + "\t\n".join(passage[a : a + n]) + " " + words(r, 9)]
    twice = words(r, 70)
    texts.append(f"{twice} | {twice}")  # only in one text
    got = {x.doc_id: x.n_shared_words for x in remove_repeats(table(list(enumerate(texts)), "doc_id int, text string"), words=50).collect()}
    want = dict(enumerate(brute_words(texts, 51)))
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert got[len(texts) - 1] == 0 and sum(v > 0 for v in got.values()) > 40


def test_query_counts_passages_under_400_bytes(table, spark, tmp_path):
    r = random.Random(6)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(55))  # 329 bytes
    texts = [f"{words(r, 40)} {passage} {words(r, 40)}" for _ in range(3)] + [words(r, 200), None]
    table(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "in" / "documents.parquet"))
    rows = sorted(op1_suffix_dedup(spark, str(tmp_path / "in")).collect())
    assert [x.n_shared_words for x in rows] == [55, 55, 55, 0, 0]
    assert [x.n_removed for x in rows] == [0] * 5  # the removal stays at 400 bytes
