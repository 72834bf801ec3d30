import random
import re

import pytest

from featurescore.llm import jaccard_join
from featurescore.llm.jaccard_join import keep_one_of_each, linked_components


def shingles(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(s[i]), ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=260):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    text = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, rows = text(60), [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One two "), (905, "a b c d e"), (906, "a b c d e"), (None, "one two"), (905, "A b c d e")]
    bases = [text(r.choice([8, 30, 90, 200])) for _ in range(6)]
    for i in range(n):
        kind = r.random()
        if kind < 0.6:
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 2, 3, 4, 6])):
                k = r.randrange(len(w))
                w[k : k + r.randrange(0, 3)] = text(r.randrange(0, 3))
            if r.random() < 0.3:
                w = w * 2
        elif kind < 0.85:
            w = text(r.randrange(0, 40)) + passage + text(r.randrange(0, 40))
        else:
            w = text(r.randrange(1, 120))
        rows.append((i * 7 % 1000, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(table, seed):
    rows = corpus(seed)
    got = linked_components(table(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_one_stays_of_each(table):
    rows = [(5, "a b c d e f", 1), (2, "a b c d e f", 2), (None, "a b c d e f", 3), (2, "a b c d e f", 4), (7, None, 5), (8, "", 6), (9, "other words here", 7)]
    kept = keep_one_of_each(table(rows, "doc_id long, text string, n int", 1))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted((r.doc_id, r.n) for r in kept.collect()) == [(2, 2), (7, 5), (8, 6), (9, 7)]


def test_empty_table(table):
    assert linked_components(table([], "doc_id long, text string", 1)).count() == 0


def test_pairs_of_near_copies_follow_their_number(table, monkeypatch):
    """Near copies of one text: what is verified between components grows with the copies, not with their square."""
    made, real = {}, jaccard_join.materialise

    def counted(df, name):
        made[name] = (out := real(df, name)).count()
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    r = random.Random(5)
    base = ["w%d" % r.randrange(10**6) for _ in range(180)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6])):
            w[r.randrange(len(w))] = "v%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    got = linked_components(table(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(rows)
    assert made["jaccard-first-pairs"] + made["jaccard-cross-pairs"] < 5 * len(rows)
