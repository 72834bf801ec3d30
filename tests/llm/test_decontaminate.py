import random
import re

from featurescore.llm.decontaminate import UNITS, drop_leaks, find_leaks, op6_decontaminate

SF = "/root/testdata/sf0.01"


def canonical(t):
    """Template words of a text, word by word: (template, kind, value)."""
    out, end, number = [], 0, False
    for m in re.finditer(r"[0-9A-Za-z'\x80-\U0010ffff]+", t or ""):
        w, opening = m[0], not out or re.search(r"[.!?\n:;]", t[end : m.start()])
        kind = ""
        if re.search("[0-9]", w):
            kind = "<number>"
        elif number and not opening and w.lower() in UNITS:
            kind = "<unit>"
        elif not opening and re.match(r"[A-ZÀ-ÖØ-Þ][a-z\x80-\U0010ffff]", w) and len(w.encode()) > 2:
            kind = "<name>"
        low = "".join(c.lower() if "A" <= c <= "Z" or c in "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ" else c for c in w)
        out.append((kind or low, kind, w))
        number, end = kind == "<number>" or number and not opening and w.lower() in ("square", "cubic"), m.end()
    return out


def brute(docs, items, coverage=0.5):
    out = set()
    for d, t in docs:
        doc = canonical(t)
        for i, q in items:
            item = canonical(q)
            size = min(8, len(item))
            if not size:
                continue
            spots = [k for k in range(len(item) - size + 1)]
            good = [k for k in spots if 2 * sum(not x[1] for x in item[k : k + size]) >= size] or spots
            seen = {}
            for k in good:
                for j in range(len(doc) - size + 1):
                    if [x[0] for x in doc[j : j + size]] == [x[0] for x in item[k : k + size]]:
                        seen.setdefault(j - k, []).append(k)
            at = set()
            for off, ks in seen.items():
                pairs = {(item[k + j][1], item[k + j][2], doc[off + k + j][2]) for k in ks for j in range(size) if item[k + j][1]}
                if len(pairs) == len({p[:2] for p in pairs}):
                    at |= set(ks)
            if len(at) >= coverage * len(good):
                out.add((d, i, len(at), len(good)))
    return out


ITEMS = [(1, "If Alice has 12 apples and Bob has 7 kg of apples, how many apples does Alice have left?"), (2, "what is it"), (3, None), (4, ""), (5, "Call Ann Bob Cid Dan Eve Flo Gus Hal now."), (1, "If Alice has 12 apples and Bob has 7 kg of apples, how many apples does Alice have left?")]
DOCS = [
    (1, "If Alice has 12 apples and Bob has 7 kg of apples, how many apples does Alice have left?"),
    (2, "Well. If Carol has 90 apples and Dave has 3 mg of apples, how many apples does Carol have left? So."),
    (3, "If Carol has 90 apples and Dave has 3 mg of apples, how many apples does Erin have left?"),
    (4, None), (5, ""), (6, "and what is it then"), (7, "nothing of the kind is said in this one at all"), (8, "If Alice has 12 apples and Bob has 7 kg"), (1, "If Alice has 12 apples and Bob has 7 kg of apples, how many apples does Alice have left?"),
    (9, "x y " * 40_000 + "If Zed has 1 apples and Yan has 2 km of apples, how many apples does Zed have left?"), (10, "Call Jo Bo Co Do Fo Go Ho Lo now. Call Jon Bon Con Don Fon Gon Hon Lon now"), (None, "what is it"),
]


def test_equals_brute_force(table):
    docs, items = table(DOCS, "doc_id long, text string"), table(ITEMS, "item_id int, text string")
    want = brute(DOCS, ITEMS)
    assert {(1, 1), (2, 1), (6, 2), (9, 1)} <= {x[:2] for x in want} and not {3, 4, 5, 7, 8} & {x[0] for x in want}
    for sent in (1 << 20, 0):
        got = find_leaks(docs, items, sent=sent).collect()
        assert {(r.doc_id, r.item_id, r.n_matched, r.n_windows) for r in got} == want
        assert sum(r.doc_id == 1 for r in got) == 2
        assert {r.doc_id: r.exact for r in got if r.item_id == 1} == {1: True, 2: False, 9: False}
    kept = drop_leaks(table([(d, t, 1) for d, t in DOCS], "doc_id long, text string, item_id int"), items)
    assert kept.columns == ["doc_id", "text", "item_id"] and sorted(r.doc_id for r in kept.collect()) == sorted({3, 4, 5, 7, 8} | ({10} - {x[0] for x in want}))


def test_empty_tables(table):
    docs, items = table(DOCS, "doc_id long, text string"), table([], "item_id int, text string", 1)
    assert find_leaks(docs, items).count() == 0 and drop_leaks(docs, items).count() == len(DOCS)
    assert find_leaks(table([], "doc_id long, text string", 1), table(ITEMS, "item_id int, text string")).count() == 0


def test_query_equals_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.item_id, r.n_matched, r.n_windows) for r in op6_decontaminate(spark, "/root/testdata/sf0.001").collect()}
    near = [(d, t) for d, t in docs if any(x[0] == d for x in got)] + docs[:20]
    assert brute(near, items) == {x for x in got}
    words = lambda t: re.findall(r"\S+", t.lower())
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    for d, t in docs:
        for i, q in items:
            if grams(words(q)) and grams(words(q)) <= grams(words(t or "")):
                assert any(x[:2] == (d, i) for x in got)


def test_opening_names_and_numbers_of_other_formats(table):
    items = table([(1, "Natalia sold 48 clips in the spring. Natalia then sold 24 more clips in May. How many clips did she sell?"), (2, "Anna had 1,200 red apples in her cellar. Ben bought 3.5 kg of them for a party. What is left for her now?")], "item_id int, text string")
    docs = table([
        (1, "So. Weng sold 50 clips in the spring. Weng then sold 24 more clips in May. How many clips did she sell?"),
        (2, "Zoe had 90 red apples in her cellar. Jo bought 12 kg of them for a party. What is left for her now?"),
        (3, "Weng sold 50 clips in the spring. Hong then sold 24 more clips in May. How many clips did she sell?"),
        (4, "The spring was cold. Nobody sold clips or apples in May, and what is left for her now is in the cellar."),
    ], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.exact) for r in find_leaks(docs, items).collect()} == {(1, 1, False), (2, 2, False)}


def test_items_without_id(table):
    items = table([(1, "one baker sells bread to the mill"), (None, "which river runs past the old mill"), (None, "who paid for the new bridge over it")], "item_id int, text string")
    docs = table([(1, "Tell me which river runs past the old mill or who paid for the new bridge over it"), (2, "None of it")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()] == [(1, None), (1, None)]
    assert [r.doc_id for r in drop_leaks(docs, items).collect()] == [2]


FRAMES = [
    "{a} buys {n} boxes of nails for the barn and {b} carries {m} of them up the hill. After {k} hours {a} has used half of her boxes. How many boxes does {a} still have?",
    "A train leaves the station at noon and travels {n} {u} before it stops for {k} minutes. If {a} drives {m} {u} along the same road, how far ahead of {a} is the train?",
    "{a} and {b} share a garden of {n} square {u}. {b} plants beans on {m} square {u} of it. What part of the garden is left for {a}?",
    "The tank at the mill holds {n} {u} of oil. Each day the miller {a} draws {m} {u} from it. After how many days must {a} call the merchant {b}?",
    "In the shop of {a} a coat costs {n} dollars and a hat costs {m} dollars. {b} has {k} dollars and wants two hats. How much must {b} borrow from {a}?",
]


def test_recall_of_reparameterised_questions(table):
    r = random.Random(5)
    names, units = "Anna Boris Clara Dmitri Elena Farid Grace Hugo Ines Jonas Karin Luis Maya Nikolai Olga Pedro Quentin Rosa Stefan Tara".split(), "km miles liters gallons meters yards".split()

    def asked(frame):
        a, b = r.sample(names, 2)
        number = lambda: r.choice(["7", "48", "1,250", "3.5", "960", "12"])
        return FRAMES[frame].format(a=a, b=b, u=r.choice(units), n=number(), m=number(), k=number())

    items = [(i, asked(i % len(FRAMES))) for i in range(20)]
    filler = lambda: " ".join(r.choice("the of a river stone bird walks slowly under old green trees and hears no sound".split()) for _ in range(40))
    docs = [(i, f"{filler()}. {asked(i % len(FRAMES))} {filler()}.") for i in range(100)] + [(1000 + i, f"{filler()}. {filler()} {r.choice(names)} has {r.randrange(99)} boxes of nails.") for i in range(100)]
    hit = {(x.doc_id, x.item_id % len(FRAMES)) for x in find_leaks(table(docs, "doc_id long, text string"), table(items, "item_id int, text string")).collect()}
    found = sum((i, i % len(FRAMES)) in hit for i in range(100))
    print("re-parameterised questions found:", found, "of 100")
    assert found >= 90 and not any(d >= 1000 or d % len(FRAMES) != f for d, f in hit)


def benchmark_like(n, words, seed):
    """Texts of invented words, so that none is like another."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    return [" ".join(word() for _ in range(rng.randint(*words))) + "." for _ in range(n)]


def test_recall_of_repeated_ids_passages_and_changed_words(spark, table):
    items = benchmark_like(40, (15, 60), 1)
    rows = lambda texts: table(list(enumerate(texts)), "doc_id long, text string")
    one_id, own_ids = table([(1, t) for t in items], "item_id long, text string"), table(list(enumerate(items)), "item_id long, text string")
    around = benchmark_like(80, (5, 20), 2)
    put = lambda parts: [f"{a} {p} {b}" for a, p, b in zip(around[:40], parts, around[40:], strict=True)]
    assert {r.doc_id for r in find_leaks(rows(put(items)), one_id).collect()} == set(range(40))
    first = [" ".join(t.split()[: max(13, len(t.split()) * 2 // 5)]) for t in items]
    assert len({r.doc_id for r in find_leaks(rows(put(first)), own_ids).where("doc_id = item_id").collect()}) >= 36
    changed = [" ".join("zzz" if k == len(t.split()) // 2 else w for k, w in enumerate(t.split())) for t in items]
    assert len({r.doc_id for r in find_leaks(rows(put(changed)), own_ids).where("doc_id = item_id").collect()}) >= 36
    assert find_leaks(rows(benchmark_like(300, (20, 200), 3)), own_ids).count() == 0
    # twelve words in a row of a long item are no leak
    short = [" ".join(t.split()[:12]) for t in items if len(t.split()) >= 40]
    assert find_leaks(rows(short), own_ids).count() == 0
