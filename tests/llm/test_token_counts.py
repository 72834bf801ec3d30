import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from featurescore.llm.token_counts import ByteMerges, Counter, _vocabulary, count_tokens, op13_token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ODD = ["", "a", "aaaa" * 500, " " * 3000, "\n\n \t x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>  ", "<|endoftext", "it's we'll I'M", "　 \xa0x", "日本語" * 900, "²½Ⅷ٣ a", "é​�", "x" * 70_000, "ab" * 30_000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_library(library):
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in [*range(1, 0xD800, 13), *range(0xE000, 0x30000, 29)]]
    texts = ODD + ["".join(rng.choice(letters, n)) for n in rng.integers(1, 80, 1500)] + ["".join(rng.choice(list("etaoin shrdlu's\n"), n)) for n in rng.integers(1, 900, 500)]
    counter = Counter(_vocabulary(PATH, PATTERN))
    assert [n for i in range(0, len(texts), 100) for n in counter.counts(texts[i : i + 100])] == library(texts)


def test_every_character_is_cut_like_the_library(library):
    cut, m = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str, _vocabulary(PATH, PATTERN)
    for c in [*range(0xD800), *range(0xE000, 0x33480), *range(0xE0000, 0xE0200)]:
        for text in (f"x{chr(c)}y", f"1{chr(c)}2", f" {chr(c)} "):
            assert len(cut(text)) == len(m.pieces(text)), hex(c)


def test_small_vocabulary_by_hand():
    letters = {chr(b): b for b in range(33, 127)} | {chr(c): c for c in range(161, 173)} | {chr(c): c for c in range(174, 256)} | {chr(256 + i): 300 + i for i in range(68)}
    merges = ByteMerges({"model": {"vocab": letters | {"aa": 400, "aab": 401, "bc": 402}, "merges": ["a a", "aa b", "b c"]}}, r"\S+|\s+")
    # aaaaa: aa aa a; aabc: aab c; bcbc: bc bc
    assert Counter(merges).counts(["aaaaa", "aabc", "bcbc", "", None, "aabc bcbc"]).tolist() == [3, 2, 2, 0, 0, 5]


def test_rows(spark, table, library):
    rows = [(i, t, i % 2) for i, t in enumerate(ODD)] + [(None, "same", 7), (None, "same", 7), (50, None, 1)]
    out = count_tokens(table(rows, "doc_id long, text string, n_tokens int"), PATH, PATTERN, limit=300)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 300) for (i, t, _), n in zip(rows, library([t or "" for _, t, _ in rows]), strict=True)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    clash = table([(1, "a b", "x", 2)], "__kept long, text string, __text string, number int")
    assert tuple(count_tokens(clash, PATH, PATTERN).first()) == (1, "x", 2, 3, 2, False)
    assert count_tokens(out.where("doc_id < 0").withColumn("text", out.doc_id.cast("string")), PATH, PATTERN).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    want = dict(zip(docs, library([t or "" for t in docs.values()]), strict=True))
    assert all(r.n_tokens == want[r.doc_id] and r.n_bytes == len((docs[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 512) for r in got)
