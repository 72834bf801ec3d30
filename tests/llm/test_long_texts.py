"""Texts longer than a slice (SLICE_BYTES) in every operator, and the two queries that have no SQL against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from featurescore.llm.common import SLICE_BYTES
from featurescore.llm.decontaminate import find_leaks
from featurescore.llm.jaccard_join import linked_components, op7_jaccard_join
from featurescore.llm.language_id import identify, train
from featurescore.llm.license_scan import scan_licenses
from featurescore.llm.mixing import mix
from featurescore.llm.quality_rules import with_features
from featurescore.llm.secret_scan import scan_secrets
from featurescore.llm.suffix_dedup import op1_suffix_dedup, remove_repeats

from .test_jaccard_join import brute as linked

SF = "/root/testdata/sf0.001"


def removed(texts, length=400):
    """(bytes, removed bytes, runs, digest of the rest) of each text, every string tried."""
    raw = [(t or "").encode() for t in texts]
    digest = lambda b, i: hashlib.blake2b(b[i : i + length], digest_size=12).digest()
    seen = Counter(digest(b, i) for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone, to = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if seen[digest(b, i)] > 1:
                gone[max(i, to) : i + length] = b"\1" * (i + length - max(i, to))
                to = i + length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_op1_equals_brute_force(spark):
    rows = documents(spark)
    want = Counter((d, *x) for (d, _), x in zip(rows, removed([t for _, t in rows]), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_suffix_dedup(spark, SF).collect())
    assert got == want


def test_op7_equals_brute_force(spark):
    assert sorted([tuple(r) for r in op7_jaccard_join(spark, SF).collect()], key=str) == linked(documents(spark))


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(9)
    words = ["the", "of", "and", "nation", "here"] + ["".join(chr(97 + r.randrange(26)) for _ in range(6)) for _ in range(5000)]
    text = " ".join(r.choice(words) for _ in range(200_000))
    assert len(text) > SLICE_BYTES
    return text


def test_long_texts(spark, table, long_text):
    short = long_text[500_000:501_000]
    changed = "other words " + long_text[: -len(long_text) // 50] + ' token = "abcdefgh1234" mit license'
    rows = [(1, long_text, "a"), (2, short, "a"), (3, changed, "b"), (4, "none of it", None)]
    docs = table(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, keep_text=False).collect()}
    assert got == {d: x for (d, _, _), x in zip(rows, removed([t for _, t, _ in rows]), strict=True)}
    assert {r.doc_id: r.component_id for r in linked_components(docs.select("doc_id", "text")).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert [(s.kind, s.end - s.start) for r in scan_secrets(docs).where("doc_id = 3").collect() for s in r.secrets] == [("assign", 21)]
    assert "mit" in scan_licenses(docs).where("doc_id = 3").first().license.labels
    items = table([(7, " ".join(short.split()[20:60]))], "item_id int, text string")
    assert {r.doc_id for r in find_leaks(docs, items).collect()} == {1, 2, 3}
    assert {r.doc_id: r.size for r in mix(docs).collect()}[1] == 200_000
    counted = {r.doc_id: r.n_words for r in with_features(docs).collect()}
    assert counted[1] == 200_000 and counted[4] == 3
    model = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert {r.doc_id for r in identify(docs, model).where("score > 0 and agreement > 0").collect()} == {1, 2, 3, 4}
