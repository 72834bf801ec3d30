import re

from featurescore.llm.license_clauses import CLAUSES
from featurescore.llm.license_scan import PHRASES, detect, op9_license_scan, rules, scan_licenses
from featurescore.llm.license_signatures import GRANTS, MARKS, WARRANTIES

SF = "/root/testdata/sf0.001"


def base(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op9_license_scan(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_edges(table):
    cases = [None, "", "MIT License, mit-license; MIT\nLICENSE", "GNU General Public License general public license", "smit license", "mit", "é mit license", "x" * 300_000 + " mit license", "mit license " * 3000]
    out = {r.i: r for r in scan_licenses(table(list(enumerate(cases)), "i int, text string")).select("i", "license.*").collect()}
    for i, t in enumerate(cases):
        assert (out[i].n_words, out[i].n_base, out[i].first_word, out[i].last_word, ",".join(out[i].base_labels)) == base(t)
    assert scan_licenses(table([], "text string", 1)).count() == 0


def test_rules_and_suppression():
    assert len(rules()) > 300
    label = lambda t: [x[2] for x in detect(t.lower())]
    assert label("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert label("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert label("under the GNU Lesser General Public License v2.1") == ["lgpl-2.1"]
    assert label("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert label("SPDX-License-Identifier: MIT") == ["mit"]
    assert label("Copyright 2020 Someone. All rights reserved.") == ["copyright", "proprietary"]
    assert label("they had a license to act and the accent of cc") == []
    assert label("cc 0 1.0") == label("cc 0 1.0 licence") == ["cc0"]


def test_every_keyword_is_in_what_its_rule_matches():
    """A keyword that a match may lack would lose detections: each is a literal piece of its pattern, or of all alternatives."""
    samples = ["mit licence", "licence", "license-identifier"]
    for _, label, pattern, keyword, _ in rules():
        plain = re.sub(r"\\(.)", r"\1", pattern.pattern)
        assert keyword in plain or all(keyword not in s for s in samples) and any(keyword in v for v in variants(pattern.pattern)), (label, pattern.pattern, keyword)


def variants(p):
    """Texts of the pattern with its optional groups left out and its first alternatives taken."""
    p = re.sub(r"\\(.)", r"\1", p)
    for _ in range(5):
        p = re.sub(r"\(\?:([^()|]*)[^()]*\)\?", "", p)
        p = re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", p)
    p = re.sub(r".\?|\[([^\]])[^\]]*\]", lambda m: m[1] or ("" if m[0].endswith("?") else m[0]), p)
    return [p]


def test_signatures_of_texts():
    label = lambda t: {x[2] for x in detect(t.lower())}
    cases = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "bsd-3-clause": "Neither the name of the Example Corp. nor the names of its contributors may be used to endorse or promote products",
        "gpl-3.0-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "apache-2.0": 'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "proprietary": "No part of this publication may be reproduced", "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "cc-by-sa": "If you remix, transform, or build upon the material, you must distribute your contributions under the same license", "openssl": "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit",
        "copyright": "© 2019 Someone", "warranty-disclaimer": "sold without warranty of any kind to you",
    }
    for want, text in cases.items():
        assert want in label(text), (want, label(text))


def test_many_detections_and_long_texts():
    many = detect("cc0 and mit license, " * 2000)
    assert len(many) == 4000 and {x[2] for x in many} == {"cc0", "mit"}
    assert detect("copyright " * 100_000 + "a" * 1_000_000) == [] and len(detect("provided " * 50_000)) == 0


def test_wrapped_notices():
    notices = {
        "bsd": "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted",
        "isc": "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee",
        "zlib": "  This software is provided 'as-is', without any express or implied\n\t  warranty.",
        "gpl": "// under the terms of the GNU General\r\n// Public License",
        "cc0": "under cc 0",
        "proprietary": "All\nrights\n  reserved",
    }
    for label, text in notices.items():
        found = detect(text.lower())
        assert label in [x[2] for x in found], label
        assert all(text[s:e].strip() == text[s:e] for s, e, _, _ in found)
    text = "x\n\n  y  the mit\n * license, z"
    assert [(text[s:e], x) for s, e, x, _ in detect(text)] == [("the mit\n * license", "mit")]


def sample(p):
    """A text that a signature matches: first alternatives, optional parts left out, gaps filled with a word."""
    p = re.sub(r"\(\?:([^()|]*)[^()]*\)\?", "", p)
    for _ in range(4):
        p = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", p)
    p = re.sub(r"\.\{0,\d+\}", "", p)
    p = re.sub(r"\.\{1,\d+\}\??", "someone ", p)
    p = re.sub(r"\[[^\]]*\](?:\?|\*|\{0,2\})", "", p)
    p = re.sub(r"\[\\?([^\]])[^\]]*\]", r"\1", p)
    p = p.replace(r"\b", "").replace(r"\w+", "word")
    p = re.sub(r"\\?.\?", "", p)
    return re.sub(r"\\(.)", r"\1", p)


def test_signatures_are_written_by_hand_and_each_is_found_in_its_text():
    assert len({p for _, p, _ in (*GRANTS, *CLAUSES, *MARKS, *WARRANTIES)}) >= 300
    assert len({p for _, p, _ in CLAUSES}) == len(CLAUSES)
    for label, pattern, keyword in CLAUSES:
        text = sample(pattern)
        assert re.search(pattern, text) and keyword in text, (label, pattern, text)
        found = detect(f"before it. {text} after it")
        assert any(x[2] == label or x[0] <= 11 and x[1] >= 11 + len(text.strip()) for x in found), (label, text, found)
        # the same clause with a word changed is not that clause
        longest = max((w for w in re.findall(r"[a-z]{4,}", text) if w not in keyword), key=len, default=None)
        if longest:
            assert not re.search(pattern, text.replace(longest, longest[::-1] + "q")), (label, text)
