"""License scan by ordered signature rules.

Signatures are regular expressions written by hand (license_signatures): sentences of grants, conditions and warranties,
notices, short names, tags and addresses; and for each license family its titles and references, with versions spelled
out. All have an order of priority. Runs of white space, with the comment signs that open a line, are one space to the
rules; spans are those of the text as it is. A text is first searched for the keywords of all rules in one pass of an
Aho-Corasick automaton; every rule has a keyword that any text it matches holds, and only rules whose keyword is there run.
Overlapping detections are resolved by interval containment: a detection that lies within one of a rule with the same or a
higher priority goes.

Counts of plain phrases are kept beside it (`PHRASES`): places where the words of a phrase stand one after the other.

Defined results: a null or empty text has no words and no labels and scores 0; positions count words from 0; labels are
distinct and sorted by code point; of detections with the same span the rule of the highest priority stays, then the first
listed; an empty table gives no rows; repeated rows are rows of their own; other columns stay, but for `license`, which is
replaced. Texts are read whole; the work of a text grows with its length and its keywords.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, LOWER, as_bytes, word_bounds
from .license_clauses import CLAUSES
from .license_signatures import GRANTS, MARKS, WARRANTIES

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[0x30:0x3A] = _WORD_BYTES[0x61:0x7B] = True
_WORD_BYTES[0x80:] = True

#: Weights of labels that say little about which license it is.
WEAK = {"copyright": 0.5, "copyleft": 0.5, "license-file": 0.5, "open-source": 0.5, "warranty-disclaimer": 0.4, "liability-disclaimer": 0.4}
#: label, spelling of the name, keyword that every form holds, versions with the spelling of each ("" for none)
FAMILIES = [
    ("mit", r"(?:the )?mit", "mit", [""]),
    ("mit-0", r"mit[ -](?:0|no attribution)", "mit", [""]),
    ("apache", r"(?:the )?apache(?: software)?", "apache", ["2.0", "1.1", "1.0", ""]),
    ("agpl", r"(?:the )?(?:gnu )?affero (?:general public|gpl)", "affero", ["3.0", "1.0", ""]),
    ("lgpl", r"(?:the )?(?:gnu )?(?:lesser|library) general public", "general public", ["3.0", "2.1", "2.0", ""]),
    ("gpl", r"(?:the )?(?:gnu )?general public", "general public", ["3.0", "2.0", "1.0", ""]),
    ("gfdl", r"(?:the )?(?:gnu )?free documentation", "free documentation", ["1.3", "1.2", "1.1", ""]),
    ("bsd", r"(?:the )?(?:new |modified |simplified |revised )?bsd", "bsd", ["4-clause", "3-clause", "2-clause", "0-clause", ""]),
    ("mpl", r"(?:the )?mozilla public", "mozilla", ["2.0", "1.1", "1.0", ""]),
    ("epl", r"(?:the )?eclipse public", "eclipse", ["2.0", "1.0", ""]),
    ("edl", r"(?:the )?eclipse distribution", "eclipse", ["1.0", ""]),
    ("cddl", r"(?:the )?common development and distribution", "common development", ["1.1", "1.0", ""]),
    ("cpl", r"(?:the )?common public", "common public", ["1.0", ""]),
    ("eupl", r"(?:the )?european union public", "european union", ["1.2", "1.1", "1.0", ""]),
    ("osl", r"(?:the )?open software", "open software", ["3.0", "2.1", "2.0", "1.0", ""]),
    ("afl", r"(?:the )?academic free", "academic free", ["3.0", "2.1", "2.0", "1.1", ""]),
    ("artistic", r"(?:the )?artistic", "artistic", ["2.0", "1.0", ""]),
    ("bsl", r"(?:the )?boost software", "boost", ["1.0", ""]),
    ("zlib", r"(?:the )?zlib", "zlib", [""]),
    ("isc", r"(?:the )?isc", "isc", [""]),
    ("psf", r"(?:the )?python software foundation", "python", ["2.0", ""]),
    ("ofl", r"(?:the )?(?:sil )?open font", "open font", ["1.1", "1.0", ""]),
    ("ecl", r"(?:the )?educational community", "educational", ["2.0", "1.0", ""]),
    ("ms-pl", r"(?:the )?microsoft public", "microsoft", [""]),
    ("ms-rl", r"(?:the )?microsoft reciprocal", "microsoft", [""]),
    ("upl", r"(?:the )?universal permissive", "universal permissive", ["1.0", ""]),
    ("wtfpl", r"(?:the )?do what the fuck you want to public", "do what the fuck", ["2.0", ""]),
    ("unlicense", r"(?:the )?unlicense", "unlicense", [""]),
    ("bsl-business", r"(?:the )?business source", "business source", ["1.1", ""]),
    ("sspl", r"(?:the )?server side public", "server side", ["1.0", ""]),
    ("elastic", r"(?:the )?elastic", "elastic", ["2.0", ""]),
    ("polyform", r"(?:the )?polyform (?:noncommercial|small business|shield|strict)", "polyform", ["1.0.0", ""]),
    ("odbl", r"(?:the )?open (?:data commons open )?database", "open d", ["1.0", ""]),
    ("openrail", r"(?:the )?(?:creativeml )?open ?rail(?:[+ -]?[ms]+)?", "rail", [""]),
    ("llama", r"(?:the )?llama (?:[23](?:\.\d)? )?community", "llama", [""]),
    ("vim", r"(?:the )?vim", "vim", [""]),
    ("php", r"(?:the )?php", "php", ["3.01", "3.0", ""]),
    ("ruby", r"(?:the )?ruby", "ruby", [""]),
    ("postgresql", r"(?:the )?postgresql", "postgresql", [""]),
    ("curl", r"(?:the )?curl", "curl", [""]),
    ("openssl", r"(?:the )?openssl", "openssl", [""]),
    ("ncsa", r"(?:the )?(?:university of illinois/?)?ncsa(?: open source)?", "ncsa", [""]),
    ("x11", r"(?:the )?x11", "x11", [""]),
    ("w3c", r"(?:the )?w3c software(?: notice and)?", "w3c", [""]),
]
#: Creative Commons: label, spelling, long name
COMMONS = [("cc-by-nc-nd", "by-nc-nd", "attribution-noncommercial-noderiv(?:ative)?s"), ("cc-by-nc-sa", "by-nc-sa", "attribution-noncommercial-sharealike"), ("cc-by-nc", "by-nc", "attribution-noncommercial"), ("cc-by-nd", "by-nd", "attribution-noderiv(?:ative)?s"), ("cc-by-sa", "by-sa", "attribution-sharealike"), ("cc-by", "by", "attribution")]
@cache
def rules() -> list[tuple[int, str, re.Pattern, str, float]]:
    """(priority, label, pattern, keyword, weight), the most specific first; several hundred."""
    out = []

    def add(rank, label, pattern, keyword, weight):
        out.append((rank, label, re.compile(pattern), keyword, weight))

    for label, name, keyword, versions in FAMILIES:
        for version in versions:
            spelled = re.escape(version)
            if version and version.endswith(".0"):
                spelled = f"{re.escape(version[:-2])}(?:\\.0)?"
            of = rf",? ?\(?(?:the )?(?:v|version|ver\.)? ?{spelled}(?![\d.]*\d)" if version else ""
            clause = version.endswith("clause")
            full = rf"{name}[ -]{spelled}[ -]licen[cs]e" if clause else rf"{name} (?:public )?licen[cs]e\b{of}"
            own = label if not version else f"{label}-{version}"
            rank = 0 if version else 5
            add(rank, own, rf"\bspdx-license-identifier: ?{re.escape(label)}{('-' + spelled) if version else ''}(?:-only|-or-later|\+)?\b", "spdx", 1.0)
            add(rank + 1, own, rf"\b(?:licensed|released|distributed|available|published) (?:under|according to) (?:the terms of )?{full}", keyword, 1.0)
            add(rank + 2, own, rf"\b(?:terms|conditions) of {full}", keyword, 0.9)
            add(rank + 3, own, rf"\b{full}", keyword, 0.8)
    for label, short, long in COMMONS:
        for version in ("4.0", "3.0", "2.5", "2.0", "1.0", ""):
            own, v = (f"{label}-{version}", re.escape(version)) if version else (label, "")
            rank = 0 if version else 5
            add(rank + 1, own, rf"\b(?:licensed|released|distributed|available) under (?:an? |the )?cc[ -]{short}\b[ -]?{v}", "cc", 1.0)
            add(rank + 2, own, rf"\bcc[ -]{short}(?!-)\b[ -]?{v}", "cc", 0.8)
            add(rank + 2, own, rf"creativecommons\.org/licenses/{short}/{v}", "creativecommons", 1.0)
            add(rank + 3, own, rf"\bcreative commons {long}(?!-)(?: {v})?(?: (?:international|unported|generic))? licen[cs]e ?{v}", "creative commons", 0.9)
    for rank, weight, signatures in ((1, 1.0, GRANTS), (1, 1.0, CLAUSES), (4, 0.9, MARKS), (6, 0.6, WARRANTIES)):
        for label, pattern, keyword in signatures:
            add(rank, label, pattern, keyword, WEAK.get(label, weight))
    return sorted(out, key=lambda r: r[0])


@cache
def _keywords() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r[3], []).append(i)
    found = ahocorasick.Automaton()
    for k in by:
        found.add_word(k, k)
    found.make_automaton()
    return found, by


_GAP = re.compile(r"[^\S\n]*\n\s*(?:(?:<!--|/\*+|\*+/?|//+|#+|;+|--+|%+|>+)\s*)*|\s\s+|[^\S ]")


def _fold(text: str) -> tuple[str, list[int], list[int]]:
    """The text with its gaps as single spaces, the places after these, and what to add to a place from there on."""
    parts, places, shifts, at, shift = [], [], [], 0, 0
    for m in _GAP.finditer(text):
        parts.append(text[at : m.start()])
        at = m.end()
        places.append(m.start() - shift + 1)
        shift += m.end() - m.start() - 1
        shifts.append(shift)
    return " ".join([*parts, text[at:]]), places, shifts


def detect(low: str) -> list[tuple[int, int, str, float]]:
    """Detections (start, end, label, weight) in a lower-cased text, by start, after suppression."""
    folded, places, shifts = _fold(low)

    def back(i: int) -> int:
        k = bisect_right(places, i)
        return i + shifts[k - 1] if k else i

    return [(back(s), back(e - 1) + 1, label, weight) for s, e, label, weight in _detect(folded)]


def _detect(low: str) -> list[tuple[int, int, str, float]]:
    automaton, by = _keywords()
    present = {k for _, k in automaton.iter(low)}
    hits = []
    for i in sorted(i for k in present for i in by.get(k, ())):
        rank, label, pattern, _, weight = rules()[i]
        hits += [(m.start(), m.end(), rank, i, label, weight) for m in pattern.finditer(low) if m.end() > m.start()]
    kept: list[tuple] = []
    # widest first; an open detection that ends later contains the next one if its priority is no lower
    best: list[tuple] = []
    for h in sorted(hits, key=lambda h: (h[0], -h[1], h[2], h[3])):
        best = [b for b in best if b[1] > h[0]]
        if not any(b[1] >= h[1] and b[2] <= h[2] for b in best):
            kept.append(h)
            best.append(h)
    # whatever contains a detection starts before it or sorts before it, so it has been seen
    return [(s, e, label, weight) for s, e, _, _, label, weight in kept]


_TYPE = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:array<string>,labels:array<string>,score:double,found:array<struct<start:long,end:long,label:string>>>"
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("found", _FOUND)])


def _scan_slice(column: pa.Array) -> list[dict]:
    data, at = as_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, at, _WORD_BYTES)
    out = []
    for i in range(len(at) - 1):
        raw = data[at[i] : at[i + 1]].tobytes()
        lo, hi = first[i], first[i + 1]
        places, labels = [], set()
        for phrase, label in PHRASES.items():
            words = [w.encode() for w in phrase.split()]
            if any(w not in raw for w in words):
                continue
            # word numbers at which the last and so, going back, all words of the phrase stand
            k = np.flatnonzero(ends[lo:hi] - starts[lo:hi] == len(words[0]))
            for n in k.tolist():
                if n + len(words) <= hi - lo and all(data[starts[lo + n + j] : ends[lo + n + j]].tobytes() == w for j, w in enumerate(words)):
                    places.append(n)
                    labels.add(label)
        found = detect(raw.decode())
        everything = labels | {x[2] for x in found}
        score = 1.0
        for x in found:
            score *= 1 - x[3]
        out.append({"n_words": int(hi - lo), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": sorted(labels), "labels": sorted(everything), "score": max(1 - score, 0.5 if places else 0.0), "found": [{"start": s, "end": e, "label": x} for s, e, x, _ in found]})
    return out


def _scan(texts: pa.Array) -> pa.Array:
    out = []
    for i in range(0, len(texts), 64):
        out += _scan_slice(texts.slice(i, 64))
    return pa.array(out, _ARROW)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column license: counts, labels, score and the detections with their code point spans."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return docs.withColumn("license", F.arrow_udf(_scan, _TYPE)(F.col(text).cast("string")))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "license.*")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
