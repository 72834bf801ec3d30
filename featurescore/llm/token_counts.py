"""Token counts of whole texts by a public byte-level vocabulary, by rank-synchronous merging of arrays.

A text is cut at the strings of special tokens (one token each) and into pre-tokens by the vocabulary's pattern. The
different pre-tokens of a batch are held as one ragged array of symbols, first the bytes. In each round every sequence
finds the least rank among its neighbouring pairs and merges all places of that pair, from left to right; all sequences of
the batch do so in the same numpy steps. A sequence without a known pair is done, and the symbols that it has left are its
tokens. As a pair's rank is lower than the ranks of all pairs that its token is part of, merging one rank of a sequence at a
time gives what merging one place at a time gives.

Counts need no shuffle, and a task holds the pre-tokens of one slice of texts (SLICE_BYTES) and a bounded table of known
counts. Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives
no rows; other columns pass through, those named like results are replaced. A text of any length is counted whole, in one
task; a very long pre-token (a line of blanks, a text without spaces) is a sequence like others, and each of its rounds costs
a few passes over what is left of it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

#: Tokens that a text may have.
LIMIT = 512
#: Pre-tokens with known counts that a task keeps from one slice to the next, and characters of the longest, at most.
KNOWN, LONGEST = 1 << 19, 1 << 10
#: Symbols that are merged at once; a longer pre-token is merged alone.
SYMBOLS = 1 << 20
#: A character without a class, in all versions of Unicode so far.
NEITHER = "\u0378"
NONE = np.iinfo(np.int32).max


def _printed() -> dict[str, int]:
    """The bytes that the vocabulary's letters stand for: printable ones for themselves, the others for 256 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteMerges:
    """The merges of a byte-level vocabulary file as sorted arrays of pairs, and the pattern that cuts texts."""

    def __init__(self, vocabulary: dict, pattern: str, unlike: list[str] = []):  # noqa: B006
        model, ids = vocabulary["model"], vocabulary["model"]["vocab"]
        self.first = np.zeros(256, dtype=np.int64)
        for letter, byte in _printed().items():
            self.first[byte] = ids[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        keys, ranks = left << 32 | right, np.arange(len(pairs), dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        # of a pair that is listed twice the last rank holds, as in a table
        order = np.lexsort((-ranks, keys))
        keep = np.concatenate([[True], np.diff(keys[order]) != 0]) if len(order) else order.astype(bool)
        self.keys, self.ranks = keys[order][keep], ranks[order][keep]
        self.made = made
        self.special = [t["content"] for t in vocabulary.get("added_tokens", []) if t.get("special")]
        # neighbours are ranges of the class, and texts without a character as high as the first need no search
        codes = np.array(sorted(map(ord, unlike)))
        ends = np.flatnonzero(np.diff(codes) != 1)
        ranges = zip(codes[np.concatenate([[0], ends + 1])], codes[np.concatenate([ends, [-1]])], strict=True) if len(codes) else ()
        self.strange = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]") if unlike else None
        self.lowest = min(unlike, default="")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(pattern)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if self.strange is None or text.isascii() or max(text) < self.lowest or not self.strange.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.strange.sub(NEITHER, text))]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each of the byte sequences that the offsets at cut data into; none is empty."""
        tokens = np.zeros(len(at) - 1, dtype=np.int64)
        symbols, sizes, owner = self.first[data], np.diff(at), np.arange(len(at) - 1)
        starts = np.cumsum(sizes) - sizes
        # the rank of the pair that begins at each symbol; the last symbol of a sequence begins none
        ranks = np.full(len(symbols), NONE, dtype=np.int64)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[starts + sizes - 1] = NONE
        while len(owner):
            least = np.minimum.reduceat(ranks, starts)
            going = least != NONE
            if not going.all():
                tokens[owner[~going]] = sizes[~going]
                keep = np.repeat(going, sizes)
                symbols, ranks, sizes, owner, least = symbols[keep], ranks[keep], sizes[going], owner[going], least[going]
                starts = np.cumsum(sizes) - sizes
                if not len(owner):
                    break
            hit = np.flatnonzero(ranks == np.repeat(least, sizes))
            # of places that overlap (a pair of two equal symbols, in a row of them) every other one is merged
            run = np.cumsum(np.concatenate([[True], np.diff(hit) != 1]))
            head = np.flatnonzero(np.concatenate([[True], np.diff(run) != 0]))
            hit = hit[(np.arange(len(hit)) - head[run - 1]) % 2 == 0]
            symbols[hit] = self.made[ranks[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            ends = np.zeros(len(symbols), dtype=bool)
            ends[starts + sizes - 1] = True
            ends[hit] |= ends[hit + 1]
            sizes = sizes - np.bincount(np.searchsorted(starts, hit, side="right") - 1, minlength=len(sizes))
            place = np.cumsum(keep) - 1
            symbols, ranks, ends, new = symbols[keep], ranks[keep], ends[keep], place[hit]
            starts = np.cumsum(sizes) - sizes
            # only pairs with a merged symbol have another rank now
            for begin in (new, new[new > 0] - 1):
                inner = begin[~ends[begin]]
                ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
                ranks[begin[ends[begin]]] = NONE
        return tokens


@cache
def unlike_letters() -> list[str]:
    """Letters and digits of the pattern module's Unicode version that the vocabulary library's version does not know as such.

    Only characters that Python's own, older version does not know either are asked for.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)
    young = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    return [c for c in young if len(cut(f"x{c}y")) > 1 and len(cut(f"1{c}2")) > 1]


@cache
def _vocabulary(path: str, pattern: str) -> ByteMerges:
    with open(path, encoding="utf-8") as f:
        return ByteMerges(json.load(f), pattern, unlike_letters())


class Known(dict):
    """Numbers of pre-tokens, with the token counts of those that were merged; a new one gets the next number."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.tokens = np.zeros(0, dtype=np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Counter:
    """Counts of texts, slice by slice, with the counts of pre-tokens that came before."""

    def __init__(self, merges: ByteMerges):
        self.merges, self.known = merges, Known()

    def _merge_new(self) -> None:
        """Counts the new pre-tokens, as many at once as have SYMBOLS bytes; a longer one alone."""
        pieces = [piece.encode() for piece in self.known.new]
        ends = np.cumsum([len(piece) for piece in pieces])
        lo, got = 0, [self.known.tokens]
        while lo < len(pieces):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SYMBOLS)))
            at = np.concatenate([[ends[lo] - len(pieces[lo])], ends[lo:hi]])
            got.append(self.merges.count(np.frombuffer(b"".join(pieces[lo:hi]), dtype=np.uint8), at - at[0]))
            lo = hi
        self.known.tokens, self.known.new = np.concatenate(got), []

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        m, number, out = self.merges, self.known.__getitem__, np.zeros(len(texts), dtype=np.int64)
        rows = []
        for i, text in enumerate(texts):
            parts = m.cut.split(text or "") if m.cut else [text or ""]
            out[i] = len(parts) - 1
            rows += [(i, np.fromiter(map(number, m.pieces(part)), dtype=np.int64)) for part in parts if part]
        longest = max(map(len, self.known.new), default=0)
        self._merge_new()
        for i, pieces in rows:
            out[i] += self.known.tokens[pieces].sum()
        if len(self.known) > KNOWN or longest > LONGEST:
            self.known = Known()
        return out


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs without its text, with n_bytes (UTF-8), n_tokens and over_limit (more tokens than limit).

    path is a vocabulary file of byte-level merges that every executor can open; pattern cuts texts into pre-tokens.
    """
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    schema = docs.select(*kept).schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches):
        counter = Counter(_vocabulary(path, pattern))
        for batch, data, at in slices(batches, "__text"):
            tokens = counter.counts(batch.column("__text").to_pylist())
            rest = batch.column("__kept")
            columns = [rest.field(k) for k in range(len(kept))] if kept else []
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(at).astype(np.int64)), pa.array(tokens)], names=[*kept, "n_bytes", "n_tokens"])

    rest = F.struct(*[docs[c] for c in kept]) if kept else F.lit(True)
    packed = docs.select(rest.alias("__kept"), docs[text].alias("__text"))
    return arrow_map(packed, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
