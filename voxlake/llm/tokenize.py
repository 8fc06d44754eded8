"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern; a piece is encoded by dynamic programming over its
prefixes. The encoding of every prefix ends in exactly one token: of all tokens that match a suffix of the
prefix (found by an automaton over the vocabulary), longest first, it is the first that may follow the last
token of the remaining prefix. Two tokens may follow each other if the plain merges of their joined bytes
give just these two. The stored last tokens are followed back from the end. This needs time linear in a
piece's length whatever its content. Pieces repeat, so their ids are kept per Python worker (bounded).

Defined cases: null and empty texts give the empty list; strings that look like special tokens are ordinary
text; texts of any length are encoded whole; every row keeps its id, repeated or null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import worker_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Cutting pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over ASCII texts, for the faster engine of the standard library.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
KEPT_PIECES = 500_000


class PrefixEncoder:
    """Exact BPE ids of single pieces of text."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        # Latin-1 gives one character per byte, which is what the automaton works on.
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids by plain merging, lowest rank first; for short inputs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        ok = self.compatible.get(key)
        if ok is None:
            if len(self.compatible) > 4 * KEPT_PIECES:
                self.compatible.clear()
            ok = self.compatible[key] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return ok

    def encode(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.rank.get(data)
        if whole is not None:
            return (whole,)
        ends: list[list[int]] = [[] for _ in data]
        for end, i in self.automaton.iter(data.decode("latin-1")):
            ends[end].append(i)
        last: list[int] = []
        for end, found in enumerate(ends):
            found.sort(key=lambda i: -len(self.token[i]))
            for i in found:
                before = end - len(self.token[i])
                if before < 0 or self.may_follow(last[before], i):
                    last.append(i)
                    break
        out, end = [], len(data) - 1
        while end >= 0:
            out.append(last[end])
            end -= len(self.token[last[end]])
        return tuple(reversed(out))


class Pieces(dict):
    """piece -> ids, filled on demand and emptied when full."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEPT_PIECES:
            self.clear()
        ids = self.encoder.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def text_encoder(path: str):
    """A function from text to an iterator of ids, made once per worker."""

    def build():
        import re

        import regex

        kept = Pieces(PrefixEncoder(path))
        full, plain = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.A).findall
        get = kept.__getitem__
        # str.isascii decides; \s of both engines agrees on ASCII but for the separators 0x1c-0x1f.
        separators = frozenset("\x1c\x1d\x1e\x1f")

        def encode(text: str) -> chain:
            cut = plain if text.isascii() and separators.isdisjoint(text) else full
            return chain.from_iterable(map(get, cut(text)))

        return encode

    return worker_cache(("bpe", path), build)


def token_ids(documents: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): one row per document; a map without shuffle, text and id are all that is read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path)
        for b in batches:
            texts = b.column(1)
            step = 500
            for at in range(0, b.num_rows, step):
                ids = [np.fromiter(encode(t), np.int32) if t else np.zeros(0, np.int32) for t in texts.slice(at, step).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, step), lists], ["doc_id", "ids"])

    return documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].alias("text")).mapInArrow(work, "doc_id long, ids array<int>")
