"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word (a match of the vocabulary's pattern) is held as its part boundaries and, beside them, the
rank of the pair that starts at each boundary. The least rank is found by a scan, its boundary is
deleted, and the two ranks it touches are refreshed. Words are short, so that scans beat a heap; a
word of more than ``SHORT`` bytes takes the same merges by a heap over linked parts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import restored, sheltered

#: The split pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 128
#: Words a task remembers; the memory is emptied when it is full, which changes no result.
REMEMBERED = 400_000
NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of a ``tokenizers`` JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = {s.encode(): i for s, i in special.items()}
        self.pieces = {i: b for b, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        marks = "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
        self.split = regex.compile(f"({marks})").split if special else lambda s: [s]
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def word(self, text: str) -> list[int]:
        """The ids of one word."""
        data = text.encode("utf-8")
        if data in self.ids and len(data) == 1:
            return [self.ids[data]]
        bounds = self._scan(data) if len(data) <= SHORT else self._heap(data)
        return [self.ids[data[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _scan(self, data: bytes) -> list[int]:
        get, n = self.ranks.get, len(data)
        bounds = list(range(n + 1))
        ranks = [get((data[i : i + 1], data[i + 1 : i + 2]), NONE) for i in range(n - 1)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((data[bounds[i] : bounds[i + 1]], data[bounds[i + 1] : bounds[i + 2]]), NONE)
            if i:
                ranks[i - 1] = get((data[bounds[i - 1] : bounds[i]], data[bounds[i] : bounds[i + 1]]), NONE)
        return bounds

    def _heap(self, data: bytes) -> list[int]:
        get, n = self.ranks.get, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: NONE if after[i] >= n else get((data[i : after[i]], data[after[i] : after[after[i]]]), NONE)
        ranks = [rank(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ranks[i] != r:
                continue
            gone = after[i]
            after[i] = after[gone]
            ranks[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    ranks[k] = rank(k)
                    if ranks[k] != NONE:
                        heapq.heappush(heap, (ranks[k], k))
        bounds = [0]
        while bounds[-1] < n:
            bounds.append(after[bounds[-1]])
        return bounds

    def encode(self, text: str) -> list[int]:
        """The ids of a text; a special token's string in it becomes that token."""
        out: list[int] = []
        known = self.known
        for part in self.split(text):
            if not part:
                continue
            if (i := self.special.get(part.encode())) is not None:
                out.append(i)
                continue
            for w in self.words(part):
                ids = known.get(w)
                if ids is None:
                    ids = self.word(w)
                    if len(w) <= SHORT:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def with_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with the tokens of each whole text.

    The vocabulary file is shipped to every executor with the job. Adds ``n_tokens`` and ``ids``
    (array<int>) and ``decoded``; with ``digest``, instead of the last two ``ids_sha256`` (of ids as
    little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of UTF-8), so that long texts do not
    travel twice. Columns of these names in ``docs`` are replaced. Null text is an empty text: no
    tokens. Any row gives one row, repeated rows included; an empty table gives none.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    added = {"n_tokens": LongType()} | ({"ids_sha256": StringType(), "decoded_sha256": StringType()} if digest else {"ids": ArrayType(IntegerType()), "decoded": StringType()})
    kept, of = sheltered(docs, tuple(added))
    at = kept.columns.index(of[text_col])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(SparkFiles.get(name))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                counts, first, second = [], [], []
                for text in part.column(at).to_pylist():
                    ids = codec.encode(text or "")
                    counts.append(len(ids))
                    whole = np.array(ids, "<u4")
                    first.append(sha(whole.tobytes()) if digest else whole.astype(np.int32))
                    back = codec.decode(ids)
                    second.append(sha(back.encode("utf-8")) if digest else back)
                kind = pa.string() if digest else pa.list_(pa.int32())
                more = [pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *added])

    more = StructType([StructField(k, v) for k, v in added.items()])
    return restored(kept.mapInArrow(kernel, StructType([*kept.schema.fields, *more.fields])), docs, tuple(added))
