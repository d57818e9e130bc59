"""Removal of repeated byte strings by a distributed difference cover.

Whether the string of ``length`` bytes at a position also starts earlier is a question about the sorted
suffixes' first ``length`` bytes. The difference cover picks a sample: positions whose offset modulo a
period lies in a set whose differences give every remainder. So any two positions have a shift below
the period that takes both into the sample, as with the triples of period 3; a longer period samples
8 of 57 positions instead of 2 of 3, which here decides whether the sort fits on disk.

1. Sampled tuples of ``length - period + 1`` bytes are sorted by range of their hash; a name that occurs
   once is discarded, for no two long strings can meet there. As the prefix is bounded, one round
   of names settles the sample, and the recursion stops.
2. The remaining suffixes are those with a name that is left within a period behind them. They are
   sorted by their ``length``-byte prefix, and neighbours in that order compared: all but the first in order of
   document and position are repeats.

Documents are packed by range of id into batches, and a batch is worked on in units of bounded size.
What is sorted travels as sorted, Rice-coded numbers, one row for each batch and range, and what comes back is one bit
for each, so that a position costs two or three bytes of shuffle where a row would cost twenty. Batches and ranges
both grow with the root of the input, so that such a row holds ``LEAST`` numbers or more at any size, and rows grow as the
input does.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Perfect difference sets by period (fixed values).
COVERS = {
    3: [0, 1],
    7: [0, 1, 3],
    13: [0, 1, 3, 9],
    31: [0, 1, 3, 8, 12, 18],
    57: [0, 1, 3, 13, 32, 36, 43, 52],
}
#: Bytes of a unit; least bytes of a batch of documents, and least values of a range that meet in one task; numbers of a row.
UNIT, BATCH, RANGE, LEAST = 2 << 20, 2 << 20, 1 << 20, 64
CHUNK = 1 << 15
_MULTIPLIERS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
_LETTERS = np.random.default_rng(57).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    c = a * _MULTIPLIERS[k % len(_MULTIPLIERS)]
    c += b
    c ^= c >> np.uint64(29)
    return c


def grams(buf: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes at each position, by doubling; positions without so many bytes are left out."""
    n = len(buf) - width + 1
    out = np.empty(max(n, 0), np.uint64)
    last = np.uint64(0x94D049BB133111EB)
    for at in range(0, n, CHUNK):
        h = _LETTERS[buf[at : at + CHUNK + width - 1]]
        size, k = 1, 0
        while 2 * size <= width:
            h = _mixed(h[:-size], h[size:], k)
            size, k = 2 * size, k + 1
        if size < width:
            h = _mixed(h[: len(h) - (width - size)], h[width - size :], k)
        h = h[: min(CHUNK, n - at)] * last
        out[at : at + CHUNK] = h ^ (h >> np.uint64(32))
    return out


def coded(v: np.ndarray) -> bytes:
    """Rising numbers, Rice-coded: the first, then each step's low bits and its high part in unary."""
    if not len(v):
        return struct.pack("<IBQ", 0, 0, 0)
    d = np.diff(v)
    k = max(0, int(max(1.0, float(d.mean()) * 0.69)).bit_length() - 1) if len(d) else 0
    low = np.packbits(np.unpackbits(d.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - k :]) if k else np.zeros(0, np.uint8)
    ends = np.cumsum((d >> np.uint64(k)).astype(np.int64)) + np.arange(len(d))
    high = np.zeros(int(ends[-1]) + 1 if len(d) else 0, np.uint8)
    high[ends] = 1
    return struct.pack("<IBQ", len(v), k, int(v[0])) + low.tobytes() + np.packbits(high).tobytes()


def decoded(data: bytes) -> np.ndarray:
    n, k, first = struct.unpack_from("<IBQ", data)
    if not n:
        return np.zeros(0, np.uint64)
    size = ((n - 1) * k + 7) // 8
    body = np.frombuffer(data, np.uint8, offset=13)
    low = np.zeros((n - 1, 64), np.uint8)
    if k:
        low[:, 64 - k :] = np.unpackbits(body[:size], count=(n - 1) * k).reshape(n - 1, k)
    d = np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64)
    ends = np.flatnonzero(np.unpackbits(body[size:]))[: n - 1]
    d += np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1) << np.uint64(k)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), d]), dtype=np.uint64)


class Plan:
    """What all tasks agree on: lengths, ranges and numbers of bits, from the input's size."""

    def __init__(self, length: int, total: int):
        self.length = length
        self.period = max(p for p in COVERS if p <= max(3, 0.6 * length))
        self.cover = COVERS[self.period]
        self.tuple = length - self.period + 1
        sampled = max(1, total * len(self.cover) // self.period)
        self.bits = min(63, sampled.bit_length() + 9)
        values = max(RANGE, math.isqrt(LEAST * sampled))  # of a batch times of a range: LEAST times all
        self.batch = max(BATCH, values * self.period // len(self.cover))
        self.name_ranges = 1 + sampled // values
        self.string_ranges = 1 + total // (3 * values)

    def split(self, v: np.ndarray, bits: int, ranges: int) -> np.ndarray:
        """Where the ranges begin among rising values of ``bits`` bits; there is one more, the end."""
        edges = np.array([(r << bits) // ranges for r in range(ranges)], np.uint64)
        return np.append(np.searchsorted(v, edges), len(v))


class Unit:
    """Consecutive pieces of documents, each with so many bytes of its continuation that every string that starts in it is whole."""

    def __init__(self, plan: Plan, pieces: list[tuple[int, int, int, bytes]]):
        self.plan, self.pieces = plan, pieces
        self.buf = np.frombuffer(b"".join(x for *_, x in pieces), np.uint8)
        n = len(self.buf)
        self.starts = np.cumsum([0, *(len(x) for *_, x in pieces)])
        sampled, self.whole = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        for (_, _, own, x), s in zip(pieces, self.starts.tolist()):
            sampled[s : s + max(0, len(x) - plan.tuple + 1)] = True
            self.whole[s : s + max(0, min(own, len(x) - plan.length + 1))] = True
        keep = np.zeros(plan.period, bool)
        keep[plan.cover] = True
        at = np.flatnonzero(sampled[:n] & np.resize(keep, n))
        self.at = at
        self.names = (grams(self.buf, plan.tuple)[at] >> np.uint64(64 - plan.bits)) if len(at) else np.zeros(0, np.uint64)

    def strings(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that may repeat, and the hash of each one's string; ``repeated`` says of each name whether it is left."""
        plan, n = self.plan, len(self.buf)
        left = np.zeros(n + plan.period + 1, np.int32)
        left[self.at[repeated] + 1] = 1
        left = np.cumsum(left, dtype=np.int32)
        at = np.flatnonzero(self.whole[:n] & (left[plan.period :][:n] > left[:n]))
        return at, grams(self.buf, plan.length)[at] if len(at) else np.zeros(0, np.uint64)


Doc = tuple[int, bool, int, bytes, int]


def unpacked(blobs: list[bytes]) -> list[Doc]:
    """``(id, known, hash of the text, text, rows)`` of the documents in blobs: in order of id, those without one last, and of
    hash and text; rows that repeat id and text are one document."""
    rows: dict[tuple, int] = {}
    for blob in blobs:
        data = zstandard.decompress(blob)
        (n,) = struct.unpack_from("<I", data)
        ids, hashes = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "<u8", n, 4 + 8 * n)
        known, sizes = np.frombuffer(data, np.uint8, n, 4 + 16 * n), np.frombuffer(data, "<u4", n, 4 + 17 * n)
        counts = np.frombuffer(data, "<i8", n, 4 + 21 * n)
        ends = np.cumsum(sizes) + 4 + 29 * n
        for i, k, h, s, e, c in zip(ids.tolist(), known.tolist(), hashes.tolist(), sizes.tolist(), ends.tolist(), counts.tolist()):
            doc = (not k, i, h, data[e - s : e])
            rows[doc] = rows.get(doc, 0) + c
    return [(i, not nameless, h, text, rows[nameless, i, h, text]) for nameless, i, h, text in sorted(rows)]


def packed(docs: list[Doc]) -> bytes:
    ids, known, hashes, texts, counts = zip(*docs)
    head = [np.array(ids, "<i8"), np.array(hashes, "<u8"), np.array(known, np.uint8), np.array([len(t) for t in texts], "<u4"), np.array(counts, "<i8")]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(docs)) + b"".join(x.tobytes() for x in head) + b"".join(texts))


def units(plan: Plan, docs: list[Doc], size: int) -> Iterator[Unit]:
    """Units of a batch, in order; a piece is ``(document, offset, own bytes, bytes with continuation)``."""
    pieces, total = [], 0
    for d, (_, _, _, text, _) in enumerate(docs):
        for at in range(0, max(1, len(text)), size):
            pieces.append((d, at, min(size, len(text) - at), text[at : at + size + plan.length - 1]))
            total += len(pieces[-1][3])
            if total >= size:
                yield Unit(plan, pieces)
                pieces, total = [], 0
    if pieces:
        yield Unit(plan, pieces)


def _results(frame: pd.DataFrame, kind: int) -> np.ndarray:
    """The bits that came back for a batch, over all ranges in order."""
    rows = frame[frame.kind == kind].sort_values("range")
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(rows.bits, rows.n)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


SORTED = "range int, batch int, data binary, flags binary"
BITS = "batch int, kind int, range int, n int, bits binary"


def slots(edges: np.ndarray, id_: int | None, hash_: int, nameless: int) -> int:
    """The batch of a document: by its id among rising ``edges``. An id that several edges equal is as many batches' own, which
    its documents share in order of hash; so are those without an id, in ``nameless`` further ones."""
    if id_ is None:
        return len(edges) + 1 + (hash_ * nameless >> 64)
    low, high = int(np.searchsorted(edges, id_)), int(np.searchsorted(edges, id_, "right"))
    return low + (hash_ * (high - low + 1) >> 64)


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, unit: int = UNIT, batch: int | None = None) -> DataFrame:
    """Per row of ``docs``: ``(id_col, n_bytes, n_removed, n_spans, kept_sha256)``, and with ``texts`` also ``kept`` (binary).

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document with
    a smaller id, or earlier in the same one; strings never cross documents. Strings are compared by 64-bit
    hashes. Null text is empty; rows with a null id come after all others; rows of one id count in order of a
    hash of their bytes, and rows that repeat id and text are one document, with one result each. An empty table
    gives no rows; other columns are not read. Ids are integers.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    rows = plain.select(id_.cast("bigint").alias("id"), F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("text"))
    size = F.octet_length("text")
    total, without = rows.agg(F.sum(size), F.sum(F.when(F.col("id").isNull(), size))).first()
    total, without = total or 0, without or 0
    plan = Plan(length, total)
    batch = batch or plan.batch
    count, nameless = 1 + (total - without) // batch, 1 + without // batch
    bounds: list[int] = []
    if count > 1:
        shares = [k / count for k in range(1, count)]
        bounds = sorted(rows.agg(F.percentile_approx("id", F.array(*map(F.lit, shares)), max(10_000, 20 * count))).first()[0] or [])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, kept, held = np.array(bounds, np.int64), {}, 0

        def flush():
            at = sorted(kept)
            listed = [[(*doc, c) for doc, c in kept[b].items()] for b in at]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([packed(x) for x in listed], pa.binary())], names=["batch", "blob"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = xxhash.xxh64_intdigest(t, 42)
                own = kept.setdefault(slots(edges, i, h, nameless), {})
                doc = (i or 0, i is not None, h, t)
                held += 0 if doc in own else len(t)
                own[doc] = own.get(doc, 0) + 1
                if held >= 16 << 20:
                    yield flush()
                    kept, held = {}, 0
        if kept:
            yield flush()

    blobs = rows.mapInArrow(pack, "batch int, blob binary")

    def sent(batch: int, values: np.ndarray, flags: np.ndarray | None, bits: int, ranges: int) -> pd.DataFrame:
        """Rising values of a batch as a row for each range that holds one."""
        cuts = plan.split(values, bits, ranges)
        out = [(r, batch, coded(values[a:b]), b"" if flags is None else np.packbits(flags[a:b]).tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        return pd.DataFrame(out, columns=["range", "batch", "data", "flags"])

    def named(listed: list[Doc]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct names of a batch, and whether it has each more than once."""
        v, n = np.unique(np.concatenate([u.names for u in units(plan, listed, unit)] or [np.zeros(0, np.uint64)]), return_counts=True)
        return v, n > 1

    def left(listed: list[Doc], back: pd.DataFrame) -> tuple[list[Unit], list[tuple[np.ndarray, np.ndarray]]]:
        """Units of a batch, and of each the positions that may repeat with their strings' hashes."""
        all_ = list(units(plan, listed, unit))
        names = np.concatenate([u.names for u in all_])
        repeated = _results(back, 0)[np.unique(names, return_inverse=True)[1]] if len(names) else np.zeros(0, bool)
        return all_, [u.strings(x) for u, x in zip(all_, np.split(repeated, np.cumsum([len(u.names) for u in all_])[:-1]))]

    def sample(f: pd.DataFrame) -> pd.DataFrame:
        return sent(f.batch.iloc[0], *named(unpacked(f.blob.tolist())), plan.bits, plan.name_ranges)

    def answered(f: pd.DataFrame, parts: list[np.ndarray], bits: np.ndarray, kind: int) -> pd.DataFrame:
        ends = np.cumsum([len(p) for p in parts])
        packs = [np.packbits(x).tobytes() for x in np.split(bits, ends[:-1])]
        return pd.DataFrame({"batch": f.batch, "kind": kind, "range": f["range"], "n": [len(p) for p in parts], "bits": packs})

    def name(f: pd.DataFrame) -> pd.DataFrame:
        parts = [decoded(x) for x in f.data]
        _, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        own = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(f["flags"], parts)])
        return answered(f, parts, (n[place] > 1) | (own > 0), 0)

    def merge(f: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        _, found = left(unpacked(f.blob.tolist()), back)
        return sent(f.batch.iloc[0], np.unique(np.concatenate([h for _, h in found])), None, 64, plan.string_ranges)

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("batch")
        parts = [decoded(x) for x in f.data]
        v = np.concatenate(parts)
        order = np.argsort(v, kind="stable")
        later = np.zeros(len(v), bool)
        later[order[1:]] = v[order[1:]] == v[order[:-1]]
        return answered(f.reset_index(drop=True), parts, later, 1)

    def remove(f: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        listed = unpacked(f.blob.tolist())
        all_, found = left(listed, back)
        h = np.concatenate([x for _, x in found])
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        again = _results(back, 1)[place] | (first[place] != np.arange(len(h))) if len(h) else np.zeros(0, bool)
        done: dict[int, list] = {}
        carried, covered = np.zeros(0, bool), False  # into the next piece of the same document
        for u, (at, _), gone in zip(all_, found, np.split(again, np.cumsum([len(x) for _, x in found])[:-1])):
            repeats = at[gone]
            steps = np.zeros(len(u.buf) + plan.length + 1, np.int32)
            steps[repeats] += 1
            np.subtract.at(steps, repeats + plan.length, 1)
            gone = np.cumsum(steps, dtype=np.int32)[: len(u.buf)] > 0
            for (d, offset, own, x), s in zip(u.pieces, u.starts.tolist()):
                if not offset:
                    carried, covered = np.zeros(0, bool), False
                    done[d] = [0, 0, hashlib.sha256(), []]
                g = gone[s : s + len(x)].copy()
                g[: len(carried)] |= carried[: len(g)]
                g, carried = g[:own], g[own:]
                state = done[d]
                state[0] += int(g.sum())
                state[1] += int((g & ~np.concatenate([[covered], g[:-1]])).sum()) if len(g) else 0
                covered = bool(g[-1]) if len(g) else covered
                rest = u.buf[s : s + own][~g].tobytes()
                state[2].update(rest)
                if texts:
                    state[3].append(rest)
        out = []
        for d, (i, known, _, text, c) in enumerate(listed):
            n, spans, sha, rest = done[d]
            out.append((i if known else None, len(text), n, spans, sha.hexdigest(), c, *([b"".join(rest)] if texts else [])))
        frame = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rows", *(["kept"] if texts else [])])
        return frame.astype({"id": "Int64"})

    groups = lambda df, *by: df.groupBy(*by)
    names = groups(groups(blobs, "batch").applyInPandas(sample, SORTED), "range").applyInPandas(name, BITS)
    strings = groups(blobs, "batch").cogroup(groups(names, "batch")).applyInPandas(merge, SORTED)
    repeats = groups(strings, "range").applyInPandas(compare, BITS)
    answers = names.unionByName(repeats)
    result = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, rows bigint" + (", kept binary" if texts else "")
    out = groups(blobs, "batch").cogroup(groups(answers, "batch")).applyInPandas(remove, result)
    each = out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows"))).drop("rows")
    return each.toDF(id_col, *each.columns[1:])
