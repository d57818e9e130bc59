"""Vector bin packing of training examples into sequences, by the dot-product heuristic.

A sequence has simultaneous limits on tokens, segments (pieces of examples) and loss-bearing tokens. It is filled by
taking, among the examples that fit in every dimension, the one whose demands have the largest dot product with
what the sequence has left, each dimension weighted by its share of the whole demand. Examples of equal demands are
one class, so that a choice costs one pass over distinct sizes, however many examples there are. Where cutting is
allowed, what is left of a sequence when nothing fits takes the beginning of the best example, and the rest
of that example goes back; a sequence that runs out of examples is cut at powers of two, which need no padding.

Each task packs the examples that it reads, a bounded group at a time, so that nothing is shuffled, no task holds
more than a group and one batch, and a lost task is computed again from its own input.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .bpe import byte_alphabet
from .common import restored, sheltered

#: Tokens and examples of a group, which is packed at once.
GROUP_TOKENS, GROUP_EXAMPLES = 1 << 21, 20_000
#: Sequences of a task are numbered from its partition's number times this.
SEQUENCES = 1 << 40


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold: tokens, segments, and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are at least 1")


#: A piece: the example's place in its group, its first token, its tokens and those that bear loss.
Piece = tuple[int, int, int, int]


def fill(tokens: Sequence[int], loss: Sequence[int], limits: Limits, cut: bool) -> list[list[Piece]]:
    """Sequences of pieces that hold every example with a token.

    The last ``loss`` tokens of an example bear loss. Without ``cut``, examples above a limit are left out.
    """
    classes: dict[tuple[int, int], int] = {}
    size, bears, count, waiting = [], [], [], []

    def put(t: int, n: int, item: tuple[int, int]) -> None:
        k = classes.setdefault((t, n), len(size))
        if k == len(size):
            size.append(t), bears.append(n), count.append(0), waiting.append([])
        waiting[k].append(item)
        count[k] += 1

    for i, (t, n) in enumerate(zip(tokens, loss)):
        if t > 0 and (cut or (t <= limits.tokens and n <= limits.loss)):
            put(int(t), int(n), (i, 0))
    left = sum(count)
    room = 2 * len(size) + 64
    demand = np.zeros((2, room))
    some = np.zeros(room, bool)
    known = 0
    # The number of segments is one for each example: it bounds a sequence, but orders nothing.
    weight = np.array([sum(tokens) / limits.tokens**3, sum(loss) / limits.loss**3])
    out: list[list[Piece]] = []
    while left:
        rest, bin_ = [limits.tokens, limits.segments, limits.loss], []
        while left and rest[0] and rest[1]:
            while known < len(size):
                if known == room:
                    demand, some, room = np.pad(demand, ((0, 0), (0, room))), np.pad(some, (0, room)), 2 * room
                demand[:, known] = size[known], bears[known]
                some[known] = True
                known += 1
            value = (weight * (rest[0], rest[2])) @ demand
            fits = some & (demand[0] <= rest[0]) & (demand[1] <= rest[2])
            k = int(np.where(fits, value, -1.0).argmax())
            whole = bool(fits[k])
            if not whole:
                if not cut:
                    break
                k = int(np.where(some, value, -1.0).argmax())
            t, n = size[k], bears[k]
            take = t if whole else min(rest[0], rest[2] + t - n)
            if not take:
                break
            i, start = waiting[k].pop()
            count[k] -= 1
            some[k] = count[k] > 0
            used = max(0, take - (t - n))
            bin_.append((i, start, take, used))
            rest = [rest[0] - take, rest[1] - 1, rest[2] - used]
            if whole:
                left -= 1
            else:
                put(t - take, n - used, (i, start + take))
                known_again = classes[t - take, n - used]
                if known_again < known:
                    some[known_again] = True
        out.append(bin_)
    return out


def at_powers(bin_: list[Piece], most: int) -> list[list[Piece]]:
    """A sequence cut into sequences whose lengths are powers of two, longest first; a full one stays."""
    total = sum(p[2] for p in bin_)
    if total == most:
        return [bin_]
    pieces, out = bin_[::-1], []
    for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        part, missing = [], size
        while missing:
            i, start, length, used = pieces.pop()
            take = min(length, missing)
            first = max(0, take - (length - used))
            part.append((i, start, take, first))
            if take < length:
                pieces.append((i, start + take, length - take, used - first))
            missing -= take
        out.append(part)
    return out


class Ids:
    """Token ids of a ``tokenizers`` JSON file with a byte-level BPE model, by a library that takes its ranks."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(alphabet[c] for c in s)
        ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [ranks[raw("".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        self.special = tuple(special)
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.slow = path, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.coder.encode_to_numpy(text, allowed_special="all" if any(s in text for s in self.special) else set(), disallowed_special=())
        except BaseException as e:  # the library panics where its pattern gives up, as on a very long run of blanks
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pack_documents(docs: DataFrame, vocabulary: str, limits: Limits = Limits(), end: int = 1, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Documents cut and packed into sequences: a row for each piece.

    A document is the ids of its whole text and the id ``end``. All its tokens but the first bear loss, as the first follows
    nothing. Columns: ``id_col``, ``start`` (ids of the document before the piece), ``length``, ``ids`` (array<int>; with
    ``digest`` instead ``ids_crc32``, of ids as little-endian unsigned 32-bit integers), ``doc_tokens`` (with ``end``),
    ``n_loss``, ``sequence_id``, ``offset`` (tokens of the sequence before the piece). Other columns are not carried.

    Sequences are full or of a power of two, so that none needs padding. Which documents meet in one depends on
    how the table is split into tasks; what is held does not. Null text is an empty text, which is its end
    alone; a null id is kept; each row is a document of its own, repeated rows and ids too. An empty table gives no row.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    inner, of = sheltered(docs)
    inner = inner.select(F.col(of[id_col]).alias("c0"), F.col(of[text_col]).alias("c1"))
    last = StructField("ids_crc32", LongType()) if digest else StructField("ids", ArrayType(IntegerType()))
    fields = [inner.schema["c0"], *[StructField(c, LongType()) for c in ("start", "length")], last, *[StructField(c, LongType()) for c in ("doc_tokens", "n_loss", "sequence_id", "offset")]]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Ids(SparkFiles.get(name))
        first = TaskContext.get().partitionId() * SEQUENCES
        keys: list = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, tokens
            sizes = [len(x) for x in held]
            rows: list[tuple] = []
            for full in fill(sizes, [n - 1 for n in sizes], limits, True):
                for bin_ in at_powers(full, limits.tokens):
                    offset = 0
                    for i, start, length, used in bin_:
                        part = held[i][start : start + length]
                        rows.append((keys[i], start, length, zlib.crc32(part.tobytes()) if digest else part.astype(np.int32), sizes[i], used, first, offset))
                        offset += length
                    first += 1
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
            keys.clear(), held.clear()
            tokens = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [kind, pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.name for f in fields])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), end).astype("<u4")
                    keys.append(key), held.append(ids)
                    tokens += len(ids)
                    if tokens >= GROUP_TOKENS or len(keys) >= GROUP_EXAMPLES:
                        yield from flush()
        if keys:
            yield from flush()

    out = inner.mapInArrow(kernel, StructType(fields))
    return out.toDF(id_col, *out.columns[1:])


def pack_examples(examples: DataFrame, limits: Limits = Limits(), tokens_col: str = "n_tokens", loss_col: str = "n_loss") -> DataFrame:
    """Whole examples packed into sequences, for instruction data: adds ``sequence_id`` and ``offset``.

    ``tokens_col`` and ``loss_col`` are an example's tokens and those that bear loss, e.g. an answer's. No example is
    cut: one above a limit, without a token, or with a null count gets null in both columns. Each row is an example of its own.
    Columns of these two names are replaced; an empty table stays empty.
    """
    added = ("sequence_id", "offset")
    inner, of = sheltered(examples, added)
    at = [inner.columns.index(of[c]) for c in (tokens_col, loss_col)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * SEQUENCES
        for b in batches:
            for lo in range(0, b.num_rows, GROUP_EXAMPLES):
                part = b.slice(lo, GROUP_EXAMPLES)
                counts = [part.column(i).to_pylist() for i in at]
                both = [(t, n) if t is not None and n is not None and 0 <= n <= t else (0, 0) for t, n in zip(*counts)]
                place: list[tuple] = [(None, None)] * part.num_rows
                for bin_ in fill([t for t, _ in both], [n for _, n in both], limits, False):
                    offset = 0
                    for i, _, length, _ in bin_:
                        place[i] = (first, offset)
                        offset += length
                    first += 1
                more = [pa.array([p[k] for p in place], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *added])

    more = [StructField(c, LongType()) for c in added]
    return restored(inner.mapInArrow(kernel, StructType([*inner.schema.fields, *more])), examples, added)
