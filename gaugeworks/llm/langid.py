"""Language identification by unigram pieces with the segmentation summed out.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's probability is
the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its
words. Probabilities are fitted by expectation maximisation: expected piece counts by forward and
backward sums on counted words of labelled texts. The pieces themselves are never trained.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import cut, restored, sheltered


#: Expected number of texts of each language that are learnt from; all are, where there are fewer.
TRAIN_TEXTS = 2000
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Longer runs of letters are summed one by one and not remembered, which bounds a task's tables; no run is cut.
LONGEST = 64
#: Added to a piece's expected count; and probability of a character that is no piece, in any language.
PRIOR, STRANGE = 0.05, 1e-7
#: Scale of each character, so that products of long words stay in range; where one could be below this log, sums are in logs.
SCALE, LEAST_LOG = 64.0, -575.0
REMEMBERED = 500_000
ADDED = ("lang_pred", "score")
RUNS = re.compile(r"[^\W_0-9]+")


def words_of(text: str) -> list[str]:
    """Whole runs of letters, lower-cased."""
    found, out = RUNS.findall(text.lower()), []
    if "".join(found).isalpha():
        return found
    for w in found:
        out += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return out


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not odd(i)]


class Lattice:
    """Cuts of words into pieces, as arrays over words of one length."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.strange, self.none = len(pieces), len(pieces) + 1
        # The beginnings of pieces as a tree: nodes are numbered, steps are sorted by node and character.
        letters = {c: i for i, c in enumerate(sorted(set().union(*pieces)), 1)}
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        nodes, steps = {"": 0}, []
        for s in pieces:
            for end in range(1, len(s) + 1):
                if s[:end] not in nodes:
                    nodes[s[:end]] = len(nodes)
                    steps.append((nodes[s[: end - 1]] * (len(letters) + 1) + letters[s[end - 1]], nodes[s[:end]]))
        steps.sort()
        self.steps = np.array([*(k for k, _ in steps), np.iinfo(np.int64).max])
        self.targets = np.array([*(t for _, t in steps), 0])
        self.piece_at = np.array([self.ids.get(s, self.none) for s in nodes], np.int32)
        self.width = len(letters) + 1

    def of(self, words: list[str]) -> np.ndarray:
        """``[word, end, length]``: the piece of this length that ends there; all words have one length."""
        n = len(words[0]) + 1
        most = min(n, self.longest)
        out = np.full((n, most, len(words)), self.none, np.int32)
        points = np.frombuffer("".join(f"▁{w}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letter[np.minimum(points, len(self.letter) - 1)]
        # All places are walked down the tree at once, until no piece goes on; a walk from a word's end stops there.
        start, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        for size in range(1, most + 1):
            step = node * self.width + letters[start + size - 1]
            at = np.searchsorted(self.steps, step)
            on = np.flatnonzero(self.steps[at] == step)
            start, node = start[on], self.targets[at[on]]
            word, first = np.divmod(start, n)
            out[first + size - 1, size - 1, word] = self.piece_at[node]
            inside = np.flatnonzero(first + size < n)
            start, node = start[inside], node[inside]
        single = out[:, 0]
        single[single == self.none] = self.strange
        return out.transpose(2, 0, 1)

    def forward(self, cuts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """``[end, word, language]``: scaled sums over all cuts of each prefix. ``p`` is ``[piece, language]``."""
        count, n, most = cuts.shape
        alpha = np.zeros((n + 1, count, p.shape[1]))
        alpha[0] = 1.0
        for end in range(1, n + 1):
            for size in range(1, min(end, most) + 1):
                ids = cuts[:, end - 1, size - 1]
                if size == 1 or (ids != self.none).any():
                    alpha[end] += alpha[end - size] * p.take(ids, 0) * SCALE**size
        return alpha

    def in_range(self, n: int, p: np.ndarray) -> bool:
        """Whether no scaled sum over ``n`` characters can leave the range of floats; a single character is always a cut."""
        return n * np.log(p[: self.strange + 1].min(initial=STRANGE) * SCALE) > LEAST_LOG

    def log_forward(self, cuts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """``forward`` in logs, without scale, for runs of any length; ``logs`` is the log of ``p``."""
        count, n, most = cuts.shape
        alpha = np.full((n + 1, count, logs.shape[1]), -np.inf)
        alpha[0] = 0.0
        for end in range(1, n + 1):
            for size in range(1, min(end, most) + 1):
                alpha[end] = np.logaddexp(alpha[end], alpha[end - size] + logs[cuts[:, end - 1, size - 1]])
        return alpha

    def log_probability(self, cuts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """``[word, language]``: logs of the sums over all cuts."""
        n = cuts.shape[1]
        if self.in_range(n, p):
            return np.log(self.forward(cuts, p)[-1]) - n * np.log(SCALE)
        return self.log_forward(cuts, _log(p))[-1]

    def run_log_probability(self, word: str, p: np.ndarray) -> np.ndarray:
        """``[language]``: the log of the sum over all cuts of one run of any length.

        The forward sums of the last positions are a window that is rescaled at each step, so that memory doesn't
        grow with the run.
        """
        s, get, most, zero = "▁" + word, self.ids.get, self.longest, np.zeros(p.shape[1])
        window, scale = [np.ones(p.shape[1])], zero  # sums by end, the last first, divided by exp(scale)
        for end in range(1, len(s) + 1):
            found = [get(s[end - size : end]) for size in range(1, min(end, most) + 1)]
            if found[0] is None:
                found[0] = self.strange
            total = sum((p[i] * a for i, a in zip(found, window) if i is not None), zero)
            window = [a / total for a in [total, *window[: most - 1]]]
            scale = scale + np.log(total)
        return scale

    def expected(self, cuts: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language, each word counted ``weight`` times; ``p`` is ``[piece, 1]``."""
        if not self.in_range(cuts.shape[1], p):
            return self._log_expected(cuts, _log(p), weight)
        count, n, most = cuts.shape
        alpha = self.forward(cuts, p)[:, :, 0]
        beta = np.zeros((n + 1, count))
        beta[n] = 1.0
        out = np.zeros(len(p))
        share = weight / alpha[n]
        for end in range(n, 0, -1):
            for size in range(1, min(end, most) + 1):
                ids = cuts[:, end - 1, size - 1]
                through = p[ids, 0] * SCALE**size * beta[end]
                beta[end - size] += through
                out += np.bincount(ids, alpha[end - size] * through * share, len(p))
        return out

    def _log_expected(self, cuts: np.ndarray, logs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        count, n, most = cuts.shape
        alpha = self.log_forward(cuts, logs)[:, :, 0]
        beta = np.full((n + 1, count), -np.inf)
        beta[n] = 0.0
        out = np.zeros(len(logs))
        for end in range(n, 0, -1):
            for size in range(1, min(end, most) + 1):
                ids = cuts[:, end - 1, size - 1]
                through = logs[ids, 0] + beta[end]
                beta[end - size] = np.logaddexp(beta[end - size], through)
                out += np.bincount(ids, np.exp(alpha[end - size] + through - alpha[n]) * weight, len(logs))
        return out


def _log(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def _table(pieces: list[str], counts: dict[str, np.ndarray]) -> np.ndarray:
    """``[piece, language]`` probabilities; the last two rows are the strange character's and zero."""
    cols = []
    for c in counts.values():
        p = c[: len(pieces)] + PRIOR
        cols.append(np.concatenate([p / p.sum(), [STRANGE, 0.0]]))
    return np.stack(cols, 1)


def _by_length(words: list[str], most: int = 4096) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, group in sorted(groups.items()):
        size = max(1, most * LONGEST // (n + 1))
        for at in range(0, len(group), size):
            yield group[at : at + size]


def fit(texts: DataFrame, pieces: list[str], train_texts: int = TRAIN_TEXTS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from rows ``(id, text, lang)`` without nulls.

    About ``train_texts`` of each language are used, picked by a hash of the id. Counts are grouped sums;
    what reaches the driver has one number for each piece and language.
    """
    counts = {r.lang: r["count"] for r in texts.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((len(pieces) + 2, 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_texts / counts[k]))])
    picked = texts.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in words_of(text):
                    found[lang, w] = found.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([k[0] for k in found], [k[1] for k in found], list(found.values()))] if found else [pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], names=["lang", "word", "n"])

    seen = cut(picked.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    spark, model = texts.sparkSession, {k: np.ones(len(pieces) + 2) for k in langs}
    shared = spark.sparkContext.broadcast(Lattice(pieces))
    for _ in range(rounds):
        now = spark.sparkContext.broadcast({k: _table(pieces, {k: c}) for k, c in model.items()})

        def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lattice, sums = shared.value, {}
            for f in frames:
                for lang, part in f.groupby("lang"):
                    words, n = part.word.tolist(), part.n.to_numpy(float)
                    for ids in _by_length(words):
                        got = lattice.expected(lattice.of([words[i] for i in ids]), now.value[lang], n[ids])
                        sums[lang] = sums.get(lang, 0) + got
            for lang, c in sums.items():
                i = np.flatnonzero(c)
                yield pd.DataFrame({"lang": lang, "piece": i, "c": c[i]})

        rows = seen.mapInPandas(expect, "lang string, piece bigint, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c"))
        model = {k: np.zeros(len(pieces) + 2) for k in langs}
        for r in rows.collect():
            model[r.lang][r.piece] = r.c
        now.unpersist()
    return langs, _table(pieces, model)


class Numbers(dict):
    """Numbers of words, from 1; a word that is met first is listed as ``fresh``. Long words are 0 and not remembered."""

    def __init__(self):
        self.fresh: list[str] = []
        self.long = 0

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST:
            self.long += 1
            return 0
        self[word] = n = len(self) + 1
        self.fresh.append(word)
        return n


class Scorer:
    """Log probabilities of texts under each language."""

    def __init__(self, lattice: Lattice, p: np.ndarray):
        self.lattice, self.p = lattice, p
        self.known = Numbers()
        self.rows = np.zeros((1 << 16, p.shape[1]))  # by number

    def learn(self) -> None:
        """Scores the fresh words."""
        words, self.known.fresh = self.known.fresh, []
        need, at = len(self.known) + 1, len(self.known) + 1 - len(words)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need - len(self.rows), len(self.rows)), self.rows.shape[1]))])
        for ids in _by_length(words):
            self.rows[at + np.array(ids)] = self.lattice.log_probability(self.lattice.of([words[i] for i in ids]), self.p)

    def logs(self, texts: list[list[str]]) -> np.ndarray:
        """``[text, language]`` for lists of words."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known.long, number = 0, self.known.__getitem__
        numbers = [np.fromiter(map(number, t), np.intp, len(t)) for t in texts]
        self.learn()
        logs = np.array([self.rows.take(i, 0).sum(0) for i in numbers]).reshape(len(texts), -1)
        if self.known.long:
            none = np.zeros(self.p.shape[1])
            logs += np.array([sum((self.lattice.run_log_probability(w, self.p) for w in t if len(w) > LONGEST), none) for t in texts])
        return logs


def with_language(docs: DataFrame, labelled: DataFrame, vocabulary: str, text_col: str = "text", train_texts: int = TRAIN_TEXTS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, its probability among the languages learnt from ``labelled (id, text, lang)``.

    Languages are equally likely beforehand. Text that is null or has no letter is ``und`` with score 0, and
    so is every text if nothing is labelled; rows of ``labelled`` with a null are left out. Ties go to the
    language that sorts first. Repeated rows are each scored; an empty table gives no rows. Columns of the two
    names are replaced, others pass through. Runs of letters are summed whole at any length, a run of n letters
    in time that grows with n. ``score`` is finite, from 0 to 1: sums are kept in logs or rescaled.
    """
    pieces = pieces_of(vocabulary)
    langs, p = fit(labelled.dropna(subset=["text", "lang"]), pieces, train_texts, rounds)
    inner, name = sheltered(docs, ADDED)
    shared = docs.sparkSession.sparkContext.broadcast((Lattice(pieces), langs, p))
    at = inner.columns.index(name[text_col])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, langs, p = shared.value
        scorer = Scorer(lattice, p)
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                words = [words_of(t or "") for t in part.column(at).to_pylist()]
                if langs:
                    logs = scorer.logs(words)
                    best = logs.argmax(1)
                    score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                pred = [langs[best[i]] if w and langs else "und" for i, w in enumerate(words)]
                sure = [float(score[i]) if w and langs else 0.0 for i, w in enumerate(words)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    schema = StructType([*inner.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return restored(inner.mapInArrow(kernel, schema), docs, ADDED)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text, modulo 4, is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
