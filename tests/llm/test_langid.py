import random
import time
import zlib

import numpy as np

from gaugeworks.llm import langid, queries

SCHEMA = "doc_id bigint, text string, id string, lang string, score string"


def all_cuts(s, p, pieces):
    """The probability of ``s`` by every way to cut it."""
    if not s:
        return 1.0
    total = 0.0
    for n in range(1, len(s) + 1):
        if s[:n] in pieces:
            total += p[pieces[s[:n]]] * all_cuts(s[n:], p, pieces)
        elif n == 1:
            total += langid.STRANGE * all_cuts(s[1:], p, pieces)
    return total


def test_forward_sums_all_segmentations():
    names = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    pieces = {s: i for i, s in enumerate(names)}
    lattice = langid.Lattice(names)
    p = np.random.default_rng(1).random((len(names) + 2, 2))
    p[-2], p[-1] = langid.STRANGE, 0
    for words in (["ab", "ba", "xa"], ["ababa", "bbbab"]):
        got = lattice.forward(lattice.of(words), p)[-1] / langid.SCALE ** (len(words[0]) + 1)
        want = [[all_cuts("▁" + w, p[:, k], pieces) for k in (0, 1)] for w in words]
        assert np.allclose(got, want, rtol=1e-9)
        # Expected counts, weighted with the pieces' lengths, cover every character once.
        counts = lattice.expected(lattice.of(words), p[:, :1], np.ones(len(words)))
        covered = sum(c * len(s) for c, s in zip(counts, names)) + counts[len(names)]
        assert abs(covered - sum(len(w) + 1 for w in words)) < 1e-9


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.QUERIES["op7_language_id"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(right) > 100 and sum(right) >= 0.95 * len(right)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "the cat and the dog " * 20_000), (5, "le chat et le chien"), (5, "le chat et le chien"), (None, "x" * 500)]
    df = spark.createDataFrame([(*r, "i", None, "s") for r in rows], SCHEMA)
    known = spark.createDataFrame([(1, "the dog and the cat", "en"), (2, "le chien et le chat", "fr"), (3, None, "fr"), (4, "x", None)], "id bigint, text string, lang string")
    got = langid.with_language(df, known, queries.PIECES).collect()
    pred = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == 7 and [pred[k] for k in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "fr"]
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}
    assert {r.lang_pred for r in langid.with_language(df, known.limit(0), queries.PIECES).collect()} == {"und"}
    assert langid.with_language(df.limit(0), known, queries.PIECES).count() == 0


def test_long_runs_of_uncovered_letters(spark):
    """A run that no piece covers, in learnt and in scored texts, spoils neither counts nor the other words' evidence."""
    names = ["▁", "a", "b", "ab"]
    lattice, p = langid.Lattice(names), np.array([[0.4, 0.3], [0.3, 0.4], [0.2, 0.2], [0.1, 0.1], [langid.STRANGE] * 2, [0, 0]])
    for word in ("x" * 62, "x" * 64, "x" * 500, "ab" + "x" * 62, "b" * 64):
        counts = lattice.expected(lattice.of([word]), p[:, :1], np.ones(1))
        assert abs(sum(c * len(s) for c, s in zip(counts, names)) + counts[4] - len(word) - 1) < 1e-6
        assert np.allclose(lattice.run_log_probability(word, p), lattice.log_probability(lattice.of([word]), p)[0], rtol=1e-9)
        assert np.isfinite(lattice.log_probability(lattice.of([word]), p)).all()
    short = lattice.of(["abxab"])
    assert np.allclose(lattice.log_forward(short, langid._log(p))[-1], lattice.log_probability(short, p), rtol=1e-12)
    assert np.allclose(lattice._log_expected(short, langid._log(p[:, :1]), np.full(1, 3.0)), lattice.expected(short, p[:, :1], np.full(1, 3.0)), rtol=1e-9)
    assert len(langid.words_of("x" * 5000)) == 1 and np.isfinite(lattice.run_log_probability("x" * 5000, p)).all()
    run = "\u1200" * 5000  # Amharic, which is not in the vocabulary
    known = spark.createDataFrame([(1, "the dog and the cat", "en"), (2, "le chien et le chat " + run, "fr"), (3, run, "en")], "id bigint, text string, lang string")
    df = spark.createDataFrame([(1, f"le chat et le chien {run}"), (2, f"the cat {run} and the dog"), (3, run)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.with_language(df, known, queries.PIECES).collect()}
    assert got[1].lang_pred == "fr" and got[2].lang_pred == "en" and all(0 < r.score <= 1 for r in got.values())


def plain_lattice(lattice, words):
    """``Lattice.of`` by looking every substring up."""
    n = len(words[0]) + 1
    most = min(n, lattice.longest)
    out = np.full((len(words), n, most), lattice.none)
    for k, w in enumerate(words):
        s, rows = "▁" + w, out[k]
        for end in range(1, n + 1):
            for size in range(1, min(end, most) + 1):
                if (i := lattice.ids.get(s[end - size : end])) is not None:
                    rows[end - 1, size - 1] = i
            if rows[end - 1, 0] == lattice.none:
                rows[end - 1, 0] = lattice.strange
    return out


def test_lattices_of_many_words_hold_every_piece():
    r = random.Random(3)
    for names in (["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "é", "\U00010428b", "bbbbbb"], ["ab"], []):
        lattice = langid.Lattice(names)
        for n in (1, 2, 5, 9, 70):
            words = ["".join(r.choice("aabbéxж\U00010428\uffff\U0010ffff") for _ in range(n)) for _ in range(50)]
            assert np.array_equal(lattice.of(words), plain_lattice(lattice, words))


def test_new_words_are_cut_fast():
    """Texts keep bringing new words, so that their cuts are most of the time."""
    r = random.Random(4)
    lattice = langid.Lattice(langid.pieces_of(queries.PIECES))
    parts = ["en", "the", "tion", "re", "ng", "st", "é", "ou", "a"]
    words = list({"".join(r.choice(parts) for _ in range(6))[:9].ljust(9, "s") for _ in range(20_000)})
    times = {"of": [], "plain": []}
    for _ in range(3):
        for k, f in (("of", lattice.of), ("plain", lambda w: plain_lattice(lattice, w))):
            at = time.process_time()
            f(words)
            times[k].append(time.process_time() - at)
    assert np.array_equal(lattice.of(words), plain_lattice(lattice, words))
    assert min(times["of"]) < 0.6 * min(times["plain"])


def test_words_are_remembered_until_there_are_many(monkeypatch):
    names = ["▁", "a", "b", "ab"]
    lattice, p = langid.Lattice(names), np.array([[0.4, 0.3], [0.3, 0.4], [0.2, 0.2], [0.1, 0.1], [langid.STRANGE] * 2, [0, 0]])
    batches = [[["ab", "b", "ab"], [], ["x" * 100, "a"]], [["b", "aab"], ["x" * 100]], [["abab"], ["ab", "a"]]]
    for most in (1, 500_000):
        monkeypatch.setattr(langid, "REMEMBERED", most)
        scorer = langid.Scorer(lattice, p)
        for texts in batches:
            want = [sum((lattice.run_log_probability(w, p) for w in t), np.zeros(2)) for t in texts]
            assert np.allclose(scorer.logs(texts), want, rtol=1e-12)
        assert len(scorer.known) == (3 if most == 1 else 5) and "x" * 100 not in scorer.known
