import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import same_rows

from gaugeworks.llm import line_dedup, queries

SCHEMA = "doc_id bigint, text string, extra int"


def near(a, b):
    """Equal, or at five words or more one word apart."""
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def brute(rows):
    """Rows of distinct ids: line by line against all earlier lines."""
    seen, out = [], {}
    for i, text in sorted(rows):
        kept, lines = [], (text or "").split("\n") if text is not None else []
        for line in lines:
            words = line.split()
            if not words or not any(near(words, s) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[i] = (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "x " * 30_000), (103, "x " * 29_999 + "y ")]
    got = line_dedup.dedup_lines(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "one two three four five\nshort", 1), (1, "one two three four five\nshort", 2), (None, "one two three four six\nnew words here", 3), (2, "short\n\n  ", None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 AS n_removed", "1 AS _bits", "2 AS _rk", "3 AS _id", "4 AS _kept", "5 AS h", "6 AS `a.b`"))
    assert got.columns == ["doc_id", "text", "extra", "_bits", "_rk", "_id", "_kept", "h", "a.b", "n_lines", "n_removed"]
    got = got.collect()
    text = {r.extra: r.text for r in got}
    assert text == {1: rows[0][1], 2: rows[0][1], 3: "new words here", None: "\n  "}
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_sql(spark, sf):
    same_rows(queries.QUERIES["op6_line_dedup"](spark, sf), queries.ORACLE_SQL["op6_line_dedup"], sf)


def test_words_are_split_without_interpreted_functions(spark):
    """Lines are told from blank ones before they are split, once, and empty words go by a function that is compiled."""
    docs = spark.createDataFrame([(1, " a  b\t\x0bc \n\n \t\nq"), (2, None), (3, "\x1fx  y"), (4, "")], "doc_id long, text string")
    got = line_dedup.distinct_lines(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(split" not in plan and plan.count(r"[\x20\x09-\x0D]+") == 1
    assert sorted((r.place.id, r.place.line_no, r.n) for r in got.collect()) == [(1, 0, 3), (1, 3, 1), (3, 0, 2)]
    assert [r.text for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [" a  b\t\x0bc \n\n \t\nq", None, "\x1fx  y", ""]
