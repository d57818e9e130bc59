"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line is a sequence of words; its edit bound is one word (inserted, deleted or replaced) if it has
five words or more, so that lines at the bound are at least 0.8 alike, and zero below. Equal lines
collapse first. Each remaining line emits the hashed keys of its neighbourhood: itself with each one
word deleted, and itself whole. Lines with equal keys are joined, the edit distance is verified, and a
line stays only if no earlier one is within the bound.

Two lines one edit apart agree on the first or on the last half of the shorter one's words. So only
lines that share such a half with another emit their neighbourhood; that loses no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, restored, sheltered, written

#: Least words of a line that may differ by an edit.
NEAR_WORDS = 5
ADDED = ("n_lines", "n_removed")
#: What separates words (fixed value): ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def _words(line: str | Column) -> Column:
    return F.array_remove(F.split(F.col(line) if isinstance(line, str) else line, SPACE), "")


def _blank(line: Column) -> Column:
    """Whether a line has no word."""
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, rk, lines)``: ``rk`` tells rows of one id apart by their text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text).alias("_rk"), F.split(text, "\n").alias("_lines"))


def _bits(places: DataFrame) -> DataFrame:
    """Line numbers ``line_no`` of each ``(_id, _rk)`` as a map from ``line_no div 64`` to 64 bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("cast(line_no % 64 as int)"))
    words = places.groupBy("_id", "_rk", F.expr("cast(line_no div 64 as int)").alias("_w")).agg(F.bit_or(bit).alias("_b"))
    return words.groupBy("_id", "_rk").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_b"))).alias("_bits"))


def _has(bits: str, line_no: Column) -> Column:
    word = F.coalesce(F.element_at(F.col(bits), F.floor(line_no / 64).cast("int")), F.lit(0).cast("long"))
    return F.call_function("shiftrightunsigned", word, (line_no % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["_rk"] == b["_rk"]) & a["_id"].eqNullSafe(b["_id"])


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each distinct line with words: its hashes, number of words, first place, and keys of its halves."""
    each = _lines(docs, id_col, text_col).select("_id", "_rk", F.posexplode("_lines").alias("line_no", "line"))
    each = each.where(~_blank(F.col("line"))).select("_id", "_rk", "line_no", _words("line").alias("w"))
    n, w = F.size("w"), F.col("w")
    halves = []
    for s in (n, n - 1):  # the shorter line's words: this one's, or one fewer
        p = F.floor(s / 2).cast("int")
        halves += [F.xxhash64(s, F.lit(0), F.slice(w, 1, p)), F.xxhash64(s, F.lit(1), F.slice(w, n - (s - p) + 1, s - p))]
    place = F.struct(F.col("_id").isNull().alias("nameless"), F.col("_id").alias("id"), F.col("_rk").alias("rk"), F.col("line_no").alias("line_no"))
    halves = F.when(n >= NEAR_WORDS, F.array(*halves))
    each = each.select(F.xxhash64(w).alias("h"), F.xxhash64(F.lit(7), w).alias("g"), n.alias("n"), place.alias("place"), halves.alias("halves"))
    firsts = each.groupBy("h", "g").agg(F.min(F.struct("place", "n", "halves")).alias("x"))
    return firsts.select("h", "g", "x.n", "x.place", "x.halves")


def candidates(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(h, g, place, w)`` of the lines that share half of their words with another distinct line."""
    keys = classes.where(F.col("halves").isNotNull()).select("h", "g", "place", F.explode(F.array_distinct("halves")).alias("half"))
    shared = cut(keys.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").drop("c"))
    found = keys.join(shared, "half").select("place.id", "place.rk", "place.line_no")
    bits = _bits(found.select(F.col("id").alias("_id"), F.col("rk").alias("_rk"), "line_no").distinct())
    lines = _lines(docs, id_col, text_col)
    each = lines.join(bits, _same_row(lines, bits)).select(lines["_id"], lines["_rk"], F.posexplode("_lines").alias("line_no", "line"), "_bits")
    each = each.where(_has("_bits", F.col("line_no"))).select("_id", "_rk", "line_no", _words("line").alias("w")).distinct()
    place = F.struct(F.col("_id").isNull().alias("nameless"), F.col("_id").alias("id"), F.col("_rk").alias("rk"), F.col("line_no").alias("line_no"))
    return each.select(F.xxhash64("w").alias("h"), F.xxhash64(F.lit(7), "w").alias("g"), place.alias("place"), "w")


def _pair_sum(w: Column) -> Column:
    """Of a list of words, an order-bound hash that a deletion changes in one place: hashes of adjacent words, summed."""
    ends = F.concat(F.array(F.lit("")), w, F.array(F.lit("")))
    sums = F.zip_with(F.slice(ends, 1, F.size(ends) - 1), F.slice(ends, 2, F.size(ends) - 1), _pair)
    return F.aggregate(sums, F.lit(0).cast("long"), lambda a, x: a + x)


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b).bitwiseAND(F.lit((1 << 40) - 1))


def near_duplicates(lines: DataFrame) -> DataFrame:
    """``(h, g)`` of the candidate lines within one edit of an earlier one."""
    w, n = F.col("w"), F.size("w")
    base = lines.select("h", "g", "place", "w", n.alias("n"), _pair_sum(w).alias("pairs"))
    here = F.transform(w, lambda x, i: F.xxhash64(i, x))
    base = base.withColumn("here", here).withColumn("all", F.aggregate("here", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))
    at = lambda i: F.get(w, i)
    edge = lambda i: F.coalesce(at(i), F.lit(""))

    def key_of(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit("")).otherwise(edge(i - 1))
        without = F.col("pairs") - _pair(before, at(i)) - _pair(at(i), edge(i + 1)) + _pair(before, edge(i + 1))
        return F.struct(
            F.xxhash64(F.lit(0), F.col("n"), i, F.col("all").bitwiseXOR(x)).alias("replaced"),
            F.xxhash64(F.lit(1), F.col("n") - 1, without).alias("deleted"),
        )

    variants = base.select("h", "g", "place", "n", F.explode(F.transform("here", key_of)).alias("v"))
    variants = variants.select("h", "g", "place", "n", "v.replaced", "v.deleted")
    # Lines with one word deleted at the same place and equal otherwise are one edit apart, all of them: the earliest stands for all.
    replaced = variants.select("h", "g", "place", F.col("replaced").alias("key"))
    first = cut(replaced.groupBy("key").agg(F.min(F.struct("place", "h", "g")).alias("x"), F.count("*").alias("c")).where("c > 1").select("key", "x"))
    same = replaced.join(first, "key").where("place > x.place").select("h", "g", F.col("x.h").alias("eh"), F.col("x.g").alias("eg"))
    # A line with one word deleted equals another as it is.
    whole = base.select(F.xxhash64(F.lit(1), F.col("n"), F.col("pairs")).alias("key"), F.col("h").alias("wh"), F.col("g").alias("wg"), F.col("place").alias("wplace"))
    longer = variants.select(F.col("deleted").alias("key"), "h", "g", "place").join(whole, "key")
    after = F.col("place") > F.col("wplace")
    pick = lambda a, b: F.when(after, F.col(a)).otherwise(F.col(b))
    moved = longer.select(pick("h", "wh").alias("h"), pick("g", "wg").alias("g"), pick("wh", "h").alias("eh"), pick("wg", "g").alias("eg"))
    pairs = same.unionByName(moved).distinct()
    early = lines.select(F.col("h").alias("eh"), F.col("g").alias("eg"), F.col("w").alias("ew"))
    checked = pairs.join(early, ["eh", "eg"]).select("h", "g", "ew").join(lines.select("h", "g", "w"), ["h", "g"])
    return checked.where(one_edit(F.col("w"), F.col("ew"))).select("h", "g").distinct()


def one_edit(a: Column, b: Column) -> Column:
    """Whether two lists of words are at most one inserted, deleted or replaced word apart."""
    rest = lambda x, i: F.slice(x, i, F.size(x) + 1)
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    p = F.coalesce(F.nullif(F.array_position(equal, F.lit(False)), F.lit(0)), F.size(equal) + 1).cast("int")
    gap = F.size(a) - F.size(b)
    return (
        F.when(gap == 0, rest(a, p + 1) == rest(b, p + 1))
        .when(gap == 1, rest(a, p + 1) == rest(b, p))
        .when(gap == -1, rest(a, p) == rest(b, p + 1))
        .otherwise(F.lit(False))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text reduced to the lines that stay, and ``n_lines`` and ``n_removed``.

    A line goes if an earlier one equals it, word by word, or, at five words or more, is one word edit
    away; of lines it is the smaller ``id_col`` that is earlier, then the line's place. Lines without
    a word always stay. Rows of one id come in the order of a hash of their text, and rows that
    repeat id and text get the same result; rows with a null id come last. Null text stays null and
    has no line; a text all of whose lines go becomes empty. Columns named ``n_lines`` or
    ``n_removed`` are replaced, others pass through, whatever their names. An empty table gives no rows.
    """
    inner, name = sheltered(docs, ADDED)
    id_, text = name[id_col], name[text_col]
    classes = written(distinct_lines(inner, id_, text), "lines")
    lines = written(candidates(inner, classes, id_, text), "near-lines")
    gone = cut(near_duplicates(lines))
    stay = classes.join(gone, ["h", "g"], "left_anti").select(F.col("place.id").alias("_id"), F.col("place.rk").alias("_rk"), "place.line_no")
    bits = cut(_bits(stay)).withColumnsRenamed({"_id": "_kid", "_rk": "_krk"})
    keyed = inner.withColumn("_rk", F.xxhash64(F.col(id_), F.coalesce(F.col(text).cast("string"), F.lit(""))))
    whole = keyed.join(bits, (F.col("_rk") == F.col("_krk")) & F.col(id_).eqNullSafe(F.col("_kid")), "left")
    pieces = F.split(F.col(text), "\n")
    kept = F.filter(pieces, lambda x, i: F.coalesce(_has("_bits", i), F.lit(False)) | _blank(x))
    whole = whole.withColumn("_kept", kept).withColumn("n_lines", F.greatest(F.coalesce(F.size(pieces), F.lit(0)), F.lit(0)))
    gone = F.greatest(F.col("n_lines") - F.size("_kept"), F.lit(0))
    whole = whole.withColumn("n_removed", F.when(F.col(text).isNull(), F.lit(0)).otherwise(gone)).withColumn(text, F.array_join("_kept", "\n"))
    return restored(whole, docs, ADDED)


#: DuckDB SQL with the rows of ``dedup_lines`` (columns doc_id, text, n_lines, n_removed).
SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) - 1 AS line_no, unnest(x) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
), t AS (
  SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS w FROM l
), firsts AS (
  SELECT w, len(w) AS n, min((doc_id, line_no)) AS place FROM t WHERE len(w) > 0 GROUP BY w
), v AS (
  SELECT w, n, place, i, list_concat(w[1:i-1], w[i+1:n]) AS d
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= 5)
), replaced AS (SELECT n, i, d, min(place) AS place FROM v GROUP BY n, i, d),
gone AS (
  SELECT v.w FROM v JOIN replaced r ON v.n = r.n AND v.i = r.i AND v.d = r.d WHERE v.place > r.place
  UNION SELECT CASE WHEN v.place > f.place THEN v.w ELSE f.w END FROM v JOIN firsts f ON v.d = f.w AND f.n >= 5
), marked AS (
  SELECT t.doc_id, t.line_no, t.line, len(t.w) = 0 OR ((t.doc_id, t.line_no) = f.place AND g.w IS NULL) AS stays
  FROM t LEFT JOIN firsts f ON t.w = f.w LEFT JOIN (SELECT DISTINCT w FROM gone) g ON t.w = g.w
)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.line_no) FILTER (WHERE m.stays), '') END AS text,
  CAST(count(m.line_no) AS INTEGER) AS n_lines, CAST(count(m.line_no) FILTER (WHERE NOT m.stays) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.text
"""
