import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import same_rows

from gaugeworks.llm import mixing, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens int, weight string"


def test_raked_sums_are_the_targets(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 40), ("b", "x", 30), ("b", "y", 20), (None, "y", 0)], "source string, lang string, tokens bigint")
    targets = {
        "source": spark.createDataFrame([("a", 0.3), ("b", 0.7)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 0.6), ("y", 0.4)], "lang string, target double"),
    }
    raked = mixing.rake(cells, targets, rounds=6).toPandas()
    assert abs(raked.weight.sum() - 100) < 1e-9
    assert abs(raked[raked.lang == "x"].weight.sum() - 60) < 1e-9 and abs(raked[raked.source == "a"].weight.sum() - 30) < 0.1


def test_sample_follows_the_rates(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'w w' AS text", "'en' AS lang", "if(id % 4 = 0, 's', 't') AS source")
    one = lambda d, v: spark.createDataFrame([(v, 1.0)], f"{d} string, target double")
    even = {"source": spark.createDataFrame([("s", 0.5), ("t", 0.5)], "source string, target double"), "lang": one("lang", "en"), "topic": one("topic", "short")}
    got = {r.source: r["count"] for r in mixing.mixed(docs, even).groupBy("source").count().collect()}
    assert got["s"] == 1000 and 900 < got["t"] < 1100  # the largest weight is taken whole
    own = mixing.mixed(docs, even | {"topic": one("topic", "mine")}, topic=F.lit("mine"))
    assert own.count() == sum(got.values()) and {r.topic for r in own.select("topic").distinct().collect()} == {"mine"}


def test_query_has_the_target_shares(spark):
    """On the whole table of sf0.1, each value's share of the sample's tokens is its target within sampling error."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.mixed(docs).select("source", "lang", "topic", "n_tokens", "p").toPandas()
    cells = docs.select("source", "lang", mixing.topic_of(F.col("text")).alias("topic"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).alias("n")).toPandas()
    total, squares = got.n_tokens.sum(), (got.n_tokens.astype(float) ** 2).sum()
    error = 5 * squares**0.5 / total
    far = 0.0
    for d, power in mixing.TEMPER.items():
        want = cells.groupby(d).n.sum() ** power
        off = (got.groupby(d).n_tokens.sum() / total).reindex(want.index).fillna(0) - want / want.sum()
        far = max(far, off.abs().max())
    assert len(got) > 100 and far < error, (far, error)


def test_whole_sample_has_the_target_shares(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "'w w' AS text", "if(id % 3 = 0, 'en', 'fr') AS lang", "if(id % 4 = 0, 's', 't') AS source")
    even = {
        "source": spark.createDataFrame([("s", 0.5), ("t", 0.5)], "source string, target double"),
        "lang": spark.createDataFrame([("en", 0.6), ("fr", 0.4)], "lang string, target double"),
        "topic": spark.createDataFrame([("short", 1.0)], "topic string, target double"),
    }
    got = mixing.mixed(docs, even).groupBy("source", "lang").count().toPandas()
    total = got["count"].sum()
    assert total > 1500
    assert abs(got[got.source == "s"]["count"].sum() / total - 0.5) < 0.03 and abs(got[got.lang == "en"]["count"].sum() / total - 0.6) < 0.03
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_one_odd_document_does_not_empty_the_sample(spark):
    """A topic of one short text among 20,000 documents gets a bounded target; most of the others' tokens stay in reach."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id = 7, 'Licensed under X', 'w w w w w w w w w w') AS text", "'en' AS lang", "'s' AS source")
    cells = docs.groupBy(mixing.topic_of(F.col("text")).alias("topic")).agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("tokens"))
    target = {r.topic: r.target for r in mixing.tempered(cells, {"topic": 0.5})["topic"].collect()}
    held, free = mixing.GROWTH * 3 / 199_993, 199_990**0.5 / (3**0.5 + 199_990**0.5)
    assert abs(target["licensed"] - held / (held + free)) < 1e-12 and abs(sum(target.values()) - 1) < 1e-12
    got = mixing.mixed(docs)
    assert 3700 < got.count() < 4300 and got.where("topic = 'licensed'").count() == 1


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "some words here", None, "web", 15), (3, "w " * 50_000, "en", "web", 100_000), (3, "w " * 50_000, "en", "web", 100_000)]
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA).withColumns({"_source": F.lit("mine"), "_lang": F.lit(1), "a.b": F.lit(2), "c`d": F.lit(3), "target": F.lit(4)})
    got = mixing.mixed(df)
    assert got.columns == [c for c in df.columns if c != "weight"] + ["topic", "n_tokens", "weight", "p"]
    assert {(r["_source"], r["a.b"], r["c`d"]) for r in got.collect()} == {("mine", 2, 3)}
    out = got.collect()
    assert {1, 2} <= {r.doc_id for r in out}  # no tokens: weight 1
    assert sum(r.doc_id == 3 for r in out) in (0, 2)  # rows of one id go together
    assert mixing.mixed(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"  # on fewer documents, shares need more rounds than the SQL has
    same_rows(queries.QUERIES["op10_source_mixing"](spark, folder), queries.ORACLE_SQL["op10_source_mixing"], folder)
