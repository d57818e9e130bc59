"""The corpus pipeline: five stages, each over all documents that the one before kept.

Quality filter, line deduplication, near-duplicate removal, mixing, tokens. Every stage takes and, but for
the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, line_dedup, mixing, quality, simhash
from gaugeworks.llm.common import restored, sheltered, table, written
from gaugeworks.llm.queries import VOCABULARY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the others stay as they are.

    A null id, text, source or language is scored like any value, repeated rows alike; no labels reject nothing.
    """
    inner, name = sheltered(docs)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", name["doc_id"])
    out = quality.scored(inner, labels, name["doc_id"], name["text"], (name["source"], name["lang"]))
    return restored(out.where("keep"), docs, ())


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier one equals or nearly equals go; ``n_chars`` follows the text.

    A null text stays null (with a null ``n_chars``), an emptied one is an empty text; no document goes. Rows with
    a null id come last, rows that repeat id and text get the same result.
    """
    inner, name = sheltered(docs)
    out = line_dedup.dedup_lines(inner, name["doc_id"], name["text"])
    return restored(out.withColumn(name["n_chars"], F.length(name["text"]).cast("bigint")), docs, ())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Groups are joined by SimHash fingerprints of five-word shingles at two bits or fewer, and by shingle sets at a
    Jaccard similarity of 0.8 or more. Rows with a null id stay, as do all rows of the id that stays. Texts without
    a word are copies of each other.
    """
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics.

    Null source or language is a value of its own; documents without tokens stay. Rows of one id go or stay together.
    """
    inner, name = sheltered(docs)
    known = {name["source"]: "source", name["lang"]: "lang"}
    out = mixing.mixed(inner.withColumnsRenamed(known), id_col=name["doc_id"], text_col=name["text"])
    return restored(out.withColumnsRenamed({v: k for k, v in known.items()}), docs, ())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of what is left, with digests of ids and of the decoded text; a null text is an empty one."""
    return bpe.with_tokens(docs, VOCABULARY, digest=True)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", near_dedup), ("mix", mix), ("bpe", tokens)]
#: SQL can express neither the near duplicates of the third stage nor the merges of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
