"""A corpus pipeline of five stages, each one operator of ``flowmine.llm``.

Every stage but the last takes and returns rows with the columns of
``documents``; ``run`` writes each result to the cluster's shared folder and
reads it back for the next stage.

All stages take null and repeated ids, null, empty and very long texts, repeated
rows, empty tables and further columns, which they carry along whatever their
names; each docstring says what becomes of such rows. An empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmine.llm.common import stage, table
from flowmine.llm.mixing import mix
from flowmine.llm.quality import keep_good
from flowmine.llm.sentencepieces import encode
from flowmine.llm.simhash import keep_representatives
from flowmine.llm.substrings import cut_repeats


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a text that was cut; without that column nothing changes."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have too few words and go. Repeated rows and rows without
    an id are judged alike, one by one; a text is judged whole, however long.
    """
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, one row each.

    Null and empty texts are copies of each other. Of rows that repeat the smallest
    id the one with the least hash of text, then of all columns, stays; a row without
    an id stays only in a group that has no id at all, one of each.
    """
    return keep_representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that start earlier elsewhere.

    Rows follow each other by id, then by a hash of the text, those without an id
    last; a repeated row loses what the first one keeps and stays with what is left.
    Null texts stay null; ``n_chars`` follows the text.
    """
    return _recounted(cut_repeats(docs).select(*docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them; those it does not reach go.

    Texts without words (or null) take no share and go. Rows that share an id, or
    have none, are mixed one by one; a null source is one of its own, the last.
    """
    return _recounted(mix(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, score and next best segmentations of each row of the mix.

    A null text is encoded like an empty one; repeated rows are encoded alike.
    """
    return encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: SimHash and piece lattices have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
