"""The corpus pipeline: language ID, exact dedup, near dedup, mixing and packing, each over all that the stage before kept.

Extra columns pass through all stages but the last, whatever their names; columns that the
operators add for themselves get names that are free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import dartminhash, exactdup, langid, mixing, packing
from tallyforge.llm.shared import delete, fresh_path, scratch, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others go.

    Null, empty and letterless texts have no language and go.  Repeated rows are judged alike; a null
    id is judged like any other, only such rows aren't taught from.  Very long texts are read whole.
    Without labelled rows nothing is recognised, and an empty table stays empty.
    """
    return langid.identify(docs, langid.train_profiles(docs), accepted_only=True)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the document with the smallest id.

    Null texts are no copies of one another and stay; empty texts are one group.  Of equal rows one
    stays.  A null id comes after all others.  Texts are compared whole; an empty table stays empty.
    """
    return exactdup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Null and empty texts, texts without words and rows without an id are in no group and stay.  Of
    equal rows with an id one stays; texts that share an id are one document.  An empty table stays empty.
    """
    return dartminhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as came in, drawn so that sources weigh as the square root of what they hold.

    Null texts are never drawn, empty ones count as one unit.  Null is a source like any other.  Of
    equal rows at the end of a sample as many are drawn as it asks for.  An empty table stays empty.
    """
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document, or piece of one, in a training window.

    Null and empty texts are placed nowhere.  Repeated rows, which mixing makes, are placed as often
    as they occur; null ids come first.  Long texts are cut into pieces.  An empty table gives no row.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Sketches and online packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage wrote on its way, and its predecessor's table, are deleted when its own table is there.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        delete(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
