"""The corpus pipeline: toxicity, language ID, near-dedup, substring dedup and packing, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tributary.llm import langid, neardup, packing, substrings, toxicity
from tributary.llm.runtime import new_path, remove_path

#: No stage's rows can be had by SQL; tests/llm/test_pipeline.py holds run() and its stages against plain Python.
ORACLE_SQL = None



def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold stay. Labels are those of sf_dir; rows without doc_id stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.language_model(docs)
    found = toxicity.train(docs, labels, model)
    return toxicity.keep(docs, found, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose cross-entropy some language explains stay."""
    model, limit = langid.train(docs)
    return langid.keep(docs, model, limit)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row with the smallest doc_id of each class stays, and every row without doc_id."""
    return neardup.keep(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has too; a text without any stays as it is."""
    return substrings.cut(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language ID", keep_known_languages), ("near-dedup", drop_near_copies), ("substring dedup", cut_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written to the shared folder and read again.

    A stage's rows are deleted once the next one's are written; the last stage's input goes when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_path(spark, "stage")
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove_path(spark, before)
            before = path
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
