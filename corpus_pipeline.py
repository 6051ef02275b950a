"""The corpus pipeline: documents through language ID, near-duplicate removal, decontamination, mixing and sharding.

Every stage works on all that the one before has kept. All but the last
return the columns of documents; the last returns each kept document's shard.
Empty tables pass through every stage, very long texts are judged as a whole,
repeated rows stay or go together, and further columns pass through under any
name. Rows that share a doc_id are one document. Rows with a null doc_id are
judged by their text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import saved, unused
from lathe.llm.decontaminate import decontaminated
from lathe.llm.jaccard import jaccard_components
from lathe.llm.language import with_language
from lathe.llm.mixing import mixed
from lathe.llm.sharding import shard_documents


def _same(docs: DataFrame) -> list:
    """The columns of docs, also those with a dot in their name."""
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be found: a null or empty text, or one without a letter. The others stay, also where no language could be learned. Ties between languages go to the first by name and drop nothing."""
    found, lang, _ = with_language(docs)
    return found.where(F.col(lang).isNull() | (F.col(lang) != "und")).select(*_same(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every component of near-duplicates the document with the smallest doc_id, so ties can't occur; its repeated rows all stay. Documents without words are no duplicates. Rows without a doc_id stay."""
    name = unused(docs, "_gone")
    ids = jaccard_components(docs).where("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct()
    # Saved, so its size is known before the join is planned: few ids are broadcast, and texts stay where they are.
    gone = saved(ids, "gone")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of benchmark: a window as similar as the threshold or more. Null and empty texts hold none; without benchmark items all stay."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mix takes them, in an order that doc_id and text give, so reruns agree. Documents without words, null texts too, don't come; a null source is one of its own."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot. Equal texts stay together where they fit; null texts count as empty, null doc_ids are placed like others, repeated rows have slots of their own."""
    return shard_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express language ID and sharding; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the folder's documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
