"""A corpus pipeline of five stages: quality, near-duplicates, repeated passages, benchmark items, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.lineage import written
from orrery.llm import bpe, decontaminate, passages, quality, simhash
from orrery.llm.common import table
from orrery.llm.queries import TOKENIZERS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; hosts are the sources, paths their languages."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.near_duplicates_removed(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; ``n_chars`` follows the text."""
    return passages.passages_removed(docs, keep=1).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and what they decode to, as digests, with the ids themselves."""
    found = bpe.encode_documents(docs, str(TOKENIZERS / "word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("substring dedup", passage_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe encoding and decoding", encoding_stage),
]

#: SQL can express neither the fitted classifier nor chains and merges; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
