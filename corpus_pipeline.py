"""Cleaning of a corpus in stages; each takes the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import decontamination, line_dedup, packing, quality_rules, simhash
from tallyhouse.llm.common import table, written

VOCABULARY = "word_bpe_49k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the document with the largest id only."""
    df = line_dedup.without_shared_lines(docs.select(*COLUMNS))
    df = df.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source")
    return df.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too many words inside benchmark windows go."""
    items = table(spark, sf_dir, "benchmark")
    df = decontamination.hits(docs.select(*COLUMNS), items, with_text=True)
    df = df.where(~decontamination.contaminated())
    return df.select("row.doc_id", "text", "row.lang", "row.source", "row.n_chars")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents, each with its place in a packed sequence."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", sequences),
]

#: SimHash fingerprints and the packing have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
