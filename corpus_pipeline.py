"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

Each stage but the last returns the columns of ``documents``. Rows are dropped by the ids that go,
so repeated rows share a fate and no row is multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.exact import exact_dedup
from weftgraph.llm.hostrules import host_rules
from weftgraph.llm.packing import pack
from weftgraph.llm.queries import tokenizer
from weftgraph.llm.shared import small_enough, write_out
from weftgraph.llm.similar import similar_dedup
from weftgraph.llm.suffix import suffix_dedup


def _staying(docs: DataFrame, verdicts: DataFrame, what: str) -> DataFrame:
    """The rows of ``docs`` whose id, null among them, has a verdict (doc_id, stays) that holds.

    The few ids that go are written out and, if they are small, broadcast, so that texts aren't shuffled.
    """
    gone = verdicts.groupBy("doc_id").agg(F.max("stays").alias("stays")).filter("not stays").select(F.col("doc_id").alias("gone"))
    gone = write_out(gone, f"gone-{what}")
    return docs.join(small_enough(gone), docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go."""
    return _staying(docs, host_rules(docs).select("doc_id", F.col("kept").alias("stays")), "rules")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return _staying(docs, exact_dedup(docs).select("doc_id", F.col("kept").alias("stays")), "exact")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return _staying(docs, similar_dedup(docs).select("doc_id", F.expr("doc_id <=> component_id").alias("stays")), "near")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 400-byte strings that occur twice go from the texts; a character that is cut goes whole. n_chars follows."""
    cut = suffix_dedup(docs, with_row=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row")["n_chars"])
    changed = {"text": F.col("kept_text"), "n_chars": n_chars}
    return cut.select(*((changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return pack(docs, *tokenizer("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packing),
]

#: SimHash, the suffix stage and packing aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
