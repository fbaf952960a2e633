"""Documents to training pieces: five stages, each written as Parquet and reread as the next one's input.

Every stage works on all rows that the one before kept. All but the last return the columns of
``documents``; the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendframe.llm import decontaminate, exact_dedup, pieces, quality, simhash
from lendframe.llm.common import remainder
from lendframe.session import scratch_path, ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the passage model, fitted on the labels outside the held-out third, predicts to be of low quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.filter(remainder("doc_id", 3) != 1))
    return quality.keep_good(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document that is left."""
    return pieces.encode_documents(docs, carry=["doc_id", "lang", "source", "n_chars"])


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
          ("decontamination", without_benchmark), ("encoding", encoded)]

#: SQL has neither the trained model nor the segmentation; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
