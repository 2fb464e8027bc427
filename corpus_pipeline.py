"""Training corpus from raw documents: toxicity, quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and judges all rows that it is given. ``run`` applies them in order and
writes each result to the shared folder, so a lost executor costs the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import dedup, packing, quality, simhash, toxicity
from wardline.llm.shared import table
from wardline.sources import staging


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: without rows that score 0.5 or more. Null texts score as empty ones; null ids stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_flagged(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: without rows that fail a rule. Null and empty texts have too few words."""
    return quality.passing(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts the row with the largest doc_id."""
    return dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each near-duplicate group, on shingles of five words, the row with the least doc_id."""
    return simhash.drop_near_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the place of every piece of every document in sequences of 2,048 tokens.

    Executors have run four stages by now and their heaps are full, so workers get a smaller memo.
    """
    return packing.pack(docs, with_ids=False, memo=120_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: Models and SimHash have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. What a stage staged on its way, and the table it was given, are deleted when
    its own result is written; the last result stays until the application's folder is cleaned."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = staging.new_path(spark, f"pipeline-{k}")
        with staging.scope(spark, f"stage-{k}"):
            docs = staging.write(stage(spark, docs, sf_dir), path)
        if before is not None:
            staging.delete(spark, before)
        before = path
    return docs
