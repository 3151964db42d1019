"""The corpus pipeline: toxicity, near-dedup, benchmark decontamination, personal data, and mixing of what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one takes as docs. All but the last return the
columns of docs as they are, whatever their names; the last adds columns of its own. In every stage null texts and texts without words stay
and stay as they are, rows without an id stay, rows that repeat are treated alike, texts of any length are read whole, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.llm import decontam, mixing, neardup, pii, toxicity as tox
from plinth.llm.common import settle, ship, table
from plinth.llm.queries import held_out

#: A document is rejected as toxic from this score.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC. The lexicon is learned from the labels over the documents as they came."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1)).select("doc_id", "toxic")
    return docs.where(tox.score(tox.learn(docs, labels))(F.col("text").cast("string")) < TOXIC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), that of the smallest id."""
    ship(spark)
    return neardup.deduplicate(docs, width=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    ship(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    ship(spark)
    return pii.mask(docs, pii.bootstrap(pii.scan(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its repetitions in the mix: size, source_size, target (words), whole repetitions and taken words."""
    return mixing.mix(docs, weights=[5, 2, 1], share=1.5, max_epochs=2, keep=docs.columns)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", personal_data), ("mixing", mixture)]
#: Several stages can't be told in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
