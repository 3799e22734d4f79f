"""A corpus from raw documents to packed sequences, five stages of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, packing, quality, shingles, toxicity
from tessera.session import table, written

#: Words of a shingle where pages of the pipeline count as near-duplicates.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the current quality policy keeps, by their entries in the rule ledger.

    A null or blank text has too few words and goes.  Rows are judged where
    they lie: repeated rows and ids, null ids and ties stay as they are, no
    rows give none.
    """
    whole = docs.select(F.struct(*docs.columns).alias("__doc"), "text")
    return quality.apply_policy(quality.ledger(whole)).where("kept").select("__doc.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scored below the threshold; fitted on the labelled ones among those handed over.

    Null and empty texts get the base rate of such examples, which stays below
    the threshold.  A row's own label never enters its score; repeated rows and
    null ids are judged row by row, no rows give none.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.clean_documents(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose five-word shingle sets are 0.8 similar.

    SimHash fingerprints at two bits or fewer find candidates; at that
    similarity 64-bit fingerprints differ in about ten bits, so MinHash bands
    find the others, and whole shingle sets decide on both.  The smallest
    doc_id of a group stays, one without an id only where none has one, of
    repeated ids the first row.  Null and blank texts are one group, no rows
    give none.
    """
    return shingles.representatives(docs, SHINGLE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item within a fifth of its words in edits.

    Null and empty texts and items hold nothing; rows are judged where they
    lie, repeated rows and null ids stay as they are, no rows give none.
    """
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences.

    A null or empty text is its end id alone; repeated rows and ids are packed
    each, no rows give none.
    """
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints, walks and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
