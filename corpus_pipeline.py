"""A training corpus from raw documents: toxicity, near duplicates, benchmark decontamination, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenvec.llm.common import drop_scratch, free_driver, materialize, table
from lumenvec.llm.decontaminate import drop_leaks
from lumenvec.llm.mix import mixed_documents
from lumenvec.llm.near_dup import drop_near_duplicates
from lumenvec.llm.packing import pack_documents
from lumenvec.llm.toxic import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't call toxic.

    Null and empty texts are judged as texts without words and stay; a null language has the threshold of all; repeated rows share a
    verdict; without labels of both kinds the score is a constant; an empty table stays empty. Columns of any name come through.
    """
    free_driver(spark)
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Rows are judged one by one, so null and repeated ids are like any other; of a group the row of the least id stays, of these the first.
    Null, empty and blank texts are no group and all stay; an empty table stays empty. Columns of any name come through.
    """
    free_driver(spark)
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as do all documents where the benchmark is empty; rows that share an id, or have none, are judged
    each by its text; an empty table stays empty. Columns of any name come through.
    """
    free_driver(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each source; a document that is taken twice comes twice.

    Texts without words (null, empty, blank) aren't in the mix; a null source is a source, the last; equal rows are interchangeable;
    ``n_chars`` is counted anew; an empty table stays empty. Columns of any name come through.
    """
    free_driver(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids: rows of ``pack_documents``, with the ids of the documents in each.

    Texts without ids are in no row; null ids stay null; repeated rows are packed each; long texts are split without loss; an empty table
    gives no rows. Other columns are not looked at.
    """
    free_driver(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("packing", packing)]

#: Trained scores, seeded block selection and token ids have no SQL. tests/llm has each stage on odd input, and its operator against brute
#: force, an exact round trip or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        new = materialize(out, name)
        if k:
            drop_scratch(docs)
        docs = new
