"""A training corpus from raw documents: drop toxic ones, exact and near copies, mix the sources, pack into sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. All but the last return
the columns of ``documents``, with whatever other columns ``docs`` has, unchanged, also where they have names that an
operator uses itself. Texts are read whole; a null text counts as an empty one; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabq.llm.common import cut, shared_path, table, text_of
from tabq.llm.exact import exact_dedup
from tabq.llm.mixing import mix_documents
from tabq.llm.neardup import near_duplicates
from tabq.llm.packing import pack, vocabulary
from tabq.llm.toxicity import fit_chain, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject.

    Row by row: repeated rows stay or go together, empty texts get the base rate and stay, null ids are scored like others.
    """
    chain = fit_chain(docs, table(spark, sf_dir, "labels"))
    held = docs.select(F.struct("*").alias("row"), text_of(docs).alias("text"))
    return score(held, chain).where("NOT rejected").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id.

    Null and empty texts are equal. Rows that repeat that id with that text all stay; null ids lose against any other, and
    all stay where there is no other.
    """
    gone = exact_dedup(docs).where("NOT kept").select("doc_id", "text_sha256").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.sha2(text_of(docs), 256).alias("sha256"))
    same = (keyed["sha256"] == gone["text_sha256"]) & keyed["row.doc_id"].eqNullSafe(gone["doc_id"])
    return keyed.join(gone, same, "left_anti").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document with the smallest id.

    Texts without words are alike to nothing and stay, as do rows with a null id. Of a repeated id all rows stay or go.
    """
    gone = cut(near_duplicates(docs, shingle=5, percent=80).where("NOT kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is one of its own, after all others; documents without words come with a source's whole repetitions; rows of
    one source and id are taken together.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Every row is packed, repeated ones and null ids too; an empty text is its end mark."""
    return pack(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]

#: The classifier, the tokenizer and the packing have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
