"""From raw documents to packed training windows: language, copies, near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eigenloom.llm.bag_minhash import drop_near_duplicates
from eigenloom.llm.block_naming import columns_of, drop_exact_duplicates, whole_row
from eigenloom.llm.language_masks import UNKNOWN, fit_languages, identify_languages
from eigenloom.llm.queries import SURROGATE_KEY, fold, tokenizer_file
from eigenloom.llm.surrogates import replace_personal_data
from eigenloom.llm.window_packing import pack_documents
from eigenloom.session import as_table, scratch_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 6 names a language for. Only texts without letters go, or all if none was learned."""
    model = fit_languages(docs.where(fold("doc_id", 3) != 1))
    found = identify_languages(docs.select(whole_row(docs)), model, "_doc.text", keep=("_doc",))
    return found.where(F.col("lang_pred") != UNKNOWN).select(*columns_of(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest id."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near likenesses connect, the one with the smallest id."""
    return drop_near_duplicates(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by surrogates."""
    return replace_personal_data(docs, SURROGATE_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens with their ids and their place in a window."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language", identify),
    ("exact_copies", drop_copies),
    ("near_copies", drop_near_copies),
    ("personal_data", replace_private),
    ("packing", pack),
]

# Languages, near copies and token ids are beyond SQL: tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = as_table(docs, scratch_path(spark, name))
    return docs
