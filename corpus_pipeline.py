"""From raw documents to packed token windows, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet into the shared folder and gives it to the next stage. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from modengine.llm import line_dedup, mixing, packing, quality_classifier, queries, simhash_dedup
from modengine.llm.common import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Null texts count as empty, null languages and sources as ''; rows that repeat
    come out alike. Without judged documents of both classes all stay. Columns
    are renamed while it runs, so none can clash; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    plain = docs.toDF(*[f"c_{c}" for c in columns])
    scored = quality_classifier.score_documents(
        plain, labels.withColumnRenamed("doc_id", "c_doc_id"), "c_doc_id", "c_text", "c_lang", "c_source",
    )
    return scored.filter("kept").select(*[F.col(f"c_{c}").alias(c) for c in columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; n_chars follows the text.

    Null and empty texts stay as they are (n_chars of a null text is null); rows
    that repeat an id are one document's, and none is dropped. An empty table
    stays empty."""
    cut = line_dedup.dedup_lines(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id.

    Null, empty and blank texts form one group. Of rows that repeat id and text
    one stays; a row without an id stays only if its group has no id. An empty
    table stays empty."""
    return simhash_dedup.keep_one(docs, words=4, max_bits=4)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their source take them: shares
    of the tokens to the power 0.7, at most two epochs of any source, as many
    tokens in all as there are.

    Null ids, languages and sources count as ''; a null text has one token. Of rows
    that repeat id and text one stands for all, as often as any of them is
    taken. An empty table stays empty."""
    return mixing.mixed_documents(docs, queries.domain_of_source())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens.

    Null and empty texts are one end token; rows that repeat are packed each; an
    empty table gives no pieces."""
    return packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates),
    ("mixing", mixture), ("packing", pack),
]

# Learning and tokenizing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}")
    return docs
