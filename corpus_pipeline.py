"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing, tokens. Each stage reads what the last one wrote."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, common, line_dedup, mixing, near_sets, toxicity
from tidewright.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> list:
    return [F.col(c) for c in COLUMNS if c in docs.columns]


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go. Null and empty texts are not toxic and stay; an empty table stays empty.

    Columns other than those of ``documents`` go, whatever their names.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.severity(docs.select(*_plain(docs)), model).where(~F.col("toxic")).select(*_plain(docs))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; n_chars follows the text. Every document stays.

    A null text stays null, an empty one empty; a text of which all lines go is empty. Other columns go.
    """
    kept = line_dedup.apply_bitmaps(docs.select(*_plain(docs)), line_dedup.keep_bitmaps(docs)).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*_plain(docs))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the row with the smallest id stays (null ids last).

    Near copies are found by their SimHashes and verified: five-word Jaccard similarity 0.8 or more.
    Texts without words, null ones included, are copies of each other. Rows that repeat id and text count once.
    """
    keyed = docs.select(*_plain(docs), line_dedup.doc_key().alias("__key"))
    near = near_sets.near_copies(keyed.select("doc_id", "text", "__key"), "__key")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key"))["__key"]
    stay = near.groupBy("root").agg(best.alias("__key")).select("__key")
    return keyed.join(stay, "__key", "left_semi").dropDuplicates(["__key"]).select(*_plain(docs))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row appears as often as the mix takes it; rows that repeat id and text share the larger number.

    Rows without words, null texts included, have size 0 and appear as often as their place among them says.
    """
    keyed = docs.select(*_plain(docs), line_dedup.doc_key().alias("__key"))
    taken = mixing.copies(keyed, carry=("__key",)).groupBy("__key").agg(F.max("copies").cast("int").alias("__copies"))
    mixed = keyed.join(taken.where("__copies > 0"), "__key")
    return mixed.select(*_plain(docs), F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digests of ids and of the text decoded from them. Null text counts as empty: no ids."""
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [("toxicity", stage_toxicity), ("line_dedup", stage_line_dedup), ("simhash_near_dedup", stage_near_dedup), ("mixing", stage_mixing), ("bpe", stage_tokens)]

#: The stages' models and hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again.

    A stage's output is deleted once the next one is written; the last one stays, as the result reads it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{folder}/{k}-{name}")
        if before:
            common.remove(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
