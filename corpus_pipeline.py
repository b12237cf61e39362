"""Training-corpus pipeline: toxicity, near and substring deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``. Filters judge each row by its own text, whatever its
doc_id; the deduplicating stages tell rows apart by doc_id and text, near
deduplication also those without doc_id, which suffix deduplication leaves as
they are.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontam, near_dedup, packing, suffix_dedup, toxicity
from tallyloom.llm.checkpoint import remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of all documents given, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(_columns(docs), toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class, and one row of it; where none has an id, a row of one text."""
    if not near_dedup.plain(docs):
        first = near_dedup.first_texts(docs).withColumnRenamed("low", "_low")
        own = docs.withColumn("key", near_dedup.text_key()).join(first, "key").where(F.col("doc_id").eqNullSafe(F.col("_low")))
        return _columns(own.dropDuplicates(["key"]))
    first = near_dedup.near_duplicates(docs).where("doc_id = class_id").select("doc_id").distinct()
    return _columns(docs.join(first, "doc_id", "left_semi"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings of earlier documents; n_chars follows. A text all cut stays, empty."""
    out = suffix_dedup.remove_repeats(_columns(docs))
    cut = F.col("n_removed") > 0
    text = F.when(cut | ~F.col("row.text_is_null"), F.col("kept"))
    chars = F.when(cut, F.char_length("kept").cast("bigint")).otherwise(F.col("row.n_chars"))
    return out.select("row.doc_id", text.alias("text"), "row.lang", "row.source", chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontam.without_hits(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: The model and the suffix, hash and packing stages are beyond SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again.

    A stage's folder goes when the next one is written; the result reads the last, which stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{i}-{name}")
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    return docs
