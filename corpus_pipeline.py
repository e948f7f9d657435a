"""A corpus pipeline of five stages; each works on all that the one before kept.

1. toxicity: documents that the model scores 0.5 or more go. The model learns from ``labels``.
2. near-dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.
3. substring dedup: words covered by a window of 50 words that starts in an earlier document go; a
   document that loses nothing keeps its text as it is, n_chars follows the text, and one that loses
   all its words goes.
4. decontamination: documents that contain a benchmark item (0.8 of its five-word shingles) go.
5. encoding: byte-pair ids, decoded again; doc_id with the digests of both.

The stages cannot be said in one SQL query (a learnt model, a tokenizer); the tests hold each
against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, decontaminate, minhash_dedup, substring_dedup, toxicity
from geoloom.llm.text import new_folder


def free_name(docs: DataFrame, name: str) -> str:
    """The name, longer if documents have a column of it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "toxic_score")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(docs)
    gone = free_name(docs, "gone")
    return docs.join(found.where("NOT kept").select(F.col("doc_id").alias(gone)), F.col("doc_id") == F.col(gone), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut, left = free_name(docs, "cut_id"), free_name(docs, "kept")
    found = substring_dedup.substring_dedup(docs).where("n_removed > 0").select(F.col("doc_id").alias(cut), F.col("kept").alias(left))
    both = docs.join(found, F.col("doc_id") == F.col(cut), "left")
    changed = F.col(left).isNotNull()
    text = F.when(changed, F.col(left)).otherwise(F.col("text"))
    n_chars = F.when(changed, F.char_length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return both.where(F.col(left).isNull() | (F.col(left) != "")).withColumns({"text": text, "n_chars": n_chars}).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.round_trip(docs, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            kept = new_folder(spark, f"stage-{k}")
            docs.write.parquet(kept)
            docs = spark.read.parquet(kept)
    return docs
