"""Corpus pipeline: raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir). All but the last return the
columns of ``documents``; ``run`` writes each stage's result and reads it again
as the next one's input.

1. toxicity: documents the ordinal model rejects go. It learns from ``labels``.
2. near_dedup: one document of each near-duplicate group (five-word shingles,
   similarity 0.8) stays, that of the least doc_id.
3. substring_dedup: repeated passages are cut from all documents but the first;
   n_chars follows the text.
4. decontamination: documents that hold an item of ``benchmark`` go.
5. tokenization: BPE ids of every whole text are added, with their number and
   the digest of the decoded text.

Documents without text pass every filter and have no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semestra.llm import bpe, decontaminate, minhash_dedup, substring_dedup, toxicity
from semestra.llm.shipping import ship
from semestra.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_on(docs, _table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash_dedup.drop_near_duplicates(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = substring_dedup.dedup_substrings(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(docs.columns)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.drop_leaked(docs, _table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_column(docs).withColumns({
        "n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2("decoded", 256)}).drop("decoded")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", remove_benchmark_leaks),
    ("tokenization", tokenize),
]

#: The model, the sketches and the tokens have no SQL form; tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
