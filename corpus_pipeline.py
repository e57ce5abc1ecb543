"""The corpus pipeline: stages that clean the documents one after the other, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import bpe, decontaminate, language, line_dedup, minhash, shared

#: No SQL: language identification and BPE cannot be put into it. Tests hold run() against brute force.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows, with that language as lang; texts without a letter go."""
    rows = docs.select(*COLUMNS)
    found = language.predict(rows, language.train(rows), carry=("text", "source", "n_chars"))
    return found.where(F.col("lang_pred") != language.UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many others hold as well; a document of which no text stays is kept, empty."""
    found = line_dedup.dedup_lines(docs, shared.scratch(spark, "line-dedup"), carry=("lang", "source"))
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("bigint").alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates (five words, similarity 0.8)."""
    groups = minhash.near_groups(docs).where("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(groups, "doc_id", "left_anti").select(*COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole benchmark window, and of which less than a twentieth of the words lies in shorter items."""
    found = decontaminate.search(docs, shared.table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    whole = F.exists("spans", lambda s: s["stop"] - s["start"] >= decontaminate.WINDOW)
    return found.where(~whole & ~decontaminate.contaminated()).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, with the digests of ids and decoded text."""
    return bpe.encode_documents(docs, with_ids=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language ID", known_language),
    ("line dedup", distinct_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmark),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; what a stage kept is written to the shared folder and read again for the next."""
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            at = shared.scratch(spark, f"stage-{k}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
