"""A training-corpus pipeline: language, near-duplicates, repeated passages, benchmark, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read back as the next one's docs.  All but the last return the columns of documents:

* language: rejects rows whose language is ``und`` (null texts, texts without a letter);
* near_duplicates: of every group of linked rows (word 5-shingles, Jaccard 0.8) the one with the
  smallest doc_id stays (null after all others, any one of equals);
* repeats: cuts bytes of 200-byte strings that start at two places; n_chars follows the
  text, and rows whose whole text was cut go;
* benchmark: rejects contaminated rows;
* tokens: byte-level BPE ids of what is left, decoded again: digests and counts.

Every stage decides row by row: rows that share a doc_id, or have none, are judged by their own
texts; of linked rows with equal doc_ids, or none, one stays.  A row's columns travel as one
value, so extra columns, whatever their names, come through.  An empty table runs through every stage and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.byte_bpe import encode_and_decode, public_ranks
from pagewright.llm.common import materialize, table
from pagewright.llm.decontaminate import decontaminate
from pagewright.llm.language_id import UNKNOWN, fit, predict
from pagewright.llm.ngram_join import near_duplicates
from pagewright.llm.suffix_dedup import remove_repeats

SHINGLE, PERCENT = 5, 80


def whole(docs: DataFrame) -> DataFrame:
    """Each row as one value beside the columns that operators read."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return predict(whole(docs), fit(docs), ["row"]).where(F.col("__lang_pred") != UNKNOWN).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows get numbers of their own, which a table fixes: rows that share a doc_id, or have none, are told apart
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("d")), "near-rows")
    found = near_duplicates(numbered.select(F.col("row").alias("doc_id"), F.col("d.text").alias("text")), SHINGLE, PERCENT)
    linked = materialize(found.where("n > 0"), "near-linked")
    several = linked.groupBy("component").agg(F.count("*").alias("c")).where("c > 1").select("component")
    members = linked.join(several, "component").select("component", F.col("doc").alias("row"))
    members = materialize(members.join(numbered.select("row", F.col("d.doc_id").alias("id")), "row"), "near-members")
    stays = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row")).select("row")
    gone = members.select("row").join(stays, "row", "left_anti")
    return numbered.join(gone, "row", "left_anti").select("d.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(whole(docs), ["row"], with_text=True).where("__n_removed < __n_bytes OR __n_bytes = 0")
    left = F.when(F.col("__n_removed") > 0, F.col("__kept_text")).otherwise(F.col("row.text"))
    of = {"text": left, "n_chars": F.length(left)}
    return cut.select(*[of[f.name].cast(f.dataType).alias(f.name) if f.name in of else F.col(f"row.`{f.name}`") for f in docs.schema])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("doc_id").alias("id"), F.md5("text").alias("text"))  # equal rows get equal verdicts
    judged = decontaminate(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    tainted = judged.where("contaminated").select(F.col("doc_id").alias("__tainted")).distinct()
    rows = whole(docs).select("row", row.alias("key"))
    return rows.join(tainted, F.col("key").eqNullSafe(F.col("__tainted")), "left_anti").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_and_decode(docs, public_ranks())


STAGES = [("language", language), ("near_duplicates", near), ("repeats", repeats), ("benchmark", benchmark), ("tokens", tokens)]

#: The language and byte stages can't be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
