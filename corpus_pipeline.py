"""The corpus pipeline: language, lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns a DataFrame; run() writes it as Parquet
in the shared folder and reads it again as the docs of the next. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.bloom import maybe_among
from tilewright.llm.jaccard_join import jaccard_groups
from tilewright.llm.language_id import of_known_language, train
from tilewright.llm.line_dedup import line_dedup
from tilewright.llm.packing import pack
from tilewright.llm.scratch import finished, stored

#: Near duplicates: five-word shingles, similarity of 0.8 or more.
WIDTH, NUM, DEN = 5, 80, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language: those without letters go, and those that are of none of the languages
    learned from the labelled documents (too few of their n-grams are known). Where no document is labelled, only those
    without letters go. Rows that repeat are judged each by itself, a null identifier plays no part."""
    model = train(docs, "doc_id", "text", "lang")
    return of_known_language(docs, model) if model.languages else docs.where(F.col("text").rlike(r"\p{L}"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays, some with fewer lines. Rows without an identifier
    pass unchanged."""
    done = line_dedup(docs, counts=False)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else done


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest identifier of each group of near copies, all of its rows where they repeat
    it; rows without an identifier stay."""
    groups = jaccard_groups(docs, width=WIDTH, num=NUM, den=DEN)
    gone = stored(groups.where("doc_id <> component_id").select("doc_id"), "gone")
    told = docs.withColumn("__maybe", maybe_among(gone, F.xxhash64("doc_id")))
    unsure = told.where("__maybe").join(gone, "doc_id", "left_anti")  # the other texts aren't shuffled
    return told.where("NOT __maybe").select(*docs.columns).union(unsure.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]
#: SQL can't express the first stage; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = finished(lambda f=stage, d=docs: f(spark, d, sf_dir), name)
    return docs
