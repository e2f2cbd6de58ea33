"""A corpus pipeline: toxic documents go, repeated lines go, one document of each near group stays, benchmark passages go, the rest is tokenized."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.automaton import contamination
from skysift.llm.bpe import encode
from skysift.llm.common import fresh, table
from skysift.llm.lines import drop_repeated_lines
from skysift.llm.near_copies import near_copies
from skysift.llm.queries import held_out
from skysift.llm.toxicity import score, train
from skysift.session import scratch_path

TOXIC_FROM = 0.7
#: Hit runs of so many words are cut out, whole items shorter than a window among them; documents with a larger share of hit words go.
CUT_WORDS, MOST_HIT = 5, 0.5


def _with_text(docs: DataFrame, text) -> DataFrame:
    return docs.withColumns({"text": text, "n_chars": F.length(text).cast("long")})


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below TOXIC_FROM. Labels of held-out documents are not learned from; null texts have the base score."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    name = fresh(docs, "toxicity")
    return score(docs, train(docs, labels), docs.columns, name=name).where(F.col(name) < TOXIC_FROM).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; a document may end up empty. Null texts stay null."""
    found = drop_repeated_lines(docs)
    return _with_text(found, F.when(F.col("text").isNotNull(), F.col("kept_text"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word Jaccard likenesses of 0.8 or more, among op8's SimHash groups and min-hash candidates. Rows without an id stay; so do all rows of an id that stays."""
    found = near_copies(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, and without those that are benchmark text for the most part.

    A passage is a run of words inside occurrences of ten-word windows, or of a whole shorter item, of CUT_WORDS words or more; items of
    fewer words are ordinary phrases and stay. Null and empty texts stay as they are, repeated rows and null ids are rows like any other.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"), docs.columns, limits=(CUT_WORDS, MOST_HIT))
    clean = found.where(F.col("clean_text").isNotNull() | F.col("text").isNull())
    return _with_text(clean, F.col("clean_text")).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit numbers) and the hash of the text they decode to.

    One row a row, whatever its id, repeated rows and null ids included; null and empty texts have no tokens.
    """
    found = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, round_trip=True)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: No SQL: the toxicity model and the tokenizer are not SQL functions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
