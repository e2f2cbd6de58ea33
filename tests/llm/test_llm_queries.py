"""Registered queries of the text operators, and the pipeline stage by stage."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]


@pytest.mark.parametrize("name", ["op7_line_dedup", "op10_decontamination", "op11_conversation_trie", "op12_embedding_links"])
def test_matches_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and int(n[2:].split("_")[0]) <= 10])
def test_one_row_a_document(spark, name):
    found = entry.queries()[name](spark, SF)
    ids = [r["doc_id"] for r in found.select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_stages(spark, tmp_path):
    """Toxic and near documents go, repeated lines and passages go, clean documents stay as they are; extra columns and nulls go along."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("x"))
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = "A wholly different story of plums, kettles, ledgers and rain that no other document tells in any line of it. " * 2
    added = spark.createDataFrame([(90001, clean), (90002, clean), (90003, None), (90004, ""), (90005, f"Words of its own before {passage} and after that quite a few more words which are not part of any test at all here, " + clean[::-1])], "doc_id long, text string")
    docs = docs.unionByName(added.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit("x").alias("score")))
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        found[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == before.columns
    assert found["near_dedup"][90001]["text"] == clean and found["decontamination"][90001]["text"] == clean
    assert 90002 in found["line_dedup"] and not found["line_dedup"][90002]["text"] and 90003 in found["line_dedup"]
    assert passage in found["near_dedup"][90005]["text"] and passage not in found["decontamination"][90005]["text"]
    assert set(found["byte_bpe"]) == set(found["decontamination"])


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        assert found.count() == 0
        docs = found if "text" in found.columns else docs
