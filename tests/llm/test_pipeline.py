"""The pipeline over the small tables and over odd rows."""

import corpus_pipeline
import pytest
from fieldtally.llm import decontamination, mixing, queries
from fieldtally.llm.shared import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "mixing":
            assert docs.columns == before.columns
    toxic = queries.op2_toxicity(spark, SF).where("predicted = 1").select("doc_id")
    assert kept["toxicity"].join(toxic, "doc_id").count() == 0
    assert kept["toxicity"].count() + toxic.count() == table(spark, SF, "documents").count()
    found = decontamination.find(kept["near_duplicates"], table(spark, SF, "benchmark"))
    bad = found.where(decontamination.contaminated()).count()
    assert kept["decontamination"].count() == kept["near_duplicates"].count() - bad
    assert kept["secrets"].count() == kept["decontamination"].count()
    assert kept["secrets"].where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    again = mixing.mix(kept["secrets"], ["doc_id"]).where("sampled").count()
    assert kept["mixing"].count() == again


def test_run_equals_its_stages(spark):
    one = corpus_pipeline.run(spark, SF).select("doc_id").toPandas()
    two = corpus_pipeline.run(spark, SF).select("doc_id").toPandas()
    assert sorted(one.doc_id) == sorted(two.doc_id) and one.doc_id.is_unique


def test_clashing_names(spark):
    names = ["_doc", "_key", "_row_key", "_spans", "_bytes", "_score", "_source", "_lang", "_topic", "_tokens", "_draw", "_toxicity", "_found_n_words", "words", "first", "given"]
    data = [(i, f"text number {i} with a password = hunter{i}{i}{i}{i} and more words", "en", "s", *[f"{n}{i}" for n in names]) for i in range(4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, SF)
        assert docs.columns[: len(before)] == before, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names), name


@pytest.mark.parametrize("rows", [0, 5])
def test_odd_rows(spark, rows):
    data = [(1, None, None, None, None, 1, "a", 0.1), (2, "", "en", "s", 0, 1, "a", 0.1), (3, "x " * 50_000, "en", "s", 9, 1, "a", 0.1), (3, "x " * 50_000, "en", "s", 9, 1, "a", 0.1), (None, "a b", "en", None, 3, None, None, None)]
    docs = spark.createDataFrame(data[:rows], "doc_id long, text string, lang string, source string, n_chars long, n_words int, topic string, score double")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() <= rows
        assert len(set(docs.columns)) == len(docs.columns)
