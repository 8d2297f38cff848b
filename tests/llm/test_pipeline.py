"""The pipeline: its stages one by one, and the whole against them."""

import corpus_pipeline
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tradewake.llm import pii, queries, simhash
from tradewake.session import cut_lineage




@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    frames = [cut_lineage(spark.read.parquet(f"{sf_dir}/documents.parquet"))]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(cut_lineage(stage(spark, frames[-1], sf_dir)))
    return frames


def test_stages_keep_the_columns(staged):
    for frame in staged[1:-1]:
        assert frame.columns == staged[0].columns and frame.dtypes == staged[0].dtypes


def test_one_document_of_each_group_stays(staged):
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(staged[1]).collect()}
    assert sorted(r.doc_id for r in staged[2].select("doc_id").collect()) == sorted(set(groups.values()))


def test_no_personal_data_is_left(staged):
    left = pii.with_base(pii.packed(staged[3])).filter(" OR ".join(f"size({k}) > 0" for k in pii.BASE))
    assert left.count() == 0
    assert staged[3].filter(F.length("text") != F.col("n_chars")).count() == 0


def test_packing_holds_what_mixing_kept(staged):
    assert {r.doc_id for r in staged[5].select("doc_id").distinct().collect()} == {r.doc_id for r in staged[4].select("doc_id").collect()}


def test_run_gives_the_last_stage(spark, sf_dir, staged):
    columns = ("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(*columns).collect())) == sorted(map(tuple, staged[-1].select(*columns).collect()))


def test_odd_documents_pass(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words without an id", "en", None, 3)] + [(10 + i, f"some words number {i} and more of them {i * i}", "en", "s", 5) for i in range(20)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_key", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    assert docs.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLES[name]) is None


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and set(queries.QUERIES) <= set(names)
