"""The queries of this subpackage against their SQL, or as far as they run."""

import pytest

import corpus_pipeline
from checks.compare import differences
from usagelens.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, folder, oracle, name):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert differences(QUERIES[name](spark, folder), oracle, ORACLE_SQL[name]) == []


def test_there_is_a_query_for_each_operator():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []


def test_pipeline_runs_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "pack":
            assert docs.columns == before.columns
    packed = docs.select("sequence_id", "offset", "length").collect()
    assert packed and all(row["offset"] + row["length"] <= 4096 for row in packed)


def test_stages_take_an_empty_table(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
