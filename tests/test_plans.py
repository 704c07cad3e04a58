"""The shape of the plans, which is what decides how they scale."""

import os

import pytest

from checks import queries as q
from litscreen.functions.scale import fits_broadcast, shared_dir

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_worker_in_stemmed_ranking(spark):
    text = plan(q.top_sections_stemmed(spark, SF))
    assert "Python" not in text and "InPandas" not in text


def test_scan_reads_only_what_it_needs(spark):
    text = plan(q.explode_sections(spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "ReadSchema: struct<doc_id:bigint>" in plan(q.pending_fetch(spark, SF))
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in plan(q.pending_fetch(spark, SF))


def test_section_statistics_need_no_exchange(spark):
    from litscreen.operators.ranking import section_term_stats
    from litscreen.sources.articles import read_articles

    text = plan(section_term_stats(read_articles(spark, f"{SF}/documents.parquet", "doc_id", "text")))
    assert "Exchange" not in text and "Aggregate" not in text and "Window" not in text


def test_search_keeps_the_best_before_the_last_exchange(spark):
    text = plan(q.search_corpus(spark, SF))
    assert text.count("WindowGroupLimit") == 2
    assert text.count("Exchange hashpartitioning") <= 2
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_broadcast_needs_a_measured_size(spark):
    df = spark.range(1_000)
    assert fits_broadcast(df)
    assert not fits_broadcast(df, max_rows=999)
    assert not fits_broadcast(df, max_bytes=1_000)


def test_shared_folder_is_the_one_of_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
