"""What the plans must look like: filters and columns reach the scans, no cross joins, no Python where columns do."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import incremental as I
from quillgraph.operators import lookup as L
from quillgraph.plans import graph_queries, problems
from quillgraph.plans.fts_plan import build_postings, corpus_size, search
from quillgraph.session import read_table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single|Round)", plan(df)))


def test_filters_and_columns_reach_the_scan(spark, small):
    edges, entities = read_table(spark, small, "edges"), read_table(spark, small, "entities")
    text = plan(G.outgoing(edges, "a", "cites").select("dst"))
    assert "EqualTo(src,a)" in text and "EqualTo(relation,cites)" in text and "Exchange" not in text
    assert "ReadSchema: struct<src:string,dst:string,relation:string>" in text
    text = plan(G.related(edges, "a"))
    assert text.count("FileScan") == 1 and "Or(EqualTo(src,a),EqualTo(dst,a))" in text
    assert "EqualTo(id,a)" in plan(L.get_entity(entities, "a"))
    text = plan(L.by_term(entities, read_table(spark, small, "terms"), "x"))
    assert "EqualTo(term,x)" in text and "TakeOrderedAndProject" in text


def test_search_over_texts_moves_only_the_top(spark, small):
    entities = read_table(spark, small, "entities")
    df = search(entities, "aa OR bb NOT cc", with_snippet=False)
    assert exchanges(df) <= 1  # that of the statistics' single row
    assert "TakeOrderedAndProject" in plan(df) and "Python" not in plan(df)


def test_search_over_the_index_reads_its_tokens(spark, small, tmp_path):
    entities = read_table(spark, small, "entities")
    build_postings(entities).write.parquet(f"{tmp_path}/postings")
    df = search(entities, "aa OR bb", postings=spark.read.parquet(f"{tmp_path}/postings"), size=corpus_size(entities), with_snippet=False)
    assert "Or(EqualTo(token,aa),EqualTo(token,bb))" in plan(df)


JVM_ONLY = ["count_by_type", "by_term", "related", "edge_upsert", "fk_violations", "orphan_edges", "upsert_last_wins", "find_scan", "find_index", "rule_schema_issues", "metadata_residual", "frontmatter_parse"]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_columns_suffice(spark, small, name):
    text = plan(graph_queries.QUERIES[name](spark, small))
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", text)


def incremental_fold(spark, small):
    """What a runner writes for the whole log, with marks of a first run."""
    marks = spark.createDataFrame([(r, "2024-01-01 00:00:00", 1) for r in ("docs", "manifests", "rules", "none")], "root string, mark string, mark_run bigint")
    slots, bounds = I.run_slots(read_table(spark, small, "ingest_runs"), marks.withColumn("mark", F.col("mark").cast("timestamp_ntz")))
    return I.fold(I.best_rows(read_table(spark, small, "entities"), slots, bounds).withColumn("part", F.lit(0)))


@pytest.mark.parametrize("name", ["p2_found", "p6_found"])
def test_problem_plans(spark, small, name):
    text = plan(incremental_fold(spark, small) if name == "p6_found" else problems.QUERIES[name](spark, small))
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", text)
    assert "partial_" in text  # combined before the shuffle


def test_a_run_reads_what_landed_since(spark, small):
    text = plan(incremental_fold(spark, small))
    assert "GreaterThan(landed_at,2024" in text and "LessThanOrEqual(landed_at," in text


def test_the_index_moves_texts_not_words(spark, small):
    text = plan(build_postings(read_table(spark, small, "entities")))
    assert exchanges(build_postings(read_table(spark, small, "entities"))) == 1 and "hashpartitioning(id" in text
