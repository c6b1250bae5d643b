import pytest

from peerlens.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, same, name):
    same(catalogue.queries()[name](spark, sf_dir), catalogue.oracle_sql()[name])
    spark.catalog.clearCache()


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["seed_id", "record_id", "cosine", "rank"] and df.count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["er_matches", "er_status", "prefilter_candidates", "near_match", "universe_trim", "query_map"])
def test_no_nested_loops(spark, sf_dir, name):
    assert "NestedLoop" not in plan(catalogue.queries()[name](spark, sf_dir)) and "Cartesian" not in plan(catalogue.queries()[name](spark, sf_dir))


def test_top_k_is_cut_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(catalogue.queries()["cosine_topk_multi"](spark, sf_dir))


def test_scan_reads_needed_columns_only(spark, sf_dir):
    scan = plan(catalogue.queries()["domain_counts"](spark, sf_dir))
    assert "ReadSchema: struct<url:string>" in scan
