"""The physical plans the operators are meant to get."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = formatted(QUERIES["scan_pushdown"](spark, sf))
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n", text).group(1)
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThanOrEqual(l_discount" in pushed
    schema = re.search(r"ReadSchema: struct<(.*?)>\n", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_returnflag", "l_shipdate", "l_discount", "l_quantity"}


def test_partition_folders_are_pruned(spark, sf):
    assert "PartitionFilters: [event_type" in formatted(QUERIES["scan_hive_partitions"](spark, sf))


@pytest.mark.parametrize("name", [
    "geo_close_pairs", "geo_radius_neighbours", "nearest_match", "kernel_weights", "join_priority_fallback",
    "leave_one_station_out", "smoothing_curves", "support_scorecard", "boot_block_days", "sites_membership"])
def test_no_cartesian_product(spark, sf, name):
    text = formatted(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    # A nested loop only serves to attach the one row of a global figure.
    assert not re.findall(r"BroadcastNestedLoopJoin.*\n(?:.*\n){0,4}?Join condition: (?!None)", text)


def test_draws_are_not_shuffled_again_after_the_lookup(spark, sf):
    """Draws are spread once; the lookup side is broadcast within its counted bound."""
    from verispark.plans import resampling

    text = resampling.draws(spark, sf, 7)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[start#\d+, take#\d+\], \[start#\d+, take#\d+\], Inner, BuildRight", text)
    assert len(re.findall(r"hashpartitioning\(draw", text)) == 1


@pytest.mark.parametrize("name", ["qc_valid_rows", "score_table", "agg_hierarchical", "conflict_dedup"])
def test_no_python_in_the_hot_path(spark, sf, name):
    text = formatted(QUERIES[name](spark, sf))
    assert "Python" not in text and "MapInPandas" not in text and "ArrowEval" not in text
