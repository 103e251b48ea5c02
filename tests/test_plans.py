"""Plans: no Python in the feature build, filters and columns at the scan, partial sums before shuffles."""

import re

import pytest

from flowmill.jobs import queries
from flowmill.jobs.views import view
from flowmill.operators.concurrency import source_stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["flow_features", "window_statistics", "softmax_detections", "stratified_split"])
def test_no_python(spark, sf_dir, name):
    assert not re.search("Python|Pandas|Arrow", plan(queries.QUERIES[name](spark, sf_dir)))


def test_scan_reads_what_is_used(spark, sf_dir):
    text = plan(queries.QUERIES["http_per_flow"](spark, sf_dir))
    scan = next(x for x in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_orderkey" in x)
    assert "l_shipdate" not in scan and "l_discount" not in scan
    assert "EqualTo(l_linestatus,O)" in text


def test_source_statistics_sum_before_each_shuffle(spark, sf_dir):
    text = plan(source_stats(view(spark, sf_dir, "conn")))
    assert text.count("partial_count(1)") == 1 and text.count("partial_sum(") >= 1


def test_first_rows_are_chosen_before_the_shuffle(spark, sf_dir):
    text = plan(queries.QUERIES["certificate_features"](spark, sf_dir))
    assert "partial_min_by" in text and "Window" not in text


def test_places_in_a_class_are_ranked_by_part(spark, sf_dir):
    text = plan(queries.QUERIES["stratified_folds"](spark, sf_dir))
    assert re.search(r"row_number\(\) windowspecdefinition\(class#\d+, _part#\d+", text)


def test_flows_are_joined_without_a_python_copy_or_cross_join(spark, sf_dir):
    text = plan(queries.QUERIES["enriched_flows"](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
