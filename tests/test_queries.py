"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from flowmill.jobs import batch_queries, model_queries, stream_queries  # noqa: F401
from flowmill.jobs.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf_dir):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return db


def plain(value):
    return ("nan" if math.isnan(value) else f"{value:.9g}") if isinstance(value, float) else str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, found.fetchall())


def test_entry_has_all_features(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert len(df.columns) == 2 + 144
    assert df.filter("uid IS NULL").count() == 0


def test_forest_detects_each_test_flow_once(spark, sf_dir):
    rows = QUERIES["forest_detections"](spark, sf_dir).collect()
    assert len({r["uid"] for r in rows}) == len(rows) > 0
    assert all(0 <= r["confidence"] <= 1 and r["is_confident"] == (r["confidence"] >= 0.9) for r in rows)


@pytest.mark.parametrize("name, table, key, kept", [("http_per_uid", "lineitem", "l_orderkey", "l_linestatus = 'O'"), ("dns_per_uid", "lineitem", "l_orderkey", "l_linestatus = 'F'"), *((n, "orders", "o_orderkey", "o_orderstatus <> 'P'") for n in ("ssl_first_handshake_per_uid", "ssl_with_certificates_per_uid", "features_ssl_per_uid"))])
def test_logs_without_an_event_are_reduced_too(spark, sf_dir, name, table, key, kept):
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(kept).select(key).distinct()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert QUERIES[name](spark, sf_dir).count() == keys.count() > keys.join(events, keys[key] == events.event_id, "left_semi").count()


def test_forests_see_all_features(spark, sf_dir):
    rows, names = model_queries.table(spark, sf_dir)
    assert len(names) == 144 and rows.columns == ["uid", "class", *names]
    assert rows.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert all(rows.filter(f"{c} > 0").count() for c in ("http_avg_ua_len", "dns_qtype_A", "ssl_version", "x509_key_length", "history_len", "src_flow_count", "duration_log"))
    assert {r["folds"] for r in QUERIES["forest_cross_validation"](spark, sf_dir).collect()} == {5}


def test_grid_search_query(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(model_queries, "GRID", ({"numTrees": 2, "maxDepth": 1}, {"numTrees": 2, "maxDepth": 3}))
    rows = QUERIES["forest_grid_search"](spark, sf_dir).collect()
    assert len(rows) == 8 and len({r["candidate"] for r in rows if r["is_best"]}) == 1


def test_sampled_flows_are_chosen_before_the_joins(spark, sf_dir):
    rows, names = model_queries.table(spark, sf_dir)
    some, found = model_queries.sampled_table(spark, sf_dir, 50)
    want = sorted_rows(rows.columns, model_queries.splits.subsample(rows, 50).collect())
    assert names == found and len(want) == 50 and sorted_rows(some.columns, some.collect()) == want


def test_fits_read_one_stored_vector_in_batches(spark, sf_dir):
    rows, names = model_queries.table(spark, sf_dir)
    packed, found = model_queries.packed_table(spark, sf_dir)
    assert names == found and packed.columns == ["uid", "class", "vector"]
    assert "Batched: true" in packed._jdf.queryExecution().executedPlan().toString()
    assert {(r[0], r[1], tuple(r[2].toArray())) for r in packed.collect()} == {(r[0], r[1], tuple(r[2:])) for r in rows.collect()}


def test_folds_dealt_before_the_joins_are_those_of_the_features(spark, sf_dir):
    found, _ = model_queries.packed_folds(spark, sf_dir, 5)
    conn = model_queries.view(spark, sf_dir, "conn")
    want = {(r["uid"], r["class"], r["fold"]) for r in model_queries.splits.folds(conn.select("uid", "class")).collect()}
    rows = found.collect()
    assert len(rows) == conn.count() and {(r["uid"], r["class"], r["fold"]) for r in rows} == want
    dealt, labels = model_queries.models.dealt_rows(found, ["unused"])
    assert sorted(labels) == labels and dealt.groupBy("fold").count().count() == 5 and dealt.count() == len(rows)
    assert "packed" in dealt.inputFiles()[0]
