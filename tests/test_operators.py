import sys
from hashlib import md5

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from flowmill.operators import concurrency as conc
from flowmill.operators import evaluate as ev
from flowmill.operators import models, splits
from flowmill.operators.enrich import enrich
from flowmill.operators.features import features, in_order
from flowmill.operators.reduce import certificate_rows, dns_rows, first_rows, http_rows, ssl_rows

CONN = "uid string, class string, id_orig_h string, id_resp_h string, id_resp_p int, proto string, service string, conn_state string, local_orig string, local_resp string, history string, duration string, orig_bytes string, resp_bytes string, orig_pkts string, resp_pkts string, orig_ip_bytes string, resp_ip_bytes string, missed_bytes string, ip_proto string"
HTTP = "uid string, class string, request_body_len double, response_body_len double, status_code int, method string, host string, user_agent string"
DNS = "uid string, class string, rtt double, rcode_name string, query string, rejected string, qtype_name string, answers array<string>, TTLs array<double>"


def flow(uid, port=443, **more):
    row = dict.fromkeys(x.strip().split(" ")[0] for x in CONN.split(",")) | {"uid": uid, "class": "normal", "id_orig_h": "a", "id_resp_h": "b", "id_resp_p": port}
    return tuple((row | more).values())


def conn(spark, *rows):
    return spark.createDataFrame(list(rows), CONN)


def test_http_of_all_null_lengths(spark):
    rows = spark.createDataFrame([("u", "n", None, 5.0, 503, "GET", None, None), ("u", "n", None, None, None, "PATCH", "h", "ab"), (None, "n", 1.0, 1.0, 200, "GET", "h", "x")], HTTP)
    out = http_rows(rows).collect()
    assert len(out) == 1  # null keys form no group
    r = out[0]
    assert (r["http_request_count"], r["http_total_req_body_len"], r["http_avg_req_body_len"]) == (0, 0.0, None)
    assert (r["http_status_5xx_ratio"], r["http_avg_ua_len"], r["http_unique_hosts"], r["http_method_GET"]) == (0.5, 1.0, 1, 1)


def test_dns_of_one_row_has_no_deviation(spark):
    rows = spark.createDataFrame([("u", "n", 0.5, "NXDOMAIN", "q", "T", "A", [], None)], DNS)
    r = dns_rows(rows).first()
    assert (r["dns_rtt_std"], r["dns_nxdomain_ratio"], r["dns_rejected"], r["dns_has_answer"], r["dns_avg_ttl"]) == (None, 1.0, 1, 0.0, None)


def test_first_rows_breaks_ties_by_all_columns(spark):
    rows = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", 2, "0")], "k string, t int, v string")
    assert [tuple(r) for r in first_rows(rows, ["k"], ["t"]).collect()] == [("k", 1, "a")]


def test_certificates(spark):
    kind = "ts double, fingerprint string, certificate_key_type string, certificate_key_length string, certificate_subject string, certificate_issuer string, certificate_not_valid_before double, certificate_not_valid_after double, basic_constraints_ca string, host_cert string"
    rows = spark.createDataFrame([(2.0, "f", "rsa", "1", "s", "s", 0.0, 86400.0, "T", "F"), (1.0, "f", "ecdsa", "x", None, None, 0.0, 43200.0, None, "T"), (0.0, None, "rsa", "1", "s", "s", 0.0, 1.0, "T", "T")], kind)
    out = certificate_rows(rows).collect()
    assert len(out) == 1
    assert tuple(out[0])[1:] == (None, 0, 1, 0, 0, 1, 0.5)


def test_flows_stay_one_row_and_flags_follow_counts(spark):
    http = spark.createDataFrame([("u1", "normal", None, None, None, None, None, None)] * 3, HTTP)
    ssl = spark.createDataFrame([("u1", "normal", 1.0, None, None), ("u1", "normal", 2.0, "TLSv12", None), ("u2", "normal", 1.0, "TLSv13", "f")], "uid string, class string, ts double, version string, first_cert_fp string")
    out = {r["uid"]: r for r in enrich(conn(spark, flow("u1"), flow("u2"), flow("u3")), ssl=ssl, http=http).collect()}
    assert len(out) == 3
    assert (out["u1"]["has_http"], out["u1"]["has_ssl"], out["u2"]["has_ssl"], out["u3"]["has_http"], out["u3"]["has_dns"]) == (1, 0, 1, 0, 0)
    assert ssl_rows(ssl).count() == 2


def test_features_without_any_log_or_value(spark):
    flows = enrich(conc.with_source_stats(conn(spark, flow("u", None, id_orig_h=None), flow("v", 1024, history="Ss", orig_bytes="x", duration="0"))))
    rows = {r["uid"]: r for r in features(flows).collect()}
    u, v = rows["u"], rows["v"]
    assert (u["duration_log"], u["orig_bytes_log"], u["total_bytes_log"], u["resp_port"], u["is_well_known_port"], u["history_entropy"], u["src_flow_count"]) == (-1, -1, 0, -1, 0, -1, -1)
    assert (v["is_registered_port"], v["history_has_upper_s"], v["history_has_lower_s"], v["history_has_lower_d"], v["bytes_per_second"], v["history_entropy"]) == (1, 1, 1, 0, 0, 1)
    assert all(x is not None for x in u)


@pytest.mark.parametrize("port, which", [(1023, "is_well_known_port"), (1024, "is_registered_port"), (32768, "is_registered_port"), (32769, "is_ephemeral_port")])
def test_port_classes(spark, port, which):
    r = features(conn(spark, flow("u", port)), families=("ports",)).first()
    assert [n for n in ("is_well_known_port", "is_registered_port", "is_ephemeral_port") if r[n]] == [which]


def test_feature_order_fills_absent_names(spark):
    rows = spark.createDataFrame([("u", 1.0, None)], "uid string, b double, a double")
    out = in_order(rows, ["a", "b", "z"], ["uid"])
    assert out.columns == ["uid", "a", "b", "z"] and tuple(out.first()) == ("u", -1.0, 1.0, -1.0)


def test_source_statistics_pass_over_null_ports(spark):
    rows = conn(spark, flow("1", 80), flow("2", 80), flow("3", 443), flow("4", 22), flow("5", None), flow("6", None, id_orig_h="only nulls"), flow("7", 1, id_orig_h=None))
    out = {r["id_orig_h"]: r for r in conc.source_stats(rows).collect()}
    assert (out["a"]["src_flow_count"], out["a"]["unique_dest_port_count"], out["a"]["dest_port_entropy"]) == (5, 3, 1.5)
    assert (out["only nulls"]["src_flow_count"], out["only nulls"]["dest_port_entropy"]) == (1, None)
    assert set(out) == {"a", "only nulls"}


def test_splits_are_exact_and_repeat(spark):
    rows = spark.createDataFrame([(f"u{i}", "a" if i % 3 else "b") for i in range(90)], "uid string, class string")
    first, again = (splits.stratified_split(rows.repartition(n)).collect() for n in (1, 5))
    assert {(r["uid"], r["is_test"]) for r in first} == {(r["uid"], r["is_test"]) for r in again}
    assert sum(r["is_test"] for r in first if r["class"] == "b") == 6 and sum(r["is_test"] for r in first) == 18
    sizes = splits.folds(rows).groupBy("class", "fold").count().collect()
    assert {(r["class"], r["count"]) for r in sizes} == {("a", 12), ("b", 6)}
    assert splits.subsample(rows, 7).count() == 7
    assert {r["class"]: r["weight"] for r in splits.class_weights(rows).collect()} == {"a": 0.75, "b": 1.5}


def test_ties_take_the_first_label(spark):
    rows = spark.range(1).select(F.array(F.lit(0.5), F.lit(0.5)).alias("p"))
    r = ev.from_probabilities(rows, F.col("p"), ["a", "b"], 0.5).first()
    assert (r["prediction"], r["is_confident"]) == ("a", True)


def test_report_of_absent_classes_is_zero(spark):
    rows = spark.createDataFrame([("a", "a", True), ("a", "b", False)], "class string, prediction string, is_confident boolean")
    report = {r["entry"]: r for r in ev.classification_report(rows, ["a", "b", "c"]).collect()}
    assert (report["c"]["precision"], report["c"]["f1"], report["c"]["support"]) == (0, 0, 0)
    assert report["accuracy"]["f1"] == 0.5
    r = ev.threshold_analysis(rows).first()
    assert tuple(r) == (50.0, 100.0, 0.0, 1)
    assert tuple(ev.threshold_analysis(rows.limit(0)).first()) == (0.0, 0.0, 0.0, 0)
    assert tuple(ev.detection_summary(rows.limit(0)).first()) == (0, 0, 0.0, 0)


class Halves:
    def predict_proba(self, frame):
        return [[0.95, 0.05] if x > 0 else [0.4, 0.6] for x in frame["f"]]


def test_scores_of_any_predictor(spark):
    rows = spark.createDataFrame([("u", 1.0), ("v", -1.0)], "uid string, f double")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import tests
    out = {r["uid"]: (r["prediction"], r["is_confident"]) for r in models.score_with(rows, Halves(), ["f"], ["x", "y"]).collect()}
    assert out == {"u": ("x", True), "v": ("y", False)}


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", "a" if i % 2 else "b", float(i % 2)) for i in range(40)], "uid string, class string, f double")
    model = models.train(rows, ["f"], numTrees=3, maxDepth=2)
    models.save(model, ["f"], str(tmp_path / "m"), spark)
    loaded, names, labels = models.load(str(tmp_path / "m"), spark)
    assert (names, labels) == (["f"], ["a", "b"])
    assert models.score(rows, loaded).filter("prediction <> class").count() == 0
    best, table = models.grid_search(rows, ["f"], [{"numTrees": 2, "maxDepth": 1}, {"numTrees": 3, "maxDepth": 1}], 2)
    assert best["numTrees"] == 2 and table.count() == 8


def test_boosted_trees_and_a_training_run(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", "abc"[i % 3], float(i % 3), float(i % 7)) for i in range(90)], "uid string, class string, f double, g double")
    model = models.train(rows, ["f", "g"], boosted=True, maxIter=3, maxDepth=2)
    found = models.score(rows, model).collect()
    assert all(r["prediction"] == r["class"] and 1 / 3 < r["confidence"] <= 1 for r in found)
    path = str(tmp_path / "run")
    report = {r["entry"]: r for r in models.train_run(rows, ["f", "g"], [{"numTrees": 2, "maxDepth": 1}, {"numTrees": 3, "maxDepth": 3}], path, k=2, most=60).collect()}
    assert set(report) == {"a", "b", "c", "accuracy", "macro avg", "weighted avg"} and report["accuracy"]["support"] == 18 and report["macro avg"]["f1"] == 1.0
    assert models.load(path, spark)[1:] == (["f", "g"], ["a", "b", "c"])
    assert spark.read.json(f"{path}/grid").count() == 8 and {r["fold"] for r in spark.read.json(f"{path}/folds").collect()} == {0, 1}


def test_places_of_null_keys_and_labels(spark):
    rows = spark.createDataFrame([(None, "a", "theirs"), ("u", "a", "theirs"), ("v", None, "theirs"), (None, "a", "theirs")], "uid string, class string, other string")
    out = splits.folds(rows, k=2)
    assert out.columns == [*rows.columns, "fold"] and sorted((r["uid"] or "", r["fold"]) for r in out.collect()) == [("", 0), ("", 1), ("u", 0)]
    order = [r["uid"] for r in splits.shuffled(rows.dropna(), seed=1).collect()]
    assert order == ["u"] and splits.folds(rows.limit(0)).count() == 0


def test_shuffled_rows_stand_by_digest(spark):
    rows = spark.createDataFrame([(f"u{i}", i) for i in range(300)], "uid string, n int")
    by_digest = lambda seed: sorted((f"u{i}" for i in range(300)), key=lambda u: md5(f"{u}/{seed}".encode()).hexdigest())
    orders = {seed: [r["uid"] for r in splits.shuffled(rows.repartition(parts), seed=seed).collect()] for seed, parts in ((1, 2), (2, 7))}
    assert all(orders[seed] == by_digest(seed) for seed in orders) and orders[1] != orders[2]


def test_top_rows_tie_as_they_are_shown(spark):
    rows = spark.createDataFrame([("b", 0.99999991), ("a", 0.99999990), ("c", 0.5), ("d", None)], "name string, v double")
    assert [tuple(r) for r in ev.top(rows, "v", 3).collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.5)]


def test_a_forest_of_packed_rows_is_the_same(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", "abc"[i * i % 3] if i % 9 else None, float(i % 5), float(i % 7)) for i in range(90)], "uid string, class string, f double, g double").coalesce(1)
    packed = models.packed(rows, ["f", "g"], str(tmp_path / "packed"))
    assert packed.columns == ["uid", "class", "vector"] and packed.count() == 90
    plain, other = (models.train(table, ["f", "g"], numTrees=3, maxDepth=3) for table in (rows, packed))
    assert len(other.stages) == 2 and models.labels_of(plain) == models.labels_of(other)
    assert plain.stages[-1].toDebugString.split("\n")[1:] == other.stages[-1].toDebugString.split("\n")[1:]
    found = [{tuple(r) for r in models.score(table, model).select("uid", "prediction", "confidence", "is_confident").collect()} for table, model in ((rows, plain), (packed, other))]
    assert found[0] == found[1] and len(found[0]) == 90
