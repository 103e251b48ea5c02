import json
import os
from datetime import timedelta

from pyspark.sql import functions as F

from flowmill.jobs import stream_queries  # noqa: F401
from flowmill.jobs.queries import QUERIES, rounded
from flowmill.jobs.views import conn, view
from flowmill.operators.concurrency import flow_windows
from flowmill.operators.enrich import enrich
from flowmill.operators.features import features
from flowmill.sources.logs import read_file_log
from flowmill.streaming import dimension, flows, job, late


def write(folder, *files):
    os.makedirs(folder, exist_ok=True)
    for n, rows in enumerate(files):
        path = f"{folder}/{n}.json"
        with open(path, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # in this order


def row(uid, minute, **more):
    return {"ts": 1_700_000_000.0 + 60 * minute, "uid": uid, "id.orig_h": "a", **more}


def test_late_rows_are_left_out_and_open_sessions_held(spark, tmp_path):
    write(tmp_path / "http", [row("u", 0, method="GET", host="h", request_body_len=5)], [row("w", 60)], [row("x", 61)], [row("u", 1, method="GET")])
    stream = read_file_log(spark, str(tmp_path / "http"), "http", "5 minutes")
    out = flows.drained(flows.http_sessions(stream), str(tmp_path / "out")).collect()
    assert [(r["uid"], r["http_method_GET"], r["http_unique_hosts"]) for r in out] == [("u", 1, 1)]


def test_logs_meet_by_flow_and_session(spark, tmp_path):
    end = row("end", 600)
    write(tmp_path / "conn", [row("u", 0, service="http"), row("v", 0), end])
    write(tmp_path / "ssl", [row("u", 2, version="TLSv12"), row("u", 1, version="TLSv13"), end])
    write(tmp_path / "http", [row("u", 1, request_body_len=3, response_body_len=4), row("u", 2, response_body_len=6), row("z", 1), end])
    write(tmp_path / "dns", [row("v", 1, rtt=0.5), end])
    logs = [read_file_log(spark, str(tmp_path / n), n, "5 minutes") for n in ("conn", "ssl", "http", "dns")]
    out = {r["uid"]: r for r in flows.drained(flows.enriched_sessions(*logs), str(tmp_path / "out")).collect()}
    assert set(out) == {"u", "v"}  # z has no conn row, the end's session is open
    u, v = out["u"], out["v"]
    assert (u["ssl_version"], u["has_ssl"], u["has_http"], u["has_dns"], u["http_request_count"], u["http_total_resp_body_len"]) == ("TLSv13", 1, 1, 0, 1, 10)
    assert (v["has_ssl"], v["has_http"], v["has_dns"], v["dns_rtt_mean"]) == (0, 0, 1, 0.5)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder = str(tmp_path / "conn")
    write(folder, [row("u", 0)])
    stream = read_file_log(spark, folder, "conn", "5 minutes").select("uid")
    assert [r["uid"] for r in flows.drained(stream, str(tmp_path / "out")).collect()] == ["u"]
    write(folder, [row("u", 0)], [row("v", 1)])
    assert sorted(r["uid"] for r in flows.drained(stream, str(tmp_path / "out")).collect()) == ["u", "v"]


def test_certificate_table(spark, tmp_path):
    rows = [{"ts": 1_700_000_000.0, "fingerprint": "f", "certificate.key_length": 1}, {"ts": 1_700_000_001.0, "fingerprint": "f"}, {"ts": 1_700_000_001.0}]
    write(tmp_path / "x509", rows[1:], rows[:1])
    job.keep_certificates(read_file_log(spark, str(tmp_path / "x509"), "x509", "24 hours"), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    table = dimension.read_dimension(spark, str(tmp_path / "table"), job.CERTIFICATE)
    assert [(r["fingerprint"], r["x509_key_length"]) for r in table.collect()] == [("f", 1.0)]
    handshakes = spark.createDataFrame([("u", "f"), ("v", None), ("w", "g")], "uid string, first_cert_fp string")
    assert {r["uid"]: r["x509_key_length"] for r in flows.with_certificate_table(handshakes, table).collect()} == {"u": 1.0, "v": None, "w": None}


def test_scored_detections_reach_the_sink(spark, tmp_path):
    write(tmp_path / "conn", [row("u", 0, duration=1.0), row("v", 1)])
    stream = read_file_log(spark, str(tmp_path / "conn"), "conn", "5 minutes")
    scored = stream.select("uid", F.lit("vpn").alias("label"), (F.col("duration") > 0).alias("is_confident"))
    flows.write_detections(scored, "json", str(tmp_path / "state"), {"path": str(tmp_path / "sink")}, {"availableNow": True}).awaitTermination()
    rows = spark.read.json(str(tmp_path / "sink")).collect()
    assert {r["key"]: json.loads(r["value"])["label"] for r in rows} == {"u": "vpn", "v": "vpn"}


def test_two_flows_of_a_session_stay_two(spark, tmp_path):
    end = row("end", 600)
    write(tmp_path / "conn", [row("u", 0, service="http"), row("u", 2, service="dns"), end])
    write(tmp_path / "ssl", [row("u", 1, version="TLSv13", cert_chain_fps=["f", "g"]), end])
    write(tmp_path / "http", [row("u", 1, request_body_len=3, method="GET", host="h", status_code=200), end])
    write(tmp_path / "dns", [row("u", 1, rtt=0.5, query="q", qtype_name="A", answers=["x"], TTLs=[4.0]), end])
    logs = [read_file_log(spark, str(tmp_path / n), n, "5 minutes") for n in ("conn", "ssl", "http", "dns")]
    out = flows.drained(flows.enriched_sessions(*logs), str(tmp_path / "out")).collect()
    assert sorted(r["service"] for r in out) == ["dns", "http"]
    for r in out:
        assert (r["first_cert_fp"], r["http_method_GET"], r["http_status_2xx_ratio"], r["http_unique_hosts"]) == ("f", 1, 1.0, 1)
        assert (r["dns_qtype_A"], r["dns_has_answer"], r["dns_avg_ttl"], r["dns_unique_queries"]) == (1, 1.0, 4.0, 1)


def test_streamed_features_match_the_batch(spark, sf_dir):
    got = {r["uid"]: r.asDict() for r in QUERIES["stream_features"](spark, sf_dir).collect()}
    logs = {v: view(spark, sf_dir, v) for v in ("ssl", "x509", "http", "dns")}
    twin = rounded(features(enrich(flow_windows(conn(spark, sf_dir)), **logs)), 5)
    expected = {r["uid"]: r.asDict() for r in twin.collect()}
    times = {r["uid"]: r["event_time"] for r in conn(spark, sf_dir).select("uid", "event_time").collect()}
    assert len(twin.columns) == 146 and len(got) == QUERIES["stream_features"](spark, sf_dir).count()
    assert {u for u, t in times.items() if t < max(times.values()) - timedelta(days=2)} <= set(got)
    assert all(got[u] == expected[u] for u in got)
    assert all(any(r[c] > 0 for r in got.values()) for c in ("http_avg_ua_len", "dns_qtype_A", "x509_key_length", "dest_port_entropy"))


def test_flows_of_one_source_are_not_held_together(spark):
    rows = [(f"u{i}" if i % 9 else None, "a" if i % 5 else None, f"h{i % 7}" if i % 3 else None, i % 4 if i % 2 else None, 37 * i) for i in range(200)]
    table = spark.createDataFrame(rows, "uid string, id_orig_h string, id_resp_h string, id_resp_p int, s long").withColumn("event_time", F.timestamp_seconds("s"))
    streamed = flows.flow_concurrency(table)
    assert "collect_" not in streamed._jdf.queryExecution().optimizedPlan().toString()
    twin = rounded(flow_windows(table).dropna(subset=["id_orig_h"])).select(streamed.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(rounded(streamed).collect(), key=key) == sorted(twin.collect(), key=key) and streamed.count() == sum(r[1] is not None for r in rows)


def test_late_rows_are_counted_and_kept_aside(spark, tmp_path):
    batches = [[row("a", 0), row("b", 20)], [row("c", 30), row("d", 14), row("e", 16), row("f", 40)], [row("g", 34), row("h", 35), row("i", 3), row("j", 60), {"uid": "k"}]]
    write(tmp_path / "http", *batches)
    stream = read_file_log(spark, str(tmp_path / "http"), "http", "5 minutes")
    want, dropped, latest, earlier = [], [], 0, 0
    for rows in batches:  # a replay by hand: the latest time of all batches before, less the delay; operators drop by the batch before's
        times = {r["uid"]: r["ts"] for r in rows if "ts" in r}
        want += [u for u, t in times.items() if t <= latest - 300]
        dropped += [u for u, t in times.items() if t <= earlier - 300]
        earlier, latest = latest, max([*times.values(), latest])
    assert (want, dropped) == (["d", "g", "h", "i"], ["i"])
    for _ in range(2):  # started again, it finds nothing new and keeps what it has
        late.keep_late(stream, str(tmp_path / "late"), str(tmp_path / "state"), "5 minutes").awaitTermination()
        assert sorted(r["uid"] for r in late.read_late(spark, str(tmp_path / "late"), stream).collect()) == want
    assert late.read_late(spark, str(tmp_path / "none"), stream).count() == 0
    listener = late.DroppedRows()
    spark.streams.addListener(listener)
    unique = stream.dropDuplicatesWithinWatermark(["uid"]).select("uid")
    query = unique.writeStream.format("noop").queryName("unique").option("checkpointLocation", str(tmp_path / "unique")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(listener)
    assert listener.dropped("unique") == late.dropped_by(query) == len(dropped) and listener.dropped("other") == 0


def test_windows_are_copied_only_to_parts_with_flows(spark):
    rows = [(f"u{i}", f"s{i % 30}", "h", i % 3, 97 * i) for i in range(300)]
    table = spark.createDataFrame(rows, "uid string, id_orig_h string, id_resp_h string, id_resp_p int, s long").withColumn("event_time", F.timestamp_seconds("s"))
    copies = flows._latest_windows(table, "10 minutes", "5 minutes", "event_time").count()
    assert copies <= len(rows) < flows.window_concurrency(table).count()
    assert flows.flow_concurrency(table).count() == len(rows)
