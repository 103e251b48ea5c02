"""Registered streaming queries: a table's files run through a stream to its end, and the SQL of what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boosting import Settings, fit_boosted, save_boosted
from ..operators.concurrency import flow_windows
from ..operators.enrich import enrich, within
from ..operators.evaluate import softmax_scores
from ..operators.features import feature_names, features
from ..operators.reduce import certificate_rows
from ..schema import DETECTION, SOURCE_FEATURES, X509_FEATURES, struct
from ..session import shared_dir, ship, until_exit
from ..sources.logs import read_detections
from ..streaming.dimension import read_dimension
from ..streaming.flows import DELAYS, dns_sessions, drained, enriched_sessions, flow_concurrency, http_sessions, read_table_stream, stream_flow_features, watermarked, window_concurrency, with_flow_concurrency, write_detections
from ..streaming.job import CERTIFICATE, keep_certificates, write_model_detections
from .queries import ALL_VIEWS, CERT_ROWS, COEFFICIENTS, ENRICHED_SQL, FEATURE_SQL, PANE, SCORED_SQL, STATS_RAW, WINDOWS_RAW, features_sql, r, registered, rounded
from .views import CONN, DNS, HTTP, K, SSL, conn, view, with_views


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the place that driver and executors share, until the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    until_exit(spark, path)
    return path


def conn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table_stream(spark, sf_dir, "events").withColumn("k", F.expr(K))
    return watermarked(events.selectExpr(*(f"{e} AS {n}" for n, e in CONN.items()), "CAST(ts AS TIMESTAMP) AS event_time"), "conn")


#: What the last watermark has passed: a window that ends by then has come out.
_CLOSED = f"(SELECT max(ts) - INTERVAL {DELAYS['conn'].upper()} FROM conn)"
#: Counters of each source and window.
_STATS = f"""spread AS (SELECT id_orig_h, id_resp_p, id_resp_h, unnest([{PANE}, {PANE} - INTERVAL 5 MINUTES]) AS window_start FROM conn),
stats AS (SELECT id_orig_h, window_start, count(*) AS src_flow_count, count(DISTINCT id_resp_h) AS unique_dest_count, count(DISTINCT id_resp_p) AS unique_dest_port_count,
  {r('CASE WHEN count(id_resp_p) > 0 THEN entropy(id_resp_p) END')} AS dest_port_entropy FROM spread WHERE window_start + INTERVAL 10 MINUTES <= {_CLOSED} GROUP BY ALL)"""


@registered(with_views(f"""-- with {_STATS}
SELECT id_orig_h, CAST(epoch(window_start) AS BIGINT) AS window_start, src_flow_count, unique_dest_count, unique_dest_port_count, dest_port_entropy FROM stats""", "conn"))
def stream_window_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(window_concurrency(conn_stream(spark, sf_dir)), shared_path(spark, "windows"))
    return rounded(out.select("id_orig_h", F.unix_seconds("window.start").alias("window_start"), *SOURCE_FEATURES))


@registered(with_views(f"""-- with {_STATS}
SELECT c.uid, CAST(epoch(s.window_start) AS BIGINT) AS window_start, src_flow_count, unique_dest_count, unique_dest_port_count, dest_port_entropy
FROM (SELECT *, {PANE} AS window_start FROM conn) c JOIN stats s USING (id_orig_h, window_start)""", "conn"))
def stream_flow_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(flow_concurrency(conn_stream(spark, sf_dir)), shared_path(spark, "flows"))
    return rounded(out.select("uid", F.unix_seconds("window_start").alias("window_start"), *SOURCE_FEATURES))


def _sessions_sql(rows: str, aggregates: str) -> str:
    """Of rows with uid and t: the aggregates of each session that the last watermark has passed."""
    return f"""WITH h AS ({rows}), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY uid ORDER BY t) < INTERVAL 5 MINUTES THEN 0 ELSE 1 END AS fresh FROM h),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY uid ORDER BY t ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT uid, CAST(epoch(min(t)) AS BIGINT) AS session_start, {aggregates}
FROM s GROUP BY uid, nth HAVING max(t) + INTERVAL 5 MINUTES <= (SELECT max(t) - INTERVAL 5 MINUTES FROM h)"""


@registered(_sessions_sql(
    "SELECT concat('C', l_orderkey) AS uid, l_shipdate AS t, l_quantity AS request, l_suppkey AS host FROM lineitem WHERE l_linestatus = 'O'",
    f"count(request) AS http_request_count, {r('sum(request)')} AS http_total_req_body_len, count(DISTINCT host) AS http_unique_hosts",
))
def stream_http_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP features of the sessions that have closed."""
    items = read_table_stream(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    http = items.selectExpr(
        "concat('C', l_orderkey) AS uid", "CAST(l_shipdate AS TIMESTAMP) AS event_time", "l_quantity AS request_body_len", "l_extendedprice AS response_body_len", "200 AS status_code",
        "'GET' AS method", "concat('h', l_suppkey) AS host", "CAST(NULL AS STRING) AS user_agent",
    )
    out = drained(http_sessions(watermarked(http, "http")), shared_path(spark, "http"))
    return rounded(out.select("uid", F.unix_seconds("session.start").alias("session_start"), "http_request_count", "http_total_req_body_len", "http_unique_hosts"))


@registered(_sessions_sql(
    f"SELECT {DNS['uid']} AS uid, l_shipdate AS t, {DNS['rtt']} AS rtt, {DNS['query']} AS query, {DNS['rejected']} AS rejected FROM lineitem WHERE l_linestatus = 'F'",
    f"count(rtt) AS dns_query_count, {r('avg(rtt)')} AS dns_rtt_mean, max(CASE WHEN rejected = 'T' THEN 1 ELSE 0 END) AS dns_rejected, count(DISTINCT query) AS dns_unique_queries",
))
def stream_dns_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS features of the sessions that have closed."""
    items = read_table_stream(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'")
    dns = items.selectExpr(*(f"{e} AS {n}" for n, e in DNS.items() if n != "class"), "CAST(l_shipdate AS TIMESTAMP) AS event_time")
    out = drained(dns_sessions(watermarked(dns, "dns")), shared_path(spark, "dns"))
    return rounded(out.select("uid", F.unix_seconds("session.start").alias("session_start"), "dns_query_count", "dns_rtt_mean", "dns_rejected", "dns_unique_queries"))


@registered("SELECT p.event_id, e.event_id AS error_id FROM events p JOIN events e ON p.user_id = e.user_id AND e.ts BETWEEN p.ts - INTERVAL 5 MINUTES AND p.ts + INTERVAL 5 MINUTES WHERE p.event_type = 'purchase' AND e.event_type = 'error'")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined within an interval, so that state is kept for its length and the watermarks' delay."""
    events = read_table_stream(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp"))
    purchases = watermarked(events.filter("event_type = 'purchase'").select("user_id", "event_id", "time"), "conn", "time")
    errors = watermarked(events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("time").alias("error_time")), "conn", "error_time")
    joined = within(purchases, errors, "user_id", "time", "error_time", "5 MINUTES", "5 MINUTES", "inner")
    return drained(joined.select("event_id", "error_id"), shared_path(spark, "interval"))


#: The chain below: kind of event, column, and how far from the purchase it may lie.
CHAIN = (("error", "error_id", 5), ("view", "view_id", 2))
_PASSED = "(SELECT least(max(ts) FILTER (WHERE event_type = 'purchase'), max(ts) FILTER (WHERE event_type = 'error'), max(ts) FILTER (WHERE event_type = 'view')) - INTERVAL 5 MINUTES FROM events)"


@registered(f"""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'),
e AS (SELECT p.*, x.event_id AS error_id FROM p LEFT JOIN events x ON x.event_type = 'error' AND x.user_id = p.user_id AND x.ts BETWEEN p.ts - INTERVAL 5 MINUTES AND p.ts + INTERVAL 5 MINUTES),
v AS (SELECT e.*, x.event_id AS view_id FROM e LEFT JOIN events x ON x.event_type = 'view' AND x.user_id = e.user_id AND x.ts BETWEEN e.ts - INTERVAL 2 MINUTES AND e.ts + INTERVAL 2 MINUTES)
SELECT event_id, error_id, view_id FROM v
WHERE (error_id IS NOT NULL OR ts + INTERVAL 5 MINUTES < {_PASSED}) AND (view_id IS NOT NULL OR ts + INTERVAL 7 MINUTES < {_PASSED})""")
def stream_left_interval_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a stream, joined from the left with errors and then with views near them: unmatched ones come out once, when the watermark lets none follow."""
    events = read_table_stream(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp"))
    out = watermarked(events.filter("event_type = 'purchase'").select("user_id", "event_id", "time"), "conn", "time")
    for kind, name, minutes in CHAIN:
        others = watermarked(events.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("time").alias("other_time")), "conn", "other_time")
        out = within(out, others, "user_id", "time", "other_time", f"{minutes} MINUTES", f"{minutes} MINUTES").drop("other_time")
    return drained(out.select("event_id", "error_id", "view_id"), shared_path(spark, "chain"))


@registered(with_views(f"{SCORED_SQL} SELECT uid, prediction AS label, {r('confidence')} AS confidence FROM scored WHERE is_confident", "conn"))
def stream_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a stream scored as they come and written to a sink as keyed JSON; the confident ones, read from there."""
    rows = features(conn_stream(spark, sf_dir), ("uid", "event_time", "id_orig_h", "id_resp_h"), ("derived", "logs", "ports"))
    scored = softmax_scores(rows, COEFFICIENTS).select(
        "uid", F.col("event_time").alias("ts"), F.col("id_orig_h").alias("orig_h"), F.col("id_resp_h").alias("resp_h"), F.col("prediction").alias("label"), "confidence", "is_confident"
    )
    path = shared_path(spark, "detections")
    write_detections(scored, "parquet", f"{path}/state", {"path": f"{path}/sink"}, {"availableNow": True}).awaitTermination()
    return rounded(read_detections(spark.read.schema("key string, value string").parquet(f"{path}/sink")).select("uid", "label", "confidence"))


def log_stream(spark: SparkSession, sf_dir: str, log: str) -> DataFrame:
    """A log's view as a stream whose rows come at the time of their flow."""
    table, key, columns, rows = {
        "http": ("lineitem", "l_orderkey", HTTP, "l_linestatus = 'O'"), "dns": ("lineitem", "l_orderkey", DNS, "l_linestatus = 'F'"), "ssl": ("orders", "o_orderkey", SSL, "o_orderstatus <> 'P'")
    }[log]
    stream = read_table_stream(spark, sf_dir, table).filter(rows)
    if log == "ssl":
        stream = stream.withColumn("copy", F.explode(F.expr("CASE WHEN o_orderkey % 20 = 0 THEN array(0, 1) ELSE array(0) END")))
    times = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("event_time"))
    joined = stream.join(times, F.col(key) == F.col("event_id"))
    return watermarked(joined.selectExpr(*(f"{e} AS {n}" for n, e in columns.items()), "event_time"), log)


#: What the watermark of all four streams has passed at their end.
_PASSED_ALL = """(SELECT least((SELECT max(ts) FROM conn), (SELECT max(ts) FROM events JOIN orders ON o_orderkey = event_id WHERE o_orderstatus <> 'P'),
  (SELECT max(ts) FROM events JOIN lineitem ON l_orderkey = event_id WHERE l_linestatus = 'O'), (SELECT max(ts) FROM events JOIN lineitem ON l_orderkey = event_id WHERE l_linestatus = 'F')) - INTERVAL 5 MINUTES)"""
#: Flows with the other logs and the statistics of their latest window.
WINDOWED_SQL = ENRICHED_SQL.replace(STATS_RAW, WINDOWS_RAW).replace("FROM conn LEFT JOIN stats ON conn.id_orig_h = stats.id_orig_h", f"FROM (SELECT *, {PANE} AS window_start FROM conn) conn LEFT JOIN stats ON conn.id_orig_h = stats.id_orig_h AND conn.window_start = stats.window_start").replace("EXCLUDE (id_orig_h)", "EXCLUDE (id_orig_h, window_start)")


@registered(with_views(f"""{WINDOWED_SQL} {features_sql(FEATURE_SQL, 'joined', 5)}
WHERE ts + INTERVAL 5 MINUTES <= {_PASSED_ALL} AND window_start + INTERVAL 10 MINUTES <= {_PASSED_ALL}""", *ALL_VIEWS))
def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the flows whose session and window have closed; source statistics are those of the flow's latest window."""
    certificates = certificate_rows(view(spark, sf_dir, "x509"))
    logs = [conn_stream(spark, sf_dir), *(log_stream(spark, sf_dir, log) for log in ("ssl", "http", "dns"))]
    return rounded(drained(stream_flow_features(*logs, certificates), shared_path(spark, "features")), 5)


#: Files that the certificates' stream reads, one in each micro-batch.
FILES = 4


def certificate_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The certificates' view, dealt to files, run through a stream that keeps each one's first row at path."""
    rows = shared_path(spark, "x509")
    view(spark, sf_dir, "x509").withColumn("ts", F.col("ts").cast("double")).repartition(FILES).write.parquet(f"{rows}/rows")
    schema = spark.read.parquet(f"{rows}/rows").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{rows}/rows")
    keep_certificates(stream, path, f"{rows}/state", {"availableNow": True}).awaitTermination()


@registered(with_views(CERT_ROWS, "x509"))
def stream_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each certificate's first row, from a table that micro-batches have written part by part."""
    path = shared_path(spark, "certificates")
    certificate_table(spark, sf_dir, path)
    return rounded(read_dimension(spark, path, CERTIFICATE).select("fingerprint", *X509_FEATURES))


def saved_model(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Boosted trees of a few rounds, trained on all features of all flows, at path."""
    logs = {v: view(spark, sf_dir, v) for v in ("ssl", "x509", "http", "dns")}
    rows = shared_path(spark, "training")
    features(enrich(flow_windows(conn(spark, sf_dir)), **logs)).write.parquet(f"{rows}/rows")
    save_boosted(fit_boosted(spark.read.parquet(f"{rows}/rows"), feature_names(), settings=Settings(rounds=2, leaves=7, rate=0.5)), path, spark)


@registered()
def stream_model_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a stream, with all features and the certificates of another stream, scored by a saved model and written to a sink; what the sink holds."""
    ship(spark)
    path = shared_path(spark, "job")
    saved_model(spark, sf_dir, f"{path}/model")
    certificate_table(spark, sf_dir, f"{path}/certificates")
    flows = conn_stream(spark, sf_dir)
    enriched = with_flow_concurrency(enriched_sessions(flows, *(log_stream(spark, sf_dir, log) for log in ("ssl", "http", "dns"))), flows).drop("session")
    write_model_detections(enriched, f"{path}/certificates", f"{path}/model", f"{path}/sink", f"{path}/state", {"availableNow": True}).awaitTermination()
    messages = spark.read.schema("key string, value string").option("recursiveFileLookup", True).json(f"{path}/sink")
    return rounded(read_detections(messages, False)).select(*struct(DETECTION).names)
