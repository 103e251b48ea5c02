"""Registered queries over the log-shaped views, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import entropy, flag, long_text_entropy, rounded_half_up
from ..operators import concurrency as conc
from ..operators import evaluate as ev
from ..operators import splits
from ..operators.enrich import enrich, with_certificates, within
from ..operators.features import HISTORY, feature_columns, features, labelled
from ..operators.reduce import certificate_rows, dns_rows, http_rows, ssl_rows
from ..schema import CIPHERS, CLASSES, CONN_STATES, CURVES, DNS_FEATURES, HTTP_FEATURES, LOGGED, METHODS, NEXT_PROTOCOLS, NUMERICS, PROTOS, PROXY_PORTS, QTYPES, SERVICES, SOURCE_FEATURES, SSL_FIELDS, SSL_VERSIONS, VPN_PORTS, WEB_PORTS, X509_FEATURES
from ..session import ship
from ..sources.logs import combine_classes, detection_messages, observed, read_detections, with_event_time, without_leaks
from .views import conn, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative 0, so that sums in another order compare equal."""
    return df.select(*(rounded_half_up(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0e0)"


def seconds(c: str):
    return F.unix_seconds(c)


# Aggregates of one log.
def same(expression: str) -> str:
    return expression


def http_sql(r=r) -> str:
    return ", ".join([
        "count(request_body_len) AS http_request_count", f"{r('avg(request_body_len)')} AS http_avg_req_body_len", f"{r('coalesce(sum(request_body_len), 0)')} AS http_total_req_body_len",
        f"{r('avg(response_body_len)')} AS http_avg_resp_body_len", f"{r('coalesce(sum(response_body_len), 0)')} AS http_total_resp_body_len",
        *(f"{r(f'avg(CASE WHEN status_code >= {low} AND status_code < {high} THEN 1.0e0 ELSE 0.0e0 END)')} AS http_status_{low // 100}xx_ratio" for low, high in ((200, 300), (300, 400), (400, 500), (500, 10**9))),
        f"{r('avg(coalesce(length(user_agent), 0))')} AS http_avg_ua_len", "count(DISTINCT host) AS http_unique_hosts",
        *(f"CAST(sum(CASE WHEN method = '{m}' THEN 1 ELSE 0 END) AS BIGINT) AS http_method_{m}" for m in METHODS),
    ])


def dns_sql(r=r) -> str:
    return ", ".join([
        "count(rtt) AS dns_query_count", f"{r('avg(rtt)')} AS dns_rtt_mean", f"{r('stddev_samp(rtt)')} AS dns_rtt_std",
        f"{r('''avg(CASE WHEN rcode_name = 'NXDOMAIN' THEN 1.0e0 ELSE 0.0e0 END)''')} AS dns_nxdomain_ratio",
        "max(CASE WHEN rejected = 'T' THEN 1 ELSE 0 END) AS dns_rejected", f"{r('avg(CASE WHEN answers IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END)')} AS dns_has_answer",
        f"{r('''avg(CAST(string_split(TTLs, ',')[1] AS DOUBLE))''')} AS dns_avg_ttl", "count(DISTINCT query) AS dns_unique_queries",
        *(f"CAST(sum(CASE WHEN qtype_name = '{q}' THEN 1 ELSE 0 END) AS BIGINT) AS dns_qtype_{q}" for q in QTYPES),
    ])


HTTP_ROWS, HTTP_RAW = (f"SELECT uid, class, {http_sql(f)} FROM http GROUP BY uid, class" for f in (r, same))
DNS_ROWS, DNS_RAW = (f"SELECT uid, class, {dns_sql(f)} FROM dns GROUP BY uid, class" for f in (r, same))
SSL_COLUMNS = ", ".join(f"{c} AS ssl_{c}" for c in SSL_FIELDS)
SSL_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ("ts", "first_cert_fp", *SSL_FIELDS))
SSL_ROWS = f"SELECT * EXCLUDE (nth) FROM (SELECT uid, class, first_cert_fp, {SSL_COLUMNS}, row_number() OVER (PARTITION BY uid, class ORDER BY {SSL_ORDER}) AS nth FROM ssl) WHERE nth = 1"
_CERT = """CAST(certificate_key_length AS DOUBLE) AS x509_key_length, CASE WHEN certificate_key_type = 'rsa' THEN 1 ELSE 0 END AS x509_is_rsa,
  CASE WHEN certificate_key_type = 'ecdsa' THEN 1 ELSE 0 END AS x509_is_ecdsa, CASE WHEN certificate_subject = certificate_issuer THEN 1 ELSE 0 END AS x509_is_self_signed,
  CASE WHEN basic_constraints_ca = 'T' THEN 1 ELSE 0 END AS x509_is_ca, CASE WHEN host_cert = 'T' THEN 1 ELSE 0 END AS x509_is_host_cert,
  round((certificate_not_valid_after - certificate_not_valid_before) / 86400, 6) + 0.0e0 AS x509_validity_days"""
CERT_ROWS = f"SELECT * EXCLUDE (nth) FROM (SELECT fingerprint, {_CERT}, row_number() OVER (PARTITION BY fingerprint ORDER BY ts, certificate_key_length) AS nth FROM x509) WHERE nth = 1"


@registered(with_views(HTTP_ROWS, "http"))
def http_per_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(http_rows(view(spark, sf_dir, "http")))


@registered(with_views(DNS_ROWS, "dns"))
def dns_per_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dns_rows(view(spark, sf_dir, "dns")))


@registered(with_views(SSL_ROWS, "ssl"))
def ssl_first_handshake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssl_rows(view(spark, sf_dir, "ssl"))


@registered(with_views(CERT_ROWS, "x509"))
def certificate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(certificate_rows(view(spark, sf_dir, "x509")))


@registered(with_views(f"-- with s AS ({SSL_ROWS}), c AS ({CERT_ROWS}) SELECT s.uid, s.class, {', '.join(f'c.{x}' for x in X509_FEATURES)} FROM s LEFT JOIN c ON s.first_cert_fp = c.fingerprint", "ssl", "x509"))
def ssl_with_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_certificates(ssl_rows(view(spark, sf_dir, "ssl")), certificate_rows(view(spark, sf_dir, "x509")))
    return rounded(rows.select("uid", "class", *X509_FEATURES))


# The same over all rows of the logs, by uid alone: the views above hold only the rows whose flow has a class.
UID = ("uid",)
SSL_ALL = f"SELECT * EXCLUDE (nth) FROM (SELECT uid, first_cert_fp, {SSL_COLUMNS}, row_number() OVER (PARTITION BY uid ORDER BY {SSL_ORDER}) AS nth FROM ssl_all) WHERE nth = 1"


@registered(with_views(f"SELECT uid, {http_sql(r)} FROM http_all GROUP BY uid", "http_all"))
def http_per_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(http_rows(view(spark, sf_dir, "http_all"), UID))


@registered(with_views(f"SELECT uid, {dns_sql(r)} FROM dns_all GROUP BY uid", "dns_all"))
def dns_per_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dns_rows(view(spark, sf_dir, "dns_all"), UID))


@registered(with_views(SSL_ALL, "ssl_all"))
def ssl_first_handshake_per_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssl_rows(view(spark, sf_dir, "ssl_all"), UID)


@registered(with_views(f"-- with s AS ({SSL_ALL}), c AS ({CERT_ROWS}) SELECT s.uid, {', '.join(f'c.{x}' for x in X509_FEATURES)} FROM s LEFT JOIN c ON s.first_cert_fp = c.fingerprint", "ssl_all", "x509"))
def ssl_with_certificates_per_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_certificates(ssl_rows(view(spark, sf_dir, "ssl_all"), UID), certificate_rows(view(spark, sf_dir, "x509")))
    return rounded(rows.select("uid", *X509_FEATURES))


# Sources and cleaning.
@registered(with_views("SELECT class, count(*) AS flows, count(service) AS with_service FROM conn GROUP BY class", "conn"))
def combined_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes' logs, some of them without a column, combined and counted."""
    flows = view(spark, sf_dir, "conn")
    parts = {c: flows.filter(F.col("class") == c).drop("class") for c in CLASSES}
    combined = combine_classes({c: p for c, p in parts.items()})
    return combined.groupBy("class").agg(F.count(F.lit(1)).alias("flows"), F.count("service").alias("with_service"))


@registered(with_views("SELECT uid, class, proto, service, conn_state, history, orig_bytes FROM conn", "conn"))
def without_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking identifiers dropped, but for the flow's key."""
    return without_leaks(view(spark, sf_dir, "conn"), "conn").select("uid", "class", "proto", "service", "conn_state", "history", "orig_bytes")


@registered(with_views("SELECT * EXCLUDE (ts) FROM ssl_all", "ssl_all"))
def ssl_without_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_leaks(view(spark, sf_dir, "ssl_all"), "ssl")


@registered(with_views("SELECT * EXCLUDE (query, answers, TTLs) FROM dns_all", "dns_all"))
def dns_without_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_leaks(view(spark, sf_dir, "dns_all"), "dns")


@registered("SELECT concat('C', event_id) AS uid, epoch_us(ts) AS event_us FROM events")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants from epoch seconds, fractions kept."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("C"), "event_id").alias("uid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return with_event_time(rows).select("uid", F.unix_micros("event_time").alias("event_us"))


def entropy_sql(c: str) -> str:
    return f"CASE WHEN length({c}) > 0 THEN list_aggregate(string_split({c}, ''), 'entropy') END"


@registered(f"SELECT page_id, length(url) AS url_len, {r(entropy_sql('url'))} AS url_entropy FROM pages")
def url_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rounded(rows.select("page_id", F.length("url").cast("long").alias("url_len"), entropy(F.col("url")).alias("url_entropy")))


@registered(f"SELECT page_id, {r(entropy_sql('html'))} AS html_entropy FROM pages")
def page_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of long texts, by the vectorised function."""
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rounded(rows.select("page_id", long_text_entropy("html").alias("html_entropy")))


# Concurrency.
def _stats_sql(key: str, source: str, r=r) -> str:
    return f"""ports AS (SELECT {key}, id_resp_p, sum(n) AS n FROM {source} GROUP BY {key}, id_resp_p),
by_port AS (SELECT {key}, CAST(sum(n) AS BIGINT) AS src_flow_count, count(id_resp_p) AS unique_dest_port_count,
  CASE WHEN count(id_resp_p) > 0 THEN log2(sum(n) FILTER (WHERE id_resp_p IS NOT NULL)) - sum(n * log2(n)) FILTER (WHERE id_resp_p IS NOT NULL) / sum(n) FILTER (WHERE id_resp_p IS NOT NULL) END AS e FROM ports GROUP BY {key}),
targets AS (SELECT {key}, count(DISTINCT id_resp_h) AS unique_dest_count FROM {source} GROUP BY {key}),
stats AS (SELECT {key}, src_flow_count, unique_dest_count, unique_dest_port_count, {r('e')} AS dest_port_entropy FROM by_port JOIN targets USING ({key}))"""


STATS_SQL, STATS_RAW = (_stats_sql("id_orig_h", "(SELECT *, 1 AS n FROM conn)", f) for f in (r, same))
PANE = "time_bucket(INTERVAL 5 MINUTES, ts)"
_SPREAD = f"""spread AS (SELECT id_orig_h, id_resp_h, id_resp_p, 1 AS n, unnest([{PANE}, {PANE} - INTERVAL 5 MINUTES]) AS window_start FROM conn), """
WINDOWS_SQL, WINDOWS_RAW = (_SPREAD + _stats_sql("id_orig_h, window_start", "spread", f) for f in (r, same))
STAT_NAMES = ", ".join(SOURCE_FEATURES)


@registered(with_views(f"-- with {STATS_SQL} SELECT * FROM stats", "conn"))
def source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conc.source_stats(view(spark, sf_dir, "conn")))


@registered(with_views(f"-- with {STATS_SQL} SELECT uid, {STAT_NAMES} FROM conn LEFT JOIN stats USING (id_orig_h)", "conn"))
def flows_with_source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conc.with_source_stats(view(spark, sf_dir, "conn")).select("uid", *SOURCE_FEATURES))


@registered(with_views(f"-- with {WINDOWS_SQL} SELECT id_orig_h, CAST(epoch(window_start) AS BIGINT) AS window_start, {STAT_NAMES} FROM stats", "conn"))
def window_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conc.window_stats(conn(spark, sf_dir)).withColumn("window_start", seconds("window_start")))


@registered(with_views(f"-- with {WINDOWS_SQL} SELECT c.uid, CAST(epoch(window_start) AS BIGINT) AS window_start, {STAT_NAMES} FROM (SELECT *, {PANE} AS window_start FROM conn) c LEFT JOIN stats USING (id_orig_h, window_start)", "conn"))
def flows_with_window_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conc.flow_windows(conn(spark, sf_dir)).select("uid", seconds("window_start").alias("window_start"), *SOURCE_FEATURES))


# Interval joins.
_ERRORS = "SELECT user_id, event_id AS error_id, ts AS error_ts FROM events WHERE event_type = 'error'"


@registered(f"WITH e AS ({_ERRORS}) SELECT p.event_id, e.error_id FROM events p LEFT JOIN e ON p.user_id = e.user_id AND e.error_ts BETWEEN p.ts - INTERVAL 5 MINUTES AND p.ts + INTERVAL 5 MINUTES WHERE p.event_type = 'purchase'")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with their user's errors of five minutes before and after."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    errors = rows.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    return within(rows.filter("event_type = 'purchase'"), errors, "user_id", "ts", "error_ts", "5 MINUTES", "5 MINUTES").select("event_id", "error_id")


@registered("SELECT o.o_orderkey, l.l_partkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate BETWEEN o.o_orderdate - INTERVAL 24 HOURS AND o.o_orderdate + INTERVAL 0 HOURS")
def lag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was published up to a day before, as a certificate before its handshake."""
    orders, items = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    joined = within(orders, items.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "o_orderdate", "l_shipdate", "24 HOURS", "0 HOURS")
    return joined.select("o_orderkey", "l_partkey", "l_linenumber")


# Features.
def n(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def z(c: str) -> str:
    return f"coalesce({n(c)}, 0.0e0)"


def bit(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def one_hot(prefix: str, column: str, values) -> dict[str, str]:
    return {f"{prefix}_{v}": bit(f"{column} = '{v}'") for v in values}


def listed(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


ob, rb, op, rp, oib, rib = (z(c) for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes"))
_LONGER = "CASE WHEN duration IS NOT NULL THEN greatest(duration, 0.001e0) END"
_DERIVED = {
    "total_bytes": f"{ob} + {rb}", "total_pkts": f"{op} + {rp}", "bytes_ratio": f"{ob} / ({rb} + 1)", "pkts_ratio": f"{op} / ({rp} + 1)",
    "avg_pkt_size_orig": f"{ob} / ({op} + 1)", "avg_pkt_size_resp": f"{rb} / ({rp} + 1)", "overhead_orig": f"({oib} - {ob}) / ({op} + 1)", "overhead_resp": f"({rib} - {rb}) / ({rp} + 1)",
    "is_bidirectional": bit(f"{ob} > 0 AND {rb} > 0"), "payload_asymmetry": f"abs({ob} - {rb}) / ({ob} + {rb} + 1)",
    "bytes_per_second": f"({ob} + {rb}) / {_LONGER}", "pkts_per_second": f"({op} + {rp}) / {_LONGER}",
}
_SSL_LEN = lambda c: f"length(coalesce({c}, ''))"
FEATURE_SQL = {
    "numerics": {c: n(c) for c in NUMERICS},
    "derived": _DERIVED,
    "logs": {f"{c}_log": f"CASE WHEN {_DERIVED.get(c, n(c))} IS NOT NULL THEN ln(1 + greatest({_DERIVED.get(c, n(c))}, 0.0e0)) END" for c in LOGGED},
    "ports": {
        "resp_port": n("id_resp_p"), "is_vpn_port": bit(f"id_resp_p IN ({listed(VPN_PORTS)})"), "is_proxy_port": bit(f"id_resp_p IN ({listed(PROXY_PORTS)})"), "is_web_port": bit(f"id_resp_p IN ({listed(WEB_PORTS)})"),
        "is_ephemeral_port": bit("id_resp_p > 32768"), "is_registered_port": bit("id_resp_p BETWEEN 1024 AND 32768"), "is_well_known_port": bit("id_resp_p < 1024"),
    },
    "categories": one_hot("proto", "proto", PROTOS) | one_hot("service", "service", SERVICES) | {"service_other": bit(f"service NOT IN ({listed(SERVICES)})")} | one_hot("conn_state", "conn_state", CONN_STATES) | {c: bit(f"{c} IN ('T', 'true')") for c in ("local_orig", "local_resp")},
    "history": {"history_len": _SSL_LEN("history")} | {name: bit(f"contains(history, '{c}')") for name, c in HISTORY.items()} | {"history_entropy": entropy_sql("history")},
    "ssl": {"ssl_version": "CASE ssl_version " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(SSL_VERSIONS)) + " END"}
    | {f"ssl_cipher_{c}": bit(f"starts_with(ssl_cipher, '{c}')") for c in CIPHERS} | one_hot("ssl_curve", "ssl_curve", CURVES)
    | {"ssl_resumed": bit("ssl_resumed = 'T'"), "ssl_established": bit("ssl_established = 'T'"), "ssl_sni_match": bit("ssl_sni_matches_cert = 'T'")}
    | {f"ssl_next_proto_{v.replace('/', '_').replace('.', '_')}": bit(f"ssl_next_protocol = '{v}'") for v in NEXT_PROTOCOLS}
    | {"ssl_history_len": _SSL_LEN("ssl_ssl_history"), "ssl_history_entropy": entropy_sql("ssl_ssl_history"), "ssl_ja3_entropy": entropy_sql("ssl_ja3"), "ssl_ja3s_entropy": entropy_sql("ssl_ja3s"), "ssl_sni_len": _SSL_LEN("ssl_server_name"), "ssl_sni_entropy": entropy_sql("ssl_server_name")},
    "joined": {c: n(c) for c in (*X509_FEATURES, "has_ssl", "has_dns", "has_http", *DNS_FEATURES, *HTTP_FEATURES, *SOURCE_FEATURES)},
}
ENRICHED_SQL = f"""-- with {STATS_RAW}, s AS ({SSL_ROWS}), c AS ({CERT_ROWS}), h AS ({HTTP_RAW}), d AS ({DNS_RAW}),
joined AS (SELECT conn.*, stats.* EXCLUDE (id_orig_h), s.* EXCLUDE (uid, class, first_cert_fp), c.* EXCLUDE (fingerprint), h.* EXCLUDE (uid, class), d.* EXCLUDE (uid, class),
  {bit('ssl_version IS NOT NULL')} AS has_ssl, {bit('h.uid IS NOT NULL')} AS has_http, {bit('d.uid IS NOT NULL')} AS has_dns
  FROM conn LEFT JOIN stats ON conn.id_orig_h = stats.id_orig_h LEFT JOIN s ON conn.uid = s.uid AND conn.class = s.class LEFT JOIN c ON s.first_cert_fp = c.fingerprint
  LEFT JOIN h ON conn.uid = h.uid AND conn.class = h.class LEFT JOIN d ON conn.uid = d.uid AND conn.class = d.class)"""
ALL_VIEWS = ("conn", "ssl", "x509", "http", "dns")


def features_sql(families, source: str, digits: int = 6) -> str:
    columns = ", ".join(f"{r(f'coalesce({n(e)}, -1.0e0)', digits)} AS {name}" for f in families for name, e in FEATURE_SQL[f].items())
    return f"SELECT uid, class, {columns} FROM {source}"


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {v: view(spark, sf_dir, v) for v in ("ssl", "x509", "http", "dns")}
    return enrich(conc.with_source_stats(view(spark, sf_dir, "conn")), **tables)


def _family_query(name: str, families: tuple[str, ...]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(features(view(spark, sf_dir, "conn"), families=families))

    query.__name__ = name
    registered(with_views(features_sql(families, "conn"), "conn"))(query)


_family_query("features_numeric", ("numerics", "derived", "logs"))
_family_query("features_ports", ("ports",))
_family_query("features_categories", ("categories",))
_family_query("features_history", ("history",))


@registered(with_views(f"-- with s AS ({SSL_ROWS}) {features_sql(('ssl',), 's')}", "ssl"))
def features_ssl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(ssl_rows(view(spark, sf_dir, "ssl")), families=("ssl",)))


@registered(with_views(f"-- with s AS ({SSL_ALL}) {features_sql(('ssl',), 's').replace('uid, class,', 'uid,', 1)}", "ssl_all"))
def features_ssl_per_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(ssl_rows(view(spark, sf_dir, "ssl_all"), UID), UID, ("ssl",)))


@registered(with_views(f"{ENRICHED_SQL} SELECT uid, class, has_ssl, has_http, has_dns, http_request_count, dns_query_count, x509_key_length FROM joined", *ALL_VIEWS))
def enriched_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("uid", "class", "has_ssl", "has_http", "has_dns", "http_request_count", "dns_query_count", "x509_key_length")


@registered(with_views(f"-- with h AS ({HTTP_ROWS}) SELECT conn.uid, conn.class, {bit('h.uid IS NOT NULL')} AS has_http, 0 AS has_ssl, 0 AS has_dns FROM conn LEFT JOIN h ON conn.uid = h.uid AND conn.class = h.class", "conn", "http"))
def enriched_without_optional_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the http log is there."""
    flows = enrich(view(spark, sf_dir, "conn"), http=view(spark, sf_dir, "http"))
    return flows.select("uid", "class", "has_http", "has_ssl", "has_dns")


@registered(with_views(f"{ENRICHED_SQL} {features_sql(FEATURE_SQL, 'joined', 5)}", *ALL_VIEWS))
def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all flows."""
    return rounded(features(enriched(spark, sf_dir)), 5)


# Labels, splits and weights.
@registered(with_views("SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS label_index FROM (SELECT DISTINCT class FROM conn)", "conn"))
def label_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.label_index(view(spark, sf_dir, "conn"))


_NTH = "row_number() OVER (PARTITION BY class ORDER BY md5(uid || '/42'), uid)"


@registered(with_views(f"SELECT uid, class, nth <= round(rows * 0.2e0) AS is_test FROM (SELECT uid, class, {_NTH} AS nth, count(*) OVER (PARTITION BY class) AS rows FROM conn)", "conn"))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(view(spark, sf_dir, "conn").select("uid", "class")).select("uid", "class", "is_test")


@registered(with_views("SELECT uid, ('0x' || substr(md5(uid || '/42'), 1, 8))::BIGINT < 858993459 AS is_test FROM conn", "conn"))
def bucket_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.bucket_split(view(spark, sf_dir, "conn").select("uid"))


@registered(with_views(f"SELECT uid, class, CAST(({_NTH} - 1) % 5 AS INTEGER) AS fold FROM conn", "conn"))
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds(view(spark, sf_dir, "conn").select("uid", "class")).select("uid", "class", "fold")


@registered(with_views("SELECT uid, class FROM conn ORDER BY md5(uid || '/42'), uid LIMIT 500", "conn"))
def subsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 rows without replacement; the number is the operator's argument."""
    return splits.subsample(view(spark, sf_dir, "conn").select("uid", "class"), 500)


@registered(with_views(f"SELECT class, rows, {r('sum(rows) OVER () / (count(*) OVER () * rows)')} AS weight FROM (SELECT class, count(*) AS rows FROM conn GROUP BY class)", "conn"))
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splits.class_weights(view(spark, sf_dir, "conn")))


# Scores and evaluation.
COEFFICIENTS = {
    "bittorrent": {"1": -0.5, "duration_log": 0.3, "is_ephemeral_port": 2.0},
    "normal": {"1": 1.0, "is_web_port": 1.5},
    "proxy": {"1": -0.2, "is_proxy_port": 3.0, "bytes_ratio": 0.001},
    "vpn": {"1": -0.2, "is_vpn_port": 4.0},
}
_USED = sorted({f for w in COEFFICIENTS.values() for f in w if f != "1"})
_FLAT = {k: v for f in ("derived", "logs", "ports") for k, v in FEATURE_SQL[f].items()}
_LINEAR = {x: " + ".join(f"{v}e0" if f == "1" else f"{v}e0 * {f}" for f, v in w.items()) for x, w in COEFFICIENTS.items()}
SCORED_SQL = f"""-- with f AS (SELECT uid, class, {', '.join(f"coalesce({n(_FLAT[c])}, -1.0e0) AS {c}" for c in _USED)} FROM conn),
l AS (SELECT uid, class, {', '.join(f'exp({e}) AS p_{x}' for x, e in _LINEAR.items())} FROM f),
p AS (SELECT uid, class, {', '.join(f"p_{x} / ({' + '.join(f'p_{y}' for y in _LINEAR)}) AS p_{x}" for x in _LINEAR)}, greatest({', '.join(f'p_{x}' for x in _LINEAR)}) / ({' + '.join(f'p_{y}' for y in _LINEAR)}) AS confidence FROM l),
scored AS (SELECT uid, class, CASE {' '.join(f"WHEN {' AND '.join(f'p_{x} >= p_{y}' for y in _LINEAR if y != x)} THEN '{x}'" for x in _LINEAR)} END AS prediction, confidence, confidence >= 0.9e0 AS is_confident FROM p)"""


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = features(view(spark, sf_dir, "conn"), families=("derived", "logs", "ports"))
    return ev.softmax_scores(flows, COEFFICIENTS).select("uid", "class", "prediction", "confidence", "is_confident")


@registered(with_views(f"{SCORED_SQL} SELECT uid, prediction, {r('confidence')} AS confidence, is_confident, CASE WHEN is_confident THEN prediction ELSE 'UNCERTAIN' END AS status FROM scored", "conn"))
def softmax_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.status(scored_flows(spark, sf_dir)).drop("class"))


@registered(with_views(f"{SCORED_SQL} SELECT count(*) AS total, CAST(sum(is_confident::INT) AS BIGINT) AS confident, {r('100.0e0 * sum(is_confident::INT) / count(*)')} AS confident_pct, CAST(count(*) - sum(is_confident::INT) AS BIGINT) AS uncertain FROM scored", "conn"))
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.detection_summary(scored_flows(spark, sf_dir)))


_CELLS = f"cells AS (SELECT a.x AS class, b.x AS prediction, count(uid) AS n FROM (SELECT unnest([{listed(sorted(CLASSES))}]) AS x) a CROSS JOIN (SELECT unnest([{listed(sorted(CLASSES))}]) AS x) b LEFT JOIN scored s ON s.class = a.x AND s.prediction = b.x GROUP BY a.x, b.x)"


@registered(with_views(f"{SCORED_SQL}, {_CELLS} SELECT * FROM cells", "conn"))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(scored_flows(spark, sf_dir), sorted(CLASSES))


_REPORT = f"""{SCORED_SQL}, {_CELLS},
t AS (SELECT class AS entry, sum(n) AS support, sum(n) FILTER (WHERE class = prediction) AS hit FROM cells GROUP BY class),
s2 AS (SELECT prediction AS entry, sum(n) AS said FROM cells GROUP BY prediction),
pr AS (SELECT entry, hit, support, CASE WHEN said > 0 THEN hit / said ELSE 0.0e0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0.0e0 END AS recall FROM t JOIN s2 USING (entry)),
f1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0e0 END AS f1 FROM pr),
al AS (SELECT entry, precision, recall, f1, support FROM f1
  UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f1
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f1
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f1)
SELECT entry, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, CAST(support AS BIGINT) AS support FROM al"""


@registered(with_views(_REPORT, "conn"))
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.classification_report(scored_flows(spark, sf_dir), sorted(CLASSES)))


@registered(with_views(f"{SCORED_SQL} SELECT {r('100 * avg(is_confident::INT)')} AS coverage_pct, {r('coalesce(100 * avg((prediction = class)::INT) FILTER (WHERE is_confident), 0)')} AS confident_accuracy_pct, {r('coalesce(100 * avg((prediction = class)::INT) FILTER (WHERE NOT is_confident), 0)')} AS uncertain_accuracy_pct, count(*) FILTER (WHERE NOT is_confident) AS uncertain FROM scored", "conn"))
def threshold_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.threshold_analysis(scored_flows(spark, sf_dir)))


@registered(with_views(f"{SCORED_SQL}, m AS (SELECT 'accuracy' AS metric, f.fold, avg((prediction = s.class)::INT) AS value FROM scored s JOIN (SELECT uid, ({_NTH} - 1) % 5 AS fold FROM conn) f USING (uid) GROUP BY f.fold) SELECT metric, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM m GROUP BY metric", "conn"))
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy in each fold, its mean and deviation."""
    folded = splits.folds(scored_flows(spark, sf_dir))
    right = flag(F.col("prediction") == F.col("class")).cast("double")
    return rounded(ev.metric_summary(folded.groupBy("fold").agg(F.lit("accuracy").alias("metric"), F.avg(right).alias("value"))))


@registered(with_views(f"{SCORED_SQL} SELECT uid, prediction, {r('confidence')} AS confidence FROM scored ORDER BY confidence DESC, uid LIMIT 20", "conn"))
def top_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most confident; the number is the report's."""
    return rounded(ev.top(scored_flows(spark, sf_dir), "confidence", 20, "uid").select("uid", "prediction", "confidence"))


@registered(with_views(f"{SCORED_SQL} SELECT uid, prediction AS label, {r('confidence')} AS confidence FROM scored WHERE is_confident", "conn"))
def confident_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as keyed JSON, read again, and the confident ones kept."""
    flows = conn(spark, sf_dir).select("uid", F.col("event_time").alias("ts"), F.col("id_orig_h").alias("orig_h"), F.col("id_resp_h").alias("resp_h"))
    scored = scored_flows(spark, sf_dir).select("uid", F.col("prediction").alias("label"), "confidence", "is_confident")
    read = read_detections(detection_messages(flows.join(scored, "uid")))
    return rounded(read.select("uid", "label", "confidence"))


# Previews, counts without a pass, sketches.
_ENDS = "CASE WHEN s.is_confident THEN prediction ELSE 'UNCERTAIN' END AS status"


def _ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored flows with the names of both ends."""
    flows = view(spark, sf_dir, "conn").select("uid", F.col("id_orig_h").alias("orig_h"), F.col("id_resp_h").alias("resp_h"))
    return scored_flows(spark, sf_dir).drop("class").join(flows, "uid")


@registered(with_views(f"{SCORED_SQL} SELECT uid, prediction, {r('confidence')} AS confidence, is_confident, {_ENDS} FROM scored s ORDER BY uid LIMIT 20", "conn"))
def detections_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty flows with their status; the number is the report's."""
    return rounded(ev.preview(scored_flows(spark, sf_dir).drop("class")))


@registered(with_views(f"{SCORED_SQL} SELECT s.uid, '[' || prediction || '] ' || id_orig_h || ' -> ' || id_resp_h || ' (' || printf('%.1f%%', round(confidence * 100, 1)) || ')' AS line FROM scored s JOIN conn USING (uid) WHERE is_confident", "conn"))
def confident_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident detections as lines of text."""
    return ev.lines(_ended(spark, sf_dir).filter("is_confident"))


@registered(with_views(f"SELECT label, {', '.join(f'{r(f'coalesce({n(e)}, -1.0e0)')} AS {name}' for name, e in FEATURE_SQL['ports'].items())} FROM (SELECT *, class AS label FROM conn)", "conn"))
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the label under its own name and without the flow's key."""
    return rounded(labelled(features(view(spark, sf_dir, "conn"), families=("ports",))))


@registered(with_views("SELECT 'read' AS stage, class, count(*) AS n FROM conn GROUP BY class UNION ALL SELECT 'known service', class, count(*) FROM conn WHERE service IS NOT NULL GROUP BY class", "conn"))
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class at two stages of a job, counted by the job's own pass."""
    flows, read = observed(view(spark, sf_dir, "conn"), "read", CLASSES)
    known, kept = observed(flows.filter("service IS NOT NULL"), "known service", CLASSES)
    known.write.format("noop").mode("overwrite").save()
    rows = [(stage, c, int(seen.get[f"rows_{c}"])) for stage, seen in (("read", read), ("known service", kept)) for c in CLASSES]
    return spark.createDataFrame([row for row in rows if row[2]], "stage string, class string, n long")


@registered(with_views(f"-- with {WINDOWS_SQL} SELECT id_orig_h, CAST(epoch(window_start) AS BIGINT) AS window_start, src_flow_count, unique_dest_count, unique_dest_port_count FROM stats", "conn"))
def window_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of sliding windows with distinct counts by sketches, which are exact for counts as small as these."""
    return conc.window_sketches(conn(spark, sf_dir)).withColumn("window_start", seconds("window_start"))
