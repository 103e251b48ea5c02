"""Log-shaped views over order and event tables: the same expressions serve Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
CLASS = "CASE event_type WHEN 'error' THEN 'bittorrent' WHEN 'view' THEN 'vpn' WHEN 'purchase' THEN 'proxy' ELSE 'normal' END"

CONN = {
    "uid": "concat('C', event_id)",
    "class": CLASS,
    "ts": "ts",
    "id_orig_h": "concat('10.0.0.', user_id)",
    "id_resp_h": "concat('192.168.1.', event_id % 211)",
    "id_resp_p": "CASE k % 10 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 1194 WHEN 4 THEN 51820 WHEN 5 THEN 3128 WHEN 6 THEN 8080 WHEN 7 THEN 22 WHEN 8 THEN 40000 + k END",
    "proto": "CASE k % 4 WHEN 0 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'tcp' END",
    "service": "CASE k % 6 WHEN 0 THEN 'ssl' WHEN 1 THEN 'http' WHEN 2 THEN 'dns' WHEN 3 THEN 'quic' WHEN 4 THEN 'ssh' END",
    "conn_state": "CASE k % 5 WHEN 0 THEN 'S0' WHEN 1 THEN 'SF' WHEN 2 THEN 'REJ' WHEN 3 THEN 'RSTO' ELSE 'OTH' END",
    "local_orig": "CASE k % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END",
    "local_resp": "CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END",
    "history": "CASE k % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'ShADadfF' WHEN 2 THEN 'Sr' WHEN 3 THEN 'Dd' END",
    "duration": "CASE WHEN event_id % 17 <> 0 THEN value END",
    "orig_bytes": "CASE WHEN event_id % 13 <> 0 THEN CAST(floor(abs(value) * 100) AS BIGINT) END",
    "resp_bytes": "CAST(k * 40 AS BIGINT)",
    "orig_pkts": "CAST(event_id % 50 AS BIGINT)",
    "resp_pkts": "CAST(k % 30 AS BIGINT)",
    "orig_ip_bytes": "CASE WHEN event_id % 13 <> 0 THEN CAST(floor(abs(value) * 100) AS BIGINT) END + 40 * CAST(event_id % 50 AS BIGINT)",
    "resp_ip_bytes": "CAST(k * 40 + 40 * (k % 30) AS BIGINT)",
    "missed_bytes": "CAST(event_id % 7 AS BIGINT)",
    "ip_proto": "CAST(CASE k % 4 WHEN 0 THEN 17 WHEN 1 THEN 1 ELSE 6 END AS BIGINT)",
}
HTTP = {
    "uid": "concat('C', l_orderkey)",
    "class": CLASS,
    "request_body_len": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END",
    "response_body_len": "l_extendedprice",
    "status_code": "CASE l_returnflag WHEN 'A' THEN 200 WHEN 'N' THEN 302 ELSE 404 END + CASE WHEN l_tax > 0.07e0 THEN 100 ELSE 0 END",
    "method": "CASE l_linenumber WHEN 1 THEN 'GET' WHEN 2 THEN 'POST' WHEN 3 THEN 'HEAD' WHEN 4 THEN 'CONNECT' ELSE 'PATCH' END",
    "host": "concat('h', l_suppkey)",
    "user_agent": "CASE WHEN l_linenumber <> 5 THEN concat('agent/', l_partkey) END",
}
DNS = {
    "uid": "concat('C', l_orderkey)",
    "class": CLASS,
    "rtt": "CASE WHEN l_linenumber < 6 THEN l_discount END",
    "rcode_name": "CASE WHEN l_tax > 0.06e0 THEN 'NXDOMAIN' ELSE 'NOERROR' END",
    "query": "concat('q', l_partkey)",
    "rejected": "CASE WHEN l_returnflag = 'R' THEN 'T' ELSE 'F' END",
    "qtype_name": "CASE l_linenumber WHEN 1 THEN 'A' WHEN 2 THEN 'AAAA' WHEN 3 THEN 'PTR' WHEN 4 THEN 'CNAME' WHEN 5 THEN 'MX' WHEN 6 THEN 'TXT' ELSE 'SRV' END",
    "answers": "CASE WHEN l_returnflag <> 'N' THEN concat('a', l_suppkey) END",
    "TTLs": "concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), ',7')",
}
SSL = {
    "uid": "concat('C', o_orderkey)",
    "class": CLASS,
    "ts": "o_orderdate",
    "version": "CASE WHEN copy = 1 THEN 'SSLv3' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'TLSv13' WHEN '2-HIGH' THEN 'TLSv12' WHEN '3-MEDIUM' THEN 'TLSv10' ELSE 'DTLSv12' END END",
    "cipher": "CASE o_orderkey % 8 WHEN 0 THEN 'TLS_AES_128_GCM_SHA256' WHEN 1 THEN 'TLS_CHACHA20_POLY1305_SHA256' WHEN 2 THEN 'TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256' WHEN 3 THEN 'TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384' WHEN 4 THEN 'TLS_RSA_WITH_AES_128_CBC_SHA' WHEN 5 THEN 'TLS_DHE_RSA_WITH_AES_128_CBC_SHA' WHEN 6 THEN 'OTHER' END",
    "curve": "CASE o_orderkey % 6 WHEN 0 THEN 'x25519' WHEN 1 THEN 'secp256r1' WHEN 2 THEN 'secp384r1' WHEN 3 THEN 'secp521r1' WHEN 4 THEN 'x448' END",
    "server_name": "CASE WHEN o_orderkey % 31 <> 0 THEN concat('s', o_custkey, '.example.net') END",
    "resumed": "CASE o_orderkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END",
    "next_protocol": "CASE o_orderkey % 5 WHEN 0 THEN 'h2' WHEN 1 THEN 'http/1.1' WHEN 2 THEN 'h3' WHEN 3 THEN 'spdy' END",
    "established": "CASE WHEN o_orderkey % 4 <> 0 THEN 'T' ELSE 'F' END",
    "ssl_history": "CASE o_orderkey % 4 WHEN 0 THEN 'CsxknGIti' WHEN 1 THEN 'Cs' WHEN 2 THEN '' END",
    "first_cert_fp": "CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_custkey * 2 AS VARCHAR(20)) END",
    "sni_matches_cert": "CASE o_orderkey % 7 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END",
    "ja3": "md5(concat('j', o_custkey))",
    "ja3s": "CASE WHEN o_orderkey % 10 <> 0 THEN md5(concat('js', o_custkey % 17)) END",
}
X509 = {
    "ts": "p_partkey",
    "fingerprint": "CAST(p_partkey AS VARCHAR(20))",
    "certificate_key_type": "CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'rsa' ELSE 'ecdsa' END",
    "certificate_key_length": "p_size * 128 + copy",
    "certificate_subject": "p_brand",
    "certificate_issuer": "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'CA' END",
    "certificate_not_valid_before": "p_partkey * 1000.0e0",
    "certificate_not_valid_after": "p_partkey * 1000.0e0 + p_size * 86400.0e0",
    "basic_constraints_ca": "CASE p_size % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END",
    "host_cert": "CASE p_size % 5 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END",
}
#: View, its columns, and the SELECT's rest. Some rows of ssl and x509 come twice, with other values.
VIEWS = {
    "conn": (CONN, f"(SELECT *, {K} AS k FROM events)"),
    "http": (HTTP, "lineitem JOIN events ON l_orderkey = event_id WHERE l_linestatus = 'O'"),
    "dns": (DNS, "lineitem JOIN events ON l_orderkey = event_id WHERE l_linestatus = 'F'"),
    "ssl": (SSL, "(SELECT *, 0 AS copy FROM orders UNION ALL SELECT *, 1 AS copy FROM orders WHERE o_orderkey % 20 = 0) JOIN events ON o_orderkey = event_id WHERE o_orderstatus <> 'P'"),
    **{f"{name}_all": ({c: e for c, e in columns.items() if c != "class"}, rows) for name, columns, rows in (
        ("http", HTTP, "lineitem WHERE l_linestatus = 'O'"), ("dns", DNS, "lineitem WHERE l_linestatus = 'F'"),
        ("ssl", SSL, "(SELECT *, 0 AS copy FROM orders UNION ALL SELECT *, 1 AS copy FROM orders WHERE o_orderkey % 20 = 0) WHERE o_orderstatus <> 'P'"),
    )},  # all rows, with or without an event; so they have no class
    "x509": (X509, "(SELECT *, 0 AS copy FROM part UNION ALL SELECT *, 1 AS copy FROM part WHERE p_partkey % 25 = 0)"),
}


def select(view: str) -> str:
    columns, rest = VIEWS[view]
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {rest}"


def with_views(body: str, *views: str) -> str:
    """SQL whose body sees the views."""
    return "WITH " + ", ".join(f"{v} AS ({select(v)})" for v in views) + (", " if body.lstrip().startswith("-- with") else " ") + body.replace("-- with", "", 1)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the Parquet tables of a folder. Times are read as UTC."""
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders", "lineitem", "part") if t in VIEWS[name][1]}
    text = select(name)
    for t in sources:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t} ", f"JOIN {{{t}}} AS {t} ").replace(f" FROM {{{t}}} AS {t} JOIN", f" FROM {{{t}}} AS {t} JOIN")
    return spark.sql(text, **sources)


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conn view with event_time as an instant."""
    df = view(spark, sf_dir, "conn")
    return df.withColumn("event_time", df.ts.cast("timestamp"))
