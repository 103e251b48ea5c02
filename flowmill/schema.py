"""Column names, types and fixed value lists of connection logs and of the features made from them."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of each log, in the order of the log files. Names have underscores for dots.
KEY = "ts double, uid string, id_orig_h string, id_orig_p long, id_resp_h string, id_resp_p long"
CONN = f"{KEY}, proto string, service string, duration double, orig_bytes long, resp_bytes long, conn_state string, local_orig string, local_resp string, missed_bytes long, history string, orig_pkts long, orig_ip_bytes long, resp_pkts long, resp_ip_bytes long, ip_proto long, tunnel_parents string, orig_l2_addr string, resp_l2_addr string"
SSL = f"{KEY}, version string, cipher string, curve string, server_name string, resumed string, last_alert string, next_protocol string, established string, ssl_history string, cert_chain_fps array<string>, client_cert_chain_fps array<string>, subject string, issuer string, sni_matches_cert string, validation_status string, ja3 string, ja3s string, orig_l2_addr string, resp_l2_addr string"
X509 = "ts double, fingerprint string, certificate_version long, certificate_serial string, certificate_subject string, certificate_issuer string, certificate_not_valid_before double, certificate_not_valid_after double, certificate_key_alg string, certificate_sig_alg string, certificate_key_type string, certificate_key_length long, certificate_exponent string, certificate_curve string, san_dns array<string>, san_uri array<string>, san_email array<string>, san_ip array<string>, basic_constraints_ca string, basic_constraints_path_len long, host_cert string"
HTTP = f"{KEY}, trans_depth long, method string, host string, uri string, referrer string, version string, user_agent string, origin string, request_body_len long, response_body_len long, status_code long, status_msg string, info_code long, info_msg string, tags array<string>, proxied string, orig_fuids array<string>, orig_filenames array<string>, orig_mime_types array<string>, resp_fuids array<string>, resp_filenames array<string>, resp_mime_types array<string>, orig_l2_addr string, resp_l2_addr string"
DNS = f"{KEY}, proto string, trans_id long, rtt double, query string, qclass long, qclass_name string, qtype long, qtype_name string, rcode long, rcode_name string, AA string, TC string, RD string, RA string, Z long, answers array<string>, TTLs array<double>, rejected string, orig_l2_addr string, resp_l2_addr string"
LOGS = {"conn": CONN, "ssl": SSL, "x509": X509, "http": HTTP, "dns": DNS}
DETECTION = "uid string, ts timestamp, orig_h string, resp_h string, label string, confidence double, is_confident boolean"

#: Prefixes whose dot the log files write and the library replaces.
DOTTED = ("id", "certificate", "san", "basic_constraints")

# Tokens of empty fields in log files.
NULL_TOKENS = ("-", "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Categories and ports.
CLASSES = ("normal", "vpn", "proxy", "bittorrent")
NUMERICS = ("duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes", "ip_proto")
LOGGED = ("duration", "orig_bytes", "resp_bytes", "total_bytes", "orig_ip_bytes", "resp_ip_bytes", "orig_pkts", "resp_pkts")
PROTOS = ("tcp", "udp", "icmp")
SERVICES = ("dns", "http", "ssl", "dhcp", "ntp", "ssh", "irc", "ftp", "smtp")
CONN_STATES = ("S0", "S1", "S2", "S3", "SF", "REJ", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR", "OTH")
SSL_VERSIONS = ("SSLv2", "SSLv3", "TLSv10", "TLSv11", "TLSv12", "TLSv13")
CIPHERS = ("TLS_AES", "TLS_CHACHA20", "TLS_ECDHE_RSA", "TLS_ECDHE_ECDSA", "TLS_RSA", "TLS_DHE")
CURVES = ("x25519", "secp256r1", "secp384r1", "secp521r1")
NEXT_PROTOCOLS = ("h2", "http/1.1", "h3")
QTYPES = ("A", "AAAA", "PTR", "CNAME", "MX", "TXT", "SRV")
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "CONNECT")
VPN_PORTS = (500, 1194, 1701, 1723, 4096, 4500, 8194, 51820)
PROXY_PORTS = (1080, 3128, 8080, 8888, 9050, 9150)
WEB_PORTS = (80, 443, 8443)
LEAKING_CONN = ("ts", "uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "tunnel_parents", "orig_l2_addr", "resp_l2_addr")
LEAKING_SSL = ("ts", "uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "last_alert", "cert_chain_fps", "client_cert_chain_fps", "subject", "issuer", "validation_status", "orig_l2_addr", "resp_l2_addr")
LEAKING_DNS = ("ts", "uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "proto", "trans_id", "query", "qclass", "qclass_name", "answers", "TTLs", "orig_l2_addr", "resp_l2_addr")
LEAKING = {"conn": LEAKING_CONN, "ssl": LEAKING_SSL, "dns": LEAKING_DNS}

HTTP_FEATURES = (
    "http_request_count", "http_avg_req_body_len", "http_total_req_body_len", "http_avg_resp_body_len", "http_total_resp_body_len",
    "http_status_2xx_ratio", "http_status_3xx_ratio", "http_status_4xx_ratio", "http_status_5xx_ratio", "http_avg_ua_len", "http_unique_hosts",
    *(f"http_method_{m}" for m in METHODS),
)
DNS_FEATURES = ("dns_query_count", "dns_rtt_mean", "dns_rtt_std", "dns_nxdomain_ratio", "dns_rejected", "dns_has_answer", "dns_avg_ttl", "dns_unique_queries", *(f"dns_qtype_{q}" for q in QTYPES))
X509_FEATURES = ("x509_key_length", "x509_is_rsa", "x509_is_ecdsa", "x509_is_self_signed", "x509_is_ca", "x509_is_host_cert", "x509_validity_days")
SOURCE_FEATURES = ("src_flow_count", "unique_dest_count", "unique_dest_port_count", "dest_port_entropy")
#: Of the ssl log, what reaches the features, with its prefix.
SSL_FIELDS = ("version", "cipher", "curve", "resumed", "established", "sni_matches_cert", "next_protocol", "ssl_history", "ja3", "ja3s", "server_name")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
