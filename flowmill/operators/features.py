"""The 144 features of a flow as named expressions, one projection for all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_least, entropy, filled, flag, log_of, number, ordinal, other, true_flag, z
from ..schema import (
    CIPHERS, CONN_STATES, CURVES, DNS_FEATURES, HTTP_FEATURES, LOGGED, NEXT_PROTOCOLS, NUMERICS, PROTOS, PROXY_PORTS, SERVICES, SOURCE_FEATURES, SSL_VERSIONS, VPN_PORTS, WEB_PORTS, X509_FEATURES,
)

#: Flags of one letter of the connection history, upper and lower case apart, by names that differ in more than case.
HISTORY = {f"history_has_{case}_{c.lower()}": c for c in "SsFfRrDd" for case in ("upper" if c.isupper() else "lower",)}


def numerics() -> dict[str, Column]:
    return {c: number(F.col(c)) for c in NUMERICS}


def derived() -> dict[str, Column]:
    ob, rb, op, rp, oib, rib = (z(number(F.col(c))) for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes"))
    duration = at_least(number(F.col("duration")), 0.001)
    return {
        "total_bytes": ob + rb,
        "total_pkts": op + rp,
        "bytes_ratio": ob / (rb + 1),
        "pkts_ratio": op / (rp + 1),
        "avg_pkt_size_orig": ob / (op + 1),
        "avg_pkt_size_resp": rb / (rp + 1),
        "overhead_orig": (oib - ob) / (op + 1),
        "overhead_resp": (rib - rb) / (rp + 1),
        "is_bidirectional": flag((ob > 0) & (rb > 0)),
        "payload_asymmetry": F.abs(ob - rb) / (ob + rb + 1),
        "bytes_per_second": (ob + rb) / duration,
        "pkts_per_second": (op + rp) / duration,
    }


def logs() -> dict[str, Column]:
    values = numerics() | derived()
    return {f"{c}_log": log_of(values[c]) for c in LOGGED}


def ports() -> dict[str, Column]:
    port = number(F.col("id_resp_p"))
    return {
        "resp_port": port,
        "is_vpn_port": flag(port.isin(*VPN_PORTS)),
        "is_proxy_port": flag(port.isin(*PROXY_PORTS)),
        "is_web_port": flag(port.isin(*WEB_PORTS)),
        "is_ephemeral_port": flag(port > 32768),
        "is_registered_port": flag((port >= 1024) & (port <= 32768)),
        "is_well_known_port": flag(port < 1024),
    }


def one_hot(prefix: str, column: str, values: Sequence[str]) -> dict[str, Column]:
    return {f"{prefix}_{v}": flag(F.col(column) == v) for v in values}


def categories() -> dict[str, Column]:
    service = one_hot("service", "service", SERVICES) | {"service_other": other(F.col("service"), SERVICES)}
    return one_hot("proto", "proto", PROTOS) | service | one_hot("conn_state", "conn_state", CONN_STATES) | {c: true_flag(F.col(c)) for c in ("local_orig", "local_resp")}


def history() -> dict[str, Column]:
    text = F.coalesce("history", F.lit(""))
    return {"history_len": F.length(text)} | {name: flag(text.contains(c)) for name, c in HISTORY.items()} | {"history_entropy": entropy(text)}


def ssl() -> dict[str, Column]:
    c = F.col
    length = lambda name: F.length(F.coalesce(c(name), F.lit("")))
    return {
        "ssl_version": ordinal(c("ssl_version"), SSL_VERSIONS),
        **{f"ssl_cipher_{f}": flag(c("ssl_cipher").startswith(f)) for f in CIPHERS},
        **one_hot("ssl_curve", "ssl_curve", CURVES),
        "ssl_resumed": true_flag(c("ssl_resumed")),
        "ssl_established": true_flag(c("ssl_established")),
        "ssl_sni_match": true_flag(c("ssl_sni_matches_cert")),
        **{f"ssl_next_proto_{v.replace('/', '_').replace('.', '_')}": flag(c("ssl_next_protocol") == v) for v in NEXT_PROTOCOLS},
        "ssl_history_len": length("ssl_ssl_history"),
        "ssl_history_entropy": entropy(c("ssl_ssl_history")),
        "ssl_ja3_entropy": entropy(c("ssl_ja3")),
        "ssl_ja3s_entropy": entropy(c("ssl_ja3s")),
        "ssl_sni_len": length("ssl_server_name"),
        "ssl_sni_entropy": entropy(c("ssl_server_name")),
    }


def joined() -> dict[str, Column]:
    names = (*X509_FEATURES, "has_ssl", "has_dns", "has_http", *DNS_FEATURES, *HTTP_FEATURES, *SOURCE_FEATURES)
    return {c: F.col(c) for c in names}


FAMILIES = {"numerics": numerics, "derived": derived, "logs": logs, "ports": ports, "categories": categories, "history": history, "ssl": ssl, "joined": joined}


def feature_columns(families: Sequence[str] = tuple(FAMILIES)) -> dict[str, Column]:
    return {name: c for f in families for name, c in FAMILIES[f]().items()}


def feature_names() -> list[str]:
    """In the order in which models get them. Needs a Spark session, as expressions do."""
    return list(feature_columns())


def features(flows: DataFrame, keep: Sequence[str] = ("uid", "class"), families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """keep, then the families' features as doubles, missing ones as -1."""
    return flows.select(*keep, *(filled(c).alias(name) for name, c in feature_columns(families).items()))


def in_order(table: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep and the named features in that order; absent ones are -1."""
    return table.select(*(c for c in keep if c in table.columns), *((filled(F.col(n)) if n in table.columns else F.lit(-1.0)).alias(n) for n in names))


def labelled(table: DataFrame, label: str = "class", name: str = "label", drop: Sequence[str] = ("uid",)) -> DataFrame:
    """table as training takes it: the label under its name, and without the flow's key. A column that has the label's new name already gives way."""
    return table.drop(*drop, *([name] if name != label else [])).withColumnRenamed(label, name)
