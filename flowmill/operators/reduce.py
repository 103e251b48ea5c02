"""Each log reduced to one row per key: first rows, and aggregates per flow and per certificate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import first_of, flag, has_items, number
from ..schema import METHODS, QTYPES, SSL_FIELDS

FLOW = ("uid", "class")


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all there: null keys form no group."""
    return df.dropna(subset=list(keys))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by order, then by all other columns that can be ordered, so that no tie is left to chance; nulls are first.

    An aggregate, so that each task keeps a row per key before the shuffle, however many rows a key has.
    """
    others = [f for f in df.schema.fields if f.name not in keys]
    ranked = F.struct(*order, *(f.name for f in others if not isinstance(f.dataType, T.MapType)))
    first = F.min_by(F.struct(*(f.name for f in others)), ranked).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def is_array(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def first_certificate(ssl: DataFrame) -> Column:
    """The fingerprint of a handshake's own certificate; null if the log has no chain."""
    if "first_cert_fp" in ssl.columns:
        return F.col("first_cert_fp").cast("string")
    return first_of(F.col("cert_chain_fps"), is_array(ssl, "cert_chain_fps")) if "cert_chain_fps" in ssl.columns else F.lit(None).cast("string")


def ssl_rows(ssl: DataFrame, keys: Sequence[str] = FLOW, order: str = "ts") -> DataFrame:
    """The first handshake of each flow: keys, first_cert_fp, and what the features need, prefixed; absent columns are null."""
    fields = [(F.col(c) if c in ssl.columns else F.lit(None).cast("string")).alias(f"ssl_{c}") for c in SSL_FIELDS]
    rows = keyed(ssl, keys).select(*keys, F.col(order).alias("_order"), first_certificate(ssl).alias("first_cert_fp"), *fields)
    return first_rows(rows, keys, ["_order"]).drop("_order")


def certificate_columns(x509: DataFrame, order: str = "ts") -> DataFrame:
    """fingerprint, _order and the features of each row. Rows without a fingerprint match no handshake and go."""
    c = F.col
    same = c("certificate_subject") == c("certificate_issuer")
    days = (number(c("certificate_not_valid_after")) - number(c("certificate_not_valid_before"))) / 86400
    return keyed(x509, ["fingerprint"]).select(
        c("fingerprint").cast("string").alias("fingerprint"), c(order).alias("_order"),
        number(c("certificate_key_length")).alias("x509_key_length"),
        flag(c("certificate_key_type") == "rsa").alias("x509_is_rsa"),
        flag(c("certificate_key_type") == "ecdsa").alias("x509_is_ecdsa"),
        flag(same).alias("x509_is_self_signed"),
        flag(c("basic_constraints_ca") == "T").alias("x509_is_ca"),
        flag(c("host_cert") == "T").alias("x509_is_host_cert"),
        days.alias("x509_validity_days"),
    )


def certificate_rows(x509: DataFrame, order: str = "ts") -> DataFrame:
    """Features of the first row of each fingerprint."""
    return first_rows(certificate_columns(x509, order), ["fingerprint"], ["_order"]).drop("_order")


def of_log(log: str | None) -> tuple[Callable[[str], Column], Callable[[Column], Column]]:
    """How aggregates read a log: its columns, or the fields of a struct of that name, rows whose struct is null not being counted."""
    if log is None:
        return F.col, lambda x: x
    return lambda name: F.col(f"{log}.{name}"), lambda x: F.when(F.col(log).isNotNull(), x)


def http_aggregates(log: str | None = None) -> list[Column]:
    c, own = of_log(log)
    request, response, status = number(c("request_body_len")), number(c("response_body_len")), number(c("status_code"))
    share = lambda low, high: F.avg(own(F.when((status >= low) & (status < high if high else F.lit(True)), 1.0).otherwise(0.0)))
    return [
        F.count(request).alias("http_request_count"),
        F.avg(request).alias("http_avg_req_body_len"),
        F.coalesce(F.sum(request), F.lit(0.0)).alias("http_total_req_body_len"),
        F.avg(response).alias("http_avg_resp_body_len"),
        F.coalesce(F.sum(response), F.lit(0.0)).alias("http_total_resp_body_len"),
        *(share(low, high).alias(f"http_status_{low // 100}xx_ratio") for low, high in ((200, 300), (300, 400), (400, 500), (500, None))),
        F.avg(own(F.coalesce(F.length(c("user_agent")), F.lit(0)))).alias("http_avg_ua_len"),
        *(F.sum(own(flag(c("method") == m))).alias(f"http_method_{m}") for m in METHODS),
    ]


def http_rows(http: DataFrame, keys: Sequence[str] = FLOW) -> DataFrame:
    """HTTP features of each flow, in one aggregate: with one distinct count Spark groups by host first and expands no rows."""
    return keyed(http, keys).groupBy(*keys).agg(*http_aggregates(), F.countDistinct("host").alias("http_unique_hosts"))


def dns_aggregates(answers: Column, ttl: Column, log: str | None = None) -> list[Column]:
    c, own = of_log(log)
    rtt = number(c("rtt"))
    return [
        F.count(rtt).alias("dns_query_count"),
        F.avg(rtt).alias("dns_rtt_mean"),
        F.stddev_samp(rtt).alias("dns_rtt_std"),
        F.avg(own(F.when(c("rcode_name") == "NXDOMAIN", 1.0).otherwise(0.0))).alias("dns_nxdomain_ratio"),
        F.max(own(flag(c("rejected").isin("T", "true")))).alias("dns_rejected"),
        F.avg(own(F.when(answers, 1.0).otherwise(0.0))).alias("dns_has_answer"),
        F.avg(number(ttl)).alias("dns_avg_ttl"),
        *(F.sum(own(flag(c("qtype_name") == q))).alias(f"dns_qtype_{q}") for q in QTYPES),
    ]


def dns_rows(dns: DataFrame, keys: Sequence[str] = FLOW) -> DataFrame:
    """DNS features of each flow; lists may be arrays or texts with commas."""
    has = has_items(F.col("answers"), is_array(dns, "answers")) if "answers" in dns.columns else F.lit(False)
    ttl = first_of(F.col("TTLs"), is_array(dns, "TTLs")) if "TTLs" in dns.columns else F.lit(None).cast("double")
    return keyed(dns, keys).groupBy(*keys).agg(*dns_aggregates(has, ttl), F.countDistinct("query").alias("dns_unique_queries"))
