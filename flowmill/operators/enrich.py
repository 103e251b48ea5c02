"""Flows with what the other logs say about them. Right sides are unique by key, so each flow stays one row."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DNS_FEATURES, HTTP_FEATURES, SSL_FIELDS, X509_FEATURES
from .reduce import FLOW, certificate_rows, dns_rows, http_rows, ssl_rows


def with_certificates(ssl: DataFrame, certificates: DataFrame | None) -> DataFrame:
    """Handshakes with their certificate's features; without a known certificate they are null. A null fingerprint matches none."""
    if certificates is None:
        return ssl.select("*", *(F.lit(None).cast("double").alias(c) for c in X509_FEATURES)).drop("first_cert_fp")
    return ssl.join(certificates, F.col("first_cert_fp") == F.col("fingerprint"), "left").drop("first_cert_fp", "fingerprint")


def attached(flows: DataFrame, reduced: DataFrame | None, columns: Sequence[str], flag: str, present: str, keys: Sequence[str], kinds: str = "double") -> DataFrame:
    """flows with the columns of their row in reduced, and flag: 1 if the column present is there. An absent log gives nulls and 0."""
    if reduced is None:
        return flows.select("*", *(F.lit(None).cast(kinds).alias(c) for c in columns), F.lit(0).alias(flag))
    return flows.join(reduced.select(*keys, *columns), list(keys), "left").withColumn(flag, F.col(present).isNotNull().cast("int"))


def enrich(conn: DataFrame, ssl: DataFrame | None = None, x509: DataFrame | None = None, http: DataFrame | None = None, dns: DataFrame | None = None, keys: Sequence[str] = FLOW) -> DataFrame:
    """conn with ssl, x509, http and dns columns and has_ssl, has_http and has_dns. All logs are reduced before they are joined, by the same keys, so conn is shuffled once."""
    handshakes = with_certificates(ssl_rows(ssl, keys), certificate_rows(x509) if x509 is not None else None) if ssl is not None else None
    ssl_columns = [f"ssl_{c}" for c in SSL_FIELDS]
    if handshakes is None:
        conn = conn.select("*", *(F.lit(None).cast("string").alias(c) for c in ssl_columns))
        conn = attached(conn, None, X509_FEATURES, "has_ssl", "ssl_version", keys)
    else:
        conn = attached(conn, handshakes, [*ssl_columns, *X509_FEATURES], "has_ssl", "ssl_version", keys)
    conn = attached(conn, http_rows(http, keys) if http is not None else None, HTTP_FEATURES, "has_http", "http_request_count", keys)
    return attached(conn, dns_rows(dns, keys) if dns is not None else None, DNS_FEATURES, "has_dns", "dns_query_count", keys)


def microseconds(interval: str) -> int:
    return round(pd.Timedelta(interval.lower()).total_seconds() * 1_000_000)


def within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, before: str, after: str, how: str = "left") -> DataFrame:
    """left with the rows of right that share the key and lie from before to after left's time. On streams with watermarks, unmatched rows come out once no match can follow.

    Both sides are dealt out by key and time: a bucket is as long as the interval, a left row is in the one of its time, and
    a right row in the one or two whose rows it can match. So a key with many rows is many small groups. Rows with a null
    key or time match nothing.
    """
    low, high = F.col(left_time) - F.expr(f"INTERVAL {before}"), F.col(left_time) + F.expr(f"INTERVAL {after}")
    reach = (microseconds(after), microseconds(before))
    length = max(sum(reach), 1_000_000)
    bucket = lambda time, shift=0: F.floor((F.unix_micros(F.col(time).cast("timestamp")) + shift) / length)
    touched = F.explode(F.sequence(bucket(right_time, -reach[0]), bucket(right_time, reach[1])))
    other = right.withColumnRenamed(key, "_key").withColumn("_in", touched)
    near = (F.col("_bucket") == F.col("_in")) & (F.col(key) == F.col("_key"))
    return left.withColumn("_bucket", bucket(left_time)).join(other, near & (F.col(right_time) >= low) & (F.col(right_time) <= high), how).drop("_key", "_bucket", "_in")
