"""Registered queries over logs that are written as CSV folders per class and read back as texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import features
from ..schema import CLASSES
from ..sources.logs import read_all_logs, read_class_folders, write_class_folders
from .batch import read_flows
from .queries import ALL_VIEWS, ENRICHED_SQL, features_sql, registered, rounded
from .stream_queries import shared_path
from .views import view, with_views

#: Of each log, a column that has nulls.
FILLED = {"conn": "service", "dns": "rtt", "http": "user_agent"}
CONN_FAMILIES = ("numerics", "derived", "logs", "ports", "categories", "history")


def class_folders(spark: SparkSession, sf_dir: str, logs: Sequence[str]) -> str:
    root = shared_path(spark, "folders")
    for log in logs:
        write_class_folders(view(spark, sf_dir, log), root, CLASSES, log)
    return root


@registered(with_views(" UNION ALL ".join(f"SELECT '{log}' AS log, class, count(*) AS n, count({c}) AS filled FROM {log} GROUP BY class" for log, c in FILLED.items()), *FILLED))
def combined_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log that the class folders hold, combined and counted, null tokens as nulls."""
    found = read_all_logs(spark, class_folders(spark, sf_dir, tuple(FILLED)), CLASSES)
    counts = [df.groupBy("class").agg(F.lit(log).alias("log"), F.count(F.lit(1)).alias("n"), F.count(FILLED[log]).alias("filled")) for log, df in found.items()]
    return reduce(DataFrame.unionByName, counts)


@registered(with_views(features_sql(CONN_FAMILIES, "conn"), "conn"))
def features_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of flows whose columns are all texts, as log files have them."""
    flows = read_class_folders(spark, class_folders(spark, sf_dir, ("conn",)), CLASSES, "conn")
    return rounded(features(flows, families=CONN_FAMILIES))


@registered(with_views(f"{ENRICHED_SQL} SELECT uid, class, has_http, has_dns, http_request_count, dns_query_count, unique_dest_count FROM joined", *ALL_VIEWS))
def flows_of_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of the class folders as the scoring job reads them; no class has ssl or x509."""
    flows = read_flows(spark, class_folders(spark, sf_dir, ("conn", "http", "dns")))
    return flows.select("uid", "class", "has_http", "has_dns", "http_request_count", "dns_query_count", "unique_dest_count")
