"""The batch jobs: flows from log files in class folders, and detections of a saved model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import number
from ..operators import models
from ..operators.concurrency import with_source_stats
from ..operators.enrich import enrich
from ..operators.evaluate import detection_summary, status
from ..operators.features import features, in_order
from ..schema import CLASSES
from ..sources.logs import read_all_logs


def read_flows(spark: SparkSession, root: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """All flows of the class folders, with source statistics and what the other logs say of them; logs that no class has give nulls."""
    logs = read_all_logs(spark, root, classes)
    timed = {log: df.withColumn("ts", number(F.col("ts"))) if "ts" in df.columns else df for log, df in logs.items()}  # texts till here
    return enrich(with_source_stats(timed["conn"]), **{log: timed.get(log) for log in ("ssl", "x509", "http", "dns")})


def score_logs(spark: SparkSession, root: str, model_path: str, classes: Sequence[str] = CLASSES) -> tuple[DataFrame, DataFrame]:
    """Detections of the folders' flows by a saved model, with their status, and their summary."""
    model, names, _ = models.load(model_path, spark)
    rows = in_order(features(read_flows(spark, root, classes)), names, ("uid", "class"))
    detections = status(models.score(rows, model)).drop(*names)
    return detections, detection_summary(detections)
