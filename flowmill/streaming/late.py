"""Rows that come after the watermark: counted where a query drops them, and kept aside."""

from __future__ import annotations

import json
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..session import place_of


class DroppedRows(StreamingQueryListener):
    """How many rows the stateful operators of each named query have dropped as too late, from its progress reports.

    An operator drops rows behind the watermark of the batch before, so it may still take some that keep_late puts aside.

    A report is counted once: a batch that reports again replaces what it said. A query without a name goes by its id.
    """

    def __init__(self) -> None:
        self.batches: dict[str, dict[int, int]] = defaultdict(dict)

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        report = event.progress
        self.batches[report.name or str(report.id)][report.batchId] = sum(op.numRowsDroppedByWatermark for op in report.stateOperators)

    def dropped(self, name: str) -> int:
        return sum(self.batches[name].values())


def dropped_by(query: StreamingQuery) -> int:
    """The same from a query's own recent reports (spark.sql.streaming.numRecentProgressUpdates of them), without a listener."""
    return sum({p["batchId"]: sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]) for p in query.recentProgress}.values())


def _marks(spark: SparkSession, path: str) -> dict[int, int]:
    store, place = place_of(spark, f"{path}/marks")
    out = {}
    for s in store.listStatus(place) if store.exists(place) else []:
        if s.getPath().getName().isdigit():
            stream = store.open(s.getPath())
            out[int(s.getPath().getName())] = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()
    return out


def keep_late(stream: DataFrame, path: str, checkpoint: str, delay: str, time: str = "event_time", trigger: dict | None = None) -> StreamingQuery:
    """Rows of a stream whose time the watermark had passed when their batch began, in path/rows: the latest time of all batches before, less the delay.

    A batch that is replayed replaces its rows, and sees the same watermark: path/marks has the latest time after each
    batch. Rows without a time are neither late nor early, and an empty batch changes nothing.
    """
    length = round(pd.Timedelta(delay).total_seconds() * 1_000_000)

    def aside(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = _marks(spark, path)
        before = max((m for n, m in marks.items() if n < number), default=None)
        micros = F.unix_micros(time)
        if before is not None:
            batch.filter(micros <= before - length).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        latest = batch.agg(F.max(micros)).first()[0]
        top = max(x for x in (before, latest) if x is not None) if before is not None or latest is not None else None
        if top is not None:
            store, place = place_of(spark, f"{path}/marks/{number}")
            out = store.create(place, True)
            out.write(json.dumps(top).encode())
            out.close()
            for n in sorted(marks)[:-2]:  # the last are enough for a replay
                if n < number:
                    store.delete(place_of(spark, f"{path}/marks/{n}")[1], False)

    return stream.writeStream.foreachBatch(aside).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_late(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows that keep_late has put aside so far, with the columns of the stream."""
    store, place = place_of(spark, f"{path}/rows")
    return spark.read.schema(like.schema).parquet(f"{path}/rows").select(like.columns) if store.exists(place) else spark.createDataFrame([], like.schema)
