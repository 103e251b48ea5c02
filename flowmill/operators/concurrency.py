"""What a source does at the same time: statistics over the whole table, and over sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SOURCE_FEATURES

SOURCE = "id_orig_h"


def entropy_of_counts(c: Column, total: Column) -> Column:
    """Entropy in bits of a histogram, from its counts, as an aggregate."""
    return F.when(F.sum(total) > 0, F.log2(F.sum(total)) - F.sum(F.when(total > 0, c * F.log2(c))) / F.sum(total))


def source_stats(conn: DataFrame) -> DataFrame:
    """Per source: flows, distinct destinations, distinct ports, and the entropy of its ports; null ports count as flows only.

    Two aggregates of (source, port) and (source, destination) counts: partial sums shrink the rows before each shuffle,
    and no task holds a source's flows.
    """
    flows = conn.dropna(subset=[SOURCE])
    ports = flows.groupBy(SOURCE, "id_resp_p").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("id_resp_p").isNotNull(), F.col("n")).otherwise(0)
    by_port = ports.groupBy(SOURCE).agg(F.sum("n").alias("src_flow_count"), F.count("id_resp_p").alias("unique_dest_port_count"), entropy_of_counts(F.col("n"), known).alias("dest_port_entropy"))
    targets = flows.groupBy(SOURCE, "id_resp_h").agg(F.lit(1).alias("one")).groupBy(SOURCE).agg(F.count("id_resp_h").alias("unique_dest_count"))
    return by_port.join(targets, SOURCE).select(SOURCE, *SOURCE_FEATURES)


#: The sources with the most flows, which are joined apart: another one has less than this part of the flows.
HEAVY = 1000


def with_source_stats(conn: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """conn with its source's statistics; nulls for a null source. They are counted over of, by default over conn.

    The statistics of the HEAVY sources with the most flows, a bounded table, are broadcast; flows of these and of no source
    are dealt out evenly in the join with the others, where they match nothing. So no task gets the flows of a large source.
    """
    stats = source_stats(conn if of is None else of)
    first = stats.orderBy(F.desc("src_flow_count"), SOURCE).limit(HEAVY)
    heavy = first.select(F.col(SOURCE).alias("_heavy"), *(F.col(c).alias(f"_{c}") for c in SOURCE_FEATURES))
    spread = F.xxhash64(*(c for c in ("uid", "id_resp_h", "id_resp_p") if c in conn.columns))
    apart = F.concat(F.lit("\0"), F.pmod(spread, F.lit(1 << 16)).cast("string"))  # no name of a source
    flows = conn.join(F.broadcast(heavy), F.col(SOURCE) == F.col("_heavy"), "left")  # at most HEAVY rows
    flows = flows.withColumn("_source", F.when(F.col("_heavy").isNull() & F.col(SOURCE).isNotNull(), F.col(SOURCE).cast("string")).otherwise(apart))
    others = stats.withColumnRenamed(SOURCE, "_name").withColumn("_name", F.col("_name").cast("string"))
    joined = flows.join(others, F.col("_source") == F.col("_name"), "left")
    return joined.select(*conn.columns, *(F.coalesce(f"_{c}", c).alias(c) for c in SOURCE_FEATURES))


def panes(conn: DataFrame, slide: str, time: str = "event_time") -> DataFrame:
    """Flow counts per source, destination, port and tumbling pane of the slide's length."""
    pane = F.window(time, slide)
    return conn.dropna(subset=[SOURCE]).groupBy(SOURCE, "id_resp_h", "id_resp_p", pane.alias("pane")).agg(F.count("uid").alias("n"))


def window_stats(conn: DataFrame, length_minutes: int = 10, slide_minutes: int = 5, time: str = "event_time") -> DataFrame:
    """Per source and sliding window: flows, distinct destinations and ports, and port entropy.

    Flows are first counted per pane; a pane goes into each of the windows that cover it. So it is counts that are
    repeated, not flows.
    """
    covers = length_minutes // slide_minutes
    step = lambda k: F.col("pane.start") - F.expr(f"INTERVAL {slide_minutes} MINUTES") * k
    starts = F.array(*(step(k) for k in range(covers)))
    rows = panes(conn, f"{slide_minutes} minutes", time).select(SOURCE, "id_resp_h", "id_resp_p", "n", F.explode(starts).alias("window_start"))
    key = [SOURCE, "window_start"]
    ports = rows.groupBy(*key, "id_resp_p").agg(F.sum("n").alias("n"))
    known = F.when(F.col("id_resp_p").isNotNull(), F.col("n")).otherwise(0)
    by_port = ports.groupBy(*key).agg(F.sum("n").alias("src_flow_count"), F.count("id_resp_p").alias("unique_dest_port_count"), entropy_of_counts(F.col("n"), known).alias("dest_port_entropy"))
    targets = rows.groupBy(*key, "id_resp_h").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("id_resp_h").alias("unique_dest_count"))
    return by_port.join(targets, key).select(*key, *SOURCE_FEATURES)


def window_sketches(conn: DataFrame, length_minutes: int = 10, slide_minutes: int = 5, time: str = "event_time", log_size: int = 12) -> DataFrame:
    """As window_stats without the entropy, with distinct destinations and ports estimated by sketches of fixed size.

    A source and pane is one row whatever it scans: its sketches are merged into those of the windows that hold the pane.
    The standard error is about 1.04 / sqrt(2 ** log_size) of a count, and small counts are exact.
    """
    covers = length_minutes // slide_minutes
    pane = F.window(time, f"{slide_minutes} minutes").start
    sketched = lambda c, name: F.hll_sketch_agg(F.col(c).cast("string"), log_size).alias(name)
    cells = conn.dropna(subset=[SOURCE]).groupBy(SOURCE, pane.alias("pane")).agg(F.count("uid").alias("n"), sketched("id_resp_h", "hosts"), sketched("id_resp_p", "ports"))
    starts = F.array(*(F.col("pane") - F.expr(f"INTERVAL {slide_minutes * k} MINUTES") for k in range(covers)))
    rows = cells.select(SOURCE, F.explode(starts).alias("window_start"), "n", "hosts", "ports")
    merged = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).cast("long")
    return rows.groupBy(SOURCE, "window_start").agg(F.sum("n").alias("src_flow_count"), merged("hosts").alias("unique_dest_count"), merged("ports").alias("unique_dest_port_count"))


def flow_windows(conn: DataFrame, length_minutes: int = 10, slide_minutes: int = 5, time: str = "event_time") -> DataFrame:
    """conn with the statistics of the latest window that holds the flow: the one that begins with the flow's own pane."""
    stats = window_stats(conn, length_minutes, slide_minutes, time)
    return conn.withColumn("window_start", F.window(time, f"{slide_minutes} minutes").start).join(stats, [SOURCE, "window_start"], "left")
