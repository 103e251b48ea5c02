"""Sharding by a two-pass external shuffle: scatter to buckets of bounded size, then a Fisher-Yates shuffle in each."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, until_exit
from .common import lean, runs

#: More buckets than this are joined with their offsets by a shuffle.
MOST_BROADCAST = 100_000
OWN = ("size", "shard", "slot")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: position i, from the last to the second, swaps with a position drawn from 0 to i."""
    out = np.arange(n)
    drawn = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = drawn[i]
        out[i], out[j] = out[j], out[i]
    return out


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in a random order dealt to shards whose row counts differ by one at most.

    Pass 1 scatters rows to buckets of about bucket_bytes by a seeded hash of key and text; pass 2 sorts a bucket by that
    hash, so that a repeated task gives the same result, and shuffles it. A row's place in the whole order, bucket after
    bucket, modulo shards is its shard, and divided by shards its slot, gapless from 0. Adds size (UTF-8 bytes of the
    text plus 1; null: no bytes), shard and slot, in place of columns with these names. Null keys are dealt by their
    texts; equal rows meet in one bucket, where their order can't be told apart. An empty table gives an empty one.
    """
    kept = docs.drop(*OWN, "_bucket", "_hash", "_place", "_offset")
    size = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")
    total = kept.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    spot = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    scattered = kept.withColumn("_hash", spot).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    counts = scattered.groupBy("_bucket").count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket, not per document
    offsets = counts.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in runs(batches, ["_bucket"]):
            rng = np.random.default_rng([seed, bucket["_bucket"][0].as_py()])
            order = fisher_yates(bucket.num_rows, rng)
            place = pa.array(np.arange(bucket.num_rows, dtype=np.int64))
            for at in range(0, bucket.num_rows, 2000):
                part = bucket.take(pa.array(order[at : at + 2000])).append_column("_place", place.slice(at, 2000))
                yield from part.combine_chunks().to_batches()

    schema = T.StructType([*scattered.schema.fields, T.StructField("_place", T.LongType())])
    shuffled = scattered.repartition("_bucket").sortWithinPartitions("_bucket", "_hash", key).mapInArrow(lean(shuffle), schema)
    placed = shuffled.join(F.broadcast(offsets) if buckets <= MOST_BROADCAST else offsets, "_bucket")
    whole = F.col("_offset") + F.col("_place")
    return placed.select(*kept.columns, size.alias("size"), (whole % shards).cast("int").alias("shard"), F.floor(whole / shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """A folder per shard, whose files together hold its rows; returns the table read back. A row's slot is its place in the shard."""
    sharded.write.partitionBy("shard").parquet(path)
    spark = sharded.sparkSession
    return spark.read.schema(sharded.schema).parquet(path).select(sharded.columns)


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    written = write_shards(shard_rows(docs), path)
    until_exit(spark, path)
    return written.select(
        "doc_id", "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
