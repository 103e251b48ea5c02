"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, with probes and checked candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mark, release, runs, stored
from .components import connected_components, joining_links

#: Vectors that are compared with as many others at once; a larger bucket or component is dealt out as pairs of blocks.
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, of a power of two entries, kept at the same length."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and the Hadamard transform: nearly a uniform rotation in d log d steps."""
    for s in signs:
        x = hadamard(x * s)
    return x


def bucket_keys(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """For each unit row, the keys of its own bucket in each table and of the probes next likeliest ones.

    A hash is the nearest of the 2d signed axes after a rotation. A probe replaces one hash by the second nearest axis,
    those first whose two nearest differ least.
    """
    d = 1 << max(1, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng, rows, out = np.random.default_rng(seed), np.arange(len(x)), []
    for t in range(tables):
        best, second, loss = [], [], []
        for _ in range(hashes):
            y = rotated(x, rng.choice([-1.0, 1.0], (3, d)))
            size = np.abs(y)
            first = size.argmax(1)
            top = size[rows, first]
            size[rows, first] = -1
            other = size.argmax(1)
            for found, axis in ((best, first), (second, other)):
                found.append(axis * 2 + (y[rows, axis] < 0))
            loss.append(top - size[rows, other])
        key = lambda axes: sum(a * (2 * d) ** i for i, a in enumerate(axes)) * tables + t
        out.append(key(best))
        order = np.argsort(np.stack(loss, 1), 1)
        for p in range(min(probes, hashes)):
            out.append(key([np.where(order[:, p] == i, second[i], best[i]) for i in range(hashes)]))
    return np.stack(out, 1).astype(np.int64)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of a list column, in double precision; scaled by their largest component first, so that no square overflows or vanishes."""
    x = np.stack(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_pairs(rows: DataFrame, key: str, id: str, size: int = BLOCK) -> DataFrame:
    """rows with side (0 or 1), i and j: every two rows of a key meet in a group (key, i, j), in blocks of about size rows.

    A key of up to size rows is one group. Blocks come from a hash of the id, and each row goes to as many groups as its
    key has blocks, so that one large key is dealt to many tasks.
    """
    counts = rows.groupBy(key).count().filter("count > 1").select(key, F.ceil(F.col("count") / size).cast("int").alias("_blocks"))
    dealt = rows.join(counts, key).withColumn("_own", F.pmod(F.xxhash64(id), "_blocks").cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(*rows.columns, F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).cast("int").alias("side"))


def near_duplicates(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, tables: int = 8, hashes: int = 2, probes: int = 2, seed: int = 5) -> DataFrame:
    """id, n_links, component_id and kept for every row of vectors.

    Vectors that are null, empty, zero, or hold null or non-finite entries have no links. Equal vectors form a class with
    a number of its own, of which one is hashed; its copies count as links of each other. Buckets are dealt out as numbers
    of classes, and vectors join only those of buckets with several classes. Two classes meet if they share a bucket, their own or a
    probe; buckets are compared in blocks and give only links that join what was apart within the block. n_links then
    comes from comparing all members of a component, in blocks too, so that it lacks only links between components, of
    which the hashing saw no pair. All comparisons are of double-precision cosines of the whole vectors. Vectors of
    different length are never compared. A null id is an id of its own; rows with equal ids and vectors count as copies.
    Other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).alias("id"), F.col(embedding).alias("vector"))
    before = mark()
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    usable = F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    classes = rows.filter(usable).groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # what is written stays so

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(batch.column("vector").value_lengths())
            for d in np.unique(lengths):
                for at in np.array_split(own := np.flatnonzero(lengths == d), -(-len(own) // 2000)):
                    part = batch.take(pa.array(at))
                    keys = bucket_keys(matrix(part.column("vector")), tables, hashes, probes, seed) * 4096 + d % 4096
                    yield pa.RecordBatch.from_pydict({"class": np.repeat(part.column("class").to_numpy(), keys.shape[1]), "bucket": keys.ravel()})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket", "i", "j"]):
            x, ids, side = matrix(group["vector"]), group["class"].to_numpy(), group["side"].to_numpy()
            alone = group["i"][0] == group["j"][0]
            rest = np.arange(len(x))
            a, b = (rest, rest) if alone else (rest[side == 0], rest[side == 1])
            linked = x[a] @ x[b].T >= least
            ends = joining_links(linked, ids[a], ids[b])
            if len(ends[0]):
                yield pa.RecordBatch.from_pydict({"a": ends[0], "b": ends[1]})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["root", "i", "j"]):
            x, ids, side, copies = matrix(group["vector"]), group["class"].to_numpy(), group["side"].to_numpy(), group["copies"].to_numpy()
            rest = np.arange(len(x))
            if group["i"][0] == group["j"][0]:
                linked = x @ x.T >= least
                np.fill_diagonal(linked, False)
                yield pa.RecordBatch.from_pydict({"class": ids, "n": linked @ copies})
            else:
                a, b = rest[side == 0], rest[side == 1]
                linked = x[a] @ x[b].T >= least
                yield pa.RecordBatch.from_pydict({"class": np.concatenate([ids[a], ids[b]]), "n": np.concatenate([linked @ copies[b], linked.T @ copies[a]])})

    entries = stored(classes.select("class", "vector").mapInArrow(lean(hashed), "class long, bucket long").distinct(), "entries")
    groups = block_pairs(entries, "bucket", "class").join(classes.select("class", "vector"), "class")
    ordered = groups.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    roots = connected_components(ordered.mapInArrow(lean(joined), "a long, b long"))
    release(before, classes, roots)
    roots = roots.select(F.col("node").alias("class"), "root")
    members = block_pairs(classes.join(roots, "class").select("class", "vector", "copies", "root"), "root", "class")
    ordered = members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = ordered.mapInArrow(lean(counted), "class long, n long").groupBy("class").agg(F.sum("n").alias("n"))
    smallest = classes.join(roots, "class").groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = classes.join(links, "class", "left").join(roots, "class", "left").join(smallest, "root", "left").select("vector", "rep", "copies", "n", "component_id")
    found = rows.filter(usable).join(stored(of_class, "of-class"), "vector").drop("vector")  # stored, so that Spark can split a vector of many rows
    nothing = [F.lit(None).cast("long").alias(c) for c in ("rep", "copies", "n", "component_id")]
    found = found.unionByName(rows.filter(~usable).select("id", *nothing))
    component = F.coalesce("component_id", "rep", "id")
    return found.select(
        F.col("id").alias(id),
        (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def op5_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
