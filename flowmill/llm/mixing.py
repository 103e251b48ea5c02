"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: A table of sources with more rows than this is joined by a shuffle.
MOST_BROADCAST = 10_000
#: Rates above this are drawn as the sum of several draws, since exp(-rate) would vanish.
LARGEST_RATE = 100.0
OWN = ("n_bytes", "rate", "copies", "copy", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array: a uniform number's rank in it is the inverted Poisson distribution."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("cdf"), F.array(first).alias("steps"))

    def step(s: Column, k: Column) -> Column:
        p = s.p * rate / k
        return F.struct(p.alias("p"), (s.cdf + p).alias("cdf"), F.concat(s.steps, F.array(s.cdf + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s.steps)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, budget: float, source: str = "source", text: str = "text") -> DataFrame:
    """A row per source: its bytes, and the mean number of times that its documents repeat so that it gets its weight.

    budget is the size of the mix as a multiple of the input's bytes. Without weights a source weighs the square root of
    its bytes; with weights, sources without one get none. Sums are of decimals, so that they don't depend on their order.
    """
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).alias("bytes"))
    if weights is None:
        weight = F.sqrt("bytes")
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(given, F.col("_source")), F.lit(0.0))
    sizes = sizes.withColumn("weight", weight.cast("decimal(28,9)"))
    total = sizes.agg(F.sum("weight").cast("double").alias("all_weight"), F.sum("bytes").alias("all_bytes"))
    rates = sizes.crossJoin(F.broadcast(total))  # one row
    rate = F.lit(float(budget)) * F.col("all_bytes") * F.col("weight").cast("double") / F.when(F.col("all_weight") > 0, F.col("all_weight")) / F.col("bytes")
    return rates.select("_source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = 11, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs repeated so that each source has its weight in the bytes of the mix, in an order shuffled globally.

    A document's number of copies is drawn from a Poisson distribution with its source's rate as mean, by inverting it
    at a number that the digest of seed and key gives; so one source of any size needs no counting or sampling across
    tasks. Rows with equal keys get equal numbers; a null key stands for the digest of the text. A null source is a
    source of its own, a null text counts as empty (every document counts one byte more than its text). Adds n_bytes,
    rate, copies, copy (from 0) and shuffle_key, in place of columns of the input with these names (and without _source, _draws and _steps); documents that get no
    copy are absent, by design. An empty table gives an empty one. Partitions hold keys dealt by hash, each in the order
    of shuffle_key.
    """
    spark = docs.sparkSession
    rates = stored(source_rates(docs, weights, budget, source, text), "rates")
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_RATE), F.lit(1)).cast("int")
    rates = rates.withColumn("_draws", parts).withColumn("_steps", poisson_steps(F.col("rate") / F.col("_draws")))
    few = rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    kept = docs.drop(*OWN, "_source", "_draws", "_steps")
    identity = F.coalesce(F.col(key).cast("string"), F.md5(F.col(text)), F.lit(""))
    joined = kept.join(F.broadcast(rates) if few else rates, F.col(source).eqNullSafe(F.col("_source")), "inner")
    draw = lambda j: F.size(F.filter("_steps", lambda c: c <= uniform(F.lit(str(seed)), identity, j.cast("string"))))
    copies = F.aggregate(F.sequence(F.lit(1), F.col("_draws")), F.lit(0), lambda n, j: n + draw(j))
    drawn = joined.withColumn("copies", copies).filter("copies > 0")
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), identity, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    out = out.select(*kept.columns, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), "rate", "copies", "copy", place.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", key, "copy")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).withColumn("rate", F.round("rate", 9))


#: {docs} is a relation with the columns of documents.
MIX_SQL = """
WITH RECURSIVE docs AS (SELECT * FROM {docs}),
sizes AS (SELECT source, sum(strlen(coalesce(text, '')) + 1) AS bytes, CAST(sqrt(sum(strlen(coalesce(text, '')) + 1)) AS DECIMAL(28,9)) AS weight FROM docs GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(bytes) FROM sizes)::DOUBLE * weight::DOUBLE / (SELECT sum(weight)::DOUBLE FROM sizes) / bytes::DOUBLE AS rate FROM sizes),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
),
drawn AS (SELECT d.*, ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, md5(text), '') || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM docs d),
lists AS (SELECT source, any_value(rate) AS rate, list(cdf) AS cdfs FROM steps GROUP BY source),
counted AS (SELECT d.*, l.rate, CAST(len(list_filter(l.cdfs, lambda c: c <= d.u)) AS INTEGER) AS copies FROM drawn d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
copied AS (SELECT *, unnest(range(copies))::INTEGER AS copy FROM counted WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, round(rate, 9) AS rate, copies, copy,
  ('0x' || substr(md5('11/order:' || coalesce(doc_id::VARCHAR, md5(text), '') || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM copied
"""
OP6_SQL = MIX_SQL.format(docs="documents")
