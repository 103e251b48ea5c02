"""Quality classification by regularised quadratic discriminants over statistics of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_of_id, lean, slices, stored, utf8_block

#: Bytes of text that a task measures at once.
BLOCK = 1 << 20
NAMES = ("bytes", "upper", "digits", "symbols", "stops", "bars", "word_bytes", "line_bytes", "other_scripts", "distinct_words", "repeated_lines", "marked_words")
OWN = ("score", "predicted")


def _kinds() -> np.ndarray:
    """Of each byte: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 usual marks, 6 bar, 7 part of a longer code, 8 line end."""
    kind = np.zeros(256, np.uint8)
    for k, chars in ((1, "abcdefghijklmnopqrstuvwxyz"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, "0123456789"), (4, " \t\r\v\f"), (5, ".,;:'\"()-?"), (6, "|"), (8, "\n")):
        kind[list(chars.encode())] = k
    kind[128:] = 7
    return kind


KIND = _kinds()


def statistics(texts: list[str], column: pa.Array) -> np.ndarray:
    """A row of transformed statistics per text: logs of sizes, square roots of shares."""
    data, at = utf8_block(column)
    kind = KIND[data]
    sums = np.stack([np.diff(np.concatenate([[0], np.cumsum(kind == k)])[at]) for k in range(9)]).astype(np.float64)
    other, lower, upper, digit, space, marks, bar, wide, line = sums
    size = np.maximum(np.diff(at), 1)
    blank = (kind == 4) | (kind == 8)
    ends = np.zeros(len(kind), bool)  # a symbol or bar before white space or the end
    if len(kind):
        ends[:-1] = ((kind[:-1] == 0) | (kind[:-1] == 6)) & blank[1:]
        ends[-1] = kind[-1] in (0, 6)
        last = at[1:][np.diff(at) > 0] - 1
        ends[last] = (kind[last] == 0) | (kind[last] == 6)
    marked = np.diff(np.concatenate([[0], np.cumsum(ends)])[at])
    words, kinds_of_words, repeated = np.ones(len(texts)), np.ones(len(texts)), np.zeros(len(texts))
    for i, t in enumerate(texts):
        w = t.split()
        if w:
            words[i], kinds_of_words[i] = len(w), len(set(w))
        lines = t.split("\n")
        repeated[i] = 1 - len(set(lines)) / len(lines)
    letters = np.maximum(lower + upper + wide, 1)
    return np.stack([
        np.log1p(size), np.sqrt(upper / letters), np.sqrt(digit / size), np.sqrt(other / size), np.sqrt(marks / size), np.sqrt(bar / size),
        np.log1p(size / words), np.log1p(size / (line + 1)), np.sqrt(wide / size), kinds_of_words / words**0.9, np.sqrt(repeated), np.sqrt(marked / words),
    ], 1)


def measured_parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches, and the statistics of their rows' whole texts. Null: as an empty text."""
    for batch in batches:
        for part in slices(batch, text, BLOCK):
            column = part.column(text).fill_null("")
            yield part, statistics(column.to_pylist(), column)


def add_statistics(docs: DataFrame, text: str = "text", to: str = "statistics") -> DataFrame:
    """docs with an array of NAMES' values measured on the whole text, in place of the text and of a column of that name.

    A null text counts as an empty one; repeated rows are measured one by one; an empty table gives an empty one.
    """
    kept = docs.drop(to)
    schema = T.StructType([*(f for f in kept.schema.fields if f.name != text), T.StructField(to, T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in measured_parts(batches, text):
            offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
            yield part.drop_columns([text]).append_column(to, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())))

    return kept.mapInArrow(lean(measure), schema)


@dataclass
class Discriminant:
    """For class 0 and 1: log of the prior, mean, and inverse Cholesky factor and log determinant of the covariance; prior alone if a class has no rows."""

    prior: float
    log_prior: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray

    @property
    def whole(self) -> bool:
        return len(self.means) == 2


def fit_quality(measured: DataFrame, label: str = "quality", of: str = "statistics", shrink: float = 0.1, floor: float = 1e-3) -> Discriminant:
    """Means and covariances of all rows that have label 0 or 1: their sums are added up per task, then by Spark.

    Other labels and null ones teach nothing, repeated rows count each time; without rows of both labels the model is the
    prior alone. A class's covariance is shrunk by the share shrink towards the pooled one's diagonal, and gets floor times the mean
    variance more on its diagonal. Its Cholesky factor is inverted once, here, and sent to the tasks.
    """
    d = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("x").to_numpy(zero_copy_only=False))
                y = batch.column("y").to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    own = x[y == c]
                    sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"at": np.arange(sums.size), "value": sums.ravel()})

    rows = measured.select(F.col(of).alias("x"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1)")
    total = np.zeros(2 * (1 + d + d * d))
    for at, value in rows.mapInArrow(lean(moments), "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        total[at] = value
    total = total.reshape(2, -1)
    n = total[:, 0]
    prior = float((n[1] + 1) / (n.sum() + 2))
    if not n.all():
        return Discriminant(prior, np.log([1 - prior, prior]), np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0))
    means = total[:, 1 : d + 1] / n[:, None]
    scatter = total[:, d + 1 :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = np.diag(np.diag(scatter.sum(0) / n.sum()))
    factors, dets = [], []
    for c in (0, 1):
        cov = (1 - shrink) * scatter[c] / n[c] + shrink * pooled + np.eye(d) * (floor * np.trace(pooled) / d + 1e-9)
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        factors.append(np.linalg.inv(factor))
        dets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(prior, np.log([1 - prior, prior]), means, np.array(factors), np.array(dets))


def log_odds(x: np.ndarray, model: Discriminant) -> np.ndarray:
    """Log of how much likelier class 1 is: the difference of the classes' log densities by Mahalanobis distance, and of the priors."""
    logs = [model.log_prior[c] - (((x - model.means[c]) @ model.factors[c].T) ** 2).sum(1) / 2 - model.log_dets[c] / 2 for c in (0, 1)]
    return logs[1] - logs[0]


def probabilities(x: np.ndarray, model: Discriminant) -> np.ndarray:
    """Of class 1, for each row of statistics; the prior if the model lacks a class."""
    return 1 / (1 + np.exp(-np.clip(log_odds(x, model), -500, 500))) if model.whole and len(x) else np.full(len(x), model.prior)


def scored_rows(kept: DataFrame, parts: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray]]], model: Discriminant, least: float) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in parts(batches):
            value = probabilities(x, model)
            yield part.append_column("score", pa.array(value)).append_column("predicted", pa.array((value >= least).astype(np.int32)))

    return kept.mapInArrow(lean(score), T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def score_quality(measured: DataFrame, model: Discriminant, of: str = "statistics", least: float = 0.3) -> DataFrame:
    """measured with score (probability of class 1; the prior if the model lacks a class) and predicted (score >= least), in place of such columns.

    Every row gets both, repeated rows the same; an empty table gives an empty one.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            yield batch, np.stack(batch.column(of).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, len(NAMES)))

    return scored_rows(measured.drop(*OWN), parts, model, least)


def classify_quality(docs: DataFrame, model: Discriminant, text: str = "text", least: float = 0.3) -> DataFrame:
    """docs with score and predicted, as score_quality gives them, measured and scored in one pass over the whole texts. Null: as an empty text."""
    return scored_rows(docs.drop(*OWN), lambda batches: measured_parts(batches, text), model, least)


#: Rows with this remainder of crc32(doc_id) by 5 are held out of learning.
FOLDS, HELD_OUT = 5, 0


def learn_quality(docs: DataFrame, labels: DataFrame) -> tuple[Discriminant, DataFrame]:
    """The discriminant learned from the labels of rows of docs that aren't held out, and a table of all rows' doc_id, held_out and statistics.

    Null labels teach nothing, and a row counts once for each label of its doc_id. Texts are measured where they are read;
    only the statistics are stored and shuffled.
    """
    held_out = F.coalesce(crc32_of_id() % FOLDS == HELD_OUT, F.lit(False))
    measured = stored(add_statistics(docs.select("doc_id", "text", held_out.alias("held_out"))), "statistics")
    known = labels.select("doc_id", F.col("quality").alias("_quality")).filter("_quality IS NOT NULL")
    return fit_quality(measured.filter("NOT held_out").join(known, "doc_id"), "_quality"), measured


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, measured = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(measured, model).select("doc_id", "held_out", "score", "predicted")
