"""Language identification by the nearest of several centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_of_id, lean, mix64, slices

#: Hashed n-grams; texts whose vectors a task holds at once; bytes of text that it takes apart at once.
BUCKETS, TEXTS, BLOCK = 4096, 250, 1 << 20
#: Numbers of n-grams at which length bands end; cosines that a band's bound is taken from, at least.
MOST_LANGUAGES = 10_000  # a label is a language: the driver gets one row for each
EDGES, FEW = np.array([8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]), 30
UNDETERMINED = "und"
OWN = ("lang_pred", "score", "rejected", "has_letter")


@cache
def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the hashed 1-, 2- and 3-grams of each text's lower-case letters, runs of others being one space; and which texts have a letter."""
    joined = "\0".join(f" {(t or '').lower()} ".replace("\0", " ") for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = code == 0
    is_letter = letters()[code]
    keep = is_letter | ends
    keep[1:] |= is_letter[:-1]  # one space after a letter
    keep[0] = True
    keep[1:] |= ends[:-1]  # and one before the first
    doc = np.cumsum(ends)[keep]
    code = np.where(is_letter | ends, code, 32)[keep].astype(np.uint64)
    inside = code != 0
    has_letter = np.bincount(doc, is_letter[keep], len(texts)) > 0
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    gram, fine = code, inside
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x110000) + code[n - 1 :]
            fine = fine[:-1] & inside[n - 1 :]
        hashed = (mix64(gram[fine] + np.uint64(n << 62 & (1 << 64) - 1)) >> np.uint64(52)).astype(np.int64)
        counts += np.bincount(doc[: len(gram)][fine] * BUCKETS + hashed, minlength=len(counts))
    return counts.reshape(len(texts), BUCKETS), has_letter


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1; a text without n-grams stays 0."""
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12, least: float = 0.02) -> np.ndarray:
    """Up to k unit centroids: spherical k-means, begun at the vector nearest the mean and then at vectors drawn by their distance from those chosen.

    Clusters with less than the share least of the vectors, which stand for single odd texts, are dropped; the largest stays.
    """
    rng, chosen = np.random.default_rng(17), [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        far = np.maximum(1 - (x @ x[chosen].T).max(1).astype(np.float64), 0)
        if far.mean() < 1e-3:
            break
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
    centroids = x[chosen]
    for _ in range(rounds):
        nearest = np.argmax(x @ centroids.T, 1)
        sums = np.stack([x[nearest == c].sum(0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    sizes = np.bincount(np.argmax(x @ centroids.T, 1), minlength=len(centroids))
    return centroids[sizes >= min(sizes.max(), least * len(x))]


def text_blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text, BLOCK):
            for at in range(0, part.num_rows, TEXTS):
                yield part.slice(at, TEXTS)


def band(counts: np.ndarray) -> np.ndarray:
    """Each text's length band, by its number of n-grams."""
    return np.digitize(counts.sum(1), EDGES)


def cuts(texts: list[str]) -> list[str]:
    """Of each text the first, and the middle, 1, 2, 4, ... words, as far as they are shorter than it and hold a letter."""
    found = []
    for words in map(str.split, texts):
        for k in (1 << e for e in range(10) if 1 << e < len(words)):
            found += [" ".join(words[at : at + k]) for at in (0, (len(words) - k) // 2)]
    return [t for t in found if any(map(str.isalpha, t))]


def bounds(texts: list[str], idf: np.ndarray, clusters: int, quantile: float, share: float) -> np.ndarray:
    """The least cosine per length band: share times a low quantile of the cosines of texts and their cuts to centroids of other texts.

    Longer texts come nearer to their language, so a bound holds for longer ones at least. A band with fewer than FEW
    cosines takes the shorter one's bound; below the first that has enough nothing is rejected.
    """
    cosines, bands = [], []
    for half in (0, 1):
        own, others = texts[half::2], texts[1 - half :: 2]
        if not own or not others:
            continue
        centroids = cluster(np.concatenate([vectors(ngram_counts(others[at : at + TEXTS])[0], idf) for at in range(0, len(others), TEXTS)]), clusters)
        for part in (own[at : at + TEXTS] for at in range(0, len(own), TEXTS)):
            pieces = part + cuts(part)
            for at in range(0, len(pieces), TEXTS):
                counts, lettered = ngram_counts(pieces[at : at + TEXTS])
                cosines.append((vectors(counts, idf) @ centroids.T).max(1)[lettered])
                bands.append(band(counts)[lettered])
    least = np.zeros(len(EDGES) + 1)
    if cosines:
        cosine, at = np.concatenate(cosines), np.concatenate(bands)
        least = np.array([share * np.quantile(cosine[at == b], quantile) if (at == b).sum() >= FEW else 0.0 for b in range(len(least))], np.float64)
    return np.maximum.accumulate(least)


@dataclass
class LanguageModel:
    """idf per bucket; unit centroids, the language of each, and its least cosine per length band that is not rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray


def fit_languages(labelled: DataFrame, lang: str = "lang", text: str = "text", per_language: int = 600, clusters: int = 3, reject_quantile: float = 0.03, reject_share: float = 0.5) -> LanguageModel:
    """A model of the rows' texts and labels; rows with a null label or text are left out.

    Document frequencies come from all rows. Centroids come from a sample of per_language different texts of each label at
    most, those whose hashes are smallest, copies counting once. A language rejects, in each band of lengths, below reject_share times the
    reject_quantile quantile of the cosines of the sample's texts and of cuts of them, so that short texts, which are far
    from any centroid, stay, and longer ones that are farther off than nearly all of the language's go.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for part in text_blocks(batches, "text"):
            counts, _ = ngram_counts(part.column("text").to_pylist())
            total += (counts > 0).sum(0)
            n += part.num_rows
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(-1, BUCKETS), "n": np.concatenate([[n], total])})

    found = rows.select("text").mapInArrow(lean(frequencies), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()  # BUCKETS + 1 rows
    df = np.zeros(BUCKETS + 1)
    for bucket, n in found:
        df[bucket + 1] = n
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    different = rows.select("lang", F.xxhash64("text").alias("text")).distinct()  # copies come or stay out together
    drawn = per_language + 6 * per_language**0.5  # so many that, but for one case in a billion, per_language are among them
    sizes = different.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shares = {r["lang"]: min(1.0, drawn / r["count"]) for r in sizes}
    if not shares:
        return LanguageModel(idf, np.zeros((0, BUCKETS), np.float32), [], np.zeros((0, len(EDGES) + 1)))
    share = F.create_map(*(F.lit(x) for kv in sorted(shares.items()) for x in kv))[F.col("lang")]
    spot = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    sample = rows.filter(spot < share * float(1 << 40)).distinct().withColumn("spot", spot)

    def centroids(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("spot", "ascending"), ("text", "ascending")]).slice(0, per_language)
        parts = [p.column("text").to_pylist() for p in text_blocks(table.to_batches(), "text")]
        own = cluster(np.concatenate([vectors(ngram_counts(p)[0], idf) for p in parts]), clusters)
        least = bounds([t for p in parts for t in p], idf, clusters, reject_quantile, reject_share)
        return pa.table({"lang": [key[0].as_py()] * len(own), "centroid": list(own.astype(np.float64)), "least": [least] * len(own)})

    made = sample.groupBy("lang").applyInArrow(centroids, "lang string, centroid array<double>, least array<double>").collect()
    made.sort(key=lambda r: (r["lang"], r["centroid"]))
    return LanguageModel(idf, np.array([r["centroid"] for r in made], np.float32), [r["lang"] for r in made], np.array([r["least"] for r in made]))


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, rejected and has_letter, in place of columns of those names.

    lang_pred is the language of the nearest centroid, the first of equally near ones in the languages' order, and
    `und` for a null text, one without letters, or a model without languages. score is the cosine to that centroid, 0
    for `und`. rejected: `und`, or farther off than the centroid's language allows texts of this length. Every row is scored from its whole text alone.
    """
    kept = docs.drop(*OWN)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids x BUCKETS floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in text_blocks(batches, text):
            counts, has_letter = ngram_counts(part.column(text).to_pylist())
            fine = has_letter & bool(model.languages)
            score, best = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
            if model.languages:
                cosines = vectors(counts, model.idf) @ model.centroids.T
                best = cosines.argmax(1)
                score = np.where(fine, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
            names = [model.languages[b] if f else UNDETERMINED for b, f in zip(best, fine)]
            rejected = ~fine | (score < (model.least[best, band(counts)] if model.languages else 1))
            for name, values in (("lang_pred", pa.array(names, pa.string())), ("score", pa.array(score)), ("rejected", pa.array(rejected)), ("has_letter", pa.array(has_letter))):
                part = part.append_column(name, values)
            yield part

    fields = [T.StructField(n, t) for n, t in zip(OWN, (T.StringType(), T.DoubleType(), T.BooleanType(), T.BooleanType()))]
    return kept.mapInArrow(lean(predict), T.StructType([*kept.schema.fields, *fields]))


#: Rows with this remainder of crc32(doc_id) by 4 are held out of learning.
FOLDS, HELD_OUT = 4, 2


def learn_and_predict(docs: DataFrame) -> DataFrame:
    """Languages of docs, learned from those of its rows that aren't held out: a null doc_id isn't.

    A null text teaches nothing and is `und`; repeated rows count each time for document frequencies, once in the sample;
    equal cosines go to the first language; an empty table gives an empty one; columns of OWN's names and held_out are replaced.
    """
    held_out = F.coalesce(crc32_of_id() % FOLDS == HELD_OUT, F.lit(False))
    model = fit_languages(docs.filter(~held_out))
    return predict_languages(docs.withColumn("held_out", held_out), model)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return learn_and_predict(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")
