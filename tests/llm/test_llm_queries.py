"""The registered queries on the smallest tables: against SQL where there is some, else against brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowmill.llm import bpe, language, quality
from flowmill.llm.common import mix64
from flowmill.llm.queries import ORACLE_SQL, QUERIES

from .test_text_operators import brute_components


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    found = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(plain, r)) for r in df.select(names).collect()) == sorted(tuple(map(plain, r)) for r in found.fetchall())


def test_jaccard_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = QUERIES["op1_ngram_jaccard_join"](spark, sf_dir).select("doc_id", "n_shingles", "component_id", "n_links")
    assert sorted(map(tuple, out.collect())) == sorted(brute_components(rows))


def test_bpe_query(spark, sf_dir):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = QUERIES["op2_byte_bpe"](spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def grams_of(text):
    """Hashed 1-, 2- and 3-grams, counted one by one."""
    runs, out = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ", Counter()
    runs = re.sub(" +", " ", runs)
    for n in (1, 2, 3):
        for k in range(len(runs) - n + 1):
            code = 0
            for c in runs[k : k + n]:
                code = code * 0x110000 + ord(c)
            out[int(mix64(np.array([(code + (n << 62)) % (1 << 64)], np.uint64))[0] >> np.uint64(52))] += 1
    return out


def test_language_query(spark, sf_dir):
    """Every row's nearest centroid and cosine, and the weights of n-grams, by loops over single texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    learned = [r for r in docs if not held[r["doc_id"]] and r["lang"] and r["text"] is not None]
    model = language.fit_languages(spark.createDataFrame([(r["text"], r["lang"]) for r in learned], "text string, lang string"))
    grams = {r["text"]: grams_of(r["text"]) for r in [*learned, *docs] if r["text"] is not None}
    seen = Counter(g for r in learned for g in grams[r["text"]])
    assert np.allclose(model.idf, [np.log((1 + len(learned)) / (1 + seen[g])) + 1 for g in range(language.BUCKETS)])
    out = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, sf_dir).collect()}
    assert set(out) == set(held) and all(r["held_out"] == held[i] for i, r in out.items())
    for r in docs:
        got = out[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (got["lang_pred"], got["score"]) == ("und", 0)
            continue
        weight = {g: np.log1p(n) * model.idf[g] for g, n in grams[r["text"]].items()}
        size = sum(w * w for w in weight.values()) ** 0.5
        cosines = [sum(w * c[g] for g, w in weight.items()) / size for c in model.centroids]
        assert abs(got["score"] - max(cosines)) < 1e-4
        assert any(name == got["lang_pred"] and c > max(cosines) - 1e-4 for name, c in zip(model.languages, cosines))


def statistics_of(text):
    """The statistics of one text, by regular expressions over its bytes."""
    data = text.encode()
    count = lambda pattern: len(re.findall(pattern, data))
    size, words, lines = max(len(data), 1), text.split(), text.split("\n")
    upper, wide = count(rb"[A-Z]"), count(rb"[\x80-\xff]")
    letters, n = max(count(rb"[a-z]") + upper + wide, 1), max(len(words), 1)
    symbols = count(rb"[^a-zA-Z0-9 \t\r\v\f\n.,;:'\"()?|\x80-\xff-]")
    ends = len(re.findall(rb"[^a-zA-Z0-9 \t\r\v\f\n.,;:'\"()?\x80-\xff-](?=[ \t\r\v\f\n]|\Z)", data))
    return [
        np.log1p(size), (upper / letters) ** 0.5, (count(rb"[0-9]") / size) ** 0.5, (symbols / size) ** 0.5, (count(rb"[-.,;:'\"()?]") / size) ** 0.5, (count(rb"[|]") / size) ** 0.5,
        np.log1p(size / n), np.log1p(size / (count(rb"\n") + 1)), (wide / size) ** 0.5, max(len(set(words)), 1) / n**0.9, (1 - len(set(lines)) / len(lines)) ** 0.5, (ends / n) ** 0.5,
    ]


def test_quality_query(spark, sf_dir):
    """Every score from statistics and covariances that are computed row by row, and densities by plain inverses."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    x = {i: np.array(statistics_of(t)) for i, t in texts.items()}
    known = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] is not None and not held.get(r["doc_id"], True)]
    of_class = [np.stack([x[i] for i, q in known if q == c]) for c in (0, 1)]
    n = [len(c) for c in of_class]
    prior = (n[1] + 1) / (sum(n) + 2)
    covs = [np.cov(c.T, bias=True) for c in of_class]
    pooled = np.diag(np.diag((n[0] * covs[0] + n[1] * covs[1]) / sum(n)))
    covs = [0.9 * c + 0.1 * pooled + np.eye(len(quality.NAMES)) * (1e-3 * np.trace(pooled) / len(quality.NAMES) + 1e-9) for c in covs]

    def density(v, c):
        away = v - of_class[c].mean(0)
        return -away @ np.linalg.inv(covs[c]) @ away / 2 - np.linalg.slogdet(covs[c])[1] / 2

    out = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, sf_dir).collect()}
    assert set(out) == set(texts) and all(r["held_out"] == held[i] for i, r in out.items())
    for i, r in out.items():
        odds = np.log(prior / (1 - prior)) + density(x[i], 1) - density(x[i], 0)
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(odds, -500, 500)))) < 1e-5 and r["predicted"] == (r["score"] >= 0.3)


def test_embedding_query(spark, tmp_path):
    """Pairs planted at cosines from 0.86 to 0.99 among unrelated vectors, in the table that the query reads: none below 0.9, nine of ten above."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.normal(size=(300, 256)))
    noise = rng.normal(size=a.shape)
    noise = unit(noise - (noise * a).sum(1, keepdims=True) * a)
    cosine = rng.uniform(0.86, 0.99, (300, 1))
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * noise, unit(rng.normal(size=(400, 256)))]).astype(np.float32)
    rows = [(i, v.tolist(), i % 7) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 256, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {r["vec_id"]: r for r in QUERIES["op5_embedding_near_duplicates"](spark, str(tmp_path)).collect()}
    y = unit(x.astype(np.float64))
    pairs = {(i, j) for i, j in zip(*np.nonzero(np.triu(y @ y.T >= 0.9, 1)))}
    assert set(out) == {r[0] for r in rows} and len(pairs) > 200 and all(j == i + 300 for i, j in pairs)
    found = {(r["component_id"], i) for i, r in out.items() if r["component_id"] != i}
    assert found <= pairs and len(found) >= 0.9 * len(pairs)
    assert all(r["n_links"] == sum(i in p for p in found) and r["kept"] == (r["component_id"] == i) for i, r in out.items())


def test_shard_query(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = QUERIES["op3_shard_documents"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    n = Counter(r["shard"] for r in out)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in out}) == len(out) and all(0 <= r["slot"] < n[r["shard"]] for r in out)
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}


def test_media_query(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op8_ogg_media"](spark, sf_dir).collect():
        data = texts[r["doc_id"]]
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_pipeline(spark, sf_dir):
    """Each stage against what it was given: what it keeps, and why the rest went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept, given = [], docs
    for name, stage in list(stages.items())[:4]:
        given = stage(spark, given, sf_dir).cache()
        assert given.columns == docs.columns
        kept.append([tuple(r) for r in given.collect()])
    everything = {tuple(r) for r in docs.collect()}
    spoken, good, single, mixed = kept
    assert set(spoken) <= everything and len(spoken) >= 0.98 * len(everything)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r[0] for r in good}
    known = [r[0] for r in spoken if r[0] in quality]
    assert set(good) <= set(spoken) and sum((i in left) == quality[i] for i in known) >= 0.93 * len(known)
    expected = {r[0] for r in brute_components([(r[0], r[1]) for r in good]) if r[0] == r[2]}
    assert {r[0] for r in single} == expected and len(single) == len(expected)
    assert set(mixed) <= set(single)
    ranks, _ = bpe.vocabulary()
    out = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r[0]: r[1] for r in mixed}
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in mixed)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"] for r in out)


def test_stages_give_back_columns_of_any_name(spark, sf_dir):
    names = ["score", "copies", "rejected", "has_letter", "lang_pred", "held_out", "predicted", "rate", "copy", "n_bytes", "shuffle_key", "_source", "_draws", "_steps", "_others", "a.b"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    given = docs.select("*", *(F.concat(F.lit(n), "doc_id").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, sf_dir)
        assert out.columns == given.columns and out.schema.simpleString() == given.schema.simpleString(), name
        assert out.filter(" OR ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).count() == 0 < out.count()
        want = stage(spark, docs, sf_dir)
        assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in want.select("doc_id").collect()), name


def test_tables_go_when_their_readers_have_run(spark, sf_dir):
    from flowmill import session

    before = session.mark()
    out = corpus_pipeline.run(spark, sf_dir)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session.tables()[before:]]
    assert left == ["stage-3"] and out.count() > 0
