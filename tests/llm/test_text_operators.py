"""Each operator against brute force and the cases that its docstring defines."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowmill.llm import bpe, chat, jaccard, language, licenses, media, mixing, quality, sharding, words

DOC = "doc_id long, text string, lang string, source string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def documents(spark):
    """Copies, near copies, empty, null, short and long texts, a null id and repeated rows; and columns that clash with those that operators add."""
    near = prose(1, 200).split()
    near[100] = "changed"
    texts = [prose(1, 200), prose(1, 200), " ".join(near), "", None, "one", "One", " \t\n", prose(2, 30), prose(3, 5000), "It's 12 l'été!\r\n\r\n  ok", "\x00 \x1c  ", "日本語 ½²", prose(2, 30)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [(13, prose(2, 30), None, "s1"), (None, prose(4, 20), "en", None), (None, None, None, None)]
    clash = ["ids", "size", "shard", "score", "copies", "rate", "media", "n_words", "labels", "statistics", "payload", "lang_pred", "_words", "_base", "_block", "_positions", "_place", "_offset", "_source", "_steps", "predicted"]
    return spark.createDataFrame(rows, DOC).select("*", *(F.lit("theirs").alias(c) for c in clash))


def brute_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = [brute_sets(t) for _, t in rows]
    root, links = list(range(len(rows))), Counter()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    group = [min((rows[k][0] for k in range(len(rows)) if root[k] == root[i] and rows[k][0] is not None), default=None) for i in range(len(rows))]
    return [(rows[i][0], len(sets[i]), group[i] if sets[i] else rows[i][0], links[i]) for i in range(len(rows))]


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_jaccard_join_of_odd_documents(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = as_rows(jaccard.near_duplicate_documents(docs, links=True), "doc_id", "n_shingles", "component_id", "n_links")
    assert out == sorted(brute_components(rows), key=str)
    assert jaccard.near_duplicate_documents(docs.limit(0)).count() == 0
    assert as_rows(jaccard.near_duplicate_documents(docs), "doc_id", "n_shingles", "component_id") == sorted((r[:3] for r in out), key=str)


@pytest.mark.parametrize(("hot", "bits"), [(1, 64), (32, 64), (32, 5)])
def test_jaccard_join_of_families(spark, monkeypatch, hot, bits):
    """Chains of edits, so that links are not transitive, in trees of a few sets; shingles of many components among them; numbers that many sets share."""
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng, rows = np.random.default_rng(5), []
    for family in range(12):
        words = prose(100 + family, int(rng.integers(4, 120))).split()
        for k in range(int(rng.integers(1, 14))):
            rows.append((len(rows), " ".join(words)))
            words[int(rng.integers(len(words)))] = f"w{family}-{k}"
    order = rng.permutation(len(rows)).tolist()
    rows = [(order[i], t) for i, t in rows]
    out = jaccard.near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), links=True, bits=bits)
    assert as_rows(out, "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute_components(rows), key=str)


@pytest.mark.parametrize("hot", [3, 32])
def test_jaccard_join_of_common_lines(spark, monkeypatch, hot):
    """Documents of a few lines from a common pool: every shingle is frequent, few documents link; compared in blocks, and by pairs."""
    monkeypatch.setattr(jaccard, "GROUP", 8)
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = np.random.default_rng(21)
    lines = [" ".join(f"{k}w{j}" for j in range(9)) for k in range(8)]
    rows = [(i, "\n".join(lines[k] for k in rng.choice(8, int(rng.integers(1, 4)), False)) + (f" tail{i % 3}" if i % 2 else "")) for i in range(90)]
    out = jaccard.near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), links=True)
    assert as_rows(out, "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute_components(rows), key=str)


def test_jaccard_join_of_templated_pages(spark, monkeypatch):
    """Pages that share four fifths and more of their shingles, and don't link: no pair of them becomes a candidate, nor a block."""
    monkeypatch.setattr(jaccard, "HOT", 3)
    checked = []
    check = jaccard.Corpus.checked_pairs
    monkeypatch.setattr(jaccard.Corpus, "checked_pairs", lambda self, pairs: checked.append(pairs.count()) or check(self, pairs))
    monkeypatch.setattr(jaccard.Corpus, "compared_clusters", None)
    frame = [f"frame{j}" for j in range(840)]
    rows = [(i, " ".join(frame[:420] + [f"own{i}-{j}" for j in range(160)] + frame[420:])) for i in range(60)]
    out = jaccard.near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(out, "doc_id", "n_shingles", "component_id") == sorted((r[:3] for r in brute_components(rows)), key=str)
    assert sum(checked) == 0


def test_words_that_collide_by_structure_stay_apart(spark):
    """Sums of bytes times powers of a base modulo 2**64 are equal for these two words, whatever the base."""
    word = "a"
    while len(word) < 2048:
        word += "".join("b" if c == "a" else "a" for c in word)
    other = "".join("b" if c == "a" else "a" for c in word)
    out = jaccard.near_duplicate_documents(spark.createDataFrame([(1, word), (2, other), (3, f"x {word} y z u v"), (4, f"x {other} y z u v")], "doc_id long, text string"))
    assert as_rows(out, "doc_id", "component_id") == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_one_document_of_each_group_stays(spark):
    """Rows with one id and other texts, repeated rows, null ids, copies and blank texts."""
    a, b, near = prose(31, 60), prose(32, 60), prose(31, 60).split()
    near[30] = "changed"
    rows = [(5, a, "s"), (5, b, "s"), (7, a, "s"), (5, a, "s"), (5, a, "r"), (None, a, "s"), (9, " ".join(near), "s"), (None, b, "s"), (None, "alone", "s"), (3, "", "s"), (3, None, "s"), (3, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    out = jaccard.one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(5, a, "r"), (5, b, "s"), (None, "alone", "s"), (3, "", "s"), (3, None, "s"), (3, "", "s")], key=str)
    assert jaccard.one_of_each_group(docs.limit(0)).count() == 0


def test_tree_overlaps_match_set_arithmetic():
    rng = np.random.default_rng(1)
    base = np.sort(rng.choice(10**6, 60, False)).astype(np.uint64)
    sets = [np.sort(np.unique(np.concatenate([rng.choice(base, int(rng.integers(30, 60)), False), rng.choice(10**6, int(rng.integers(0, 12))).astype(np.uint64)]))) for _ in range(60)]
    found = {(k, h) for k, hits in jaccard.tree_overlaps(sets[:40], sets[20:]) for h in hits.tolist()}
    expected = {(i, j) for i, a in enumerate(sets[:40]) for j, b in enumerate(sets[20:]) if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))}
    assert found == expected and len(expected) > 20


def test_bpe_matches_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark)
    out = bpe.decode(bpe.encode(docs, ranks, pattern), ranks)
    rows = out.select("doc_id", "ids", "decoded", "source", "size").collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in rows), key=str) == texts
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(bytes(r["decoded"]).decode()) and r["size"] == "theirs"
    assert bpe.decode(bpe.encode(docs.limit(0), ranks, pattern), ranks).count() == 0


def test_bpe_of_rows_that_come_in_another_order_on_each_read(spark):
    ranks, pattern = bpe.vocabulary()

    def turned(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng().permutation(batch.num_rows)))

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), *(F.md5(F.concat("id", F.lit(k))) for k in range(9))).alias("text"))
    upstream = docs.repartition(3).mapInArrow(turned, docs.schema)
    out = bpe.encode(upstream.select("*", F.col("text").alias("own")), ranks, pattern, decoded="decoded").collect()
    assert len(out) == 400 and all(bytes(r["decoded"]).decode() == r["own"] for r in out)


def test_bpe_stops_when_a_second_read_gives_other_rows(spark):
    """As after the loss of an executor: without the shared shuffle, both sides read the table, whose texts are others each time."""
    ranks, pattern = bpe.vocabulary()

    def noisy(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": [f"{np.random.default_rng().random()} words"] * batch.num_rows})

    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        with pytest.raises(Exception, match="store it first"):
            bpe.encode(docs.mapInArrow(noisy, docs.schema), ranks, pattern).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_bpe_of_very_long_texts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    letters = "".join(np.random.default_rng(3).choice(list("etaoinshr"), 1_000_000))
    texts = [letters, (prose(5, 1000) + "\n") * 2000, "x"]  # one word of a million letters, and 12 MB of prose
    out = bpe.encode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), ranks, pattern, decoded="decoded").collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in out} == dict(enumerate(texts))
    assert next(np.frombuffer(r["ids"], "<u4").tolist() for r in out if r["doc_id"] == 1) == library.encode_ordinary(texts[1])
    assert bpe.encode_word(letters[:100_000].encode(), ranks) == library.encode_ordinary(letters[:100_000])


def test_bpe_of_long_words_and_bad_ids(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(2)
    for word in ("a" * 5000, "".join(rng.choice(list("thean"), 3000)), "".join(rng.choice(list("thean"), 50))):
        assert bpe.encode_word(word.encode(), ranks) == library.encode_ordinary(word)
    numbers = np.array([0, 127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1])
    assert bpe.unpack(bpe.pack(numbers)).tolist() == numbers.tolist()
    bad = spark.createDataFrame([(bytearray(b"\xff\xff\xff\x00"),)], "ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad, ranks).collect()
    assert bpe.decode(spark.createDataFrame([(None,)], "ids binary"), ranks).first()["decoded"] is None


def test_shards_are_even_and_repeat(spark, tmp_path):
    docs = documents(spark).unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")), allowMissingColumns=True)
    out = sharding.shard_rows(docs, 7, bucket_bytes=2000)
    written = sharding.write_shards(out, str(tmp_path / "shards")).collect()
    sizes = Counter(r["shard"] for r in written)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in written if r["shard"] == s) == list(range(n))
    assert Counter((r["doc_id"], r["text"], r["size"]) for r in written) == Counter((r["doc_id"], r["text"], len((r["text"] or "").encode()) + 1) for r in docs.collect())
    again = sharding.shard_rows(docs.repartition(6), 7, bucket_bytes=2000)
    key = lambda rows: sorted((r["shard"], r["slot"], str(r["text"])) for r in rows)
    assert key(again.collect()) == key(written)
    assert [r["text"] for r in sorted(written, key=lambda r: (r["slot"], r["shard"]))] != sorted(r["text"] or "" for r in written)
    assert sharding.shard_rows(docs.limit(0)).count() == 0


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(3)
    seen = Counter(tuple(sharding.fisher_yates(3, rng)) for _ in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


def test_language_of_odd_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit_languages(docs)
    assert len(model.languages) > len(set(model.languages)) >= 2  # several centroids for a language
    out = language.predict_languages(documents(spark), model).collect()
    for r in out:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
        assert lettered or r["rejected"]
    far = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок"), (2, docs.first()["text"])], "doc_id long, text string")
    assert {r["doc_id"]: r["rejected"] for r in language.predict_languages(far, model).collect()} == {1: True, 2: False}
    assert language.predict_languages(docs.limit(0), model).count() == 0
    nothing = language.fit_languages(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict_languages(far, nothing).collect()} == {"und"}


def test_language_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language.learn_and_predict(docs).filter("held_out").collect()
    assert len(out) > 20 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert not any(r["rejected"] for r in out if r["text"] and len(r["text"]) > 100)


def test_foreign_and_random_texts_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = np.random.default_rng(8)
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa".split()
    letters = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(n))
    far = [" ".join(rng.choice(polish, n)) for n in (30, 100, 1000)] + [letters(n) for n in (30, 100, 330, 3000)]
    own = [r["text"] for r in docs.collect() if r["text"]]
    short = [" ".join(t.split()[:k]) for t in own[:40] for k in (4, 20) if len(t.split()) > k]
    rows = [(k, t) for k, t in enumerate(far + own + short)]
    out = {r["n"]: r["rejected"] for r in language.predict_languages(spark.createDataFrame(rows, "n int, text string"), language.fit_languages(docs)).collect()}
    assert all(out[k] for k in range(len(far)))
    assert sum(out[k] for k in range(len(far), len(rows))) <= 0.01 * len(rows)


def test_language_of_many_copies_is_learned(spark):
    texts = [prose(k, 40) for k in range(8)]
    rows = [(t, "xx") for t in texts for _ in range(50)] + [(t.upper().replace("A", "é"), "yy") for t in texts]
    model = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"), per_language=8)
    assert set(model.languages) == {"xx", "yy"}
    drawn = language.predict_languages(spark.createDataFrame(rows[:400], "text string, lang string"), model).collect()
    assert {r["lang_pred"] for r in drawn} == {"xx"}


def test_ngram_counts_by_hand():
    counts, lettered = language.ngram_counts(["ab", None, "!?", "a b", "AB"])
    assert lettered.tolist() == [True, False, False, True, True]
    assert (counts[0] == counts[4]).all()
    assert counts[0].sum() == 4 + 3 + 2 and counts[1].sum() == counts[2].sum()
    assert counts[3].sum() == 5 + 4 + 3


def test_quality_of_held_out_rows(spark):
    """On 70 rows that taught nothing; the smallest tables have but 19 of them."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, measured = quality.learn_quality(docs, labels)
    out = quality.score_quality(measured, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(out) > 50 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.93 * len(out)


def test_quality_of_odd_texts(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(3, None), (99, 1), (13, 1)], "doc_id long, quality int")
    for known in (labels, labels.filter("quality = 1"), labels.limit(0)):
        model, measured = quality.learn_quality(docs, known)
        scores = quality.score_quality(measured, model).collect()
        assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    whole = quality.classify_quality(docs, model).collect()
    assert sum(r["text"] is None for r in whole) == 2 and {r["source"] for r in whole} == {r["source"] for r in docs.collect()}
    assert sorted(r["score"] for r in whole) == sorted(r["score"] for r in quality.score_quality(quality.add_statistics(docs), model).collect())
    assert quality.learn_quality(docs.limit(0), labels)[1].count() == 0


def test_log_odds_match_densities():
    rng = np.random.default_rng(4)
    means, covs = rng.normal(size=(2, 3)), []
    for _ in range(2):
        m = rng.normal(size=(3, 3))
        covs.append(m @ m.T + np.eye(3))
    chol = [np.linalg.cholesky(c) for c in covs]
    model = quality.Discriminant(0.5, np.log([0.25, 0.75]), means, np.array([np.linalg.inv(c) for c in chol]), np.array([2 * np.log(np.diag(c)).sum() for c in chol]))
    x = rng.normal(size=(5, 3))
    density = [np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - means[c], np.linalg.inv(covs[c]), x - means[c])) / np.sqrt(np.linalg.det(covs[c])) for c in (0, 1)]
    assert np.allclose(quality.log_odds(x, model), np.log(0.75 * density[1]) - np.log(0.25 * density[0]))


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum_and_round_trip():
    rng = np.random.default_rng(6)
    assert media.page_crc(data := rng.bytes(999)) == slow_crc(data)
    for n in (64, 64 * 93, 2 * 6000, 255 * 64 * 6, 400_000 // 64 * 64):
        payload = rng.bytes(n)
        made = media.write_ogg(payload)
        assert media.read_payload(made)[0] == payload
        streams, pages = media.read_ogg(made)
        assert pages >= 4 and all(s.ends[-1] == n // 2 and s.ends[1] == min(6000, n // 2) for s in streams.values())
        for spot in (3, 30, len(made) // 2, len(made) - 1):
            broken = bytearray(made)
            broken[spot] ^= 1
            with pytest.raises(ValueError):
                media.read_payload(bytes(broken))
        with pytest.raises(ValueError):
            media.read_payload(made[:-40])


def test_media_columns(spark):
    docs = documents(spark)
    out = media.read_media(media.add_media(docs)).collect()
    assert len(out) == docs.count()
    for r in out:
        data = (r["text"] or "").encode()
        assert bytes(r["payload"]) == media.pad(data) and r["media_error"] is None
    assert len({bytes(r["media"]) for r in out}) == len({r["text"] or "" for r in out})
    bad = media.read_media(spark.createDataFrame([(None,), (bytearray(b"OggS"),), (bytearray(b""),)], "media binary")).collect()
    assert [r["payload"] for r in bad] == [None] * 3 and [r["media_error"] is None for r in bad] == [True, False, False]
    assert media.read_media(media.add_media(docs.limit(0))).count() == 0


def test_mix_of_odd_documents(spark):
    docs = documents(spark)
    out = mixing.mix_sources(docs, budget=3.0).collect()
    assert {r["source"] for r in out} == {"s0", "s1", "s2", None} - ({"s0"} - {r["source"] for r in out})
    assert all(r["copy"] < r["copies"] for r in out)
    assert Counter((r["doc_id"], r["copy"], r["text"]) for r in out) == Counter({(r["doc_id"], r["copy"], r["text"]): Counter((x["doc_id"], x["text"]) for x in docs.collect())[(r["doc_id"], r["text"])] for r in out})
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert {r["source"] for r in mixing.mix_sources(docs, {"s1": 1.0, "absent": 1.0}).collect()} <= {"s1"}


def test_mix_reaches_its_weights(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") < 15000, "hot").otherwise("rare").alias("source"))
    out = mixing.mix_sources(docs, {"hot": 1.0, "rare": 3.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["hot"] - 5000) < 300 and abs(n["rare"] - 15000) < 500
    assert out.filter("source = 'rare'").agg(F.max("copies")).first()[0] > 6
    many = mixing.mix_sources(docs.filter("doc_id < 100 OR doc_id >= 15000"), {"hot": 1.0}, budget=20.0)
    assert abs(many.count() - 5100 * 20) < 5 * (5100 * 20) ** 0.5  # a rate of about a thousand


def test_poisson_steps(spark):
    r = spark.range(1).select(mixing.poisson_steps(F.lit(2.0)).alias("s")).first()["s"]
    assert np.allclose(np.diff([0, *r])[:4], [np.exp(-2), 2 * np.exp(-2), 2 * np.exp(-2), 4 / 3 * np.exp(-2)]) and abs(r[-1] - 1) < 1e-12


def brute_license(text, templates=licenses.TEMPLATES):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
    labels, best = {x for x in at if at[x]}, 0.5 if any(at.values()) else 0.0
    base = ",".join(sorted(labels))
    for t in templates:
        for i in range(len(words)):
            if words[i : i + len(t.key_words)] == t.key_words:
                s = i - t.key_at
                share = sum(w in words[max(s + q - 4, 0) : max(s + q + 5, 0)] for q, w in enumerate(t.words)) / len(t.words)
                if share >= 0.8 and not {"not", "never"} & set(words[max(s - 2, 0) : i]):
                    labels.add(t.label)
                    best = max(best, share)
    places = sorted(x for v in at.values() for x in v)
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, base, ",".join(sorted(labels)), best


def test_licenses_match_brute_force(spark):
    whole = {t.label: t.text for t in licenses.TEMPLATES if len(t.words) > 20}
    texts = ["Released under the MIT License.", "x CC BY cc by CC-BY-NC 4.0", "GNU General Public License, version 3", "All rights reserved. All Rights Reserved", "", None, "ccby", "İ cc by K", "mit license license", "\x00cc\x7fby", "Licensed under CC BY-NC 4.0.", "version 2 license general public license", prose(1, 3000) + " all rights reserved", "éall rights reserved"]
    texts += ["not under the mit license", "This is NOT the MIT license", "under the terms of THE MIT-license", "the mit license " * 50, "licensed under the gnu general public license version 2 or the apache license version 2 0", "publicly licensed, general success"]
    for label, t in whole.items():
        words = t.split()
        texts += [t, "# " + "\n# ".join(words), " ".join(words[3:]), " ".join(words[::2]), " ".join("x" if k % 9 == 0 else w for k, w in enumerate(words)), prose(7, 50) + "\n" + t.upper() + "\n" + prose(8, 30)]
    texts.append("\n\n".join(whole.values()))  # more licences than rare words are looked up
    docs = spark.createDataFrame([(i, t, "theirs") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    out = {r["doc_id"]: tuple(r)[2:9] for r in licenses.scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        assert out[i][:6] == brute_license(t)[:6], t
        assert out[i][6] == pytest.approx(brute_license(t)[6])
    assert out[0][5] == "mit" and out[14][5] == "" and out[len(texts) - 1][5] == ",".join(sorted({"cc-by", "gpl", "reserved"} & set(out[len(texts) - 1][4].split(",")) | set(whole)))
    assert licenses.scan_licenses(documents(spark)).count() == documents(spark).count()
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_licenses_of_very_long_texts(spark):
    """A phrase that stands very often, a long word, and many other words: the work grows with the text, not with its square."""
    n = 20_000
    texts = ["mit license " * n, "x" * 5_000_000, prose(7, 300_000) + " all rights reserved"]
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["n_words"] for r in out] == [2 * n, 1, 300_003] and out[2]["first_word"] == 300_000 and out[2]["labels"] == "reserved" and out[1]["labels"] == ""


MIT = next(t.text for t in licenses.TEMPLATES if t.label == "mit" and 50 < len(t.words) < 100)


@pytest.mark.parametrize("text, labels", [
    (MIT, "mit"), (" ".join([*MIT.split()[:40], "indeed", *MIT.split()[40:]]), "mit"), (" ".join([*MIT.split()[:40], *MIT.split()[41:]]), "mit"), ("Licensed under MIT license", "mit"), ("SPDX-License-Identifier: MIT", "mit"),
    ("License: GPL-3.0-or-later", "gpl-3.0"), ("released under the GPL v3", "gpl-3.0"), ("licensed under the terms of the Apache License 2.0", "apache-2.0"), ("not licensed under the MIT license", ""),
    ("It was never released under the GPL v3", ""), (" ".join(reversed(MIT.split())), ""), ("a permit of the university license", ""),
])
def test_licenses_in_other_words(spark, text, labels):
    docs = spark.createDataFrame([(text,), ("x " * 30 + text + " y" * 30,)], "text string")
    assert {r["labels"] for r in licenses.scan_licenses(docs).collect()} == {labels}


def test_licences_come_by_the_index(spark):
    """Without rare words nothing but the phrases is found; letters beyond ASCII keep their case; a column of the scan's own names gives way."""
    ecole = licenses.Template("ecole", "Sous LICENCE ÉCOLE LIBRE pour tous les usages", "LICENCE ÉCOLE LIBRE")
    docs = spark.createDataFrame([(MIT, "x"), ("cc by", "x"), (ecole.text, "x"), (None, "x")], "text string, _votes string")
    scan = lambda **more: [r["labels"] for r in licenses.scan_licenses(docs, templates=(*licenses.TEMPLATES, ecole), **more).collect()]
    assert scan() == ["mit", "cc-by", "ecole", ""] and scan(rare=0) == ["", "cc-by", "", ""]
    assert not re.search("Python|Pandas|Arrow", licenses.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString())


def test_licenses_of_own_templates(spark):
    """What a file must hold follows from the templates given."""
    own = (licenses.Template("public-domain", "this is free and unencumbered stuff", "free and unencumbered"), licenses.Template("beer", "buy me a beer in return", "a beer"))
    texts = ["This is FREE and unencumbered stuff, really", "free and unencumbered", "please buy me a beer, in return!", "Released under the MIT License", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs, templates=own).collect()}
    assert out == {i: brute_license(t, own)[5:] for i, t in enumerate(texts)} and out[0] == ("public-domain", 1.0) and out[2] == ("beer", 1.0)
    assert {r["labels"] for r in licenses.scan_licenses(docs, templates=()).collect()} == {""}


def test_chat_parts_and_mask(spark):
    part = lambda kind, **more: (kind, *(more.get(k) for k in ("text", "ref", "width", "height", "seconds", "pages")))
    rows = [
        (1, 1, "assistant", [part("text", text="<|end|> <~| ok<"), part("image", ref="i.png", width=56, height=29)]),
        (1, 0, "user", [part("audio", ref="a.wav", seconds=1.5), part("text", text="x"), part("document", ref="d.pdf", pages=2), part("video", ref="v")]),
        (1, 2, None, None),
        (None, 0, "assistant", [part("text", text=None)]),
        (2, 0, "assistant", [part("text", text="b")]),
        (2, 0, "assistant", [part("text", text="a")]),
        (2, None, "assistant", [part("text", text="c\n<|turn|>")]),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    chats = chat.format_chats(frame.withColumn("formatted", F.lit("theirs")))
    out = {r["conv_id"]: r for r in chats.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    one, two = out[1], out[2]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("audio", "a.wav", 38), ("document", "d.pdf", 512), ("video", "v", 0), ("image", "i.png", 6)]
    assert one["expanded_tokens"] == 556 and one["n_turns"] == 3
    assert [(t["role"], t["text"]) for t in one["turns"]] == [("user", "<|audio|>x<|document|><|other|>"), ("assistant", "<|end|> <~| ok<<|image|>"), ("", "")]
    assert two["learned"] == "c\n<|turn|>ab" and [t["text"] for t in two["turns"]] == ["c\n<|turn|>", "a", "b"]
    assert out[None]["n_turns"] == 1 and out[None]["learned"] == ""
    for r in out.values():
        assert r["formatted"].count(chat.END) == r["n_turns"] and all(0 <= s["start"] and s["start"] + s["length"] <= len(r["formatted"]) for s in r["loss"])
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_control_strings_cut_across_parts(spark):
    """Whatever parts a text is cut into, and whatever stands between them, it is read back, and no turn comes or goes."""
    part = lambda kind, text=None: (kind, text, None, None, None, None, None)
    rng, rows, expected = np.random.default_rng(12), [], {}
    pool = [chat.TURN, chat.BODY, chat.END, "<", "|", "~", "<~", "<|", "|>", "<~|end|>", "<|image|>", "x", "assistant", "\n", ""]
    for conv in range(120):
        said = []
        for turn in range(int(rng.integers(1, 4))):
            parts, text = [], ""
            for _ in range(int(rng.integers(0, 4))):
                whole = "".join(rng.choice(pool, int(rng.integers(1, 6))))
                cuts = [0, *sorted(rng.integers(0, len(whole) + 1, 3).tolist()), len(whole)]
                parts += [part("text", whole[a:b]) for a, b in zip(cuts, cuts[1:])]
                text += whole
                if rng.random() < 0.3:
                    kind = str(rng.choice(["image", "audio", "document"]))
                    parts.append(part(kind))
                    text += f"<|{kind}|>"
            role = str(rng.choice(["user", "assistant", "<|end|>", "a<"]))
            rows.append((conv, turn, role, parts))
            said.append((role, text))
        expected[conv] = said
    chats = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    out = chats.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out} == expected
    assert {r["conv_id"]: r["learned"] for r in out} == {c: "".join(t for role, t in said if role == "assistant") for c, said in expected.items()}


def test_hard_conversation(spark):
    frame = spark.createDataFrame([(-7, 0, "user", chat.HARD), (-7, 1, "assistant", chat.HARD)], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(frame.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).select(chat.read_loss(F.col("formatted"), F.col("loss")).alias("x")).first()
    assert r["x"] == r"\### Assistant: </turn> ok" and hashlib.sha256(r["x"].encode()).hexdigest()


def test_text_blocks_of_a_batch():
    from flowmill.llm.common import runs, slices

    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 100, "c", "", "d" * 5]})
    parts = [p.column("t").to_pylist() for p in slices(batch, "t", 12)]
    assert sum(parts, []) == batch.column("t").to_pylist() and ["b" * 100] in parts
    halves = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1, 2], [2, 2], [], [3])]
    assert [r["k"].to_pylist() for r in runs(iter(halves), ["k"])] == [[1, 1], [2, 2, 2], [3]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab  S\n\t\r'''sllrevemtdéßñ日1½$%!\x1c\x85\xa0 😀́\x00")), max_size=40), max_size=5))
def test_words_at_once_match_the_pattern(texts):
    expected = words.by_expression(texts, words.USUAL)
    found = words.split_words(texts)
    assert found[0] == expected[0] and found[1].tolist() == expected[1].tolist() and found[2].tolist() == expected[2].tolist()
    assert bpe.vocabulary()[1] == words.USUAL


def test_license_words_are_counted_in_all_files(spark, monkeypatch):
    counted, count = [], licenses.document_frequency
    monkeypatch.setattr(licenses, "document_frequency", lambda *a: counted.append(count(*a)) or counted[-1])
    licenses.scan_licenses(spark.createDataFrame([("the public version",), ("general public version",), ("mit license",), (None,)], "text string"))
    assert [counted[0][w] for w in ("public", "version", "general", "license", "apache")] == [2, 2, 1, 1, 0]
