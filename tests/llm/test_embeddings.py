import numpy as np

from flowmill.llm import embeddings
from flowmill.llm.components import connected_components

KIND = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.9):
    usable = {i: np.array(v, float) for i, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    for i in usable:
        for j in usable:
            if i < j and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= least * np.linalg.norm(usable[i]) * np.linalg.norm(usable[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return {i: (links[i], root[i]) for i in links}


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng, rows = np.random.default_rng(1), []
    for size in (1, 1, 2, 5, 60):
        centre = rng.normal(size=64)
        rows += [((centre + rng.normal(size=64) * 0.1).astype(np.float32).tolist(),) for _ in range(size)]
    rows += [(rows[0][0],), (rows[0][0],), (None,), ([],), ([0.0] * 64,), ([float("nan")] * 64,), ([float("inf")] + [1.0] * 63,), ([None] + [1.0] * 63,), ([1.0, 2.0],), ([1.0, 2.0],), (rng.normal(size=64).tolist(),)]
    ids = rng.permutation(len(rows)).tolist()
    rows = [(ids[i], v, 0, "theirs") for i, (v,) in enumerate(rows)]
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    expected = brute(rows)
    assert {i: (r["n_links"], r["component_id"]) for i, r in out.items()} == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.values())
    assert embeddings.near_duplicates(spark.createDataFrame([], KIND)).count() == 0


def test_recall_just_above_the_threshold():
    """Pairs with a cosine of 0.9 to 0.95 that share a bucket: at least nine of ten."""
    rng = np.random.default_rng(2)
    a, noise = rng.normal(size=(1500, 64)), rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.95, (1500, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * noise
    keys = [embeddings.bucket_keys(x, 8, 2, 2, 5) for x in (a, b)]
    met = [bool(set(p) & set(q)) for p, q in zip(*keys)]
    assert np.mean(met) >= 0.9


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(3).normal(size=(4, 8))
    assert np.allclose(np.linalg.norm(embeddings.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(embeddings.hadamard(embeddings.hadamard(x)), x)


def test_components_of_chains_stars_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0} and {out[100 + k] for k in range(30)} == {100} and out[202] == 200 and 300 not in out
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers_of_extreme_size_and_other_columns(spark):
    """Vectors whose squares overflow or vanish, a vector of many copies, and clashing names."""
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.1e200]), (2, [1e-200, 1e-200]), (3, [1e-320, -1e-320]), (4, [-1e300, 1e300]), (5, [0.0, 0.0]), (6, None), (7, [float("nan"), 1.0]), (8, []), (9, [None, 1.0])]
    table = spark.createDataFrame(rows + [(100 + i, [1e-200, 1e-200]) for i in range(50)], "vec_id long, embedding array<double>").selectExpr("*", "'x' AS class", "'x' AS vector", "'x' AS bucket", "'x' AS n_links")
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(table).collect()}
    assert all(out[i]["component_id"] == 0 and out[i]["n_links"] == 52 for i in (0, 1, 2, 100, 149))
    assert all((out[i]["component_id"], out[i]["n_links"]) == (i, 0) for i in (3, 4))  # opposite to each other
    assert all((out[i]["component_id"], out[i]["n_links"], out[i]["kept"]) == (i, 0, True) for i in range(5, 10))
    assert embeddings.near_duplicates(table.limit(0)).count() == 0
