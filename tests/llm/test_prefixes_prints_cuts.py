"""Prefix tries, fingerprints and fill-in-the-middle against brute force on small tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import fingerprints as fp
from flowmill.llm import infilling, prefixes
from flowmill.llm.queries import QUERIES

CHATS = "conv_id long, turn long, role string, text string"


def brute_trie(chats):
    """Nodes by loops over whole prefixes; chats: lists of (role, text) by conversation."""
    members = defaultdict(set)
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = {}
    for node, inside in members.items():
        below = [p for p in members if p[: len(node)] == node]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c in inside if len(chats[c]) == len(node))))
        out[node] = (
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), sum(len(p) == len(node) + 1 for p in below),
            sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below), sum((len(members[p]) - 1) * words(p) for p in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def found(nodes):
    return sorted((tuple(r) for r in nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_trie_of_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, 0, "user", "a b"), (1, 1, "assistant", "c"), (2, 0, "user", "a b"), (2, 1, "assistant", "c"), (2, 2, "user", "d  e f"), (3, 0, "user", "a b"), (3, 1, "assistant", "x"),
        (4, None, None, None), (4, 0, "user", "a b"), (5, 0, None, None), (5, 0, None, None), (6, None, "", ""), (7, 0, "user", "a b"), (None, 0, "user", "a b"), (-8, 3, "user", "b"), (-8, 3, "user", "a"),
    ]
    chats = defaultdict(list)
    by_digest = lambda r: hashlib.sha256((hashlib.sha256((r[2] or "").encode()).hexdigest() + hashlib.sha256((r[3] or "").encode()).hexdigest()).encode()).digest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", by_digest(r))):
        chats[r[0]].append((r[2] or "", r[3] or ""))
    table = spark.createDataFrame(rows, CHATS).withColumns({n: F.lit("theirs") for n in ("conv", "key", "words", "node", "hi", "depth", "last")})
    nodes = prefixes.prefix_trie(table.repartition(3))
    assert found(nodes) == sorted(brute_trie(chats).values(), key=str)
    told = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in prefixes.with_last_turns(nodes.select("conv_id", "depth"), table).collect()}
    assert all(told[(c, d)] == ((None, None) if not d else chats[c][d - 1]) for c, d in told) and len(told) == nodes.count()
    names = {r["node"]: r["depth"] for r in nodes.collect()}
    assert len(names) == nodes.count() and all(r["parent"] is None if r["depth"] == 0 else names[r["parent"]] == r["depth"] - 1 for r in nodes.collect())


def test_trie_of_nothing(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], CHATS)).count() == 0


def test_trie_of_a_long_conversation_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "HEAVY", 3)
    long = spark.range(3000).select(F.lit(0).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("w "), "id").alias("text"))
    copies = spark.range(10, 9000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("w 0").alias("text"))
    other = spark.range(20_000, 20_040).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("o"), "id").alias("text"))
    nodes = {(r["conv_id"], r["depth"]): r for r in prefixes.prefix_trie(long.unionByName(copies).unionByName(other)).collect()}
    assert len(nodes) == 3001 + 40
    root, first = nodes[0, 0], nodes[0, 1]
    assert (root["n_convs"], root["n_children"], root["n_leaves"]) == (1 + 8990 + 40, 41, 41)
    assert (first["n_convs"], first["n_children"], first["saved_tokens"], first["parent_conv_id"]) == (8991, 1, 8990 * 2, 0)
    assert first["ends_sha256"] == hashlib.sha256(",".join(map(str, range(10, 9000))).encode()).hexdigest()
    assert (nodes[0, 3000]["n_leaves"], nodes[0, 3000]["n_children"], nodes[0, 3000]["ends_sha256"]) == (1, 0, hashlib.sha256(b"0").hexdigest())


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user", f"{c}/{t}") for c, n in ((20, 2), (21, 3), (22, 1), (40, 5), (45, 2)) for t in range(n)]
    turns = prefixes.placed(prefixes.turn_digests(spark.createDataFrame(rows, CHATS)))
    texts = {hashlib.sha256((hashlib.sha256(b"user").hexdigest() + hashlib.sha256(r[3].encode()).hexdigest()).encode()).digest(): r[3] for r in rows}
    out = prefixes.branched(turns, F.lit(3), F.col("conv") - F.col("conv") % 20, 3)
    got = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r["conv"], r["place"])):
        got[r["conv"]].append(texts[bytes(r["key"])])
    assert got == {20: ["20/0", "20/1"], 21: ["20/0", "20/1"], 22: ["20/0", "20/1"], 40: [f"40/{t}" for t in range(5)], 45: ["40/0", "40/1", "40/2"]}


def brute_sketch(text, k=fp.K):
    low = (text or "").translate({o: o + 32 for o in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} if words else set()
    return sorted(hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles)[:k]


TEXTS = [None, "", " \t\n", "one", "a b c d", "A b\tC  d\x0be", "a b c d e f g a b c d e f g", "É ß ſ   x y z", "wort " * 3000, "x" * 1_000_000, " ".join(f"w{i % 977}" for i in range(300_000)), "a b c d e f 😀 g"]


def test_sketches_by_blocks_are_those_of_whole_texts(spark):
    rows = [(i, t, "theirs") for i, t in enumerate(TEXTS)] + [(90, TEXTS[6], "theirs")] * 2
    out = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, sketch string"))
    assert out.columns == ["doc_id", "text", "sketch", "fingerprint", "distinct_shingles"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["sketch"] == brute_sketch(t) and got[i]["fingerprint"] == "".join(brute_sketch(t)) for i, t in enumerate(TEXTS))
    assert got[90]["sketch"] == got[6]["sketch"] and out.count() == len(rows)
    assert abs(got[10]["distinct_shingles"] / 977 - 1) < 0.3 and got[6]["distinct_shingles"] == 7
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_are_exact_for_few_shingles_and_near_for_many(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [(" ".join(a := draw.choices(words, k=n)), " ".join([*a[: n * share // 100], *draw.choices(words, k=n - n * share // 100)])) for n in (20, 60, 4000) for share in (100, 75, 30, 0)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i long, a string, b string").withColumns({"x": fp.sketch(F.col("a")), "y": fp.sketch(F.col("b"))})
    for r in rows.select("i", fp.resemblance(F.col("x"), F.col("y")).alias("near"), fp.containment(F.col("x"), F.col("y")).alias("inside")).collect():
        a, b = (set(zip(*(w[j:] for j in range(5)))) for w in (t.split() for t in texts[r["i"]]))
        small = len(a | b) <= fp.K
        assert abs(r["near"] - len(a & b) / len(a | b)) <= (1e-9 if small else 0.15) and abs(r["inside"] - len(a & b) / len(a)) <= (1e-9 if small else 0.2)
    none = spark.createDataFrame([("", ""), ("", "a")], "a string, b string").select(fp.resemblance(fp.sketch(F.col("a")), fp.sketch(F.col("b"))))
    assert [r[0] for r in none.collect()] == [1.0, 0.0]


def test_sketches_merge_to_that_of_the_union(spark):
    draw = random.Random(5)
    parts = [" ".join(draw.choices("abcdefgh", k=400)) for _ in range(6)]
    table = fp.fingerprints(spark.createDataFrame([*((g, p) for g, p in zip("xxxyy", parts)), (None, "a b"), ("empty", "")], "g string, text string"))
    merged = {r["g"]: r["sketch"] for r in fp.merged_sketches(table, ["g"]).collect()}
    for g, some in (("x", parts[:3]), ("y", parts[3:5]), (None, ["a b"]), ("empty", [])):
        assert merged[g] == sorted(h for h in set().union(*(brute_sketch(p, 10**6) for p in some)))[: fp.K]
    assert not re.search("Python|Pandas|Arrow", table._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("ranges", [1, 2, 7, 50])
def test_each_document_meets_the_next(spark, ranges):
    draw = random.Random(ranges)
    ids = [*draw.sample(range(-500, 500), 60), 7, 7, 7, None, None]
    rows = [(i, draw.choice([None, "", "short", *(" ".join(draw.choices("ab cd é 😀 xyz".split(), k=n)) for n in (3, 9, 40))])) for i in ids]
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for n, (i, t) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        want.append((i, t, edited, brute_sketch(t), brute_sketch(edited), brute_sketch(after)))
    got = fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ranges=ranges)
    assert sorted(map(str, (tuple(r) for r in got.select("id", "text", "edited", "sketch", "edited_sketch", "next_sketch").collect()))) == sorted(map(str, want))


def test_neighbours_of_none_and_one(spark):
    kind = "doc_id long, text string"
    assert fp.edited_fingerprints(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r)[:3] for r in fp.edited_fingerprints(spark.createDataFrame([(3, "abcdefgh")], kind)).collect()] == [(3, "abcdefgh", "abcdefab")]


def test_fingerprint_query_runs_without_python(spark, sf_dir):
    df = QUERIES["op12_fingerprints"](spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


LINES = ["", "a", "\n", "a\n", "a\nb", "\n\n\nx\n", "é\n😀😀\nü\n", "no end " * 50, "<S>", "x<M>\ny", "<\n<S\n<P", "line\n" * 700]


def brute_cut(key, text, unit=r"[^\n]*\n|[^\n]+", rate=100, spm=50):
    units = re.findall(unit, text, re.S)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("char", "."), ("word", r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+")])
@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 14])
def test_cuts_by_chunks(spark, unit, pattern, chunk):
    draw = random.Random(chunk)
    texts = [*LINES, *("".join(draw.choices("ab \né😀<", k=draw.randrange(40))) for _ in range(80))]
    rows = [*enumerate(texts), (None, "a\nb\nc\n"), (5, texts[6]), (5, texts[6]), (900, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("theirs"), "row": F.lit("own"), "h1": F.lit("own"), "output": F.lit("theirs")})
    out = infilling.infill(table, unit=unit, chunk=chunk, rate=90, spm=30)
    assert out.columns == ["doc_id", "text", "row", "h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", infilling.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(str((k, t, *brute_cut(k, t or "", pattern, 90, 30))) for k, t in rows)
    assert all(r[7] == (r["text"] or "") for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_cuts_of_nothing_and_of_long_texts(spark):
    assert infilling.infill(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    texts = ["zeile é\n" * 1_200_000, "x" * 6_000_000]
    got = infilling.infill(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[2:] for r in got) == sorted(brute_cut(k, t) for k, t in enumerate(texts))


def test_counts_and_cuts_of_chunks():
    data = np.frombuffer(b"ab\ncd\n\nef" + b"\n" + b"xyz", np.uint8)
    starts = np.array([0, 9, 9, 10, 13])
    for size in (1, 2, 3, 4, 100):
        inside, before, chunks = infilling.unit_counts(data, starts, infilling.UNITS["line"], size)
        assert inside.tolist() == [3, 0, 0, 0] and before[-1] == 3
        for ranks, places in (([0, 0, 0, 0], [0, 9, 9, 10]), ([1, 0, 1, 1], [3, 9, 10, 13]), ([2, 0, 0, 0], [6, 9, 9, 10]), ([3, 1, 1, 1], [7, 9, 10, 13]), ([4, 1, 1, 1], [9, 9, 10, 13])):
            assert infilling.cut_places(data, starts, np.array(ranks), infilling.UNITS["line"], size=size).tolist() == places
