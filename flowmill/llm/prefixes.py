"""The trie of conversations' prefixes: chained digests name its nodes, and each node's sums go to all nodes above it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Conversation ids that are put together to one piece of a node's list, at most.
PIECE = 4096
#: At most so many nodes have more than one in so many of all nodes as children; they are joined apart.
HEAVY = 1000
#: The digest of the empty string.
NOTHING = hashlib.sha256().hexdigest()
NODE = ["hi", "lo"]


def turn_digests(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, key (digest of role and text) and words (of the text): what the trie needs of a turn, without its text. Rows without a conversation go."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    key = F.unhex(F.sha2(F.concat(F.sha2(r, 256), F.sha2(t, 256)), 256))
    rows = chats.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), key.alias("key"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"))
    return rows.dropna(subset=["conv"])


def placed(turns: DataFrame) -> DataFrame:
    """conv, place (from 0), key and words: turns in order, null turns first, those of one turn by role and digest."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    return turns.select("conv", (F.row_number().over(order) - 1).alias("place"), "key", "words")


@lean
def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations whose turns come in order; a row without a key begins each and gives the root. Whether a prefix is the whole conversation shows by the next row."""
    conv, depth, state, held = None, 0, b"", None
    for batch in batches:
        rows = []
        for c, key, words in zip(*(batch.column(n).to_pylist() for n in ("conv", "key", "words"))):
            if held is not None:
                rows.append((*held, c != conv))
            before = state[:16]
            if key is None or c != conv:
                conv, depth, state = c, 0, bytes(32)
                before = bytes(16)
            if key is not None:
                before, depth, state = state[:16], depth + 1, hashlib.sha256(state + key).digest()
            held = (c, depth, state[:16], before, words if depth else 0)
        if rows:
            yield _prefix_batch(rows)
    if held is not None:
        yield _prefix_batch([(*held, True)])


def _prefix_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, node, parent, words, last = zip(*rows)
    numbers = [np.frombuffer(b"".join(x), "<i8").reshape(-1, 2).T for x in (node, parent)]
    columns = [pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), *(pa.array(np.ascontiguousarray(n)) for pair in numbers for n in pair), pa.array(words, pa.int64()), pa.array(last)]
    return pa.RecordBatch.from_arrays(columns, names=["conv", "depth", "hi", "lo", "above_hi", "above_lo", "words", "last"])


PREFIX = "conv long, depth long, hi long, lo long, above_hi long, above_lo long, words long, last boolean"


@lean
def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order, with a comma between two; a piece at a time is held."""
    node, state = None, None
    for batch in batches:
        done = []
        for hi, lo, piece in zip(*(batch.column(n).to_pylist() for n in ("hi", "lo", "piece"))):
            if (hi, lo) == node:
                state.update(b"," + piece.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (hi, lo), hashlib.sha256(piece.encode())
        if done:
            yield _list_batch(done)
    if node is not None:
        yield _list_batch([(*node, state.hexdigest())])


def _list_batch(rows: list[tuple]) -> pa.RecordBatch:
    hi, lo, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(digest)], names=["hi", "lo", "ends_sha256"])


def end_lists(prefixes: DataFrame) -> DataFrame:
    """hi, lo and ends_sha256: of nodes at which conversations end, the digest of their ids, ascending and comma-joined.

    Ids are put together in pieces of PIECE ids at most, by many tasks; only a node's pieces meet in one, which reads them in order.
    """
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    ends = prefixes.filter("last").groupBy(*NODE, F.floor(F.col("conv") / PIECE).alias("part")).agg(piece.alias("piece"))
    return ends.repartition(*NODE).sortWithinPartitions(*NODE, "part").mapInArrow(_digest_lists, "hi long, lo long, ends_sha256 string")


def subtree_sums(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """hi, lo, n_leaves and saved_tokens: what the nodes of each one's subtree have together.

    A node stands in the conversation of its smallest member, whose other prefixes are all nodes above and below it. So
    along each conversation its own nodes are first summed from the end, and every prefix is then a row for the node it
    names: as if each node were exploded to all those above it, but with a row per prefix instead of one per pair.
    """
    own = nodes.select("conv", "depth", F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), F.when(F.col("goes_on"), 0).otherwise(1).alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    rows = prefixes.select("conv", "depth", "hi", "lo", F.lit(0).alias("leaf"), F.lit(0).cast("long").alias("saved")).unionByName(own)
    upwards = Window.partitionBy("conv").orderBy(F.col("depth").desc(), F.col("hi").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("hi", "lo", F.sum("leaf").over(upwards).alias("leaf"), F.sum("saved").over(upwards).alias("saved")).filter("hi IS NOT NULL AND leaf + saved > 0")
    return summed.groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def with_parents(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """nodes with parent_conv, their parent's smallest member.

    Parents that have more than one in HEAVY of all nodes as children, at most HEAVY by that, are broadcast; so no key of
    the other join has more than that share of the rows.
    """
    parents = nodes.join(children, NODE).select(F.col("hi").alias("above_hi"), F.col("lo").alias("above_lo"), F.col("conv").alias("parent_conv"), "n_children")
    least = nodes.count() // HEAVY
    above = ["above_hi", "above_lo"]
    below = nodes.filter("depth > 0")
    heavy = parents.filter(F.col("n_children") > least).drop("n_children")
    found = below.join(F.broadcast(heavy), above)  # at most HEAVY rows
    rest = below.join(F.broadcast(heavy), above, "left_anti").join(parents.filter(F.col("n_children") <= least).drop("n_children"), above)
    root = nodes.filter("depth = 0").withColumn("parent_conv", F.lit(None).cast("long"))
    return found.unionByName(rest).unionByName(root)


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie's nodes, of turns as placed gives them; conversations has conv, each id once, and may have some without turns.

    Node columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and node and
    parent, their digests in hexadecimal (null above the root).
    """
    begin = conversations.select("conv", F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    rows = turns.unionByName(begin).repartition("conv").sortWithinPartitions("conv", "place").select("conv", "key", "words")
    prefixes = stored(rows.mapInArrow(_chain, PREFIX), "prefixes")
    # What a node's prefixes have in common is in the keys, so that only numbers are summed, by each task first.
    common = ["depth", *NODE, "above_hi", "above_lo", "words"]
    nodes = prefixes.groupBy(*common).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), (F.min(F.col("last").cast("int")) == 0).alias("goes_on"))
    nodes = stored(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("above_hi").alias("hi"), F.col("above_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    out = with_parents(nodes, children).join(children, NODE, "left").join(subtree_sums(prefixes, nodes), NODE, "left").join(end_lists(prefixes), NODE, "left")
    name = lambda hi, lo: F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (hi, lo))))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), name("hi", "lo").alias("node"), F.when(F.col("depth") > 0, name("above_hi", "above_lo")).alias("parent"),
    )


def prefix_trie(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of all prefixes of conversations: a row per node, which is a distinct sequence of first turns (role and text).

    A node's members are the conversations that begin with it; conv_id is the smallest. The root, of depth 0, holds all.
    n_leaves counts childless nodes in the subtree, the node included; saved_tokens sums over it the words of each node's
    last text, times its members but one: what a store of prefixes saves. ends_sha256 is of the ids of members that end there.

    Turns stand in order, null turns first; those of one turn by role and by a digest of role and text, so repeated rows are
    repeated turns. A null role or text is empty; rows without a conversation go, since they belong to none; an empty table
    has no nodes, not even a root. Ids are integers. Other columns are ignored, whatever their names. Texts are digested
    where they are read and are not shuffled. A conversation's turns pass through one task, a batch at a time; those of
    a node never do.
    """
    turns = stored(placed(turn_digests(chats, conv, turn, role, text)), "turns")
    return trie(turns, turns.filter("place = 0").select("conv"))


def with_last_turns(nodes: DataFrame, chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of prefix_trie with role and text of their last turn; null at the root."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    order = Window.partitionBy("conv_id").orderBy(F.col(turn).asc_nulls_first(), r, F.sha2(F.concat(F.sha2(r, 256), F.sha2(t, 256)), 256))
    rows = chats.dropna(subset=[conv]).select(F.col(conv).cast("long").alias("conv_id"), turn, role, text)
    return nodes.join(rows.select("conv_id", F.row_number().over(order).cast("long").alias("depth"), r.alias("role"), t.alias("text")), ["conv_id", "depth"], "left")


def branched(turns: DataFrame, kept: Column, base: Column, most: int) -> DataFrame:
    """Each conversation with its first turns replaced: the first kept ones are those of the conversation base (fewer where that has fewer), its own follow after its first kept.

    kept, at most most, and base are of the column conv; a conversation is the base of a bounded number of others.
    """
    ids = turns.filter("place = 0").select("conv", kept.cast("int").alias("kept"), base.alias("base"))
    first = turns.filter(F.col("place") < most).select(F.col("conv").alias("base"), "place", "key", "words")
    given = ids.join(first, "base").filter("place < kept").select("conv", "place", "key", "words")
    return turns.filter(F.col("place") >= kept).select("conv", "place", "key", "words").unionByName(given)


#: The query's rebuilt conversations: of each block of so many ids the first gives its first turns to the others, fewer than DRAWN.
BLOCK, DRAWN = 20, 4


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(placed(turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), "turns")
    drawn = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(DRAWN))
    rebuilt = branched(turns, drawn, F.col("conv") - F.col("conv") % BLOCK, DRAWN - 1)
    nodes = trie(rebuilt, turns.filter("place = 0").select("conv"))
    return nodes.drop("node", "parent")


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: each byte is followed by eight steps of its bits."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"


OP11_SQL = rf"""
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT conv_id, conv_id - conv_id % {BLOCK} AS base, {_crc32_sql('conv_id::VARCHAR')} % {DRAWN} AS kept FROM (SELECT DISTINCT conv_id FROM placed)),
rebuilt AS (
  SELECT p.conv_id, place, role, text FROM placed p JOIN ids i ON p.conv_id = i.conv_id WHERE place >= kept
  UNION ALL SELECT i.conv_id, place, role, text FROM ids i JOIN placed p ON p.conv_id = i.base WHERE place < kept
),
paths AS (SELECT i.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY place) FILTER (WHERE role IS NOT NULL), []) AS path FROM ids i LEFT JOIN rebuilt r ON i.conv_id = r.conv_id GROUP BY i.conv_id),
exploded AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths),
named AS (SELECT conv_id, depth, len(path) AS turns, sha256(path[1:depth]::VARCHAR) AS node, CASE WHEN depth > 0 THEN sha256(path[1:depth - 1]::VARCHAR) END AS parent, CASE WHEN depth > 0 THEN len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words, path FROM exploded),
nodes AS (
  SELECT depth, node, parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    CASE WHEN max(turns) = depth THEN 1 ELSE 0 END AS leaf, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
  FROM named GROUP BY depth, node, parent
),
above AS (SELECT n.node AS below, a.node, n.leaf, n.saved FROM nodes n JOIN named a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
sums AS (SELECT node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent AND p.depth = n.depth - 1 LEFT JOIN children c ON c.node = n.node LEFT JOIN sums s ON s.node = n.node
"""
