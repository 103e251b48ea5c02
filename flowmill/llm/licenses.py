"""License scans with a positional index of rare words, in DataFrame operations only."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from math import floor
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import IDENTIFIERS, NAMES, PASSAGES, STATEMENTS, TAGS


def template_words(text: str) -> list[str]:
    """The words of a template or phrase, as those of a file: runs of letters, digits and codes beyond ASCII, in ASCII lower case."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Template:
    """A licence's statement, and the key phrase in it that a file must hold word by word."""

    label: str
    text: str
    key: str

    @cached_property
    def words(self) -> list[str]:
        return template_words(self.text)

    @cached_property
    def key_words(self) -> list[str]:
        return template_words(self.key)

    @cached_property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words) - n + 1) if n and self.words[i : i + n] == self.key_words)


# The phrases of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    *(Template(label, statement.format(name), name.removeprefix("the ")) for label, names in NAMES.items() for name in names for statement in STATEMENTS),
    *(Template(label, text, text) for label, id in IDENTIFIERS.items() for text in (tag.format(id) for tag in TAGS)),
    *(Template(*passage) for passage in PASSAGES),
)
#: Of a template, as many of its rarest words are indexed as may be missing in a match, and RARE more: so many must agree on where it begins.
#: A match has SHARE of its template's words in place, each at most DRIFT words before or behind.
RARE, SHARE, DRIFT = 2, 0.8, 4
#: One of these in the two words before a match, or between its beginning and the key phrase, denies it.
DENIALS = ("not", "never")
#: Words of a template, at most.
LONGEST = 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OWN = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The lower-case words of a text, in order."""
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def starts(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively."""
    at = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())
    return F.filter(at, lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(phrase))))


def document_frequency(files: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many of all files (their words are in _words) each word of the vocabulary stands. Its size bounds what the driver gets."""
    present = F.array_intersect("_words", F.array(*(F.lit(w) for w in vocabulary)))
    rows = files.select(F.explode(present).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows}


def constant(value: object, kind: str) -> Column:
    """A value of that type as one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def rare_words(t: Template, df: dict[str, int], rare: int, share: float) -> tuple[list[str], int]:
    """The words of a template that are indexed, its rarest over all files, and how many of them must agree on a place.

    Of a match at most missing words of the template are absent, so of missing + rare different words rare are there.
    """
    missing = floor((1 - share) * len(t.words) + 1e-9)
    words = sorted(set(t.words), key=lambda w: (df[w], w))[: missing + rare if rare else 0]
    return words, max(1, len(words) - missing)


def scan_licenses(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, rare: int = RARE, share: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """docs with the licences that they state.

    A positional index has the rarest words of each template (by how few of all files have them), with the templates and
    places at which they stand. A file's words that are in it name the templates of which it has enough; only these words
    are looked up at each of their places. A posting and the word's place in the file give where a template would begin;
    where rare of a template's words agree on that to within twice drift, its key phrase must stand whole, and at least
    share of its words in place, each at most drift words off. So words put in or left out don't undo a match. One that
    is denied (see DENIALS) doesn't count. Without indexed words (rare 0) only the phrases are found.

    Adds n_words; n_base, first_word, last_word and base_labels of the phrases; labels of both; score, the best share (at
    least 0.5 with a phrase, 0 without a label); and matches (label, start, share). They replace columns of these names. A
    null text is empty, and so has no words; repeated rows are scanned one by one; an empty table gives an empty one. There
    is no shuffle of files: rows stay where they are read.
    """
    own = ("_words", "_seen", "_hits", "_named", "_look", "_spots", "_votes", "_near", "_began", "_base")
    kept = docs.drop(*OWN, *own)
    if any(len(t.words) > LONGEST for t in templates):
        raise ValueError(f"a template of more than {LONGEST} words")
    vocabulary = sorted({w for t in templates for w in t.words})
    df = document_frequency(docs.select(words_of(F.col(text)).alias("_words")), vocabulary) if vocabulary else {}
    indexed = [rare_words(t, df, rare, share) for t in templates]
    index, named = defaultdict(list), defaultdict(list)
    for k, (t, (words, _)) in enumerate(zip(templates, indexed)):
        for w in words:
            named[w].append(k)
        for at, w in enumerate(t.words):
            if w in words:
                index[w].append({"t": k, "at": at})
    postings = constant(index, "map<string,array<struct<t:int,at:int>>>")
    templates_of = constant(named, "map<string,array<int>>")
    needed = constant([n for _, n in indexed], "array<int>")
    of = constant([{"label": t.label, "words": t.words, "key": t.key_words, "key_at": t.key_at} for t in templates], "array<struct<label:string,words:array<string>,key:array<string>,key_at:int>>")
    spoken = {p: template_words(p) for p in phrases}
    wanted = constant(sorted({*index, *(w for p in spoken.values() for w in p)}), "array<string>")

    words = F.col("_words")
    some = lambda given, column, kind: F.when(F.size(given) > 0, column).otherwise(F.array().cast(kind))
    there = lambda values, n, f: F.filter(F.transform(values, lambda x, j: F.when(f(x, F.get(values, j + n(x) - 1)), x)), lambda x: x.isNotNull())
    # A template and a place as one number, so that Spark sorts and tells apart longs. Columns are named between the steps: named once, Spark would compute them anew for each word.
    code = lambda t, start: t.cast("long") * (1 << 33) + start + LONGEST
    template = lambda c: F.shiftright(c, 33).cast("int")
    begin = lambda c: (c.bitwiseAND((1 << 33) - 1) - LONGEST).cast("int")

    def is_key(c: Column) -> Column:
        t, at = F.get(of, template(c)), begin(c) + F.get(of, template(c)).key_at
        rest = F.forall(F.transform(t.key, lambda w, q: F.coalesce(F.get(words, at + q) == w, F.lit(False))), lambda x: x)
        return F.coalesce(F.get(words, at) == F.get(t.key, F.lit(0)), F.lit(False)) & rest

    def around(first: Column, last: Column) -> Column:
        """The words from the place first to the place last."""
        low = F.greatest(first, F.lit(0))
        return F.slice(words, low + 1, F.greatest(last - low + 1, F.lit(0)))

    def matched(c: Column) -> Column:
        t, start = F.get(of, template(c)), begin(c)
        same = F.filter(F.transform(t.words, lambda w, q: F.array_contains(around(start + q - drift, start + q + drift), w)), lambda x: x)
        denied = F.arrays_overlap(around(start - 2, start + t.key_at - 1), F.array(*map(F.lit, DENIALS)))
        return F.struct(t.label.alias("label"), start.alias("start"), F.when(denied, 0.0).otherwise(F.size(same) / F.size(t.words)).alias("share"))

    found = kept.withColumn("_words", words_of(F.col(text))).withColumn("n_words", F.coalesce(F.size("_words"), F.lit(0)).cast("long"))
    found = found.withColumn("_seen", F.array_intersect(wanted, words))
    found = found.withColumn("_hits", some("_seen", F.sort_array(F.flatten(F.transform("_seen", lambda w: F.coalesce(F.try_element_at(templates_of, w), F.array().cast("array<int>"))))), "array<int>"))
    found = found.withColumn("_named", F.array_distinct(there(F.col("_hits"), lambda t: F.get(needed, t), lambda t, later: later == t)))
    found = found.withColumn("_look", some("_named", F.filter("_seen", lambda w: F.coalesce(F.arrays_overlap(F.try_element_at(templates_of, w), "_named"), F.lit(False))), "array<string>"))
    found = found.withColumn("_spots", some("_look", F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_contains("_look", s.w)), "array<struct<w:string,i:int>>"))
    votes = F.transform("_spots", lambda s: F.transform(F.filter(F.try_element_at(postings, s.w), lambda p: F.array_contains("_named", p.t)), lambda p: code(p.t, s.i - p.at)))
    found = found.withColumn("_votes", F.sort_array(F.flatten(votes)))
    found = found.withColumn("_near", there(F.col("_votes"), lambda c: F.get(needed, template(c)), lambda c, later: F.coalesce(later - c <= 2 * drift, F.lit(False))))
    found = found.withColumn("_began", F.array_distinct(F.flatten(F.transform("_near", lambda c: F.filter(F.sequence(c - drift, c + drift), is_key)))))
    found = found.withColumn("matches", F.filter(F.transform("_began", matched), lambda m: m.share >= share))
    has_all = lambda p: F.size(F.array_intersect("_seen", F.array(*map(F.lit, sorted(set(p)))))) == len(set(p))
    base = F.array(*(F.struct(F.lit(label).alias("label"), F.when(has_all(spoken[p]), starts(words, spoken[p])).otherwise(F.array().cast("array<int>")).alias("at")) for p, label in phrases.items()))
    found = found.withColumn("_base", some("_seen", F.filter(base, lambda b: F.size(b.at) > 0), "array<struct<label:string,at:array<int>>>"))
    places = F.flatten(F.transform("_base", lambda b: b.at))
    base_labels = F.transform("_base", lambda b: b.label)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m.share)), F.lit(0.0))
    return found.select(
        *kept.columns, "n_words",
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("matches", lambda m: m.label))).alias("labels"),
        F.greatest(best, F.when(F.size(places) > 0, 0.5).otherwise(0.0)).alias("score"),
        "matches",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 9).alias("score"))


def _sql_starts(words: list[str]) -> str:
    same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(len(w) - {len(words) - 1}), lambda i: {same})"


def _sql_shares(t: Template) -> str:
    """The shares of the template's words in place, each at most DRIFT off, wherever its key phrase stands undenied, those of SHARE at least."""
    at = f"i - {t.key_at}"
    near = f"w[greatest({at} + q + 1 - {DRIFT}, 1):greatest({at} + q + 1 + {DRIFT}, 0)]"
    same = f"len(list_filter(range({len(t.words)}), lambda q: list_contains({near}, [{', '.join(f"'{x}'" for x in t.words)}][q + 1])))"
    undenied = f"NOT list_has_any(w[greatest({at} - 1, 1):greatest(i, 0)], [{', '.join(f"'{x}'" for x in DENIALS)}])"
    starts = f"list_filter({_sql_starts(t.key_words)}, lambda i: {undenied})"
    return f"list_filter(list_transform({starts}, lambda i: {same} / {len(t.words)}.0::DOUBLE), lambda x: x >= {SHARE})"


OP9_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
places AS (SELECT doc_id, w, {', '.join(f"{_sql_starts(template_words(p))} AS p{k}" for k, p in enumerate(PHRASES))}, {', '.join(f"{_sql_shares(t)} AS t{k}" for k, t in enumerate(TEMPLATES))} FROM words),
found AS (
  SELECT doc_id, len(w) AS n_words, list_concat({', '.join(f"p{k}" for k in range(len(PHRASES)))}) AS spots,
    list_concat({', '.join(f"CASE WHEN len(p{k}) > 0 THEN ['{label}'] ELSE [] END" for k, label in enumerate(PHRASES.values()))}) AS base,
    list_concat({', '.join(f"CASE WHEN len(t{k}) > 0 THEN ['{t.label}'] ELSE [] END" for k, t in enumerate(TEMPLATES))}) AS more,
    list_concat({', '.join(f"t{k}" for k in range(len(TEMPLATES)))}) AS shares FROM places
)
SELECT doc_id, n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
  round(greatest(coalesce(list_max(shares), 0.0), CASE WHEN len(spots) > 0 THEN 0.5 ELSE 0.0 END), 9)::DOUBLE AS score
FROM found
"""
