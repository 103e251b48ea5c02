"""Fingerprints of documents: the smallest hashes of their shingles, in DataFrame operations only.

A sketch is an ascending array of at most k distinct hashes (16 hexadecimal digits each, so that they sort as numbers): all
of them for few shingles, else the k smallest. Sketches of a text's parts, or of several texts, merge to that of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tasks

K, WORDS, BLOCK = 128, 5, 256
SPACES = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ranges of ids that a task gets, so that their sizes even out; of a range's texts each meets the next.
RANGES = 4
HASHES = "array<string>"
OWN = ("sketch", "fingerprint", "distinct_shingles")


def plain(text: Column) -> Column:
    """The text with as many code points: ASCII letters in lower case, every white space a blank; null: empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER + SPACES, LOWER + " " * len(SPACES))


def let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def begun() -> Column:
    """What is known before the first word: the smallest hashes, and the last words that the next shingles begin with."""
    return F.struct(F.array().cast(HASHES).alias("least"), F.array().cast(HASHES).alias("last"))


def digest(words: Column) -> Column:
    return F.substring(F.md5(F.array_join(words, " ")), 1, 16)


def read_on(state: Column, text: Column, k: int = K, n: int = WORDS) -> Column:
    """The state after more text, as plain gives it, that begins with a new word. It is taken in blocks of words, so that their number bounds the memory, not the text's."""
    blocks = F.regexp_extract_all(text, F.lit("[^ ]++(?: ++[^ ]++){0,%d}+" % (BLOCK - 1)), F.lit(0))

    def step(s: Column, block: Column) -> Column:
        def of(words: Column) -> Column:
            at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
            hashes = F.transform(at, lambda i: F.substring(F.md5(F.concat_ws(" ", *(F.get(words, i + (j - 1)) for j in range(n)))), 1, 16))
            bound = F.get(s.least, F.lit(k - 1))
            return F.struct(smallest(F.array_union(s.least, F.filter(hashes, lambda h: bound.isNull() | (h < bound))), k).alias("least"), F.slice(words, -F.least(F.size(words), F.lit(n - 1)), n - 1).alias("last"))

        return let(F.concat(s.last, F.split(block, " +")), of)

    return F.aggregate(blocks, state, step)


def finished(state: Column) -> Column:
    """The sketch. With fewer words than a shingle has, the whole sequence is one; without words there is none."""
    return F.when((F.size(state.least) == 0) & (F.size(state.last) > 0), F.array(digest(state.last))).otherwise(state.least)


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    """The sketch of a text's distinct shingles of n words; a null text is empty."""
    return finished(read_on(begun(), plain(text), k, n))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sets' union, exactly."""
    return smallest(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the sets' Jaccard similarity, exact where the union has at most k shingles: the share of the union's k smallest that both have. Two empty sets: 1."""
    share = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(share(u)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has, among those of a below both sketches' last hashes. An empty a: 1; a without such a hash: 0."""
    seen = lambda s, hashes: F.filter(hashes, lambda h: (F.size(s) < k) | (h <= F.element_at(s, -1)))
    share = lambda mine: F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, b)) / F.size(mine)).otherwise(0.0)
    return F.when(F.size(a) == 0, 1.0).when(F.size(b) == 0, 0.0).otherwise(let(seen(b, a), share))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles, exact below k: k - 1 over the k-th smallest hash as a share of all hashes."""
    top = F.conv(F.substring(F.element_at(a, -1), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def fingerprint(a: Column) -> Column:
    """The sketch as one text."""
    return F.array_join(a, "")


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, n: int = WORDS) -> DataFrame:
    """docs with sketch, fingerprint and distinct_shingles, in place of columns of these names.

    Words are runs without ASCII white space, A-Z in lower case. A null or empty text has an empty sketch; equal texts, and
    so repeated rows, have equal ones; an empty table gives an empty one. No shuffle.
    """
    kept = docs.drop(*OWN)
    rows = kept.withColumn("sketch", sketch(F.col(text), k, n))
    return rows.select("*", fingerprint(F.col("sketch")).alias("fingerprint"), distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"))


def merged_sketches(table: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """by and column: the sketch of each group's union. Null groups are groups of their own, groups of empty sketches get an empty one.

    Hashes are told apart first, so a group of many rows is many small groups; then each task keeps the k smallest of a
    group before they meet.
    """
    kept = table.select(*by, F.explode_outer(column).alias("_hash")).groupBy(*by, "_hash").agg(F.lit(1).alias("_one"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_hash").asc_nulls_last()))
    least = kept.select("*", nth.alias("_nth")).filter(F.col("_nth") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def range_starts(docs: DataFrame, key: str, ranges: int) -> list[int]:
    """Ids at which ranges of about equally many rows begin, the smallest first; their number is a parameter."""
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    row = docs.agg(F.min(key).alias("least"), F.percentile_approx(key, shares, 10 * ranges if ranges > 1000 else 10_000).alias("others")).first()
    return sorted({row["least"], *(row["others"] or ())}) if row["least"] is not None else []


def range_of(key: Column, starts: Column, size: int) -> Column:
    """The number of the last start that isn't above the key, by halving; 0 for a null key."""
    steps = [1 << i for i in reversed(range(max(size - 1, 1).bit_length()))]
    fits = lambda at: (at < size) & F.coalesce(F.get(starts, at) <= key, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(fits(at + s), at + s).otherwise(at))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> tuple[DataFrame, object]:
    """key, text, next_text (the text of the next document by key, of the first after the last), and what the next steps need; see edited_fingerprints.

    Null keys come first, equal keys stand by their texts, null texts are empty. Rows go by range of keys to their places,
    and the text at which a range begins goes along with the range before it: one shuffle of texts, no order over all rows.
    Rows of one key meet in one range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = range_starts(rows, "id", ranges or RANGES * tasks(spark))
    size = max(len(found), 1)
    starts = F.split(F.lit(",".join(map(str, found))), ",").cast("array<long>") if found else F.array().cast("array<long>")
    own = rows.select(range_of(F.col("id"), starts, size).alias("range"), F.lit(0).alias("after"), "id", "text")
    begins = F.col("id").isNull() | (F.get(starts, F.col("range")) == F.col("id"))
    firsts = own.filter(begins).groupBy("range", "id").agg(F.min("text").alias("text"))
    firsts = firsts.select(F.when(F.col("id").isNull() | (F.col("range") == 0), size - 1).otherwise(F.col("range") - 1).alias("range"), F.lit(1).alias("after"), "id", "text")
    order = Window.partitionBy("range").orderBy("after", F.col("id").asc_nulls_first(), "text")
    return own.unionByName(firsts).select("*", F.lead("text").over(order).alias("next_text")), order


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, n: int = WORDS, part: int = 4, ranges: int | None = None) -> DataFrame:
    """id, text, edited (the last floor(n_chars / part) code points replaced by the first as many, or all, of the next document), and the three sketches: sketch, edited_sketch, next_sketch.

    What a text and its edited form share is sketched once: both go on from the state at the last blank before the edit.
    Nulls, ties and the order are those of with_next; repeated rows are each other's next; an empty table gives an empty one.
    """
    rows, order = with_next(docs, key, text, ranges)
    cut = F.floor(F.length("text") / part).cast("int")
    rows = rows.withColumn("_cut", cut).withColumn("_kept", F.length("text") - F.col("_cut")).withColumn("_plain", plain(F.col("text")))
    head = F.substr(F.col("_plain"), F.lit(1), F.col("_kept"))
    rows = rows.withColumn("_open", F.substring_index(head, " ", -1))  # the word that the edit may go on with
    rows = rows.withColumn("_state", read_on(begun(), F.substr(F.col("_plain"), F.lit(1), F.col("_kept") - F.length("_open")), k, n))
    rest = F.concat("_open", F.substr(F.col("_plain"), F.col("_kept") + 1))
    given = F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), F.col("_cut"))
    rows = rows.select(
        "range", "after", "id", "text",
        F.concat(F.substr("text", F.lit(1), F.col("_kept")), given).alias("edited"),
        finished(read_on(F.col("_state"), rest, k, n)).alias("sketch"),
        finished(read_on(F.col("_state"), F.concat("_open", plain(given)), k, n)).alias("edited_sketch"),
    )
    return rows.select("*", F.lead("sketch").over(order).alias("next_sketch")).filter("after = 0").drop("range", "after")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = edited_fingerprints(docs)
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(own).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"),
        F.round(resemblance(own, edited), 9).alias("near_edited"), F.round(resemblance(own, after), 9).alias("near_next"),
        F.round(containment(edited, own), 9).alias("edited_in_text"), F.round(distinct_shingles(own), 3).alias("distinct_shingles"),
    )


def _sketch_sql(w: str) -> str:
    shingles = f"list_transform(range(1, len({w}) - {WORDS - 2}), lambda i: array_to_string({w}[i:i + {WORDS - 1}], ' '))"
    whole = f"CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < {WORDS} THEN [array_to_string({w}, ' ')] ELSE {shingles} END"
    return f"list_sort(list_distinct(list_transform({whole}, lambda s: substr(md5(s), 1, 16))))[1:{K}]"


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"


def _near_sql(a: str, b: str) -> str:
    union = f"list_sort(list_distinct(list_concat({a}, {b})))[1:{K}]"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_filter({union}, lambda h: list_contains({a}, h) AND list_contains({b}, h))) / len({union}) END"


_SEEN = f"list_filter(e, lambda h: len(s) < {K} OR h <= s[-1])"
OP12_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ordered AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM docs WINDOW o AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
edits AS (SELECT doc_id, text, next_text, substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) AS edited FROM ordered),
split AS (SELECT *, {_words_sql('text')} AS w, {_words_sql('edited')} AS we, {_words_sql('next_text')} AS wn FROM edits),
sketches AS (SELECT doc_id, text, edited, {_sketch_sql('w')} AS s, {_sketch_sql('we')} AS e, {_sketch_sql('wn')} AS n FROM split)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, coalesce(array_to_string(s, ''), '') AS fingerprint, coalesce(array_to_string(e, ''), '') AS edited_fingerprint,
  round({_near_sql('s', 'e')}, 9)::DOUBLE AS near_edited, round({_near_sql('s', 'n')}, 9)::DOUBLE AS near_next,
  round(CASE WHEN len(e) = 0 THEN 1.0 WHEN len(s) = 0 THEN 0.0 WHEN len({_SEEN}) = 0 THEN 0.0 ELSE len(list_filter({_SEEN}, lambda h: list_contains(s, h))) / len({_SEEN}) END, 9)::DOUBLE AS edited_in_text,
  round(CASE WHEN len(s) < {K} THEN len(s) ELSE {K - 1} / (('0x' || substr(s[-1], 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE) END, 3)::DOUBLE AS distinct_shingles
FROM sketches
"""
