"""Fill-in-the-middle: texts cut at two drawn unit boundaries, which chunks of bytes find by counts, and put in another order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, utf8_block

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, without the one byte of the next chunk that it overlaps.
CHUNK = 1 << 14
#: Bytes of text that are cut in one go.
BLOCK = 4 << 20
OWN = ("n", "form", "prefix_chars", "middle_chars", "output")

Boundary = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Does a unit end between a byte and the next one? Of UTF-8, whose codes below 128 stand for themselves only.
UNITS: dict[str, Boundary] = {
    "line": lambda a, b: a == 0x0A,
    "char": lambda a, b: (b & 0xC0) != 0x80,
    "word": lambda a, b: ((a == 0x20) | (a >= 0x09) & (a <= 0x0D)) & ~((b == 0x20) | (b >= 0x09) & (b <= 0x0D)),
}


def chunk_bounds(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts lie one after the other, text t from starts[t] to starts[t + 1]. Of their chunks: where each begins and ends, and each text's first chunk (one more entry ends the last)."""
    n = -(-np.diff(starts) // size)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    begin = starts[text] + (np.arange(first[-1]) - first[text]) * size
    return begin, np.minimum(begin + size, starts[text + 1]), first


def unit_counts(data: np.ndarray, starts: np.ndarray, boundary: Boundary, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Boundaries inside each text, the running count of all chunks before each chunk, and the chunks.

    A chunk sees one byte of the next one, so a predicate on two adjacent bytes is decided in exactly one chunk; a text's
    last byte has no next one and no boundary after it. Chunks don't depend on each other.
    """
    begin, end, first = chunk_bounds(starts, size)
    ends = np.append(starts[1:], -1)
    inner = np.where(np.isin(end, ends), end - 1, end)  # the last chunk of a text has no byte to overlap
    counts = np.fromiter((np.count_nonzero(boundary(data[b:e], data[b + 1 : e + 1])) for b, e in zip(begin, inner)), np.int64, len(begin))
    before = np.concatenate([[0], np.cumsum(counts)])
    return before[first[1:]] - before[first[:-1]], before, (begin, inner, first)


def cut_places(data: np.ndarray, starts: np.ndarray, ranks: np.ndarray, boundary: Boundary, counted=None, size: int = CHUNK) -> np.ndarray:
    """Where the first ranks[t] units of text t end, as a place in data. Only the chunk that holds the boundary is looked at again."""
    inside, before, (begin, inner, first) = counted or unit_counts(data, starts, boundary, size)
    out = np.where(ranks <= 0, starts[:-1], starts[1:])
    for t in np.flatnonzero((ranks > 0) & (ranks <= inside)):
        rank = before[first[t]] + ranks[t]  # among all texts' boundaries
        c = int(np.searchsorted(before, rank)) - 1
        at = np.flatnonzero(boundary(data[begin[c] : inner[c]], data[begin[c] + 1 : inner[c] + 1]))
        out[t] = begin[c] + at[rank - before[c] - 1] + 1
    return out


def characters(data: np.ndarray, begin: int, end: int) -> int:
    return int(np.count_nonzero((data[begin:end] & 0xC0) != 0x80))


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers: the first n groups of eight digits of the digest of seed and key (decimal; null: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def infill(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", boundary: Boundary | None = None, chunk: int = CHUNK) -> DataFrame:
    """docs with n (units of the text), form, prefix_chars, middle_chars and output, in place of columns of these names.

    The prefix ends after the smaller of two ranks drawn from 0 to n by the digest of seed and key, the middle after the
    larger. rate of 100 texts are cut, spm of 100 of these in the form spm, the others psm: `<P>`prefix`<S>`suffix`<M>`middle,
    or `<S>`suffix`<P>`prefix`<M>`middle. A null text is empty; an empty text, and one that holds one of the three marks,
    is plain: its output is the text, its parts have no length. Equal keys get equal draws, and a null key those of an empty
    one; repeated rows are cut one by one; an empty table gives an empty one. unit is line, char, word (with the white
    space after it), or any boundary of two adjacent bytes.

    Nothing is shuffled: a batch's texts lie one after the other in chunks that overlap by a byte, each chunk counts its
    boundaries by itself, running sums of the counts tell which chunk holds which rank, and only those are searched.
    A text's memory is a few times its own size.
    """
    ends = boundary or UNITS[unit]
    kept = docs.drop(*OWN)
    names = kept.columns
    h = draws(F.col(key), seed)
    work = kept.select(F.struct(*names).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(h, 1)))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                yield cut_block(part)

    def cut_block(part: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = utf8_block(part.column("text"))
        counted = unit_counts(data, starts, ends, chunk)
        n = np.where(np.diff(starts) > 0, counted[0] + 1, 0)
        h1, h2, h3, h4 = (part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
        ranks = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
        low, high = (cut_places(data, starts, np.where(r >= n, counted[0] + 1, r), ends, counted, chunk) for r in ranks)
        raw, forms, outputs, sizes = data.tobytes(), [], [], ([], [])
        for t, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            whole = raw[a:z]
            if not whole or any(m.encode() in whole for m in (PREFIX, SUFFIX, MIDDLE)) or h3[t] % 100 >= rate:
                forms.append("plain"), outputs.append(whole), sizes[0].append(None), sizes[1].append(None)
                continue
            p, m = int(low[t]), int(high[t])
            first, second = (PREFIX.encode() + raw[a:p], SUFFIX.encode() + raw[m:z])
            forms.append("spm" if h4[t] % 100 < spm else "psm")
            outputs.append(b"".join((second, first) if forms[-1] == "spm" else (first, second)) + MIDDLE.encode() + raw[p:m])
            sizes[0].append(characters(data, a, p)), sizes[1].append(characters(data, p, m))
        columns = [part.column("row"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *(pa.array(s, pa.int64()) for s in sizes), pa.array(outputs, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["row", *OWN])

    schema = work.select("row").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return work.mapInArrow(cut, schema).select("row.*", *OWN)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output and its form. A text that is cut holds no mark, and none can come about where parts meet."""
    parts = lambda first, second: (F.substring_index(F.substr(output, F.lit(len(first) + 1)), second, 1), F.substring_index(F.substring_index(output, MIDDLE, 1), second, -1))
    prefix, suffix = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix = parts(SUFFIX, PREFIX)
    middle = F.substring_index(output, MIDDLE, -1)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, middle, late_suffix)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = infill(docs)
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_H = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
OP13_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
units AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, {_H} FROM docs),
ranks AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM units),
forms AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM ranks
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM forms
"""
