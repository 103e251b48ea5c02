"""Byte-level BPE over a corpus: every distinct word is encoded once, and documents are put together from positions."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from hashlib import blake2b
from heapq import heappop, heappush
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, lean_group, slices, tasks, utf8_block
from .words import split_words

#: Bytes of text in a block: what one task holds the positions of at once. A longer text is a block of its own.
BLOCK = 8 << 20
#: Bytes of text that are split into words at once.
STEP = 1 << 19
#: Rows whose ids are put together at once, by their number of words; bytes of a word that is encoded without a heap.
PIECE, SHORT = 1 << 20, 64
#: Word buckets for each shuffle partition; bytes of words and their ids that a bucket's task keeps at once.
BUCKETS_PER_TASK, KNOWN = 4, 32 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of byte strings from a file of base64 and number per line; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the neighbours whose union has the lowest rank, the leftmost of equals, merge until none has one."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > SHORT:
        return encode_long(word, ranks)
    get, none, cuts = ranks.get, len(ranks), list(range(len(word) + 1))
    pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(word[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[word[i:j]] for i, j in zip(cuts, cuts[1:])]


def encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps. Merges of two bytes wait in a sorted array, later ones in a heap, as rank and place in one number.

    Places are bytes: at the first byte of a part stand the end of the part, the part before it, and the rank of its
    union with the next one. An entry counts if that is still its rank.
    """
    n, none = len(word), max(ranks.values()) + 1
    two = np.frombuffer(word, np.uint8)[:-1].astype(np.int64) << 8 | np.frombuffer(word, np.uint8)[1:]
    known = np.full(1 << 16, none, np.int64)
    for code in np.flatnonzero(np.bincount(two, minlength=1 << 16)).tolist():
        known[code] = ranks.get(bytes(divmod(code, 256)), none)
    first = known[two] << 32 | np.arange(n - 1)
    rank = array("q", known[two].tobytes())
    rank.append(none)
    first = np.sort(first[first < none << 32])
    end, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    heap: list[int] = []
    for entry in chain(chain.from_iterable(part.tolist() for part in np.array_split(first, len(first) // 65536 + 1)), [none << 32]):
        while True:
            from_heap = bool(heap) and heap[0] < entry
            r, i = divmod(heappop(heap) if from_heap else entry, 1 << 32)
            if r < none and rank[i] == r:
                gone, to = end[i], end[end[i]]
                rank[gone], end[i] = none, to
                rank[i] = ranks.get(word[i : end[to]], none) if to < n else none
                if to < n:
                    before[to] = i
                if rank[i] < none:
                    heappush(heap, rank[i] << 32 | i)
                if (b := before[i]) >= 0:
                    rank[b] = ranks.get(word[b:to], none)
                    if rank[b] < none:
                        heappush(heap, rank[b] << 32 | b)
            if not from_heap:
                break
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


def packed_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + sum((codes >= 1 << s).astype(np.int8) for s in (7, 14, 21, 28))


def pack(codes: np.ndarray) -> bytes:
    """Numbers under 2**32 as 1 to 5 bytes each, 7 bits a byte, the last one's high bit clear."""
    codes = codes.astype(np.uint32)
    size = packed_sizes(codes)
    width = int(size.max(initial=1))
    out = np.stack([codes >> 7 * k & 127 | 128 for k in range(width)], 1).astype(np.uint8)
    out[np.arange(len(codes)), size - 1] &= 127
    return out[np.arange(width) < size[:, None]].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    value = (raw[begins] & 127).astype(np.int64)
    for k in range(1, int((ends - begins).max(initial=0)) + 1):
        has = begins + k <= ends
        value[has] |= (raw[begins[has] + k] & 127).astype(np.int64) << (7 * k)
    return value


def gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The slices values[starts[w]:starts[w + 1]] for each w in which, one after the other."""
    begin, size = starts[which], starts[which + 1] - starts[which]
    total = int(size.sum())
    if not total:
        return values[:0]
    step = np.ones(total, np.int32 if len(values) < 2**31 else np.int64)
    full = size > 0
    begin, size = begin[full], size[full]
    step[0] = begin[0]
    step[np.cumsum(size)[:-1]] = begin[1:] - (begin[:-1] + size[:-1] - 1)
    return values[np.cumsum(step, dtype=step.dtype)]


def rows_of(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose rows are data's bytes up to each end. Spark's rows can't hold 2 GB, nor can a column of a batch."""
    if len(ends) and ends[-1] >= 2**31:
        raise ValueError("a text's ids or bytes take 2 GB or more")
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after the other, and where each row begins; one more entry ends the last. Null: no bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def assembled(values: np.ndarray, starts: np.ndarray, which: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a list column: first and last row, values, and each row's end in them. Row i has the slices of values that which[at[i]:at[i + 1]] names."""
    row = 0
    while row < len(at) - 1:
        to = min(max(int(np.searchsorted(at, at[row] + PIECE, "right")) - 1, row + 1), len(at) - 1)
        part = which[at[row] : at[to]]
        ends = np.concatenate([[0], np.cumsum(starts[part + 1] - starts[part])])[at[row + 1 : to + 1] - at[row]]
        yield row, to, gather(values, starts, part), ends
        row = to


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Blocks of rows, each with its own number, that of the partition and the block in it, and a digest of its texts."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, text, BLOCK):
            data, at = utf8_block(part.column(text))
            digest = blake2b(data.tobytes(), key=blake2b(at.tobytes(), digest_size=8).digest(), digest_size=8).digest()
            yield number, int.from_bytes(digest, "little", signed=True), part
            number += 1


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Tokens:
    """The token table: the bytes of all ids one after the other, where each begins, and which ids there are."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.known = np.zeros(len(tokens), bool)
        self.known[list(ranks.values())] = True

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """A binary column: the bytes of the ids up to each end."""
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = np.concatenate([[0], np.cumsum(self.starts[1:][ids] - self.starts[ids])])
        return rows_of(gather(self.data, self.starts, ids), sizes[ends])


#: What a row for the words of a block in a bucket has beside its key, block and digest.
PACKED = ("codes", "sizes", "data")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs without text, with ids: the little-endian 32-bit ids of the whole text, each match of pattern encoded separately.

    A task splits its texts into words once and gives two kinds of rows, dealt out by one shuffle: a row per text with
    the numbers of its words in their block, by first occurrence, and rows with a block's distinct words by bucket of
    words. The task of a bucket encodes each distinct word of the corpus once (again only after it has held KNOWN bytes
    of others), and the ids go back to the blocks that hold the word. There they meet the numbers, in the task where
    the shuffle has put them, and give the ids in order. A frequent word is at most once in a block, so no key is hot.

    Both consumers read the same shuffle, so a table whose rows come in another order on each read is read once. If a
    lost executor makes Spark read a part of such a table again, a block's digest of its texts tells, and the job stops
    instead of mixing up words; a table in files, or stored before, gives the same blocks again. With decoded, a column
    of that name has the bytes that the ids stand for. Null texts are empty and get no ids; repeated rows, null keys and
    other columns are kept as they are, but for those named as ids or decoded and _key, _block, _digest, _positions and
    PACKED's names with an underscore. An empty table gives an empty one.
    """
    packed = [f"_{c}" for c in PACKED]
    kept = docs.drop(ids, *([decoded] if decoded else []), "_key", "_block", "_digest", "_positions", *packed)
    rest = [f for f in kept.schema.fields if f.name != text]
    table = docs.sparkSession.sparkContext.broadcast((ranks, Tokens(ranks)))  # the vocabulary: its size doesn't follow the corpus
    buckets = BUCKETS_PER_TASK * tasks(docs.sparkSession)
    own = [T.StructField(c, t) for c, t in (("_key", T.LongType()), ("_block", T.LongType()), ("_digest", T.LongType()), ("_positions", T.BinaryType()), *((c, T.BinaryType()) for c in packed))]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rest), *own])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, digest, part in blocks(batches, text):
            codes: dict[str, int] = {}
            found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for some in slices(part, text, STEP):
                words, which, n = split_words([t or "" for t in some.column(text).to_pylist()], pattern)
                known = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int32, len(words))
                found.append(known[which])
                counts.append(n)
            numbers, counts = np.concatenate(found), np.concatenate(counts)
            ends = np.concatenate([[0], np.cumsum(packed_sizes(numbers), dtype=np.int64)])[np.cumsum(counts)]
            column = {f.name: part.column(f.name) for f in rest} | {"_positions": rows_of(np.frombuffer(pack(numbers), np.uint8), ends)}
            types = {name: c.type for name, c in column.items()}
            column |= {"_key": pa.array(np.full(part.num_rows, number)), "_block": pa.nulls(part.num_rows, pa.int64()), "_digest": pa.array(np.full(part.num_rows, digest))}
            column |= {c: pa.nulls(part.num_rows, pa.binary()) for c in packed}
            yield pa.RecordBatch.from_pydict({f.name: column[f.name] for f in schema.fields})

            words = [w.encode() for w in codes]
            del codes, found, numbers, column
            bucket = np.fromiter(map(crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            key, begins = np.unique(bucket[order], return_index=True)
            rows = []
            for at in np.split(order, begins[1:]) if len(key) else []:
                some = [words[i] for i in at]
                sizes = np.fromiter(map(len, some), np.int64, len(some))
                rows.append((squeeze(pack(np.diff(at, prepend=0))), squeeze(pack(sizes)), squeeze(b"".join(some))))
            column = {name: pa.nulls(len(rows), t) for name, t in types.items()}
            column |= {"_key": pa.array(-1 - key), "_block": pa.array(np.full(len(rows), number)), "_digest": pa.array(np.full(len(rows), digest))}
            column |= {c: pa.array([r[k] for r in rows], pa.binary()) for k, c in enumerate(packed)}
            yield pa.RecordBatch.from_pydict({f.name: column[f.name] for f in schema.fields})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = table.value[0]
        last, known, held = None, {}, 0
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("_block")))
            sizes, data = [], []
            for bucket, size, blob in zip(*(batch.column(c).to_pylist() for c in ("_key", "_sizes", "_data"))):
                if bucket != last or held > KNOWN:  # rows are sorted by bucket
                    last, known, held = bucket, {}, 0
                blob, ends = expand(blob), np.cumsum(unpack(expand(size))).tolist()
                made = []
                for begin, end in zip([0, *ends], ends):
                    word = blob[begin:end]
                    if (found := known.get(word)) is None:
                        found = known[word] = encode_word(word, ranks)
                        held += 200 + len(word) + 8 * len(found)
                    made.append(found)
                sizes.append(squeeze(pack(np.fromiter(map(len, made), np.int64, len(made)))))
                data.append(squeeze(pack(np.fromiter(chain.from_iterable(made), np.int64))))
            yield pa.RecordBatch.from_pydict({"_key": batch.column("_block"), "_digest": batch.column("_digest"), "_codes": batch.column("_codes"), "_sizes": pa.array(sizes, pa.binary()), "_data": pa.array(data, pa.binary())})

    out = T.StructType([*rest, T.StructField(ids, T.BinaryType()), *([T.StructField(decoded, T.BinaryType())] if decoded else [])])

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda name: [unpack(expand(x)) for x in right[name].to_pylist()]
        whole = lambda arrays: np.concatenate([np.zeros(0, np.int64), *arrays])
        begins = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int64)
        of_words = left.num_rows and left["_key"][0].as_py() < 0  # a bucket of words: it has been read on the other side
        kept = left.select([f.name for f in rest])
        codes = np.sort(whole(np.cumsum(x) for x in column("_codes")))
        if of_words:
            kept, which, at = kept.slice(0, 0), np.zeros(0, np.int64), np.zeros(1, np.int64)
        else:
            data, at = bytes_of(left["_positions"])
            at = np.concatenate([[0], np.cumsum(data < 128)])[at]
            which = unpack(data.tobytes())
            digests = {*left["_digest"].unique().to_pylist(), *right["_digest"].unique().to_pylist()}
            if len(digests) > 1 or int(which.max(initial=-1)) + 1 != len(codes) or (codes != np.arange(len(codes))).any():
                raise RuntimeError("the input gave other rows when it was read again: store it first")
        order = np.argsort(whole(np.cumsum(x) for x in column("_codes")))
        sizes = whole(column("_sizes"))
        values = gather(whole(column("_data")), begins(sizes), order).astype("<u4")
        pieces, texts = [], []
        for _, _, found, ends in assembled(values, begins(sizes[order]), which, at):
            pieces.append(rows_of(found.view(np.uint8), ends * 4))
            if decoded:
                texts.append(table.value[1].decoded(found, ends))
        kept = kept.append_column(ids, pa.chunked_array(pieces, pa.binary()))
        return kept.append_column(decoded, pa.chunked_array(texts, pa.binary())) if decoded else kept

    dealt = kept.mapInArrow(lean(split), schema).repartition("_key")
    by_word = dealt.sortWithinPartitions("_key").mapInArrow(lean(encoded), "_key long, _digest long, _codes binary, _sizes binary, _data binary")
    return dealt.groupBy("_key").cogroup(by_word.groupBy("_key")).applyInArrow(lean_group(together), out)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for, in place of a column of that name; null ids: null.

    The token table is joined in each task, since it is of the vocabulary's size. An id that isn't in it raises. Repeated
    rows are decoded one by one; an empty table gives an empty one.
    """
    kept = encoded.drop(to)
    table = encoded.sparkSession.sparkContext.broadcast(Tokens(ranks))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, at = bytes_of(batch.column(ids))
            row, at = 0, at // 4
            while row < batch.num_rows:
                end = min(max(int(np.searchsorted(at, at[row] + PIECE, "right")) - 1, row + 1), batch.num_rows)
                part = batch.slice(row, end - row)
                made = table.value.decoded(blob[4 * at[row] : 4 * at[end]].view("<u4"), at[row + 1 : end + 1] - at[row])
                yield part.append_column(to, pc.if_else(part.column(ids).is_null(), pa.scalar(None, pa.binary()), made))
                row = end

    return kept.mapInArrow(lean(decoded), T.StructType([*kept.schema.fields, T.StructField(to, T.BinaryType())]))


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the installed public tokenizer."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs."""
    ranks, pattern = vocabulary()
    out = encode(docs.select("doc_id", "text"), ranks, pattern, decoded="decoded")
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
