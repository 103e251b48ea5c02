"""Ogg media columns: a container writer, and a reader that checks pages, rebuilds packets and tells their times."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, slices

RATE, CHANNELS, PACKET, SEGMENTS = 8000, 2, 6000, 64
MAGIC = b"PCM8"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Every byte with its bits in reverse.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """Ogg's checksum: polynomial 0x04C11DB7, highest bit first, from 0 and without a final change.

    The usual CRC-32 has the same polynomial with the lowest bit first, so it is taken of reversed bytes and reversed.
    """
    low = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    data = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return data[:22] + page_crc(data).to_bytes(4, "little") + data[26:]


def stream_pages(packets: list[bytes], ends: list[int], serial: int) -> list[tuple[int, bytes]]:
    """The pages of one logical stream after its header packet, which fills the first page; each with its time for interleaving."""
    out = [(-1, page(FIRST, 0, serial, 0, bytes([len(packets[0])]), packets[0]))]
    lacing, body, done = bytearray(), bytearray(), bytearray()
    for p in packets[1:]:
        n = len(p)
        lacing += b"\xff" * (n // 255) + bytes([n % 255])
        done += b"\0" * (n // 255) + b"\1"
        body += p
    at, packet, granule, cut = 0, 0, 0, False
    for number, start in enumerate(range(0, len(lacing), SEGMENTS), 1):
        part = bytes(lacing[start : start + SEGMENTS])
        size, ended = sum(part), done[start : start + SEGMENTS].count(1)
        packet += ended
        granule = ends[packet - 1] if ended else -1
        last = start + SEGMENTS >= len(lacing)
        out.append((ends[max(packet - 1, 0)], page(CONTINUED * cut | LAST * last, granule, serial, number, part, bytes(body[at : at + size]))))
        at, cut = at + size, part[-1] == 255
    return out


def write_ogg(payload: bytes) -> bytes:
    """8-bit samples of two channels, each a logical stream; packets of PACKET samples, a granule per sample."""
    pages: list[tuple[int, int, bytes]] = []
    for c in range(CHANNELS):
        samples = payload[c::CHANNELS]
        packets = [samples[i : i + PACKET] for i in range(0, len(samples), PACKET)]
        ends = [min((i + 1) * PACKET, len(samples)) for i in range(len(packets))]
        head = MAGIC + struct.pack("<BBI", c, CHANNELS, RATE)
        pages += [(time, c, data) for time, data in stream_pages([head, *packets], ends, c + 1)]
    return b"".join(data for _, _, data in sorted(pages, key=lambda x: x[:2]))


@dataclass
class Stream:
    """A logical stream as far as it has been read: packets, and the sample at which each ends (None: unknown)."""

    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)
    part: bytes = b""
    number: int = -1
    over: bool = False


def read_ogg(data: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and the number of pages. Raises ValueError at the first page that is wrong."""
    streams: dict[int, Stream] = {}
    at = pages = 0
    while at < len(data):
        if len(data) < at + HEADER.size:
            raise ValueError(f"page {pages}: cut header")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"page {pages}: no capture pattern")
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(lacing)
        if end > len(data) or len(lacing) < n:
            raise ValueError(f"page {pages}: cut body")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"page {pages}: checksum")
        if bool(flags & FIRST) == (serial in streams):
            raise ValueError(f"page {pages}: stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if number != s.number + 1 or s.over or bool(flags & CONTINUED) != bool(s.part):
            raise ValueError(f"page {pages}: out of order")
        at, before = at + HEADER.size + n, len(s.packets)
        size = 0
        for x in lacing:
            size += x
            if x < 255:
                s.packets.append(s.part + data[at : at + size])
                at, size, s.part = at + size, 0, b""
        s.part += data[at:end]
        at, pages = end, pages + 1
        s.number, s.over = number, bool(flags & LAST)
        known: list[int | None] = []  # from the page's granule position backwards: a packet has a sample per byte
        for p in reversed(s.packets[before:]):
            known.append(None if granule < 0 else granule)
            granule -= len(p) if granule >= 0 else 0
        s.ends += reversed(known)
    if any(not s.over or s.part for s in streams.values()):
        raise ValueError("a stream doesn't end")
    return streams, pages


def read_payload(data: bytes) -> tuple[bytes, str]:
    """The payload of write_ogg's containers, and their features. Raises ValueError if anything is wrong."""
    streams, pages = read_ogg(data)
    channels: dict[int, bytes] = {}
    for s in streams.values():
        head = s.packets[0]
        if head[:4] != MAGIC:
            raise ValueError("no sample stream")
        number, total, rate = struct.unpack("<BBI", head[4:10])
        if s.ends[1:] and s.ends[-1] != sum(map(len, s.packets[1:])):
            raise ValueError("granule positions don't fit the samples")
        channels[number] = b"".join(s.packets[1:])
    if not channels or sorted(channels) != list(range(total)):
        raise ValueError("a channel is missing")
    payload = bytearray(sum(map(len, channels.values())))
    for c, samples in channels.items():
        payload[c::total] = samples
    packets, samples = sum(len(s.packets) - 1 for s in streams.values()), max(s.ends[-1] or 0 for s in streams.values())
    peak, low = (max(payload), min(payload)) if payload else (0, 0)
    return bytes(payload), f"streams={len(streams)};pages={pages};packets={packets};seconds={samples / rate:.6f};peak={peak};low={low}"


def pad(data: bytes, to: int = 64) -> bytes:
    """Bytes 0 up to a positive multiple of to."""
    return data + b"\0" * (max(to, -(-len(data) // to) * to) - len(data))


def add_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the padded UTF-8 bytes of the text (null: none) in an Ogg container, in place of a column of that name.

    Work is row by row: no shuffle, and a task holds one part of a batch. Equal texts get equal containers.
    """
    kept = docs.drop(media)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 8 << 20):
                made = [write_ogg(pad((t or "").encode())) for t in part.column(text).to_pylist()]
                yield part.append_column(media, pa.array(made, pa.binary()))

    return kept.mapInArrow(lean(encode), T.StructType([*kept.schema.fields, T.StructField(media, T.BinaryType())]))


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with payload, feature and media_error: what the containers hold, or null and what is wrong (null: nothing).

    A null container gives three nulls. The columns replace those of these names.
    """
    kept = df.drop("payload", "feature", "media_error")

    def one(data: bytes | None) -> tuple[bytes | None, str | None, str | None]:
        try:
            return (None, None, None) if data is None else (*read_payload(data), None)
        except (ValueError, struct.error) as e:
            return None, None, str(e)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                payload, feature, error = zip(*map(one, part.column(media).to_pylist()))
                for name, values, kind in (("payload", payload, pa.binary()), ("feature", feature, pa.string()), ("media_error", error, pa.string())):
                    part = part.append_column(name, pa.array(values, kind))
                yield part

    fields = [T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("media_error", T.StringType())]
    return kept.mapInArrow(lean(decode), T.StructType([*kept.schema.fields, *fields]))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = add_media(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "media")
    return read_media(stored).select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
