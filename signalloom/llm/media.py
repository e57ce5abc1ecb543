"""Media columns: content-addressed payloads in tar shards, with metadata filled by range reads of headers.

A payload is stored as an 8-bit grey PNG, 64 samples wide. Each scan task appends the media it meets to its own tar
shards in the shared folder and returns an index of digest, shard, offset and length; payloads are never shuffled.
A digest that several shards hold keeps one entry, the first by (shard, offset). Rows then carry digest, offset and
length. The header pass reads 33 bytes of each object; payloads are read back only where asked for.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import shared

WIDTH = 64
HEADER = 33  # signature and IHDR chunk
#: A shard is closed beyond so many bytes.
SHARD_BYTES = 256 << 20
#: Digests a task remembers, so that copies near each other are stored once.
REMEMBERED = 100_000

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The payload, a positive multiple of WIDTH bytes, as rows of grey samples without prediction."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(data: bytes) -> bytes:
    width, height, _ = header_of(data[:HEADER])
    packed, at = [], 8
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without prediction are stored here")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size, mean sample and a 64-bit difference hash of the column means."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    columns = rows.sum(axis=0, dtype=np.int64)
    bits = columns > np.roll(columns, 1)
    return f"{WIDTH}x{len(rows)}:{columns.sum() / rows.size:.3f}:{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


class ShardWriter:
    """Tar shards of one task. Names are unique to the attempt: only what a task returns counts, a retry writes anew."""

    def __init__(self, folder: str):
        self.folder, self.out = folder, None

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            files, root = pafs.FileSystem.from_uri(self.folder)
            files.create_dir(root, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = files.open_output_stream(f"{root}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.PAX_FORMAT)
        offset = self.at + len(head)
        self.out.write(head + data + bytes(-len(data) % tarfile.BLOCKSIZE))
        self.at = offset + len(data) + -len(data) % tarfile.BLOCKSIZE
        found = (self.name, offset, len(data))
        if self.at >= SHARD_BYTES:
            self.close()
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


class ShardReader:
    """Range reads, with a few shards kept open."""

    def __init__(self, folder: str, most: int = 16):
        self.folder, self.most, self.open = folder, most, OrderedDict()

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            files, root = pafs.FileSystem.from_uri(self.folder)
            self.open[shard] = files.open_input_file(f"{root}/{shard}")
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(shard)
        return self.open[shard].read_at(length, offset)


def with_digests(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_bytes and the payload's digest, all computed in the JVM; null texts count as empty."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    n = F.octet_length(data)
    padded = F.greatest(F.lit(WIDTH), WIDTH * F.ceil(n / WIDTH)).cast("int")
    return shared.slim(docs, "doc_id", "text").select(
        "doc_id", "text", n.cast("bigint").alias("n_bytes"), F.sha2(F.call_function("rpad", data, padded, F.lit(bytearray(b"\0"))), 256).alias("digest")
    )


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write every distinct payload of ``docs`` into tar shards under ``folder``; the index: digest, shard, offset, length.

    The index is checkpointed, so a later loss of executors writes no shard again. Attempts that failed leave shards
    that no index row names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, seen = ShardWriter(folder), OrderedDict()
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text"):
                payload = payload_of(text.as_py())
                digest = hashlib.sha256(payload).hexdigest()
                if digest in seen:
                    continue
                seen[digest] = True
                if len(seen) > REMEMBERED:
                    seen.popitem(last=False)
                rows.append((digest, *writer.add(digest, to_png(payload))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["digest", "shard", "offset", "length"])
        writer.close()

    written = shared.cut(shared.slim(docs, "text").mapInArrow(shared.tidy(run), "digest string, shard string, offset bigint, length bigint"))
    return written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and bits, from HEADER bytes of each object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(folder)
        for batch in batches:
            heads = [header_of(reader.read(s, o, HEADER)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            more = [pa.array([h[k] for h in heads], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["digest", "shard", "offset", "length", "width", "height", "bits"])

    ordered = index.select("digest", "shard", "offset", "length")
    return ordered.mapInArrow(shared.tidy(run), "digest string, shard string, offset bigint, length bigint, width bigint, height bigint, bits bigint")


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """digest, payload and media digests and sizes, the checksum of the payload's tail, and its feature, all read back."""
    names = ["digest", "shard", "offset", "length", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(folder)
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                data = reader.read(shard, offset, length)
                payload = from_png(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            more = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:6]] + more, names=names)

    schema = "digest string, shard string, offset bigint, length bigint, width bigint, height bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return index.select(*names[:6]).mapInArrow(shared.tidy(run), schema)


def attach(docs: DataFrame, folder: str) -> DataFrame:
    """Documents with their media columns: doc_id, n_bytes, digest, shard, offset, length, width, height and features.

    Null and empty texts have the payload of 64 zero bytes; equal texts share one stored object, repeated rows repeat
    the columns; an empty table gives an empty result. Ids may be null. Columns besides doc_id and text are left out.
    The join on digest is a plain one, so that adaptive execution can split a digest that very many rows carry.
    """
    index = store(docs, folder)
    found = read_features(read_headers(index, folder), folder)
    return with_digests(docs).drop("text").join(found, "digest", "left")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stored payload, read back from its shard, with digests and features."""
    media = attach(shared.table(spark, sf_dir, "documents"), shared.scratch(spark, "media"))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def brute(documents: list[tuple]) -> list[tuple]:
    """The contract of op4 without shards, for tests."""
    out = []
    for doc, text in documents:
        payload = payload_of(text)
        data = to_png(payload)
        with io.BytesIO(data) as f:
            back = from_png(f.read())
        n = len((text or "").encode())
        out.append((doc, n, len(back), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload)))
    return out
