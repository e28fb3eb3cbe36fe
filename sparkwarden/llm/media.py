"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as the 8-bit grey samples of a PNG image 64
pixels wide, as a member of a plain tar file named by the payload's SHA-256.
Rows carry the digest, the shard and the member's offset and length.  Metadata
columns (width, height, bit depth) come from range reads of the 33 header bytes
only; features come from reading the stored bytes back.

Within a shard equal payloads are stored once; of several shards' copies the
first is the address of a digest, which is all that is read back.  Shards are
written by the task that reads the rows, under a name of the task's own, then
renamed, so a lost task's second run replaces nothing that is in use.

Defined results: null text is an empty payload; an empty payload is 64 zero
bytes; equal payloads get equal values; an empty table writes no shard.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 64
HEADER = 33
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the UTF-8 bytes with zeros up to a positive multiple of 64."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """8-bit grey samples, rows of 64, no row filter."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    scan = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    scan[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(scan, 2)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or len(head) < HEADER:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image as :func:`to_png` writes it; checks every chunk."""
    width, height, _ = png_header(data[:HEADER])
    at, parts = 8, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    scan = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(height, width + 1)
    return np.ascontiguousarray(scan[:, 1:]).tobytes()


def feature(samples: bytes) -> str:
    """Size, mean level, share of zero samples and entropy in bits, as text."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    return f"{WIDTH}x{len(x) // WIDTH};mean={x.mean():.4f};zero={counts[0] / len(x):.4f};bits={-(p * np.log2(p)).sum():.4f}"


class _Shards:
    """Tar files of one task, each closed at about ``SHARD_BYTES``."""

    def __init__(self, where: str) -> None:
        self.system, self.path = fs.FileSystem.from_uri(where)
        self.out = None
        self.name = ""

    def add(self, digest: str, data: bytes) -> tuple[str, int]:
        """Shard and offset of the member's data."""
        if self.out is None:
            self.name = f"shard-{uuid.uuid4().hex}.tar"
            self.system.create_dir(self.path, recursive=True)
            self.out, self.at = self.system.open_output_stream(f"{self.path}/{self.name}.part"), 0
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(bytes(-len(data) % tarfile.BLOCKSIZE))
        name, start = self.name, self.at + len(head)
        self.at = start + len(data) + -len(data) % tarfile.BLOCKSIZE
        if self.at >= SHARD_BYTES:
            self.close()
        return name, start

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.system.move(f"{self.path}/{self.name}.part", f"{self.path}/{self.name}")
            self.out = None


_INDEX = "n_bytes long, digest string, shard string, start long, length long"


def store(docs: DataFrame, where: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads of all rows; id, n_bytes, digest, shard, start, length of each.

    The result is read from a stored index, so using it never writes again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, seen = _Shards(where), {}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                n, payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    image = to_png(payload)
                    seen[digest] = (*shards.add(digest.hex(), image), len(image))
                rows.append((n, digest.hex(), *seen[digest]))
            out = pd.DataFrame(rows, columns=["n_bytes", "digest", "shard", "start", "length"])
            out.insert(0, "id", batch["id"])
            yield out
        shards.close()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return common.stored(rows.mapInPandas(run, f"id {kind}, {_INDEX}").withColumnRenamed("id", id_col), "media-index")


def addresses(index: DataFrame) -> DataFrame:
    """One (digest, shard, start, length) a digest: the first of its copies."""
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "start", "length")).alias("a"))
    return first.select("digest", "a.shard", "a.start", "a.length")


def _in_order(found: DataFrame) -> DataFrame:
    return found.repartition("shard").sortWithinPartitions("shard", "start")


def _reader(where: str):
    system, path = fs.FileSystem.from_uri(where)
    held: dict = {}

    def read(shard: str, start: int, length: int) -> bytes:
        if shard not in held:
            for f in held.values():
                f.close()
            held.clear()
            held[shard] = system.open_input_file(f"{path}/{shard}")
        return held[shard].read_at(length, start)

    return read


def with_metadata(found: DataFrame, where: str) -> DataFrame:
    """``found`` (digest, shard, start, length) with width, height and depth, from headers only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _reader(where)
        for batch in batches:
            meta = [png_header(read(s, a, HEADER)) for s, a in zip(batch["shard"], batch["start"])]
            yield batch.assign(width=[m[0] for m in meta], height=[m[1] for m in meta], depth=[m[2] for m in meta])

    return _in_order(found).mapInPandas(run, "digest string, shard string, start long, length long, width int, height int, depth int")


def read_back(found: DataFrame, where: str) -> DataFrame:
    """What the stored bytes of each digest hold: payload and media digests, lengths, feature.

    The payload's length is told by the header (width * height) and checked
    against what was decoded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _reader(where)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                data = read(r.shard, r.start, r.length)
                payload = from_png(data)
                if len(payload) != r.width * r.height * r.depth // 8:
                    raise ValueError(f"{r.digest}: header and samples differ")
                rows.append((r.digest, r.width, r.height, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            yield pd.DataFrame(rows, columns=["digest", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return with_metadata(found, where).mapInPandas(run, "digest string, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, where: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all payloads under ``where``, read them back, one row per row of ``docs``."""
    where = where or common.new_dir(docs.sparkSession, "media")
    index = store(docs, where, id_col, text_col)
    return index.select(id_col, "n_bytes", "digest").join(read_back(addresses(index), where), "digest")
