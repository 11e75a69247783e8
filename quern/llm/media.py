"""Media columns over directories of archives.

Texts become 8-bit grey images 64 samples wide (lossless PNG), stored as members
of tar archives in the shared folder, one archive a task, renamed into place
when whole.  A Python data source plans byte ranges over the archives, streams
the members that begin in a range as Arrow batches, and reads each member again
by its offset when a read fails.  Beside an archive lies a sparse index: the
first member at or after each 64 KB.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import Scratch, column

WIDTH = 64
STEP = 1 << 16
BLOCK = 512


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_image(payload: bytes, level: int = 6) -> bytes:
    """A payload of n * 64 bytes as a grey PNG of n rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> np.ndarray:
    """The samples of an image that encode_image made; ValueError for anything else or a damaged one."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))) != media[at + 8 + size : at + 12 + size]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *_, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not a plain 8-bit grey image")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return np.ascontiguousarray(lines[:, 1:])


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}"
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        at, marks, members, mark = 0, [], 0, 0
        with fs.open_output_stream(part) as out:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    n, payload = payload_of(text)
                    media = encode_image(payload)
                    info = tarfile.TarInfo(f"{'null' if key is None else key}.{n}.png")
                    info.size = len(media)
                    if at >= mark:
                        marks.append(at)
                        mark = (at // STEP + 1) * STEP
                    data = info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % BLOCK)
                    out.write(data)
                    at += len(data)
                    members += 1
            out.write(b"\0" * (2 * BLOCK))
        with fs.open_output_stream(f"{part}.idx") as out:
            out.write(np.array(marks, np.int64).tobytes())
        fs.move(f"{part}.idx", f"{name}.idx")
        fs.move(part, f"{name}.tar")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.tar"]), pa.array([at], pa.int64()), pa.array([members], pa.int64())], names=["archive", "bytes", "members"])

    return run


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write one archive for each partition of docs into `folder`; returns how many members they hold.

    A task that runs again writes the same archive and renames it over the first.
    """
    fs, root = place(folder)
    fs.create_dir(root)
    rows = docs.select(column(id_col).cast("long").alias("i"), column(text_col).alias("t"))
    done = rows.mapInArrow(_write(folder), "archive string, bytes long, members long")
    return int(done.groupBy().sum("members").first()[0] or 0)


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = max(STEP, int(options.get("split_bytes", 16 << 20)) // STEP * STEP)
        self.retries, self.batch = int(options.get("retries", 3)), int(options.get("batch_bytes", 8 << 20))

    def partitions(self) -> list[ByteRange]:
        fs, root = place(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root))
        return [ByteRange(f.path, a, min(a + self.split, f.size)) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".tar") for a in range(0, f.size, self.split)]

    def _member(self, fs, path: str, at: int, held: list):
        """Header and payload at an offset, on a file opened anew for each further try."""
        last = None
        for _ in range(self.retries + 1):
            try:
                if not held:
                    held.append(fs.open_input_file(path))
                head = held[0].read_at(BLOCK, at)
                if not head.strip(b"\0"):
                    return None
                info = tarfile.TarInfo.frombuf(head, "utf-8", "surrogateescape")
                media = held[0].read_at(info.size, at + BLOCK)
                if len(media) < info.size:
                    raise OSError(f"{len(media)} of {info.size} bytes")
                return info.name, info.size, media, None
            except (OSError, tarfile.HeaderError) as error:
                last = error
                held.clear()
        raise OSError(f"{path} at {at}: {last}")

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        fs, _ = place(self.folder)
        with fs.open_input_stream(partition.archive.removesuffix(".tar") + ".idx") as f:
            marks = np.frombuffer(f.read(), np.int64)
        k = int(np.searchsorted(marks, partition.start))
        at = int(marks[k]) if k < len(marks) else partition.end
        held, rows, size = [], [], 0
        while at < partition.end and (got := self._member(fs, partition.archive, at, held)):
            rows.append((got[0], at, got[2]))
            size += got[1]
            at += BLOCK + -(-got[1] // BLOCK) * BLOCK
            if size >= self.batch:
                yield self._batch(partition.archive, rows)
                rows, size = [], 0
        if rows:
            yield self._batch(partition.archive, rows)

    @staticmethod
    def _batch(archive: str, rows: list) -> pa.RecordBatch:
        names, places, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows)), pa.array(names), pa.array(places, pa.int64()), pa.array(media, pa.binary())], names=["archive", "member", "offset", "media"])


class ArchiveSource(DataSource):
    """Members of the tar archives of a folder: archive, member, offset, media.

    Options: path, split_bytes (of a task's range), batch_bytes (of an Arrow
    batch) and retries (of a member).
    """

    @classmethod
    def name(cls) -> str:
        return "quern_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("quern_archive").options(path=folder, **options).load()


def feature_of(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy (bits a sample) and mean step between neighbours."""
    flat = samples.ravel()
    share = np.bincount(flat, minlength=256) / len(flat)
    share = share[share > 0]
    steps = np.abs(np.diff(samples.astype(np.int16), axis=1)).mean()
    return f"{samples.shape[1]}x{samples.shape[0]};mean={flat.mean():.4f};std={flat.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};step={steps:.4f}"


FACTS = {"id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}


def _facts(member: str, media: bytes) -> tuple:
    key, n, _ = member.rsplit(".", 2)
    key, n, stored = None if key == "null" else int(key), int(n), (len(media), hashlib.sha256(media).hexdigest())
    try:
        samples = decode_image(media)
    except (ValueError, TypeError, zlib.error, struct.error) as error:  # one damaged member costs no other
        return key, n, None, None, None, *stored, None, f"{type(error).__name__}: {error}"
    payload = samples.tobytes()
    return key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), *stored, feature_of(samples), None


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_facts(member, media) for member, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(FACTS), FACTS.values(), strict=True)], names=list(FACTS))


def describe(found: DataFrame) -> DataFrame:
    """What media_columns() returns, of archives' members (member, media).

    An image that can't be decoded keeps its row: error says why, and what would
    come from its samples is null.
    """
    return found.select("member", "media").mapInArrow(_describe, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Store each text as an image in archives, read them back and describe them.

    Returns id, n_bytes (UTF-8), payload_bytes (padded), payload_sha256 and
    tail_crc32 (of the samples read back), media_bytes and media_sha256 (of the
    stored image), feature and error (describe()), a row per input row.  Ids
    have to be integers, or strings of them.  Null counts as an empty text of 64
    zero bytes; a null id stays null; rows alike give like values; an empty
    table gives an empty table; other columns play no part.  The images lie
    under the shared folder.
    """
    spark = docs.sparkSession
    folder = f"{Scratch(spark, 'media').path}/archives"
    write_archives(docs, folder, id_col, text_col)
    return describe(read_archives(spark, folder, **options)).withColumnRenamed("id", id_col)
