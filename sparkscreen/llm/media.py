"""Media columns: payloads stored as 8-bit sound in archives, and a Spark data source that reads them.

``write_media`` stores each payload as a WAV file (8-bit mono) in ZIP archives, a few for each task.
``MediaArchiveSource`` plans byte ranges over the archives from their sizes alone; a task takes the
members whose header lies in its range from the archive's directory, reads each by its offset, again
on its own if that fails, and streams Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import wave
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch_path, table, text_or_empty

UNIT, ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES, RATE = 192, 64 << 20, 16 << 20, 8 << 20, 3, 8000


def to_payload(text: str) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with spaces up to a positive multiple of ``UNIT``."""
    raw = text.encode()
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Archives under ``folder``; returns how many. Null texts count as empty.

    A task writes under a name of its own and renames at the end, so one that runs again leaves
    whole archives. Ids of any JSON kind, null included, go into each member's comment.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        context, made, used, zipped, out, at = TaskContext.get(), [], 0, None, None, 0

        def close():
            zipped.close()
            out.close()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if zipped is None or used > archive_bytes:
                    if zipped is not None:
                        close()
                    else:
                        store.create_dir(root, recursive=True)
                    made.append((f"{root}/_{context.taskAttemptId()}-{len(made)}", f"{root}/media-{context.partitionId():06d}-{len(made):04d}.zip"))
                    out, used = store.open_output_stream(made[-1][0]), 0
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                n, payload = to_payload(text)
                info = zipfile.ZipInfo(f"{at:09d}.wav")
                info.compress_type, info.comment = zipfile.ZIP_DEFLATED, json.dumps([doc, n]).encode()
                zipped.writestr(info, to_wav(payload), compresslevel=1)
                used, at = used + info.compress_size, at + 1
        if zipped is not None:
            close()
        for own, name in made:
            store.move(own, name)
        yield pa.RecordBatch.from_pydict({"archives": [len(made)]}, pa.schema([("archives", pa.int64())]))

    return rows.mapInArrow(write, "archives long").agg(F.coalesce(F.sum("archives"), F.lit(0))).first()[0]


@dataclass
class ByteRange(InputPartition):
    path: str
    lo: int
    hi: int


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.folder, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.tries, self.batch_bytes = int(options.get("tries", TRIES)), int(options.get("batchbytes", BATCH_BYTES))
        self.id_type = options.get("idtype", "bigint")

    def partitions(self) -> list[ByteRange]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("media-"))
        return [ByteRange(p, lo, min(size, lo + self.range_bytes)) for p, size in found for lo in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        self.file = store.open_input_file(partition.path)
        with zipfile.ZipFile(self.file) as z:
            members = sorted((i for i in z.infolist() if partition.lo <= i.header_offset < partition.hi), key=lambda i: i.header_offset)
        rows, held = [], 0
        for info in members:
            media = self._member(store, partition.path, info)
            rows.append((*json.loads(info.comment), media))
            held += len(media)
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _member(self, store: fs.FileSystem, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset; on failure the file is opened anew for this member alone."""
        for n in range(self.tries):
            try:
                self.file.seek(info.header_offset)
                head = self.file.read(30)
                names = sum(struct.unpack("<HH", head[26:30]))
                self.file.seek(info.header_offset + 30 + names)
                raw = self.file.read(info.compress_size)
                media = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else raw
                if head[:4] != b"PK\x03\x04" or len(media) != info.file_size or zlib.crc32(media) != info.CRC:
                    raise OSError(f"{path} at {info.header_offset}: bytes differ from the directory")
                return media
            except (OSError, zlib.error, struct.error):
                if n + 1 == self.tries:
                    raise
                time.sleep(0.1 * 2**n)
                self.file = store.open_input_file(path)
        raise AssertionError

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, media = zip(*rows)
        kind = pa.int64() if self.id_type == "bigint" else pa.string()
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: doc_id, n_bytes, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return f"doc_id {self.options.get('idtype', 'bigint')}, n_bytes bigint, media binary"

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader(self.options, schema)


def sound_feature(payload: bytes) -> str:
    """Mean, root mean square, sign changes and the shares of eight frequency bands, over all frames."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    frames = x.reshape(-1, UNIT)
    bands, step = np.zeros(8), 4096
    for at in range(0, len(frames), step):
        power = np.abs(np.fft.rfft(frames[at : at + step], axis=1)[:, 1:]) ** 2
        bands += power.reshape(len(power), 8, -1).sum(axis=(0, 2), dtype=np.float64)
    shares = bands / (bands.sum() or 1)
    changes = np.count_nonzero(np.diff(np.signbit(x - x.mean()))) / len(x)
    return f"mean={x.mean(dtype=np.float64):.3f};rms={np.sqrt(np.square(x, dtype=np.float64).mean()):.3f};zcr={changes:.4f};bands=" + ",".join(f"{s:.4f}" for s in shares)


def media_columns(media: DataFrame) -> DataFrame:
    """Columns computed from the stored bytes that were read back."""

    def compute(batches):
        for batch in batches:
            out = []
            for stored in batch.column(2).to_pylist():
                p = from_wav(stored)
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), sound_feature(p)))
            cols = list(zip(*out)) if out else [[]] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(compute, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_media(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "media")
    write_media(table(spark, sf_dir, "documents"), folder)
    return media_columns(read_media(spark, folder))
