"""Media columns: texts stored as gray images in archives, and a Spark data source that reads archive members back.

Storage: the UTF-8 bytes, padded with 255 to a positive multiple of 576, are the samples of an 8-bit gray PNG 576 samples wide. Each
task writes ZIP archives of its own into the shared folder and reports them, so only archives of tasks that ended well are read.

Data source: plans byte ranges over the reported archives (or all archives below a folder) from their sizes alone. A reader loads an
archive's central directory, takes the members whose offset lies in its range, reads each by its offset, checks its CRC-32, and on
failure opens the archive anew and retries that member alone. Members leave in Arrow batches of bounded bytes.

Defined results: a null text is empty and stores 576 bytes of 255; repeated rows are members of their own; an empty table gives no
archive and an empty result; a member is held whole, one at a time beside the batch. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarryline.llm import _shared, _text

UNIT = 576
ROLL_BYTES = 256 << 20
RANGE_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit gray PNG, 576 samples wide, no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples, a row for each line, of an 8-bit gray PNG without interlacing whose rows have filter 0, 1 or 2. CRCs are verified."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, body, shape = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's CRC differs")
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if (depth, color, interlace) != (8, 0, 0):
                raise ValueError("no 8-bit gray image")
            shape = height, width + 1
        elif kind == b"IDAT":
            body.append(part)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape)
    kinds, out = lines[:, 0], lines[:, 1:]
    if kinds.any():
        out = out.copy()
        for i, kind in enumerate(kinds):
            if kind == 1:
                out[i] = np.cumsum(out[i], dtype=np.uint64).astype(np.uint8)
            elif kind == 2:
                out[i] += out[i - 1] if i else 0
            elif kind:
                raise ValueError(f"row filter {kind}")
    return out


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy of samples, mean step to the next sample and the commonest sample, in fixed decimals."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    p = counts[counts > 0] / len(flat)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(flat))
    dev = float(np.sqrt(max((counts * values**2).sum() / len(flat) - mean**2, 0)))
    steps = np.abs(flat[1:].astype(np.int16) - flat[:-1])
    return f"mean={mean:.4f};dev={dev:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={float(steps.sum()) / len(steps):.4f};mode={int(counts.argmax())};rows={len(samples)}"


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """Stores every text as a member; a row (path, n_members, n_bytes) for each archive. The caller must materialise it.

    Members are named by number, n_bytes of the text and id, separated by "-"; a null id is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _shared.file_system(folder)
        done, stream, archive = [], None, None

        def close():
            archive.close()
            stream.close()
            done.append((path, count, fs.get_file_info(path).size))

        for b in _text.slices(batches, "text"):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if archive is None:
                    fs.create_dir(base, recursive=True)
                    path, size, count = f"{base}/{uuid.uuid4().hex}.zip", 0, 0
                    stream = fs.open_output_stream(path, compression=None)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
                raw = (text or "").encode()
                png = to_png(padded(raw), level)
                archive.writestr(zipfile.ZipInfo(f"{count:08d}-{len(raw)}-{'' if doc_id is None else doc_id}"), png)
                count, size = count + 1, size + len(png)
                if size >= ROLL_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "n_members", "n_bytes"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, "path string, n_members long, n_bytes long")


@dataclass
class ByteRange(InputPartition):
    """Members of one archive whose offset lies from start, before end."""

    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.listed = options.get("manifest")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", _text.STEP_BYTES))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        """Sizes only: no archive is opened here."""
        from pyarrow import fs as pafs, parquet

        fs, base = _shared.file_system(self.folder)
        if self.listed:
            where, listed = _shared.file_system(self.listed)
            table = parquet.read_table(listed, columns=["path", "n_bytes"], filesystem=where)
            found = list(zip(*(c.to_pylist() for c in table.columns), strict=True)) if table.num_rows else []
        else:
            found = [(x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)) if x.path.endswith(".zip")]
        return [ByteRange(path, at, min(at + self.range_bytes, size)) for path, size in sorted(found) for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def member(self, fs, stream, path: str, info: zipfile.ZipInfo):
        """(stream, payload) of the member at its offset. Each try after the first opens the archive anew."""
        for left in range(self.retries, -1, -1):
            try:
                if stream is None:
                    stream = fs.open_input_file(path)
                stream.seek(info.header_offset)
                head = stream.read(30)
                if len(head) < 30 or head[:4] != b"PK\x03\x04":
                    raise OSError(f"no member at {info.header_offset}")
                name, extra = struct.unpack("<HH", head[26:30])
                stream.seek(info.header_offset + 30 + name + extra)
                data = stream.read(info.compress_size)
                payload = zlib.decompress(data, -15) if info.compress_type == zipfile.ZIP_DEFLATED else data
                if len(payload) != info.file_size or zlib.crc32(payload) != info.CRC:
                    raise OSError(f"the member at {info.header_offset} is damaged")
                return stream, payload
            except (OSError, zlib.error) as e:
                stream = None
                if not left:
                    raise OSError(f"{path}, offset {info.header_offset}: {e}") from e
                time.sleep(0.1 * (self.retries - left + 1))

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = _shared.file_system(self.folder)
        with fs.open_input_file(part.path) as f, zipfile.ZipFile(f) as archive:
            own = [x for x in archive.infolist() if part.start <= x.header_offset < part.end]
        rows, held, stream = [], 0, None
        for info in own:
            stream, payload = self.member(fs, stream, part.path, info)
            rows.append((part.path, info.header_offset, info.filename, payload))
            held += len(payload)
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["archive", "offset", "name", "payload"])


class ArchiveSource(DataSource):
    """Format quarryline_archive. Options: path (folder), manifest (Parquet with path and n_bytes; without it all .zip files below the
    folder), rangeBytes, batchBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "quarryline_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, payload binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_members(spark: SparkSession, folder: str, manifest: str | None = None, **options) -> DataFrame:
    """The members of archives: archive, offset, name, payload."""
    spark.dataSource.register(ArchiveSource)
    read = spark.read.format("quarryline_archive").options(**options)
    return (read.option("manifest", manifest) if manifest else read).load(folder)


def media_features(members: DataFrame, id_type: str = "bigint") -> DataFrame:
    """From members that write_archives made: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, png in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, n_bytes, doc_id = name.split("-", 2)
                samples = from_png(png)
                payload = samples.tobytes()
                rows.append((doc_id or None, int(n_bytes), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), features(samples)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    out = members.select("name", "payload").mapInArrow(run, "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select(F.col("id").cast(id_type).alias("doc_id"), *out.columns[1:])


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, manifest = _shared.shared_dir(spark, "media"), _shared.shared_dir(spark, "media-list")
    write_archives(docs, folder).write.parquet(manifest)
    return media_features(read_members(spark, folder, manifest), docs.schema["doc_id"].dataType.simpleString())
