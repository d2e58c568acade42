"""WARC archives of pages: a writer with revisits, and a sequential reader.

Writer: one gzip member a record; each task appends to archives of its own in the shared folder and reports them, so a task that
runs again writes new files and only reported ones are read. Among records of equal payload digest and at least `least` bytes, that
of the smallest page id is a response and the others are revisits without the payload.

Reader: streams an archive in blocks through an incremental zlib decompressor that gives bounded pieces, restarts it at each member's
end, frames records by Content-Length and verifies the digests of block and payload that a record names (SHA-1, SHA-256, SHA-512 or
MD5, in hex or Base32). A mismatch, a truncated record or a member that doesn't end with its record raises. It holds one block, the
headers and, where payloads are asked for, one payload; other payloads pass through the digests piece by piece. Records of any type
are read, those of other writers too; archives without compression are read alike. `checked` holds revisits against their responses.

Defined results: a null html is an empty payload, a null url an empty target; records too small to revisit are all responses; of
repeated rows with the smallest page id all are responses; null page ids come after all others; page ids may be of any type that
casts from text, and stand percent-encoded in the record's id; a record of another writer has a null page id; an empty table gives an
empty result. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.llm import _shared, _text

ROLL_BYTES = 256 << 20
BLOCK = 1 << 20
PIECE = 256 << 10
HEAD_BYTES = 1 << 20
_NO_PAGE = "urn:page-none"
_DIGESTS = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha512": hashlib.sha512, "sha-512": hashlib.sha512, "md5": hashlib.md5}
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def response_or_revisit(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns id, url, payload (binary), digest, and first: the id that a revisit refers to, null for responses.

    Digests are pre-aggregated before the shuffle and only repeated ones join back, so a payload that many pages share is a hot key
    on one side of a left join alone, which adaptive execution splits."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "first")
    )
    return rows.join(firsts, "digest", "left").select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def _urn(page_id) -> bytes:
    return (_NO_PAGE if page_id is None else "urn:page:" + quote(str(page_id), safe="")).encode()


def _page(name: str | None) -> str | None:
    """The page id of a record's id, as text; null if it has none."""
    inner = (name or "").strip("<>")
    return unquote(inner[9:]) if inner.startswith("urn:page:") else None


def record(page_id, url: str, payload: bytes, digest: str, first) -> bytes:
    """One WARC/1.1 record, uncompressed. page ids are kept in the record's and the referred record's ids."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if first is None else b"")
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"response" if first is None else b"revisit"), b"WARC-Record-ID: <%s>" % _urn(page_id),
        b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A"),
        b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(),
        b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block),
    ]
    if first is not None:
        head += [b"WARC-Refers-To: <%s>" % _urn(first), b"WARC-Profile: " + _PROFILE]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes response_or_revisit's rows; a row (path, n_records, n_bytes) for each archive. The caller must materialise it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _shared.file_system(folder)
        out, path, done, size, count = None, "", [], 0, 0
        for b in _text.slices(batches, "payload"):
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, payload, digest, first)) + z.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "n_records", "n_bytes"])

    return rows.select("id", "url", "payload", "digest", "first").mapInArrow(run, "path string, n_records long, n_bytes long")


class _Records:
    """The decompressed bytes of an archive, in pieces: a gzip member at a time, or all of an archive that isn't compressed."""

    def __init__(self, stream):
        self.stream, self.data, self.held, self.z, self.plain = stream, b"", bytearray(), None, False

    def _fill(self) -> bool:
        """More bytes in `held`; False at the member's or the archive's end."""
        while True:
            if self.z is not None and (self.z.eof or self.plain and not self.data and not self._more()):
                return False
            if self.plain:
                piece, self.data = self.data, b""
            else:
                # what a piece leaves over is decompressed before more is read
                piece = self.z.decompress(self.z.unconsumed_tail or self.data, PIECE)
                self.data = b"" if not self.z.eof else self.z.unused_data
                if not piece and not self.z.eof and not self.z.unconsumed_tail and not self._more():
                    raise ValueError("the archive ends within a record")
            if piece:
                self.held += piece
                return True

    def _more(self) -> bool:
        self.data = self.stream.read(BLOCK)
        return bool(self.data)

    def open(self) -> bool:
        """Goes to the next record; False at the archive's end."""
        if self.plain and (self.held or self._fill()):
            return True
        if self.plain or not (self.data or self._more()):
            return False
        self.plain = not self.data.startswith(b"\x1f")
        self.z = zlib.decompressobj(31)
        return self._fill() or self.open()

    def until(self, mark: bytes, most: int) -> bytes:
        """What stands before a mark, which is passed over; more than `most` bytes raise."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(len(self.held) - len(mark) + 1, 0)
            if len(self.held) > most:
                raise ValueError("a header is too long")
            if not self._fill():
                raise ValueError("no WARC record" if not at else "the archive ends within a record")
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """`size` bytes, in pieces."""
        while size:
            if not self.held and not self._fill():
                raise ValueError("Content-Length doesn't frame the record")
            piece = bytes(self.held[:size])
            del self.held[: len(piece)]
            size -= len(piece)
            yield piece

    def close(self) -> None:
        """The record's end: two line breaks, and for a gzip member nothing else."""
        if b"".join(self.take(4)) != b"\r\n\r\n" or not self.plain and (self.held or self._fill()):
            raise ValueError("Content-Length doesn't frame the record")


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-cased name; a line that begins with a space goes on with the one before."""
    out, last = {}, ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif line:
            name, _, value = line.partition(b":")
            last = name.strip().lower().decode("utf-8", "replace")
            out[last] = value.strip().decode("utf-8", "replace")
    return out


def _digest(named: str | None) -> tuple[Callable, str] | None:
    """(function, hex value) of a digest such as sha1:Base32; None if there is none or its algorithm isn't known."""
    algorithm, _, value = (named or "").partition(":")
    make = _DIGESTS.get(algorithm.strip().lower())
    if make is None:
        return None
    value, size = value.strip(), make().digest_size
    if len(value) == 2 * size:
        return make, value.lower()
    try:
        return make, base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError as e:
        raise ValueError(f"no digest: {named}") from e


def records(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive: header fields, payload_bytes, payload_sha256 and, if asked for, payload. The payload of a revisit is
    the one it refers to: its length stands in its HTTP header, its digest in its own header (null where they aren't given)."""
    source = _Records(stream)
    while source.open():
        lines = source.until(b"\r\n\r\n", HEAD_BYTES).split(b"\r\n")
        while lines and not lines[0]:
            lines = lines[1:]
        if not lines or not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC record")
        head = _fields(lines[1:])
        if not head.get("content-length", "").isdigit():
            raise ValueError("a record without Content-Length")
        kind = head.get("warc-type", "")
        http = head.get("content-type", "").replace(" ", "").lower().startswith("application/http") and kind in ("response", "revisit", "request")
        whole, own = _digest(head.get("warc-block-digest")), _digest(head.get("warc-payload-digest"))
        whole_sum, own_sum, plain_sum = whole and whole[0](), own and own[0](), hashlib.sha256()
        size, before, kept, fields, inside = 0, bytearray(), bytearray(), {}, not http
        for piece in source.take(int(head["content-length"])):
            if whole:
                whole_sum.update(piece)
            if not inside:
                before += piece
                at = before.find(b"\r\n\r\n", max(len(before) - len(piece) - 3, 0))
                if at < 0:
                    if len(before) > HEAD_BYTES:
                        raise ValueError("a header is too long")
                    continue
                fields, piece, inside = _fields(bytes(before[:at]).split(b"\r\n")[1:]), bytes(before[at + 4 :]), True
            size += len(piece)
            plain_sum.update(piece)
            if own:
                own_sum.update(piece)
            if payloads:
                kept += piece
        source.close()
        if whole and whole_sum.hexdigest() != whole[1]:
            raise ValueError("the block's digest differs")
        if kind == "revisit":
            full = fields.get("content-length", "")
            known = own[1] if own and own[0] is hashlib.sha256 else None
            head |= {"payload_bytes": int(full) if full.isdigit() else None, "payload_sha256": known}
        else:
            if own and own_sum.hexdigest() != own[1]:
                raise ValueError("the payload's digest differs")
            head |= {"payload_bytes": size, "payload_sha256": plain_sum.hexdigest()}
        yield head | ({"payload": bytes(kept)} if payloads else {})


def parse(raw: bytes) -> dict:
    """The one record of bytes that aren't compressed, with its payload."""
    import io

    found = list(records(io.BytesIO(bytes(raw)), payloads=True))
    if len(found) != 1:
        raise ValueError(f"{len(found)} records")
    return found[0]


def read_archives(archives: DataFrame, folder: str, payloads: bool = False, path_col: str = "path", id_type: str = "bigint") -> DataFrame:
    """The records of all archives: record_id, page_id, url, payload_bytes, payload_digest (SHA-256), record_type, refers_to (a page id),
    and the payload if asked for."""
    names = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _shared.file_system(folder)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in records(stream, payloads):
                        name = r.get("warc-record-id")
                        rows.append((name, _page(name), r.get("warc-target-uri"), r["payload_bytes"], r["payload_sha256"], r.get("warc-type"), _page(r.get("warc-refers-to")), *([r["payload"]] if payloads else [])))
                        held += 300 + (len(r["payload"]) if payloads else 0)
                        if held >= _text.STEP_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = "record_id string, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    found = archives.select(path_col).mapInArrow(run, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def checked(found: DataFrame) -> DataFrame:
    """read_archives' rows; a revisit raises unless a response of the page it refers to has its payload's digest and length."""
    known = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").where("refers_to IS NOT NULL").distinct().withColumn("known", F.lit(True))
    revisits = found.where("record_type = 'revisit'").join(known, ["refers_to", "payload_digest", "payload_bytes"], "left")
    held = F.when(F.col("known"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("no response for revisit "), F.coalesce(F.col("record_id"), F.lit("")))))
    return found.where("record_type <> 'revisit'").unionByName(revisits.withColumn("payload_digest", held).select(found.columns))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    folder = _shared.shared_dir(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = response_or_revisit(pages)
    archives = _shared.written(write_archives(rows, folder), "warc-list")
    n = spark.sparkContext.defaultParallelism
    found = _shared.written(read_archives(archives.repartition(max(2, n)), folder, id_type=pages.schema["page_id"].dataType.simpleString()), "warc-records")
    return checked(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
