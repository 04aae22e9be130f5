"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import as_column, cut, map_arrow, remove, shared_dir, table

#: Fixed values of the formats: magic numbers of the dictionary's skippable frame, of a Zstandard frame and
#: of a trained dictionary; the base-32 alphabets of conv() and of digests.
DICTIONARY_MAGIC, FRAME_MAGIC, TRAINED_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Uncompressed bytes after which a new archive begins; size of the dictionary, and of the sample it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 20, 16 << 10, 1 << 20
#: Tasks that read archives at most; each archive is read by one task.
MOST_READERS = 50_000
DATE = "1970-01-01T00:00:00Z"
_ID = "urn:x-page:"
#: An extension header for urls with line ends or outer or repeated white space, in base64.
_EXACT_URI = "X-Target-URI-Base64"


class WarcError(ValueError):
    """An archive or record that isn't as the format says."""


# ---------------------------------------------------------------- records
def record_bytes(page_id: int | None, url: str | None, kind: str, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        plain = " ".join(url.split())
        head.append("WARC-Target-URI: " + plain)
        if plain != url:  # a header can't hold it as it is
            head.append(f"{_EXACT_URI}: " + base64.b64encode(url.encode()).decode())
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "WARC-Block-Digest: sha1:" + base32_sha1(block), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises WarcError if headers, lengths or digests don't hold."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line, or headers without an end")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"malformed header line {line[:60]!r}")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise WarcError(f"header {need} is missing")
    if not fields["content-length"].isdigit():
        raise WarcError("Content-Length isn't a number")
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) < length or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}; the frame holds {max(0, len(rest) - 4)} bytes of block")
    digest = fields.get("warc-block-digest")
    if digest and digest != "sha1:" + base32_sha1(block):
        raise WarcError("block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    if not sep or not size:
        raise WarcError("no HTTP headers with a length in the block")
    out = {"page_id": _page(fields["warc-record-id"]), "url": base64.b64decode(fields[_EXACT_URI.lower()]).decode() if _EXACT_URI.lower() in fields else fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_bytes": int(size[1]), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": None}
    if out["record_type"] == "response":
        if len(payload) != out["payload_bytes"] or base32_sha1(payload) != out["payload_digest"]:
            raise WarcError("payload length or digest differs")
        out["payload"] = payload
    elif out["record_type"] == "revisit" and payload:
        raise WarcError("a revisit with a payload")
    return out


def _page(value: str) -> int | None:
    found = re.fullmatch(rf"<{_ID}(-?\d*)>", value)
    if not found:
        raise WarcError(f"record id {value[:60]!r}")
    return int(found[1]) if found[1] else None


# ---------------------------------------------------------------- archives
def _dictionary(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on the sample, or the sample itself if it is too small; none without one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=128, d=8)
    except zstandard.ZstdError:
        joined = b"".join(sample)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(joined, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(joined) >= 8 else None


class ArchiveWriter:
    """Writes records to a stream; the first ones, up to SAMPLE_BYTES, wait for the dictionary."""

    def __init__(self, out) -> None:
        self.out, self.waiting, self.size, self.records, self.zip = out, [], 0, 0, None

    def add(self, record: bytes) -> None:
        self.records += 1
        self.size += len(record)
        if self.zip is not None:
            self.out.write(self.zip.compress(record))
            return
        self.waiting.append(record)
        if self.size >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        shared = _dictionary(self.waiting)
        if shared is not None:
            held = zstandard.ZstdCompressor(level=9).compress(shared.as_bytes())
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held)
        self.zip = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True, write_content_size=True)
        for record in self.waiting:
            self.out.write(self.zip.compress(record))
        self.waiting = []

    def close(self) -> None:
        if self.zip is None:
            self._begin()
        self.out.close()


def read_frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time; memory is bounded by the largest record."""
    data = b""

    def fill(n: int) -> bool:
        nonlocal data
        while len(data) < n:
            more = stream.read(chunk)
            if not more:
                return False
            data += more
        return True

    shared, first = None, True
    while fill(1):
        if not fill(8):
            raise WarcError("archive ends inside a frame header")
        magic, size = struct.unpack_from("<II", data)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if not fill(8 + size):
                raise WarcError("archive ends inside a skippable frame")
            held, data = data[8 : 8 + size], data[8 + size :]
            if magic == DICTIONARY_MAGIC:
                if not first:
                    raise WarcError("a dictionary that isn't at the start")
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = zstandard.ZstdDecompressor().decompress(held)
                trained = held[:4] == struct.pack("<I", TRAINED_MAGIC)
                shared = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            first = False
            continue
        first = False
        if magic != FRAME_MAGIC:
            raise WarcError(f"no Zstandard frame: magic {magic:#x}")
        unzip, parts = zstandard.ZstdDecompressor(dict_data=shared).decompressobj(), []
        while True:
            if not data and not fill(1):
                raise WarcError("archive ends inside a frame")
            try:
                parts.append(unzip.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"damaged frame: {e}") from e
            data = b""
            if unzip.eof:
                data = unzip.unused_data
                break
        yield b"".join(parts)


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else "file://" + folder)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to; returns the manifest.

    Each task writes archives of its own under new names. The manifest (path, records) is cut by a checkpoint,
    so it names the files of the attempts that counted, and no others; files of lost attempts aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        writer, path, done = None, "", []
        for batch in batches:
            columns = [as_column(batch, c) for c in ("page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to")]
            for values in zip(*columns):
                page, url, kind, payload, length, digest, refers = (v.as_py() for v in values)
                if writer is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(system.open_output_stream(path, compression=None))
                writer.add(record_bytes(page, url, kind, payload or b"", length, digest, refers))
                if writer.size >= archive_bytes:
                    writer.close()
                    done.append((path, writer.records))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((path, writer.records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return cut(map_arrow(records, run, "path string, records long"))


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def read_archives(manifest: DataFrame, folder: str, strict: bool = True) -> DataFrame:
    """Records of the archives in the manifest (path, records).

    strict: a damaged archive or record, or a wrong number of records, fails the job; else it gives a row with
    `error` and the records before it stay. An empty manifest gives no rows.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]

    def rows(system: fs.FileSystem, path: str, records: int) -> Iterator[dict]:
        seen = 0
        try:
            with system.open_input_stream(path, compression=None) as stream:
                for frame in read_frames(stream):
                    seen += 1
                    yield parse_record(frame) | {"error": None}
            if records is not None and seen != records:
                raise WarcError(f"{seen} records; the manifest says {records}")
        except WarcError as e:
            if strict:
                raise WarcError(f"{path}, record {seen}: {e}") from e
            yield dict.fromkeys(n for n, _ in kinds) | {"error": f"record {seen}: {e}"}

    def batch_of(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], t) for n, t in kinds], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        for batch in batches:
            for path, records in zip(as_column(batch, "path"), as_column(batch, "records")):
                held, size = [], 0
                for row in rows(system, path.as_py(), records.as_py()):
                    held.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    # A given number of partitions, dealt in turn, so that no planner joins the few rows of a manifest in one task.
    return map_arrow(manifest.repartition(min(max(1, manifest.count()), MOST_READERS)), run, RECORD)


# ---------------------------------------------------------------- operator
def base32(digest_hex: Column) -> Column:
    """Base32 of 40 hexadecimal digits."""
    parts = [F.lpad(F.conv(F.substring(digest_hex, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Columns that write_archives() takes, a row for each page.

    Of equal payloads of least_bytes or more, the one with the smallest id is the response, the others (null
    ids too, unless all are null) revisit it; rows that repeat the smallest id are all responses. Null html is
    an empty payload. Payloads that occur once, and revisits' payloads, aren't shuffled.
    """
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32(F.sha1("payload")))
    keys = cut(rows.select("page_id", "url", "payload_bytes", "payload_digest"))
    bits = bloom.size_for(keys.count())
    words = cut(bloom.build(keys.where(F.col("payload_bytes") >= least_bytes), "payload_digest", bits, least=2))
    maybe = bloom.flag(rows, "payload_digest", words, bits, "__maybe")
    maybe = maybe.withColumn("__maybe", F.col("__maybe") & (F.col("payload_bytes") >= least_bytes))
    some = bloom.flag(keys, "payload_digest", words, bits, "__maybe").where(F.col("__maybe") & (F.col("payload_bytes") >= least_bytes))
    first = cut(some.groupBy(F.col("payload_digest").alias("__d")).agg(F.min("page_id").alias("__first")))
    none = F.lit(None).cast("long")
    once = maybe.where(~F.col("__maybe")).withColumn("record_type", F.lit("response")).withColumn("refers_to", none)
    shown = maybe.where("__maybe").join(first, (F.col("payload_digest") == F.col("__d")) & F.col("page_id").eqNullSafe(F.col("__first")), "left_semi")
    shown = shown.withColumn("record_type", F.lit("response")).withColumn("refers_to", none)
    again = some.join(first, (F.col("payload_digest") == F.col("__d")) & ~F.col("page_id").eqNullSafe(F.col("__first")))
    again = again.withColumn("record_type", F.lit("revisit")).withColumn("refers_to", F.col("__first").cast("long")).withColumn("payload", F.lit(None).cast("binary"))
    columns = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    return once.select(columns).unionByName(shown.select(columns)).unionByName(again.select(columns))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    remove(spark, folder, at_exit=True)  # the result reads the archives when it is asked for
    manifest = write_archives(to_records(table(spark, sf_dir, "pages")), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x FROM p),
d AS (
  SELECT page_id, payload_bytes,
    translate(
      to_base(('0x' || substr(x, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(x, 11, 10))::BIGINT, 32, 8) ||
      to_base(('0x' || substr(x, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(x, 31, 10))::BIGINT, 32, 8),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
