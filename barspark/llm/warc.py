"""WARC archives of Zstandard frames: writer and reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
compression dictionary; then one Zstandard frame follows for each record. Files
are written by Spark's own text writer, so any Hadoop file system will do: every
frame is a row, and the row separator is an empty skippable frame, which readers
pass over. Each file is one task's output of about ``ARCHIVE_BYTES``.

The reader takes ``binaryFile`` rows (or any ``path``, ``content`` table), loads
the dictionary, decodes one frame a record and validates: the version line,
header syntax and required fields, ``Content-Length`` against the block, the
HTTP ``Content-Length`` and the payload digest of responses against the payload,
and that a frame holds one record only. A record that fails has ``error`` set; a
frame that cannot be decoded ends its archive with an error row.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with
the smallest id is the response; the others are revisits that refer to it.

Defined results: null payloads are empty; a null url is written as an empty
target; null ids never get referred to: records of a payload that only null ids
have are all responses. Repeated rows with the smallest id are all responses.
Extra columns are ignored; an empty table writes no archive and reads no record.
Payloads may be as long as a binary value can be (2 GB).
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_split, scratch_path, ship

ARCHIVE_BYTES = 8 << 20
REVISIT_BYTES = 100
#: The dictionary is trained on about so many payload bytes; a bounded sample.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4096, 32_768
LEVEL = 3
DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame, between two records.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
#: Bytes handed to the frame decoder at a time.
STEP = 1 << 15

RECORD = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
          "target_uri string, payload binary, error string")


def _field(value: str) -> str:
    """Header values hold no control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Target-URI: {_field(uri or '')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = http
    else:
        block = http + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes, what: str) -> tuple[str, dict[str, str]]:
    first, *rest = head.split(b"\r\n")
    out = {}
    for line in rest:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise ValueError(f"{what}: bad header line {line[:60]!r}")
        key = name.decode("ascii", "replace").lower()
        if key in out:
            raise ValueError(f"{what}: {key} given twice")
        out[key] = value.strip().decode("utf-8", "surrogatepass")
    return first.decode("ascii", "replace"), out


def _number(fields: dict[str, str], name: str) -> int:
    value = fields.get(name, "")
    if not (value.isascii() and value.isdigit()):
        raise ValueError(f"{name}: no length {value!r}")
    return int(value)


def _page(ref: str) -> int | None:
    if not (ref.startswith("<urn:page:") and ref.endswith(">")):
        raise ValueError(f"record id {ref!r}")
    number = ref[10:-1]
    return None if number == "None" else int(number)


def parse(data: bytes) -> tuple:
    """A ``RECORD`` row (without error) of one decoded frame; ValueError when it is not valid."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, f = _fields(head, "WARC")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"version line {version[:20]!r}")
    for name in ("warc-type", "warc-record-id", "content-length", "warc-payload-digest"):
        if name not in f:
            raise ValueError(f"{name} is missing")
    n = _number(f, "content-length")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block: {n} bytes declared, {len(rest) - 4} found")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    status, h = _fields(http, "HTTP")
    if not gap or not status.startswith("HTTP/"):
        raise ValueError("HTTP head is missing")
    size = _number(h, "content-length")
    kind, digest = f["warc-type"], f["warc-payload-digest"]
    if not digest.startswith("sha256:") or len(digest) != 71:
        raise ValueError(f"payload digest {digest[:20]!r}")
    refers = None
    if kind == "response":
        if len(payload) != size:
            raise ValueError(f"payload: {size} bytes declared, {len(payload)} found")
        if hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise ValueError("payload digest differs")
    elif kind == "revisit":
        if payload:
            raise ValueError("revisit with a payload")
        refers = _page(f.get("warc-refers-to", ""))
    else:
        raise ValueError(f"record type {kind!r}")
    return _page(f["warc-record-id"]), size, digest[7:], kind, refers, f.get("warc-target-uri", ""), payload


def frames(content: bytes):
    """The decoded frames of an archive, one record each; ValueError at the first bad one."""
    view, at, dictionary = memoryview(content), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"{len(view) - at} stray bytes at the end")
        magic, size = struct.unpack_from("<II", view, at)
        if magic >> 4 == 0x184D2A5:
            if at + 8 + size > len(view):
                raise ValueError("skippable frame is cut off")
            if magic == DICTIONARY_MAGIC and at == 0:
                data = bytes(view[8:8 + size])
                if data[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                    data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 27)
                dictionary = zstandard.ZstdCompressionDict(data)
            at += 8 + size
            continue
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        parts, end = [], at
        while not decoder.eof:
            if end >= len(view):
                raise ValueError("frame is cut off")
            try:
                parts.append(decoder.decompress(view[end:end + STEP]))
            except zstandard.ZstdError as e:
                raise ValueError(f"frame: {e}") from None
            end = min(end + STEP, len(view))
        at = end - len(decoder.unused_data)
        yield b"".join(parts)


def classify(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``pages`` with payload, digest and refers_to (null for responses)."""
    base = pages.withColumn("_payload", F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))).withColumn("_digest", F.sha2("_payload", 256))
    long = F.octet_length("_payload") >= REVISIT_BYTES
    first = (base.where(long).groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_times"))
             .where("_times > 1 and _first is not null").select("_digest", "_first"))
    # most payloads occur once: a fixed-size filter spares them the join
    may, rest = bloom_split(base, "_digest", first)
    refers = F.when(long & F.col("_first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_first")), F.col("_first"))
    return may.join(first, "_digest", "left").withColumn("_refers", refers).drop("_first").unionByName(
        rest.withColumn("_refers", F.lit(None).cast(base.schema[id_col].dataType)))


def _dictionary(pages: DataFrame, rows: int, id_col: str, payload_col: str) -> bytes:
    """Trained on the heads of a bounded sample of payloads; empty when there are too few."""
    draw = F.pmod(F.xxhash64(id_col, payload_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = pages.where(F.col(payload_col).isNotNull() & (draw < min(1.0, SAMPLE_ROWS / max(1, rows))))
    samples = sorted({bytes(r[0]) for r in picked.select(F.substring(F.col(payload_col).cast("binary"), 1, SAMPLE_BYTES)).collect()})
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write ``pages`` as archives under ``path``."""
    ship(pages.sparkSession)
    total, count = pages.agg(F.sum(F.octet_length(F.col(payload_col).cast("binary"))), F.count(F.lit(1))).first()
    files = max(1, -(-int(total or 0) // ARCHIVE_BYTES))
    dictionary = pages.sparkSession.sparkContext.broadcast(_dictionary(pages, count, id_col, payload_col))
    rows = classify(pages, id_col, payload_col).select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col("_payload").alias("payload"),
        F.col("_digest").alias("digest"), F.col("_refers").cast("bigint").alias("refers"))

    def run(batches):
        known = dictionary.value
        given = zstandard.ZstdCompressionDict(known) if known else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=given) if given else zstandard.ZstdCompressor(level=LEVEL)
        begun = False
        for b in batches:
            out = []
            if not begun and b.num_rows:
                out.append(struct.pack("<II", DICTIONARY_MAGIC, len(known)) + known)
                begun = True
            for page_id, url, payload, digest, refers in zip(*b.columns, strict=True):
                out.append(packer.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    (rows.repartition(files, F.xxhash64("page_id", "digest")).mapInArrow(run, "frame binary")
     .select(F.expr("cast(frame as string)").alias("value")).write.option("lineSep", SEPARATOR.decode("ascii")).text(path))


def read(archives: DataFrame) -> DataFrame:
    """The records of a (path, content) table of archives, in ``RECORD`` rows."""
    ship(archives.sparkSession)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                try:
                    for data in frames(content.as_py() or b""):
                        try:
                            rows.append((*parse(data), None))
                        except ValueError as e:
                            rows.append((None,) * 7 + (str(e),))
                        size += len(data)
                        if size >= 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    rows.append((None,) * 7 + (f"archive: {e}",))
                if rows:
                    yield _batch(rows)

    return archives.select("content").mapInArrow(run, RECORD)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def load(spark, path: str) -> DataFrame:
    """Archives under ``path`` as (path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives into the shared folder and read the records back."""
    path = scratch_path(pages.sparkSession)
    write(pages, path, id_col, url_col, payload_col)
    return read(load(pages.sparkSession, path))
