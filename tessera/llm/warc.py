"""WARC archives compressed with Zstandard, written and read.

An archive is: one skippable frame (magic number 0x184D2A5D) that holds the dictionary, then one Zstandard frame per
record, compressed with that dictionary. `records` reads an archive: it loads the dictionary from the leading frame
(itself compressed or not), finds each frame's end from its block headers, decodes one frame per record, and checks the
frame's content size, the version line, the named fields, Content-Length against the block and the closing line ends;
anything else raises WarcError.

`write_archives` makes archives of bounded size inside the tasks and stores them as rows (archive_id, content) in the
shared folder; `read_archives` decodes them there. Files in any store that Spark reads come through `read_files`.

`with_revisits` finds, for payloads of at least LEAST bytes, the smallest page_id of each payload by SHA-256 (partial
aggregation, then a join that Spark may split); later copies become revisit records without payload.

Defined cases: a null html is an empty payload; a payload under LEAST bytes is always a response; rows of null page_id
are responses that nothing refers to; repeated rows of the smallest page_id are all responses (a record's id says page and
payload, so equal rows have equal ids); a page larger than an archive gets one of its own; a null url leaves the target
out; control characters in a url are percent-encoded; an empty table gives no archives and no rows; extra columns,
whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialised, text_or_empty

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
LEAST = 100
ARCHIVE_BYTES = 8 << 20  # of records before compression
DICT_BYTES = 16 << 10
DICT_SAMPLES, SAMPLE_CHARS = 128, 16 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


class WarcError(ValueError):
    pass


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _field(name: str, value: str) -> bytes:
    safe = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)
    return f"{name}: {safe}".encode("utf-8", "surrogatepass") + CRLF


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (refers_to given) has the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    out = b"WARC/1.1" + CRLF + _field("WARC-Type", "response" if refers_to is None else "revisit") + _field("WARC-Record-ID", record_id(page_id, digest))
    out += _field("WARC-Date", DATE) + _field("Content-Type", "application/http;msgtype=response") + _field("WARC-Payload-Digest", f"sha256:{digest}")
    if url:
        out += _field("WARC-Target-URI", url)
    if page_id is not None:
        out += _field("X-Page-ID", str(page_id))
    if refers_to is not None:
        out += _field("WARC-Profile", PROFILE) + _field("WARC-Refers-To", record_id(refers_to, digest)) + _field("X-Refers-To-Page-ID", str(refers_to))
    return out + _field("Content-Length", str(len(block))) + CRLF + block + CRLF + CRLF


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary for records like the samples; their own bytes where there are too few to train on."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


def _dictionary(data: bytes):
    import zstandard

    trained = data[:4] == struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """An archive in the making."""

    def __init__(self, dictionary: bytes, level: int = 3):
        import zstandard

        d = _dictionary(dictionary)
        d.precompute_compress(level)
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=True)
        self.start = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary
        self.parts, self.size = [self.start], 0

    def add(self, rec: bytes) -> None:
        self.parts.append(self.zip.compress(rec))
        self.size += len(rec)

    def close(self) -> bytes:
        out, self.parts, self.size = b"".join(self.parts), [self.start], 0
        return out


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise WarcError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if len(data) < pos + 3:
            raise WarcError("a frame is cut short")
        block = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise WarcError("a frame is cut short")
    return pos


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of one record."""
    cut = rec.find(CRLF + CRLF)
    if cut < 0:
        raise WarcError("a record has no end of header")
    lines = rec[:cut].split(CRLF)
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"not a WARC version: {lines[0][:20]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a named field: {line[:60]!r}")
        fields[name.decode("ascii").lower()] = value.strip().decode("utf-8", "surrogatepass")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    if not fields["content-length"].isdigit():
        raise WarcError("content-length is no number")
    block = rec[cut + 4 : -4]
    if rec[-4:] != CRLF + CRLF or len(block) != int(fields["content-length"]):
        raise WarcError("the block's length is not content-length")
    return fields, block


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of an archive, checked."""
    import zstandard

    at, unzip = 0, zstandard.ZstdDecompressor()
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICT_MAGIC:
        at = 8 + struct.unpack_from("<I", archive, 4)[0]
        if at > len(archive):
            raise WarcError("the dictionary is cut short")
        d = archive[8:at]
        if d[:4] == struct.pack("<I", FRAME_MAGIC):
            d = zstandard.ZstdDecompressor().decompressobj().decompress(d)
        unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(d))
    while at < len(archive):
        if struct.unpack_from("<I", archive, at)[0] & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            continue
        end = frame_end(archive, at)
        frame = archive[at:end]
        try:
            size = zstandard.frame_content_size(frame)
            rec = unzip.decompress(frame) if size >= 0 else unzip.decompressobj().decompress(frame)
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at} does not decode: {e}") from e
        if 0 <= size != len(rec):
            raise WarcError("a frame's content size is wrong")
        yield parse(rec)
        at = end


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, refers_to (null: a response)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long_ = F.octet_length("html") >= least
    firsts = rows.where(long_ & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = rows.join(firsts.drop("n"), "digest", "left")
    return out.select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive_id, content: rows of with_revisits() as archives, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Writer(dictionary)

        def close() -> pa.RecordBatch:
            content = w.close()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()]), pa.array([content], pa.binary())], ["archive_id", "content"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*batch.columns, strict=True):
                refers = refers_to.as_py()
                w.add(record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), refers))
                if w.size >= archive_bytes:
                    yield close()
        if len(w.parts) > 1:
            yield close()

    return materialised(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive_id string, content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the archives' `content`: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for fields, block in records(content.as_py()):
                    head, _, payload = block.partition(CRLF + CRLF)
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    n = next(int(x.split(b":")[1]) for x in head.split(CRLF) if x.lower().startswith(b"content-length:"))
                    if fields["warc-type"] == "response" and (n != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                        raise WarcError(f"the payload of {fields['warc-record-id']} does not have its length and digest")
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    rows.append((page and int(page), fields.get("warc-target-uri"), fields["warc-type"], n, digest, refers and int(refers), payload))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return archives.select("content").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.zst files anywhere that Spark reads."""
    return read_archives(spark.read.format("binaryFile").load(path))


def warc_query(pages: DataFrame) -> DataFrame:
    rows = with_revisits(pages)
    taken = [r.html.encode("utf-8", "surrogatepass") for r in pages.select(F.left(text_or_empty("html"), F.lit(SAMPLE_CHARS)).alias("html")).take(DICT_SAMPLES)]
    back = read_archives(write_archives(rows, train_dictionary(taken)))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id > first THEN first END AS refers_to FROM q
"""
