"""WARC archives compressed with Zstandard: one frame per record, the
compression dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import settled, working_folder

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 16 << 10
DICTIONARY_SAMPLES = 256
SAMPLE_BYTES = 8 << 10
STEP = 32 << 10
MAX_STRAYS = 1000

RECORD_SCHEMA = "archive string, position long, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format."""


def train_dictionary(pages: DataFrame, id_col: str, payload_col: str) -> bytes:
    """A dictionary from at most DICTIONARY_SAMPLES payloads, the first
    SAMPLE_BYTES of each, of the rows with the smallest hashed ids; empty if
    there is too little to train on.  (It affects size only, never content.)"""
    pick = pages.select(F.xxhash64(id_col).alias("h"), F.substring(F.encode(F.col(payload_col), "UTF-8"), 1, SAMPLE_BYTES).alias("p"))
    # Hashes alone are ranked, so that a task sends the driver a few KB; then the payloads up to the last rank.
    ranks = [r.h for r in pages.select(F.xxhash64(id_col).alias("h")).orderBy("h").limit(DICTIONARY_SAMPLES).collect()]
    if not ranks:
        return b""
    rows = pick.filter((F.col("h") <= ranks[-1]) & F.col("p").isNotNull()).limit(2 * DICTIONARY_SAMPLES).collect()
    samples = [bytes(r.p) for r in sorted(rows, key=lambda r: (r.h, r.p)) if len(r.p) >= 16]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # samples that have nothing in common
        return b""


def _header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in fields] + [f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _escaped(url: str) -> str:
    """The url on one header line: ``%`` and what is neither printable ASCII nor a
    space inside are percent-encoded, so that ``unquote`` gives the url back."""
    keep = "".join(map(chr, range(33, 127))).replace("%", "")
    edge = len(url) - len(url.strip(" "))
    return quote(url, safe=keep if edge else keep + " ")


def record_bytes(page_id, url: str | None, digest: str, payload: bytes | None, refers_to=None) -> bytes:
    """A response record, or with ``payload`` None a revisit record."""
    name = "" if page_id is None else str(page_id)
    fields = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _escaped(url)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if payload is None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        return _header(fields, http + b"\r\n")
    return _header(fields, http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)


def parse_record(data: bytes) -> dict:
    """The fields of one record; raises WarcError if the record is malformed."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise WarcError("a record without WARC version line or header end")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"header line {line[:80]!r}")
        fields[name.strip().lower().decode()] = value.strip().decode()
    for need in ("warc-type", "warc-record-id", "content-length"):
        if need not in fields:
            raise WarcError(f"a record without {need}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length} against {len(rest) - 4} bytes")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise WarcError("a block without HTTP header")
    for line in http.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and int(value) != len(payload):
            raise WarcError(f"HTTP Content-Length {int(value)} against {len(payload)} bytes")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] == "response" and digest and hashlib.sha256(payload).hexdigest() != digest:
        raise WarcError("payload digest differs")
    uri = fields.get("warc-target-uri")
    if uri is not None and fields["warc-record-id"].startswith("<urn:page:"):  # written here, with its escapes
        uri = unquote(uri, errors="surrogatepass")
    return {"type": fields["warc-type"], "id": fields["warc-record-id"], "uri": uri, "refers_to": fields.get("warc-refers-to"), "digest": digest or None, "payload": payload}


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(write_content_size=True).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def leading_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in an archive's leading skippable frame, and where that frame ends."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise WarcError("the dictionary frame is cut off")
    raw = data[8 : 8 + size]
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
    return zstandard.ZstdCompressionDict(raw), 8 + size


def read_archive(data: bytes) -> Iterator[tuple[int, dict]]:
    """(position, fields) of every record of an archive, frame by frame."""
    dictionary, at = leading_dictionary(data)
    view = memoryview(data)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise WarcError(f"no frame at {at}")
        frame, parts, start = reader.decompressobj(), [], at
        try:
            while not frame.eof:
                if at >= len(data):
                    raise WarcError(f"the frame at {start} is cut off")
                parts.append(frame.decompress(view[at : at + STEP]))
                at = min(at + STEP, len(data)) - len(frame.unused_data)
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at {start}: {e}") from e
        yield start, parse_record(b"".join(parts))


def _store(uri: str):
    """(file system, path) of a folder; local paths and every store that pyarrow opens."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def _frames(dictionary: bytes):
    """(id, url, payload) rows to rows with digest, length and the frame of a response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
        for batch in batches:
            digests, frames = [], []
            for page_id, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (payload or "").encode()
                digests.append(hashlib.sha256(raw).hexdigest())
                frames.append(packer.compress(record_bytes(page_id, url, digests[-1], raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(frames, pa.binary())], names=["page", "url", "digest", "frame"])

    return run


def _write(folder: str, dictionary: bytes):
    """Rows of frames into archive files.  A file's name holds the task attempt;
    the rows returned name the files of the attempt that succeeded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = dictionary_frame(dictionary) if dictionary else b""
        packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
        context, store = TaskContext.get(), None
        parts, size, count, nth = [lead], len(lead), 0, 0

        def close() -> pa.RecordBatch:
            nonlocal parts, size, count, nth, store
            name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{nth:04d}.warc.zst"
            if store is None:
                store = _store(folder)
                store[0].create_dir(store[1], recursive=True)
            with store[0].open_output_stream(f"{store[1]}/{name}", compression=None) as out:
                for part in parts:
                    out.write(part)
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])
            parts, size, count, nth = [lead], len(lead), 0, nth + 1
            return done

        for batch in batches:
            for page_id, url, digest, frame, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if refers_to is not None:
                    frame = packer.compress(record_bytes(page_id, url, digest, None, refers_to))
                parts.append(frame)
                size += len(frame)
                count += 1
                if size >= ARCHIVE_BYTES:
                    yield close()
        if count:
            yield close()

    return run


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record per row into ``.warc.zst`` archives of about 16 MB under
    ``folder`` (default: a fresh one in the shared folder) and returns the
    manifest: ``archive`` (full path), ``records``, ``bytes``.

    Of rows with equal payloads of at least ``min_revisit`` bytes, the one with
    the smallest id is a response and the others are revisits of it; rows that
    repeat that id and payload are responses too.  Shorter payloads are always
    responses.  A null payload is empty, a null url leaves its header out, null
    ids are written without a name and never chosen unless alone.
    An empty table writes no archive.  Only narrow rows (digest, id) meet in the
    search for equal payloads; payloads travel compressed.
    """
    spark = pages.sparkSession
    folder = folder or working_folder(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    dictionary = train_dictionary(source, "page", "payload")
    raw = F.coalesce(F.encode("payload", "UTF-8"), F.lit("").cast("binary"))
    narrow = source.select("page", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("size")).filter(F.col("size") >= min_revisit)
    # Partial minima: a payload that many pages share is one row per task here.
    firsts = narrow.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    revisits = narrow.join(firsts, "digest").filter(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("page").alias("_page"), F.col("digest").alias("_digest"), F.col("first").cast("string").alias("refers_to")).distinct()
    frames = source.mapInArrow(_frames(dictionary), f"page {kind}, url string, digest string, frame binary")
    rows = frames.join(revisits, F.col("page").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page", "url", "digest", "frame", "refers_to")
    written = settled(rows.mapInArrow(_write(folder, dictionary), "archive string, records long, bytes long"), "warc-manifest")
    return written.select(F.concat(F.lit(folder.rstrip("/") + "/"), "archive").alias("archive"), "records", "bytes")


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of ``.warc.zst`` archives (of at most 2 GB, Spark's bound for one
    value; ``write_warc`` closes them at 16 MB) or folders of them: ``archive,
    position, record_type, record_id, uri, refers_to, payload_digest, payload``.

    Each archive is opened through Spark, so any store that Spark reads will do.
    Its dictionary comes from the leading skippable frame (archives without one
    are read too); each following frame must hold exactly one record, whose
    version line, header, lengths and payload digest are checked.  A broken
    archive raises WarcError with the archive's name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                try:
                    for at, r in read_archive(content.as_py()):
                        rows.append((path, at, r["type"], r["id"], r["uri"], r["refers_to"], r["digest"], r["payload"]))
                        size += len(r["payload"])
                        if size >= 4 << 20:
                            yield _records(rows)
                            rows, size = [], 0
                except WarcError as e:
                    raise WarcError(f"{path}: {e}") from e
                if rows:
                    yield _records(rows)

    if not paths:
        return spark.createDataFrame([], RECORD_SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(paths).select("path", "content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def read_manifest(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that a manifest of ``write_warc`` names, all
    of them in ``folder``.  Only the folder's name passes through the driver.

    Files of task attempts that failed lie in the folder too but not in the
    manifest: their records are left out by file name.  A manifest without rows
    gives an empty result.
    """
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD_SCHEMA)
    records = read_warc(spark, [folder])
    names = manifest.select(F.regexp_extract("archive", "[^/]*$", 0).alias("_name")).distinct()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load([folder]).select(F.regexp_extract("path", "[^/]*$", 0).alias("_name"))
    strays = [r["_name"] for r in files.join(names, "_name", "left_anti").limit(MAX_STRAYS + 1).collect()]
    if len(strays) > MAX_STRAYS:  # more failed attempts than a plan should list
        return records.withColumn("_name", F.regexp_extract("archive", "[^/]*$", 0)).join(names, "_name", "left_semi").drop("_name")
    return records.filter(~F.regexp_extract("archive", "[^/]*$", 0).isin(strays)) if strays else records


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "position", "record_type", "record_id", "uri", "refers_to", "payload_digest", "payload"])


def page_records(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Of records read back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``, ids as ``id_type``.  A revisit has its payload's length from the
    response that it refers to."""

    def number(c: str):
        return F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)

    flat = records.select(
        F.when(number("record_id") != "", number("record_id")).cast(id_type).alias("page_id"),
        F.octet_length("payload").cast("long").alias("own"),
        "payload_digest",
        "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).cast(id_type).alias("refers_to"),
    )
    flat = settled(flat, "warc-records")
    base = flat.filter("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("own").alias("_own")).distinct()
    at = (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    return flat.join(base, at, "left").select("page_id", F.when(F.col("record_type") == "revisit", F.col("_own")).otherwise(F.col("own")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
