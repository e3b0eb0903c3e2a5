"""Zstandard WARC archives: one frame per record, one dictionary per archive in a leading skippable frame.

Writing: a payload's SHA-1 is taken natively; of the payloads of at least ``dedup_bytes`` that are equal, the
row with the largest id is the response and the others are revisit records that refer to it.  Groups are found
by an aggregate of (digest, largest id, rows), so a payload that a third of all pages share costs one row a
task before the shuffle.  Reading: the dictionary comes from the archive's first frame, each further frame
must hold exactly one record, and version, headers, lengths and digests are validated.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, scratch, slices, written

#: Magic number of the skippable frame that holds the dictionary (the WARC/zstd convention).
DICTIONARY_MAGIC = 0x184D2A5D
#: How a compressed frame begins.
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: Groups of equal payloads are broadcast while there are so many at most (of about 100 bytes); beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: The dictionary is trained on so many payloads at most, each cut to so many bytes; records are never cut.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 800, 8192, 32 << 10
#: An archive is closed at the record that brings it to so many bytes.
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise ArchiveError(f"a record id of another kind: {name}")
    return int(name[10:-1]) if name[10:-1] else None


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record; ``payload`` counts only for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + b"\r\n\r\n"
    block = http if revisit else http + payload
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE), *([("WARC-Target-URI", uri)] if url is not None else []), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}")]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of one record, after every check that needs the record alone."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(VERSION):
        raise ArchiveError("no WARC/1.1 record")
    fields: dict[str, str] = {}
    for line in head[len(VERSION) :].split(b"\r\n"):
        key, colon, value = line.decode("utf-8").partition(":")
        if not colon or key.lower() in fields:
            raise ArchiveError(f"a malformed or repeated header: {line[:80]!r}")
        fields[key.lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"):
        if key not in fields:
            raise ArchiveError(f"no {key}")
    if not fields["content-length"].isdigit():
        raise ArchiveError("a malformed content-length")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError("the record's length differs from its content-length")
    block = rest[:length]
    if fields["warc-block-digest"] != f"sha1:{_base32(hashlib.sha1(block).hexdigest())}":
        raise ArchiveError("a wrong block digest")
    http, found, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    if not found or not http.startswith(b"HTTP/1.1 ") or size is None:
        raise ArchiveError("no HTTP response with a length")
    kind = fields["warc-type"]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ArchiveError("the payload differs from its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields or fields.get("warc-profile") != REVISIT_PROFILE:
        raise ArchiveError(f"a malformed {kind} record")
    return {"page_id": _number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _number(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload}


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes):
        import zstandard

        self.out, self.size = out, 0
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        kind = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_checksum=True, write_content_size=True).compress

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self._compress(data))


def frames(source, chunk: int = 1 << 15) -> Iterator[bytes]:
    """The records of an archive's stream, one from each frame; holds one record and one chunk."""
    import zstandard

    head = source.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICTIONARY_MAGIC:
        raise ArchiveError("the archive doesn't begin with a dictionary frame")
    size = struct.unpack("<II", head)[1]
    dictionary = source.read(size)
    if len(dictionary) != size:
        raise ArchiveError("the dictionary is cut off")
    if dictionary[:4] == FRAME_MAGIC:
        # The convention lets the dictionary itself be one compressed frame.
        try:
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"a damaged dictionary: {e}") from e
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    data = source.read(chunk)
    while data:
        one, parts = decompressor.decompressobj(), []
        try:
            while not one.eof:
                if not data:
                    raise ArchiveError("the last frame is cut off")
                parts.append(one.decompress(data))
                data = one.unused_data if one.eof else source.read(chunk)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"a damaged frame: {e}") from e
        yield b"".join(parts)
        data = data or source.read(chunk)


def train_dictionary(df: DataFrame) -> bytes:
    """A dictionary from a bounded sample (SAMPLE_ROWS x SAMPLE_BYTES) of (page_id, payload): the pages of the lowest ids.

    It is the same in every run; empty where there are too few payloads.
    """
    import zstandard

    filled = df.where(F.octet_length("payload") > 0)
    # The ids first, a narrow scan; the filter on them then spares the payloads of most row groups where files are ordered.
    top = df.select("page_id").orderBy(F.col("page_id").asc_nulls_last()).limit(SAMPLE_ROWS).agg(F.max("page_id")).first()[0]
    lowest = filled if top is None else filled.where((F.col("page_id") <= top) | F.col("page_id").isNull())
    sample = [bytes(r[1]) for r in lowest.select("page_id", F.substring("payload", 1, SAMPLE_BYTES).alias("head")).orderBy(F.col("page_id").asc_nulls_last(), "head").limit(SAMPLE_ROWS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if len(sample) >= 50 else b""
    except zstandard.ZstdError:
        return b""


def classified(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to and revisit of every row.

    A null html is an empty payload.  Rows that share the largest id of a group are all responses.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})
    groups = rows.where(F.col("payload_bytes") >= dedup_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "refers_to")
    # Only payloads with a copy are in ``groups``; a short payload's digest never is, as equal digests have equal lengths.
    # Their digests meet the rows by a broadcast, so that payloads stay where they are; a shuffle moves them only if groups are very many.
    groups = written(groups, "payload-groups")
    joined = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "payload_digest", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(df: DataFrame, folder: str, **columns) -> DataFrame:
    """Write one record per row under ``folder``; returns the manifest (path, bytes, n_records) of committed archives."""
    spark = df.sparkSession
    rows = classified(df, **columns)
    dictionary = spark.sparkContext.broadcast(train_dictionary(df.select(F.col(columns.get("id_col", "page_id")).cast("bigint").alias("page_id"), F.col(columns.get("html_col", "html")).cast("binary").alias("payload"))))

    def write(batches):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        out = writer = None
        done, n = [], 0
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                if writer is None:
                    path, n = f"{folder}/pages-{uuid.uuid4().hex}.warc.zst", 0
                    out = fs.open_output_stream(filesystem(path)[1])
                    writer = ArchiveWriter(out, dictionary.value)
                writer.add(record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["payload_bytes"], row["refers_to"], row["revisit"]))
                n += 1
                if writer.size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, writer.size, n))
                    writer = None
        if writer is not None:
            out.close()
            done.append((path, writer.size, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "bytes", "n_records"])

    return written(rows.mapInArrow(write, "path string, bytes bigint, n_records bigint"), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, *, payload: bool = False) -> DataFrame:
    """One row per record of the manifest's archives, validated; ``payload`` adds the payload (null for a revisit).

    Raises ArchiveError on a damaged archive, or one whose records are not as many as the manifest says.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + ([("payload", pa.binary())] if payload else []))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = filesystem(row["path"])
                rows, total, held = [], 0, 0
                with fs.open_input_stream(at) as source:
                    for data in frames(source):
                        one = parse(data)
                        body = one.pop("payload")
                        if payload:
                            one["payload"] = body if one["record_type"] == "response" else None
                            held += len(body)
                        rows.append(one)
                        total += 1
                        if len(rows) >= 2000 or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if total != row["n_records"]:
                    raise ArchiveError(f"{row['path']} has {total} records, not {row['n_records']}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.repartition(min(4096, max(1, manifest.count()))).mapInArrow(read, RECORD + (", payload binary" if payload else ""))


def unresolved(records: DataFrame) -> DataFrame:
    """The revisit records (as ``read_archives`` gives them) whose response of the same payload is in none of the archives."""
    there = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest")
    return records.where("record_type = 'revisit'").join(there, ["refers_to", "payload_digest"], "left_anti")


def round_trip(df: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    spark = df.sparkSession
    return read_archives(spark, write_archives(df, scratch(spark, "warc")))
