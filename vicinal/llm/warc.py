"""WARC archives compressed with Zstandard dictionaries (.warc.zst).

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from a bounded sample of
its own records; then every record is a frame of its own, so that any can be read alone. Of records with equal
payloads the one with the smallest id is a response, later ones are revisits that refer to it.

Archives go to a folder that all executors share. A task writes under a name that no other attempt uses, and an
archive counts only if the manifest, which Spark commits, names it: lost executors leave nothing half-written in use.

Defined cases: a null payload counts as empty; rows with a null id are archived like others but never the response
others refer to unless all ids of the payload are null, and then each is a response; rows that repeat an id and
payload repeat the record type; a record has a WARC-Record-ID made of its page_id if no other row has that page_id, else, as without page_id, one
made of its archive and place, and revisits of a page_id that several rows have name the page alone, not a record; an empty table makes no
archive and no rows; other columns are ignored. Archives that the manifest does not name are removed once it is written.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, written

#: The skippable frame's magic number for dictionaries. Fixed value.
MAGIC = 0x184D2A5D
#: Bytes of a dictionary, of the sample it is built from, and of one sampled record.
DICTIONARY, SAMPLE, SAMPLED_RECORD = 64 << 10, 2 << 20, 32 << 10
LEVEL, ARCHIVE_BYTES, SALTS = 3, 512 << 20, 16
#: Repeated page_ids that are broadcast to the rows; more are joined.
BROADCAST_IDS = 500_000
DATE = "2000-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    """SHA-1 in base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(uri: str, page_id, payload: bytes | None, size: int, digest: str, refers_to=None, name_of: str | None = None, named: bool = True) -> bytes:
    """A WARC/1.1 record: a response, or a revisit if refers_to is given, which holds the HTTP header alone. Its id is made
    of page_id, so that revisits can tell that of their response, or of name_of, if given. named: whether refers_to names one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(x))}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id if name_of is None else name_of)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(uri.split())}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
        if named:
            lines.append(f"WARC-Refers-To: {name(refers_to)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary; None if the records are too few or too small to train one."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 8 << 10:
        return None
    try:
        return zstandard.train_dictionary(max(1 << 10, min(DICTIONARY, total // 8)), samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Writes records to a binary stream; the first records, up to SAMPLE bytes, wait until the dictionary is built."""

    def __init__(self, stream):
        self.stream, self.waiting, self.size, self.compressor, self.count, self.bytes = stream, [], 0, None, 0, 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def add(self, raw: bytes) -> None:
        self.count += 1
        if self.compressor:
            return self._put(self.compressor.compress(raw))
        self.waiting.append(raw)
        self.size += len(raw)
        if self.size >= SAMPLE:
            self._start()

    def _start(self) -> None:
        trained = dictionary([x[:SAMPLED_RECORD] for x in self.waiting])
        if trained:
            packed = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
            self._put(struct.pack("<II", MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
        for raw in self.waiting:
            self._put(self.compressor.compress(raw))
        self.waiting = []

    def close(self) -> None:
        if not self.compressor:
            self._start()


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    head, trained = stream.read(8), None
    if len(head) == 8 and struct.unpack("<II", head)[0] == MAGIC:
        packed = stream.read(struct.unpack("<II", head)[1])
        trained, head = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed)), b""
    decompressor, left = zstandard.ZstdDecompressor(dict_data=trained), head
    while True:
        frame, out = decompressor.decompressobj(), io.BytesIO()
        left = left or stream.read(1 << 16)
        if not left:
            return
        while True:
            out.write(frame.decompress(left))
            if frame.eof:
                left = frame.unused_data
                break
            left = stream.read(1 << 16)
            if not left:
                raise ValueError("the archive ends within a record")
        yield out.getvalue()


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")
    return system, path


def with_revisits(pages: DataFrame, min_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """page_id, url, payload (null in revisits), payload_bytes, sha1 (hex), refers_to, repeated and first_repeated (whether several rows have
    this page_id, or that of refers_to).

    Page ids are counted over narrow rows; only repeated ones come back. Payload groups are summed to their smallest id before they move, and only groups of two or more come back to the
    rows, each in SALTS copies, so that one payload shared by a third of all pages is spread over many tasks.
    """
    payload = F.coalesce(F.col(payload_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("page_id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    repeated = written(rows.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 AND page_id IS NOT NULL").select("page_id"), "repeated-ids")
    sent = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
    often = lambda table, key: table.join(sent.select(F.col("page_id").alias(key), F.lit(True).alias("_r")), key, "left")
    narrow = rows.where(F.col("payload_bytes") >= min_bytes).select("sha1", "page_id")
    groups = narrow.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = often(groups, "first_id").withColumn("first_repeated", F.coalesce("_r", F.lit(False))).drop("_r")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = often(rows, "page_id").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups.hint("merge"), ["sha1", "salt"], "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    refers = F.when(revisit, F.col("first_id"))
    return joined.select(
        "page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", "sha1", refers.alias("refers_to"),
        (F.coalesce("_r", F.lit(False)) | F.col("page_id").isNull()).alias("repeated"), F.coalesce("first_repeated", F.lit(False)).alias("first_repeated"),
    )


def write_archives(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Archive every row of pages; returns the committed manifest: uri, records, bytes of each archive."""

    def run(batches):
        writer = stream = system = uri = None
        done = []

        def close():
            writer.close()
            stream.close()
            done.append((uri, writer.count, writer.bytes))

        for batch in batches:
            for page_id, url, payload, size, sha1, refers, repeated, first_repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    system, path = _open(uri)
                    system.create_dir(os.path.dirname(path), recursive=True)
                    stream = system.open_output_stream(path, compression=None)
                    writer = ArchiveWriter(stream)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                writer.add(record(url, page_id, payload, size, digest, refers, f"{uri}#{writer.count}" if repeated else None, not first_repeated))
                if writer.bytes >= ARCHIVE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["uri", "records", "bytes"]
        )

    rows = with_revisits(pages, **columns)
    manifest = written(rows.mapInArrow(run, "uri string, records long, bytes long"), "warc-manifest")
    remove_strays(manifest, folder)
    return manifest


def remove_strays(manifest: DataFrame, folder: str) -> None:
    """Delete archives of attempts that failed: those in the folder that the manifest does not name."""
    spark = manifest.sparkSession
    named = {r["uri"].rpartition("/")[2] for r in manifest.select("uri").toLocalIterator()}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(path):
        for found in system.listStatus(path):
            if found.getPath().getName() not in named:
                system.delete(found.getPath(), False)


def read_archives(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """A row for each record: page_id, url, record_type, payload (null in revisits), payload_bytes, payload_digest, refers_to."""
    schema = f"page_id {id_type}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {id_type}, payload binary"

    def run(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                system, path = _open(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for raw in read_archive(stream):
                        rows.append(_row(raw))
                        size += len(raw)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    def _row(raw):
        fields, block = parse(raw)
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response" and (len(payload) != length or digest32(payload) != digest):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
        number = lambda name: int(fields[name]) if name in fields else None
        return number("X-Page-ID"), fields["WARC-Target-URI"], kind, length, digest, number("X-Refers-To-Page-ID"), payload if kind == "response" else None

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    ids = pa.int64() if id_type == "bigint" else pa.int32()
    types = [ids, pa.string(), pa.string(), pa.int64(), pa.string(), ids, pa.binary()]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = manifest.select("uri").repartition(max(1, min(manifest.count(), 10_000)), "uri")
    return files.mapInArrow(run, schema)


def archived(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Write archives of all pages to the shared folder and read them back."""
    folder = shared_path(spark, "warc")
    return read_archives(write_archives(pages, folder), pages.schema["page_id"].dataType.simpleString())
