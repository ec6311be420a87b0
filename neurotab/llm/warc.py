"""Dictionary-compressed WARC archives.

Each archive (.warc.zst) starts with a skippable frame that holds a Zstandard
dictionary trained on the archive's own payloads; then every WARC record is one
frame compressed with it, so that any record can be read alone given its
offset.  Equal payloads are stored once: the record of the smallest page id is
a ``response``, later ones ``revisit`` it.  Small payloads are all responses.

Tasks write archives of bounded size into a folder that all executors share,
under names of their own, and return a manifest with one row per record.  The
manifest is a Spark table, so the files of a task attempt that was lost are
listed nowhere and never read.

Defined results: a null payload is an empty one; rows of one payload that share
its smallest id (repeated rows) are all responses; among equal payloads without
any id all are responses, and one without an id revisits the smallest id there
is; an empty table gives no archive; a very long payload is one record of an
archive of its own size.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import map_batches, write_scratch

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20  # of payload, before compression
DICT_BYTES = 64 << 10
LEVEL = 3
ARCHIVES_A_TASK = 4
# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "archive string, offset long, length long, page_id {id}, record_type string, payload_digest string"
RECORDS = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}, payload binary"


def urn(page_id) -> str:
    return "<urn:page:" + ("" if page_id is None else quote(str(page_id), safe="")) + ">"


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record.  A revisit carries the payload's digest and length alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha256:" + digest)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(header fields, payload, announced payload length) of one record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, payload = rest[:int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    announced = next(int(line[16:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    return fields, payload, announced


def dictionary(payloads: list[bytes]):
    """Dictionary from all payloads of an archive; raw content where there is
    too little to train on."""
    import zstandard as zstd

    samples = [p for p in payloads if p]
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstd.train_dictionary(size, samples, k=512, d=8)
    except (zstd.ZstdError, ValueError):
        return zstd.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES].ljust(8, b"\0"), dict_type=zstd.DICT_TYPE_RAWCONTENT)


def as_dictionary(data: bytes):
    import zstandard as zstd

    raw = data[:4] != struct.pack("<I", 0xEC30A437)
    return zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT if raw else zstd.DICT_TYPE_AUTO)


def write_archive(rows: list[dict], folder: str) -> list[dict]:
    """Write one archive and return its manifest rows."""
    import zstandard as zstd
    from pyarrow import fs

    trained = dictionary([r["payload"] for r in rows if r["kind"] == "response"])
    body = trained.as_bytes()
    compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=trained)
    system, base = fs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.warc.zst"
    out = []
    with system.open_output_stream(f"{base}/{name}.part", compression=None) as f:
        f.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        for r in rows:
            frame = compressor.compress(record(r["kind"], r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"]))
            out.append({"archive": f"{folder}/{name}", "offset": f.tell(), "length": len(frame), "page_id": r["page_id"],
                        "record_type": r["kind"], "payload_digest": r["digest"]})
            f.write(frame)
    system.move(f"{base}/{name}.part", f"{base}/{name}")
    return out


def read_archive(path: str) -> Iterator[bytes]:
    """The records of an archive, frame by frame, in bounded memory."""
    import zstandard as zstd
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE_MAGIC:
            raise ValueError(f"{path}: no dictionary frame")
        reader = zstd.ZstdDecompressor(dict_data=as_dictionary(f.read(size)))
        left = b""
        while left or (left := f.read(1 << 16)):
            frame, parts = reader.decompressobj(), []
            while True:
                parts.append(frame.decompress(left))
                left = frame.unused_data
                if frame.eof:
                    break
                left = f.read(1 << 16)
                if not left:
                    raise ValueError(f"{path}: a frame is cut off")
            yield b"".join(parts)


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to) of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    digests = rows.select("page_id", F.sha2("payload", 256).alias("d"), F.octet_length("payload").alias("n")).filter(F.col("n") >= MIN_REVISIT_BYTES)
    # partial counts keep a payload with very many copies from one task
    firsts = digests.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null")
    # a written table: broadcast by the planner if small, else AQE may split a hot payload's rows
    firsts = write_scratch(firsts.select("d", "first"), "warc-firsts")
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(firsts, F.col("digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"),
                       F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages and return the manifest, written beside the archives."""
    records = plan_records(pages, page_id, url, html)
    kind = records.schema["page_id"].dataType.simpleString()
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    schema = ["archive", "offset", "length", "page_id", "record_type", "payload_digest"]

    def columns(rows: list[dict]) -> dict:
        return {c: [r[c] for r in rows] for c in schema}

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from neurotab.llm.common import as_batch

    arrow = to_arrow_schema(_parse_datatype_string(MANIFEST.format(id=kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                held.append(row)
                size += len(row["payload"])
                if size >= ARCHIVE_BYTES:
                    yield as_batch(columns(write_archive(held, folder)), arrow)
                    held, size = [], 0
        if held:
            yield as_batch(columns(write_archive(held, folder)), arrow)

    manifest = records.mapInArrow(run, MANIFEST.format(id=kind))
    return write_scratch(manifest, "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives that the manifest lists, checked against
    its digest.  A revisit's payload stays with the record it refers to."""
    kind = manifest.schema["page_id"].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")

    def identity(value: str):
        text = unquote(value[len("<urn:page:"):-1])
        return None if not text else int(text) if whole else text

    def run(batch: pa.RecordBatch):
        for path in batch.column(0).to_pylist():
            out = {c: [] for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
            held = 0
            for data in read_archive(path):
                fields, payload, announced = parse(data)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != announced):
                    raise ValueError(f"{path}: {fields['WARC-Record-ID']} does not match its digest")
                target, referred = fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To")
                for c, v in zip(out, (identity(fields["WARC-Record-ID"]), target and unquote(target), announced, digest, fields["WARC-Type"],
                                      referred and identity(referred), payload if payloads else None), strict=True):
                    out[c].append(v)
                held += len(payload) if payloads else 0
                if held > 1 << 22:
                    yield out
                    out, held = {c: [] for c in out}, 0
            yield out

    archives = manifest.select("archive").distinct()
    # a few archives a task: by their names alone AQE would put very many into one
    archives = archives.repartition(max(1, -(-archives.count() // ARCHIVES_A_TASK)), "archive")
    return map_batches(archives, run, RECORDS.format(id=kind))
