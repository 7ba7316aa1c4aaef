"""Web archives: written as whole-file gzip streams, normalised to one member a record, and read back by an index.

``write`` turns pages into WARC records, equal payloads as revisits of one
response. ``normalise`` inflates each archive once from start to end, writes
every record as a gzip member of its own, and a sidecar index of offsets.
``read`` fetches records by that index. Files lie in the cluster's shared
folder; each attempt of a task writes under a name of its own and only names
in a finished table count, so lost executors leave nothing half done behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import land
from .files import reach

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
# Gzip, not the bare zlib stream.
GZIP = 31
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + END


def _parse(record: bytes) -> dict:
    """Fields of one record and its payload; a response's digest is computed again and must agree."""
    head, _, rest = record.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(END)
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def page(name: str) -> int | None:
        number = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None
    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest,
            "record_type": kind, "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write archives of about ``ARCHIVE_BYTES`` before compression; returns the landed table (path, records).

    Of pages with equal payloads of at least ``min_bytes``, the one with the
    largest page_id is the response (all of them, if it repeats), the others
    revisit it. Pages with a NULL id are responses. A NULL html is an empty
    payload, a NULL url is left out. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = rows.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(
        F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1").select("digest", "newest")
    linked = rows.join(shared, "digest", "left").select(
        "page_id", "url", "payload", F.when((F.length("payload") >= min_bytes) & (F.col("page_id") < F.col("newest")), F.col("newest")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = reach(folder)
        store.create_dir(base, recursive=True)
        path, out, squeeze, records, size = None, None, None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, squeeze = store.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP)
                record = _record(row["page_id"], row["url"], row["payload"], row["refers_to"])
                out.write(squeeze.compress(record))
                records, size = records + 1, size + len(record)
                if size >= ARCHIVE_BYTES:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})
    return land(linked.mapInArrow(run, "path string, records long"), "warc-written")


def _inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file, member after member, without holding the file."""
    inflate = zlib.decompressobj(GZIP)
    while raw := source.read(READ_BYTES):
        while raw:
            yield inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(GZIP)


def _records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of bytes."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            if need is None:
                end = held.find(END, at)
                if end < 0:
                    break
                lengths = [line for line in bytes(held[at:end]).split(b"\r\n") if line.lower().startswith(b"content-length:")]
                need = end - at + len(END) + int(lengths[0].split(b":")[1]) + len(END)
            if len(held) - at < need:
                break
            yield bytes(held[at:at + need])
            at, need = at + need, None
        del held[:at]
    if held:
        raise ValueError("archive ends within a record")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """One gzip member for each record, and a sidecar index; returns the landed index (path, offset, length).

    Beside each archive lies ``<archive>.idx`` with one line ``offset length``
    for each record. A task takes one archive at a time, in a stream.
    """
    n = max(1, archives.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = reach(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                made, offset, places = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, []
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(made, compression=None) as out:
                    for record in _records(_inflated(source)):
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = squeeze.compress(record) + squeeze.flush()
                        out.write(member)
                        places.append((offset, len(member)))
                        offset += len(member)
                with store.open_output_stream(f"{made}.idx", compression=None) as side:
                    side.write("".join(f"{a} {b}\n" for a, b in places).encode())
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([made] * len(places), pa.string()), "offset": pa.array([a for a, _ in places], pa.int64()),
                    "length": pa.array([b for _, b in places], pa.int64())})
    return land(archives.select("path").repartition(n).mapInArrow(run, "path string, offset long, length long"), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the indexed records."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = reach(folder)
        path, source = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = []
                for place in batch.slice(start, 256).to_pylist():
                    if place["path"] != path:
                        if source is not None:
                            source.close()
                        path, source = place["path"], store.open_input_file(place["path"])
                    source.seek(place["offset"])
                    found.append(_parse(zlib.decompress(source.read(place["length"]), GZIP)))
                yield pa.RecordBatch.from_arrays([pa.array([row[name] for row in found], types[kinds[name]]) for name in names], names=names)
        if source is not None:
            with suppress(OSError):
                source.close()
    return index.select("path", "offset", "length").mapInArrow(run, ", ".join(f"{name} {kinds[name]}" for name in names))
