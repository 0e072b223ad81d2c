"""Seekable Zstandard WARC bundles: written with a footer seek table, then read back.

Records are grouped into independent frames of about `frame_bytes`; after the frames comes a skippable frame
with the seek table of the public seekable format (compressed and raw size of each frame).  The writer's rows
map every record identifier to (bundle, frame, offset inside the raw frame, length).

Of records with equal payloads of at least `min_revisit_bytes`, the one with the largest id is a `response`
and the others are `revisit` records naming it.  The hot side of that grouping is (id, digest) pairs only;
html meets the decision on (id, digest), which no copy group shares.

Cases: null html is an empty payload; a null url is an empty target; repeated rows of one id and payload all
take the same type; a null id is written as `null` and read back as null; an empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import cut, temporary
from maskweave.llm.shards import Upload, _store

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Tasks that read bundles back.
READERS = 20_000
INDEX = "record_id string, bundle string, frame int, frame_offset long, frame_size long, record_offset long, record_length long"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has no body but its payload's length and digest."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = HTTP + (payload if refers_to is None else b"")
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of a raw frame."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, raw[stop + 4 + len(HTTP) : stop + 4 + size]
        at = stop + 4 + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame, from the footer alone."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    flat, out, at = struct.unpack(f"<{2 * n}I", f.read(8 * n)), [], 0
    for k in range(n):
        out.append((at, flat[2 * k], flat[2 * k + 1]))
        at += flat[2 * k]
    return out


def revisits(pages: DataFrame, id_col: str, html_col: str, min_revisit_bytes: int) -> DataFrame:
    """Pairs (id, sha) that revisit another record, with that record's id."""
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    keys = cut(pages.select(F.col(f"`{id_col}`").alias("__id"), F.sha1(payload.cast("binary")).alias("__sha"), F.octet_length(payload).alias("__n")))
    keys = keys.filter(F.col("__n") >= min_revisit_bytes).drop("__n")
    # stored, so that the join below has a shuffle on either side and Spark can split a digest that very many records share
    leaders = cut(keys.groupBy("__sha").agg(F.max("__id").alias("__to"), F.count("*").alias("__c")).filter("__c > 1").drop("__c"))
    return keys.join(leaders, "__sha").filter("not __id <=> __to").distinct()


def write_bundles(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    frame_bytes: int = 256 << 10,
    bundle_bytes: int = 64 << 20,
    level: int = 3,
) -> DataFrame:
    """Write every row as a record; the result is the index of all records."""
    folder = folder or temporary(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    source = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").cast("string").alias("__url"), payload.alias("__html"))
    source = source.withColumn("__sha", F.sha1(F.col("__html").cast("binary")))
    found = revisits(pages, id_col, html_col, min_revisit_bytes).withColumnsRenamed({"__id": "__rid", "__sha": "__rsha"})
    decided = source.join(found, F.col("__id").eqNullSafe(F.col("__rid")) & (F.col("__sha") == F.col("__rsha")), "left").select("__id", "__url", "__html", "__sha", "__to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_, part = zstandard.ZstdCompressor(level=level, write_content_size=True), TaskContext.get().partitionId()
        count, frames, sizes, raw, notes, held = 0, [], [], bytearray(), [], []

        def close_frame() -> None:
            nonlocal raw, held
            packed = zip_.compress(bytes(raw))
            notes.extend((r, len(sizes), sum(map(len, frames)), len(packed), o, n) for r, o, n in held)
            frames.append(packed)
            sizes.append((len(packed), len(raw)))
            raw, held = bytearray(), []

        def close_bundle() -> pa.RecordBatch:
            nonlocal count, frames, sizes, notes
            name = f"part-{part:06d}-{count:04d}.warc.zst"

            file = Upload(folder)
            for x in [*frames, seek_table(sizes)]:
                file.write(x)
            file.done(name)
            c = list(zip(*notes, strict=True))
            made = pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip([c[0], [f"{folder}/{name}"] * len(notes), *c[1:]], [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4], strict=True)],
                names=[x.split()[0] for x in INDEX.split(", ")],
            )
            count, frames, sizes, notes = count + 1, [], [], []
            return made

        total = 0
        for batch in batches:
            for page, url, html, sha, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = record(page, url, html.encode(), base64.b32encode(bytes.fromhex(sha)).decode(), to)
                held.append((f"urn:page:{'null' if page is None else page}", len(raw), len(made)))
                raw += made
                if len(raw) >= frame_bytes:
                    close_frame()
                    total += sizes[-1][0]
                    if total >= bundle_bytes:
                        total = 0
                        yield close_bundle()
        if held:
            close_frame()
        if frames:
            yield close_bundle()

    return cut(decided.mapInArrow(write, INDEX))


def read_bundles(index: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Every record of the bundles that an index names, frame by frame, each payload checked against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                store, base = _store(folder)
                with store.open_input_file(f"{base}/{name}") as f:
                    for at, size, _ in read_seek_table(f):
                        f.seek(at)
                        rows = []
                        for head, payload in records(unzip.decompress(f.read(size))):
                            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"payload and digest differ in {path}")
                            to = head.get("WARC-Refers-To")
                            rows.append((head["WARC-Record-ID"][10:-1], int(head["X-Payload-Length"]), digest, kind, to and to[10:-1], head["WARC-Target-URI"], payload if kind == "response" else None))
                        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    bundles = cut(index.select("bundle").distinct())
    # a bundle a task; up to READERS tasks
    out = bundles.repartition(max(1, min(bundles.count(), READERS))).mapInArrow(read, "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(id_type)
    return out.withColumns({"record_id": number("record_id"), "refers_to": number("refers_to")})


def read_record(bundle: str, frame_offset: int, frame_size: int, record_offset: int, record_length: int) -> bytes:
    """One record by its index entry: a single ranged read and one frame's decompression."""
    import zstandard

    folder, _, name = bundle.rpartition("/")
    store, base = _store(folder)
    with store.open_input_file(f"{base}/{name}") as f:
        f.seek(frame_offset)
        return zstandard.ZstdDecompressor().decompress(f.read(frame_size))[record_offset : record_offset + record_length]
