"""WARC archives: writing with revisits and segments, reading back with segment reassembly.

Large blocks are written as a first segment and continuation records; each record is a gzip member of its own.
Reading groups segments by the origin record, orders them by number, checks the total length, and undoes chunked
transfer framing. Records of one segment are whole as they are read and are not shuffled.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.store import filesystem, maybe_member, membership, prepare, shared_dir, written

#: A block longer than this is cut into segments of this size; payloads are framed in chunks of CHUNK bytes.
SEGMENT, CHUNK = 8192, 4096
#: Payloads shorter than this are always written in full.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
RECORDS = "record_id string, warc_type string, origin string, segment int, total long, page_id long, refers_to long, digest string, block binary"
_FIELDS = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])


def frame(payload: bytes) -> bytes:
    """An HTTP response with the payload in chunked transfer coding."""
    out = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for a in range(0, len(payload), CHUNK):
        part = payload[a : a + CHUNK]
        out += [f"{len(part):x}\r\n".encode(), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unframe(block: bytes) -> bytes:
    """The payload of an HTTP response, with chunked transfer coding undone if its head names it."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP head")
    if not any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")):
        return body
    at, out = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size, at = int(body[at:end].partition(b";")[0], 16), end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, block: bytes, fields: dict[str, object]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **fields, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """The record of a page, and its continuation records if the block is long."""
    rid = f"<urn:uuid:{uuid.uuid4()}>"
    uri = "".join(c if 32 < ord(c) < 127 else "_" for c in url or "") or "unknown:"
    fields = {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": len(payload), **({"X-Page-ID": page_id} if page_id is not None else {})}
    if refers_to is not None:
        yield record("revisit", rid, b"HTTP/1.1 200 OK\r\n\r\n", fields | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": refers_to})
        return
    block = frame(payload)
    if len(block) <= SEGMENT:
        yield record("response", rid, block, fields)
        return
    cuts = range(0, len(block), SEGMENT)
    for k, a in enumerate(cuts):
        part = block[a : a + SEGMENT]
        if not k:
            yield record("response", rid, part, fields | {"WARC-Segment-Number": 1})
        else:
            last = {"WARC-Segment-Total-Length": len(block)} if k == len(cuts) - 1 else {}
            yield record("continuation", f"<urn:uuid:{uuid.uuid4()}>", part, {"WARC-Target-URI": uri, "WARC-Segment-Origin-ID": rid, "WARC-Segment-Number": k + 1, **last})


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads (names in lower case) and blocks of an archive, one record at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline().strip()):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a block is cut short")
        yield head, block


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write an archive per task under `path`; the manifest (path, n_records) is a written table.

    Only pages whose digest several pages have, as far as a filter of bounded size tells, are shuffled to learn
    whether they are revisits; all others are written where they are read. An attempt of a task writes a file of
    its own, and only finished attempts are in the manifest.
    """
    spark = pages.sparkSession
    prepare(spark)
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    page = page.withColumn("digest", F.unhex(F.sha1("payload")))
    full = page.where(F.length("payload") >= LEAST_REVISIT)
    first = written(full.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    several = spark.sparkContext.broadcast(membership(first, "digest"))

    def chosen(batches: Iterator[pa.RecordBatch], repeated: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([(len(p) >= LEAST_REVISIT and maybe_member(several.value, d.as_py())) == repeated for p, d in zip((x.as_buffer() for x in batch.column(2)), batch.column(3))], pa.bool_()))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, n = None, f"{path}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for page_id, url, payload, digest, keeper in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    fs, local = filesystem(uri)
                    fs.create_dir(local.rpartition("/")[0])
                    out = fs.open_output_stream(local, compression=None)
                for x in records(page_id, url, payload, digest.hex(), keeper):
                    out.write(gzip.compress(x, 1))
                    n += 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([uri]), pa.array([n])], names=["path", "n_records"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return archive(pa.record_batch([*b.columns, pa.nulls(b.num_rows, pa.int64())], names=[*b.schema.names, "keeper"]) for b in chosen(batches, False))

    # the largest page_id is the response; a null id is a revisit wherever another row has an id
    keeper = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper")), F.col("keeper"))
    told = page.mapInArrow(lambda batches: chosen(batches, True), page.schema).join(first, "digest", "left").select("page_id", "url", "payload", "digest", keeper.alias("keeper"))
    made = page.mapInArrow(alone, "path string, n_records long").unionByName(told.mapInArrow(archive, "path string, n_records long"))
    return written(made, "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """The records of all archives of a manifest, one file to a task."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, local = filesystem(uri)
                with fs.open_input_stream(local, compression=None, buffer_size=1 << 20) as stream:
                    rows, size = [], 0
                    for h, block in parse(gzip.GzipFile(fileobj=io.BufferedReader(stream, 1 << 20))):
                        number = lambda k: int(h[k]) if k in h else None
                        rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-segment-origin-id", h["warc-record-id"]), number("warc-segment-number"), number("warc-segment-total-length"), number("x-page-id"), number("x-refers-to-page"), h.get("warc-payload-digest"), block))
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)
                            rows, size = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(load, RECORDS)


def reassemble(found: DataFrame) -> DataFrame:
    """origin, page_id, warc_type, refers_to, digest, payload, complete: whole records.

    `segment` is null for records that are not segmented. A group holds one record's segments, so it is as large
    as one block. A record with a missing or repeated segment or a wrong total length, continuations without
    their first segment, and blocks whose framing is broken are kept with complete = false and a null payload.
    """
    cols = ["origin", "page_id", "warc_type", "refers_to", "digest"]
    alone = found.where("segment is null").select(*cols, F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("parts"), F.length("block").cast("long").alias("total"))
    parts = found.where("segment is not null").groupBy("origin").agg(*[F.max(c).alias(c) for c in ("page_id", "refers_to", "digest")], F.max(F.when(F.col("warc_type") != "continuation", F.col("warc_type"))).alias("warc_type"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for segments, total in zip(batch.column("parts").to_pylist(), batch.column("total").to_pylist()):
                block = b"".join(s["block"] for s in segments)
                try:
                    if total != len(block) or [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                        raise ValueError("a segment is missing, repeated or cut short")
                    good.append(unframe(block))
                except ValueError:
                    good.append(None)
            yield pa.record_batch([*[batch.column(c) for c in cols], pa.array(good, pa.binary()), pa.array([x is not None for x in good])], names=[*cols, "payload", "complete"])

    shape = "origin string, page_id long, warc_type string, refers_to long, digest string, payload binary, complete boolean"
    return alone.mapInArrow(decode, shape).unionByName(parts.select(*cols, "parts", "total").mapInArrow(decode, shape))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. Rows that repeat a page_id with the same payload are each written as the
    first is. A revisit's length and digest are those of the response it names, which is read from the archives;
    they are null where that response is incomplete. No row is lost. Null ids are kept; of equal payloads whose
    ids are all null every one is a response. Other columns than page_id, url and html are not looked at.
    """
    back = reassemble(read(write(pages, shared_dir(pages.sparkSession, "warc"))))
    back = written(back.select("page_id", "warc_type", "refers_to", F.regexp_replace("digest", "^sha1:", "").alias("named"), F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest")), "warc-read")
    whole = back.where("warc_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to")
    kept = whole.select(F.col("payload_digest").alias("d"), F.col("page_id").alias("k"), "payload_bytes").distinct()
    again = back.where("warc_type = 'revisit'").join(kept, (F.col("named") == F.col("d")) & (F.col("refers_to") == F.col("k")), "left")
    return whole.unionByName(again.select("page_id", "payload_bytes", F.col("d").alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to"))
