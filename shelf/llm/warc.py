"""Web archives (WARC 1.1): writing with segmented records and revisits, reading with segments put together again."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from shelf.llm.arrow import bounded_batches
from shelf.llm.bits import bitmap, maybe_in, surely_not_in
from shelf.session import materialize

#: Bytes of a record's block: a longer one goes on in continuation records. Bytes of one chunk of the transfer framing.
SEGMENT_BYTES, CHUNK_BYTES = 64 * 1024, 8 * 1024
#: Records of one file.
FILE_RECORDS = 4096
#: What a record begins with; the reader parts files there and puts together what a payload of this text was parted into.
MARK = b"WARC/1."
HEADER_BYTES = 64 * 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
IDS = uuid.UUID("5f0ad0b6-6b5e-4f5c-9b1e-2f0f6ad4a0c3")

RECORD = "record_id string, record_type string, key string, uri string, refers_to string, payload binary, payload_digest string, problem string"
PART = "origin string, number int, total bigint, record_type string, key string, uri string, declared string, block binary, problem string"
VALUE = pa.schema([("value", pa.binary())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        chunk = payload[at:at + size]
        parts += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """What the chunked framing holds; ValueError where a size, a line break or the last chunk is missing."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if size < 0 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, its transfer framing taken off."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP head")
    fields = [line.partition(b":") for line in head.split(b"\r\n")[1:]]
    coded = any(name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower() for name, _, value in fields)
    return unchunked(body) if coded else body


# writing

def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in [*fields, ("Content-Length", len(block))] if value is not None]
    return MARK + b"1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _urn(name: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, name) if name is not None else uuid.uuid4()}>"


def _records_of(row: dict, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    quoted = {name: None if row[name] is None else quote(row[name], safe=":/?#[]@!$&'()*+,;=%~" if name == "uri" else "") for name in ("key", "uri")}
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["sha"])).decode()
    common = [("WARC-Date", date), ("WARC-Target-URI", quoted["uri"]), ("Source-Key", quoted["key"]), ("WARC-Payload-Digest", digest)]
    if row["payload"] is None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(None)), *common, ("WARC-Refers-To", _urn(row["sha"])), ("WARC-Profile", PROFILE),
                       ("Content-Type", "application/http;msgtype=response")], HEAD)
        return
    block = HEAD + chunked(row["payload"], chunk_bytes)
    own = _urn(row["sha"] if row["named"] else None)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    yield _record([*fields, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = at + segment_bytes >= len(block)
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(f"{own}:{number}")), ("WARC-Date", date), ("WARC-Target-URI", quoted["uri"]),
                       ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", len(block) if last else None)],
                      block[at:at + segment_bytes])


def _written(batches: Iterator[pa.RecordBatch], date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [v for row in batch.to_pylist() for v in _records_of(row, date, segment_bytes, chunk_bytes)]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], schema=VALUE)


def _dealt(pages: DataFrame, key: str, uri: str, payload: str, least: int) -> DataFrame:
    """(key, uri, sha, payload, named): what is written of every row; a revisit has no payload.

    Only rows whose payload may have copies are shuffled.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    fit = F.octet_length("payload") >= least
    order = F.struct(F.col("key").isNull().alias("none"), "key")
    times = rows.where(fit).groupBy("sha", "key").agg(F.count(F.lit(1)).alias("n"))
    groups = materialize(times.groupBy("sha").agg(F.sum("n").alias("all"), F.min_by(F.struct("key", "n"), order).alias("first")).where("all > 1").select("sha", "first"))
    copied = bitmap(groups, "sha")

    def out(df: DataFrame, kept, named=F.lit(True)) -> DataFrame:
        return df.select(F.col("key").cast("string").alias("key"), "uri", "sha", kept.alias("payload"), named.alias("named"))

    alone = out(surely_not_in(rows, "sha", copied), F.col("payload"), fit).unionByName(
        out(maybe_in(rows.where(~fit), "sha", copied), F.col("payload"), F.lit(False)))
    met = maybe_in(rows.where(fit), "sha", copied).join(groups, "sha", "left")
    is_first = F.col("first").isNull() | F.col("key").eqNullSafe(F.col("first.key"))
    again = F.col("first.n") > 1
    once = met.where(~(is_first & F.coalesce(again, F.lit(False))))
    found = alone.unionByName(out(once, F.when(is_first, F.col("payload"))))
    if groups.where(again).limit(1).count() == 0:
        return found
    # rows that repeat the first one: one of them is the response; they are counted where they are, not gathered
    counted = met.where(is_first & again).withColumn("pid", F.spark_partition_id()).groupBy("sha", "key", "uri", "pid").agg(
        F.any_value("payload").alias("payload"), F.count(F.lit(1)).alias("n"))
    counted = materialize(counted)
    chosen = counted.groupBy("sha").agg(F.min(F.struct(F.col("uri").isNull().alias("none"), "uri", "pid")).alias("least"))
    chosen = counted.join(chosen, "sha").withColumn("own", F.col("uri").eqNullSafe(F.col("least.uri")) & (F.col("pid") == F.col("least.pid")))
    left = F.col("n") - F.when(F.col("own"), 1).otherwise(0)
    copies = chosen.where(left > 0).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return found.unionByName(out(chosen.where("own"), F.col("payload"))).unionByName(out(copies, F.lit(None).cast("binary")))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0,
               segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_records: int = FILE_RECORDS, date: str | None = None) -> None:
    """Write a record of every row to gzip archives in the folder ``path``.

    Of rows with equal payloads of at least ``least`` bytes that of the smallest key (null keys last;
    of repeated rows any one) becomes a response, the others revisits of it; shorter payloads are all responses. A null
    payload is empty. A response is an HTTP message in chunked framing; where that is longer than
    ``segment_bytes``, it goes on in continuation records, which may be in other files. Keys are kept
    as text in the field Source-Key; null keys and addresses are left out. Other columns are not written.

    Spark's own writer commits the files, so a task that is lost and run again leaves none twice; a
    response's id comes from its payload, so revisits know it without a look at it.
    """
    bounded_batches(pages.sparkSession)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = _dealt(pages, key, uri, payload, least).mapInArrow(
        partial(_written, date=date, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes), "value binary")
    # each record ends in two line breaks, which the text writer adds; a cast keeps bytes as they are
    (records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", file_records).text(path))


# reading

def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(fields, block, problem) of every record of the files, each given as its pieces between marks, in order."""
    file: str | None = None
    held: list[bytes] = []
    size, need, fields, start = 0, None, {}, 0

    def broken() -> tuple[dict[str, str], bytes, str]:
        return fields, MARK.join(held)[start:] if start else b"", "the record ends before its length"

    for batch in batches:
        for path, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            piece = value.as_py()
            if path != file:
                if held:
                    yield broken()
                file, held, need, fields, start = path, [], None, {}, 0
                if piece.strip():
                    yield {}, piece, "the file does not begin with a record"
                continue  # what stands before the first mark
            size = size + len(MARK) + len(piece) if held else len(piece)
            held.append(piece)
            if need is None:
                text = MARK.join(held)
                head, found, _ = text.partition(b"\r\n\r\n")
                if not found:
                    if len(text) > HEADER_BYTES:
                        yield {}, text, "no end of the header"
                        held = []
                    continue
                lines = [line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]]
                fields = {name.strip().lower(): value.strip() for name, _, value in lines}
                start = len(head) + 4
                length = fields.get("content-length", "")
                if not length.isdigit():
                    yield fields, text, "no length"
                    held, fields, start = [], {}, 0
                    continue
                need = start + int(length)
            if size >= need:
                text = MARK.join(held)
                yield fields, text[start:need], None if text[need:] in (b"\r\n\r\n", b"") else "more than its length says"
                held, need, fields, start = [], None, {}, 0
    if held:
        yield broken()


def _unquoted(fields: dict[str, str], name: str) -> str | None:
    return unquote(fields[name]) if name in fields else None


def _decoded(record_id, kind, key, uri, refers_to, declared, block, problem) -> tuple:
    """A row of ``RECORD``: responses get their payload and its digest, which must be the declared one."""
    payload = digest = None
    if kind == "response" and problem is None:
        try:
            payload = payload_of(block)
            digest = base32_sha1(payload)
            problem = None if declared in (None, digest) else "the payload's digest differs"
        except ValueError as error:
            problem = str(error)
    return (record_id, kind, key, uri, refers_to, payload, digest or declared, problem)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _parsed(batches: Iterator[pa.RecordBatch], segments: bool, schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for fields, block, problem in _framed(batches):
        if ("warc-segment-number" in fields) != segments:
            continue
        kind, key, uri = fields.get("warc-type"), _unquoted(fields, "source-key"), _unquoted(fields, "warc-target-uri")
        declared = fields["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in fields else None
        own = fields.get("warc-record-id")
        if segments:
            number, total = fields["warc-segment-number"], fields.get("warc-segment-total-length", "")
            rows.append((fields.get("warc-segment-origin-id", own), int(number) if number.isdigit() else None, int(total) if total.isdigit() else None,
                         kind, key, uri, declared, block, problem))
        else:
            rows.append(_decoded(own, kind, key, uri, fields.get("warc-refers-to"), declared, block, problem))
        size += len(block)
        if size >= most:
            yield _batch(rows, schema)
            rows, size = [], 0
    yield _batch(rows, schema)


def _assembled(origin: str | None, parts: list[dict]) -> tuple:
    """The record of segments that are in order: numbers from 1 without a gap, one total, which is their length."""
    first, totals = parts[0], {p["total"] for p in parts if p["total"] is not None}
    problem = next((p["problem"] for p in parts if p["problem"]), None)
    block = b"".join(p["block"] for p in parts)
    if problem is None and [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
        problem = "a segment is missing or comes twice"
    if problem is None and (parts[-1]["total"] is None or totals != {len(block)}):
        problem = "the segments are not as long as their total"
    return _decoded(origin, first["record_type"], first["key"], first["uri"], None, first["declared"], block, problem)


def _make_assembled():
    kind = to_arrow_type(StructType.fromDDL(RECORD))

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for origin, parts in columns:
            yield pa.array([_assembled(o, p) for o, p in zip(origin.to_pylist(), parts.to_pylist())], type=kind)

    run.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, StructType.fromDDL(RECORD))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, key, uri, refers_to, payload, payload_digest and problem of every record of gzip archives.

    A record that is in one piece is decoded where it is read. Continuation records are grouped by the
    id of their origin and put in order of their segment numbers; a missing or repeated segment, or a total that is not
    their length, is named in ``problem``, as are cut records, bad framing and a digest that differs
    from the payload's. Such records have no payload or the one that was read. Revisits have none; their digest is the
    declared one. Empty archives give no rows. The files are read front to back, a task each, and no
    more than one record is held: payloads may hold anything, the record mark too.
    """
    bounded_batches(spark)
    read = spark.read.option("lineSep", MARK.decode()).text(path)
    if plain := [f for f in read.inputFiles() if not f.endswith(".gz")]:
        raise ValueError(f"only gzip archives are read, as others are split between tasks: {plain[0]}")
    pieces = read.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    most = 4 << 20

    def rows(segments: bool, kind: str) -> DataFrame:
        return pieces.mapInArrow(partial(_parsed, segments=segments, schema=to_arrow_schema(StructType.fromDDL(kind)), most=most), kind)

    parts = rows(True, PART).groupBy("origin").agg(F.array_sort(F.collect_list(F.struct(
        "number", "total", "record_type", "key", "uri", "declared", "block", "problem"))).alias("parts"))
    return rows(False, RECORD).unionByName(parts.select(_make_assembled()("origin", "parts").alias("r")).select("r.*"))


def resolved(records: DataFrame) -> DataFrame:
    """Every record with payload_bytes, payload_digest and refers_to_key: revisits take them from the response they refer to.

    A revisit whose response is not there has null payload_bytes and refers_to_key. What is joined is without payloads.
    """
    slim = materialize(records.select("record_id", "record_type", "key", "uri", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"),
                                      "payload_digest", "problem"))
    origins = slim.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("key").alias("refers_to_key"),
                                                            F.col("payload_bytes").alias("origin_bytes"))
    revisits = slim.where("record_type = 'revisit'").join(origins, "refers_to", "left").withColumn("payload_bytes", F.col("origin_bytes"))
    columns = ["record_id", "record_type", "key", "uri", "refers_to", "refers_to_key", "payload_bytes", "payload_digest", "problem"]
    others = slim.where("NOT record_type <=> 'revisit'").withColumn("refers_to_key", F.lit(None).cast("string"))
    return others.select(columns).unionByName(revisits.select(columns))
