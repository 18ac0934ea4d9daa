"""WARC: write pages as archives, read archives back, assemble transactions.

`write_archives` makes three records of a page, a request, a response (or a revisit,
where an earlier capture has the same payload) and a metadata record; request and
metadata name the response in WARC-Concurrent-To. Records are written by Spark's
text sink, whose separator is the blank line pair that ends a record, so archives can
lie in any store that Spark writes; files are cut by bytes. `read_archives` parses any
gzipped or plain archives by Content-Length, inflating and parsing as it goes, and
`assemble` joins records into one row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, written

CRLF = "\r\n"
#: equal rows that one task makes of one; more are dealt out in runs of so many
EQUAL_ROWS = 1000
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: two digit groups of 10 make 8 letters each... of 5 bits."""
    groups = []
    for g in range(4):  # 10 hex digits are 40 bits are 8 letters
        number = F.conv(F.substring(digest, g * 10 + 1, 10), 16, 10).cast("long")
        for k in range(8):
            at = F.shiftright(number, 35 - 5 * k).bitwiseAND(31).cast("int")
            groups.append(F.substring(F.lit(_B32), at + 1, F.lit(1)))
    return F.concat(*groups)


def _uuid(*parts: Column) -> Column:
    """Record id derived from the content, so that a task that runs again gives the same one."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cut)), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record up to its block's end; fields that are null are left out. The sink adds the closing line pair."""
    head = [F.lit("WARC/1.1" + CRLF)]
    head += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, bytes_per_file: int = 16_000_000,
    every_row: bool = False,
) -> None:
    """Write gzipped archives of ``pages`` under ``path``.

    Of captures with equal payloads of at least ``least_bytes`` bytes the one with the
    smallest id is the response and the others are revisits of it; smaller payloads are
    all responses. Null html is an empty payload, a null url an empty one; line breaks
    in urls are percent-encoded in the target URI and kept exactly in the metadata.
    Null ids order last. Rows that repeat id, url and payload are one capture; with
    ``every_row`` they are numbered and each is a capture of its own. Numbers only tell
    equal rows apart, so a task that runs again writes the same records. An empty table
    gives archives without records; other columns are ignored, whatever their names.

    A file holds at most ``bytes_per_file`` before compression, or one capture that is
    larger by itself.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("hex", F.sha1("html")).withColumn("size", F.octet_length("html"))
    # ids as keys of joins, with null as one of them
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("null")))
    capture = ["hex", "size", "key", "url"]
    distinct = rows.groupBy(*capture).agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # null ids are never the smallest unless there are no others
    # (copies are in it so that both uses of `distinct` have the same columns and share its exchange)
    first = distinct.groupBy("hex", "size").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "url", "copies")).alias("first"))
    # computed keys keep the join from taking over the aggregations' partitioning, so that
    # adaptive execution can split a payload that many pages have
    payload = lambda: F.concat_ws(" ", "hex", F.col("size").cast("string"))
    first = first.select(payload().alias("_payload"), "first")
    named = distinct.join(first, payload() == F.col("_payload")).select(*capture, "id", "copies", "first")
    # whole captures are dealt, so a payload that many pages have stays spread out
    if not every_row:
        d = rows.join(named.drop("id"), capture).withColumn("n", F.lit(1))
    else:
        named = written(named, "captures")
        if named.filter(F.col("copies") > EQUAL_ROWS).isEmpty():
            d = rows.join(named.drop("id"), capture).withColumn("n", F.row_number().over(Window.partitionBy(*capture).orderBy("hex")))
        else:
            # of equal rows one is taken where they lie, before anything moves, and made again, very many of them in runs
            one = rows.groupBy(*capture).agg(F.first("html").alias("html")).join(named, capture)
            few, many = one.filter(F.col("copies") <= EQUAL_ROWS), one.filter(F.col("copies") > EQUAL_ROWS)
            few = few.withColumn("run", F.lit(0).cast("long"))
            many = many.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / EQUAL_ROWS)))).repartition(*capture, "run")
            start = F.col("run") * EQUAL_ROWS + 1
            d = few.unionByName(many).withColumn("n", F.explode(F.sequence(start, F.least(start + EQUAL_ROWS - 1, F.col("copies")))))
    d = d.withColumn("revisit", (F.col("size") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first.id")))
    own = (F.col("key"), F.col("hex"), F.col("n").cast("string"), F.col("url"))
    ids = {k: _uuid(F.lit(k), *own) for k in ("response", "request", "metadata")}
    original = _uuid(F.lit("response"), F.col("first.key"), F.col("hex"), F.lit("1"), F.col("first.url"))
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("hex")))
    line = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    when = F.lit("1970-01-01T00:00:00Z")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2)
    )
    common = [("WARC-Target-URI", F.when(line != "", line)), ("WARC-Date", when)]
    again = F.col("revisit")
    response = _record(
        [
            ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", ids["response"]),
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(again, original)),
            ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(again, http).otherwise(F.concat(http, F.col("html"))),
    )
    target = F.coalesce(F.nullif(F.regexp_replace(line, r"^.*?://[^/?#]*", ""), F.lit("")), F.lit("/"))
    host = F.regexp_extract(line, r"://([^/?#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", ids["request"]), *common, ("WARC-Concurrent-To", ids["response"]), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)),
    )
    meta = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("url").alias("url")))
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", ids["metadata"]), *common, ("WARC-Concurrent-To", ids["response"]), ("Content-Type", F.lit("application/json"))],
        meta,
    )

    def files(batches):
        """Captures of a task, put together up to a file's bytes: one row a file."""
        held, size = [], 0
        for batch in batches:
            for r in batch.column(0).cast(pa.binary()).to_pylist():
                if held and size + len(r) > bytes_per_file:
                    yield _one_string(_BETWEEN.join(held))
                    held, size = [], 0
                held.append(r)
                size += len(r) + len(_BETWEEN)
        if held:
            yield _one_string(_BETWEEN.join(held))

    captures = d.select(F.concat_ws(CRLF * 2, request, response, metadata).alias("value")).mapInArrow(files, "value string")
    captures.write.option("compression", "gzip").option("lineSep", CRLF * 2).option("maxRecordsPerFile", 1).text(path)
    if every_row:
        discard(named)


_BETWEEN = (CRLF * 2).encode()


def _one_string(data: bytes) -> pa.RecordBatch:
    offsets = pa.py_buffer(np.array([0, len(data)], np.int32).tobytes())
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), 1, [None, offsets, pa.py_buffer(data)])], ["value"])


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r?\n")


#: bytes that are taken from a file, and records that are handed on, at a time
STEP, BATCH_BYTES = 1 << 20, 16_000_000


def plain(data: bytes) -> Iterator[bytes]:
    """Plain bytes of a gzip file of any number of members, or of a plain file, piece by piece."""
    at = 0
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + STEP] for at in range(0, len(data), STEP))
        return
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = data[at : at + STEP]
            if not piece:
                raise ValueError("gzip file is cut short")
            if out := z.decompress(piece, 4 * STEP):
                yield out
            at += len(piece) - len(z.unconsumed_tail) - len(z.unused_data)


def inflated(data: bytes) -> bytes:
    return b"".join(plain(data))


def parse(data: bytes | Iterator[bytes]):
    """(offset, headers, block) of each record; names in lower case, repeated ones in a list.

    Takes bytes or pieces of them and holds one record and one piece at a time. Raises on
    a record that is cut short, or that does not state its length in one number: an archive
    is never taken for complete when it is not.
    """
    pieces = iter([data]) if isinstance(data, bytes) else data
    held, at, base = bytearray(), 0, 0  # held[at] is byte base + at of the archive

    def more() -> bool:
        nonlocal at, base
        del held[:at]
        base, at = base + at, 0
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while at < len(held) and held[at] in b"\r\n":
            at += 1
        if at == len(held):
            if not more():
                return
            continue
        while len(held) - at < 5 and more():
            pass
        if not held.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {base + at}")
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError(f"the record at byte {base + at} is cut short")
        headers: dict[str, list[str]] = {}
        for m in _HEADER.finditer(bytes(held[held.index(b"\n", at) + 1 : end + 2])):
            headers.setdefault(m[1].decode("utf-8").lower(), []).append(m[2].decode("utf-8", "replace").strip())
        stated = set(headers.get("content-length", []))
        if len(stated) != 1 or not re.fullmatch("[0-9]+", said := stated.pop()):
            raise ValueError(f"the record at byte {base + at} has no Content-Length")
        length, head = int(said), end + 4 - at
        while len(held) < at + head + length:
            if not more():
                raise ValueError(f"the record at byte {base + at} is cut short")
        yield base + at, headers, bytes(held[at + head : at + head + length])
        at += head + length


RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "content_type string, stated_digest string, stated_bytes long, payload_bytes long, payload_digest string, payload binary, file string, offset long"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (see RECORD).

    payload is the entity of HTTP messages and the block of others, null without
    ``payloads``; payload_digest is computed from it, stated_* are what headers say.
    A file comes as one value, as Spark reads it (2 GB at most, or it fails), and is
    inflated and parsed piece by piece. Files without records, and folders of such, give
    no rows; records that came twice give a row each.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, h, block in parse(plain(content.as_py())):
                    one = lambda n, h=h: h.get(n, [None])[0]
                    stated = None
                    if (one("content-type") or "").startswith("application/http"):
                        head, _, block = block.partition(b"\r\n\r\n")
                        if m := re.search(rb"(?im)^content-length:[ \t]*(\d+)", head):
                            stated = int(m[1])
                    rows.append(
                        (
                            one("warc-record-id"), one("warc-type"), one("warc-target-uri"), one("warc-date"), h.get("warc-concurrent-to", []), one("warc-refers-to"),
                            one("content-type"), one("warc-payload-digest"), stated, len(block), base64.b32encode(hashlib.sha1(block).digest()).decode(),
                            block if payloads or one("content-type") == "application/json" else None, name, offset,
                        )
                    )
                    size += len(rows[-1][-3] or b"")
                    if len(rows) >= 2000 or size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    s, n = pa.string(), pa.int64()
    types = [s, s, s, s, pa.list_(s), s, s, s, n, n, s, pa.binary(), s, n]
    schema = pa.schema([(f.split()[0], t) for f, t in zip(RECORD.split(", "), types, strict=True)])
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response, request, metadata (record structs, null where there is none).

    A capture is a response or revisit record. Its request and metadata are the records
    that name it in WARC-Concurrent-To, or that it names. Of several of a kind the one with
    the smallest id counts; a record that came twice counts once; a record that belongs to
    no capture gives no row. Responses that share an id are one capture. Records without an
    id are told apart by their places: such a response is a capture with a null capture_id,
    and such a request or metadata record belongs to the capture that it names.
    """
    own = F.col("type").isin("response", "revisit")
    every = F.struct(*(F.col(c) for c in records.columns))
    # ids are URIs, which have no spaces
    name = F.coalesce("record_id", F.concat_ws(" ", F.lit("at"), "offset", "file"))
    linked = records.select(name.alias("name"), "type", F.explode("concurrent_to").alias("other"))
    links = linked.select(F.when(own, F.col("name")).otherwise(F.col("other")).alias("capture"), F.when(own, F.col("other")).otherwise(F.col("name")).alias("name"))
    kinds = records.filter(F.col("type").isin("request", "metadata")).select(name.alias("name"), "type", every.alias("record"))
    parts = links.distinct().join(kinds, "name").groupBy("capture").agg(
        *(F.min_by(F.when(F.col("type") == k, F.col("record")), F.when(F.col("type") == k, F.col("name"))).alias(k) for k in ("request", "metadata"))
    )
    captures = records.filter(own).select(name.alias("capture"), F.col("record_id").alias("capture_id"), every.alias("response")).dropDuplicates(["capture"])
    return captures.join(parts, "capture", "left").drop("capture")
