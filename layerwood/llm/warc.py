"""WARC archives: records written as gzip members, and a splittable reader.

Writer: every record is one gzip member.  Spark's own text writer stores the
members, so files appear only when a task commits, on any file system Spark
knows.  A member ends with a zero byte (the high byte of its length; a longer
record is followed by an empty member), and that byte is the writer's line end:
a file is exactly its members in a row.

Reader: a task gets a byte range of a file.  It scans for the gzip magic,
accepts a place only if the member there decodes to a WARC header, decodes it to
its end (past the end of the range if need be, checksum included) and looks on
behind it.  The record belongs to the range its member starts in.  Only one
record is held at a time.

Defined cases: null payloads are empty; a null id is written as an absent
record number and read back as null; rows repeated with the largest id are all
responses, since no record can revisit itself; control characters in URLs are
percent-encoded; an empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compressobj(wbits=31).flush()
STEP = 1 << 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"
WHEN = "2000-01-01T00:00:00Z"


def mark_revisits(rows: DataFrame, key: str, payload: Column, least_bytes: int = 1000) -> DataFrame:
    """Add payload, payload_bytes, payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least ``least_bytes`` the one with the
    largest key is the response.  Digests are counted with partial sums in the
    tasks; only digests that occur twice are joined back, and adaptive execution
    splits the rows of a frequent one.
    """
    rows = rows.withColumn("payload", F.coalesce(payload.cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = rows.filter(F.col("payload_bytes") >= least_bytes).select("payload_digest", F.col(key).alias("_key"))
    twice = (large.groupBy("payload_digest").agg(F.max("_key").alias("_first"), F.count("*").alias("_copies"))
             .filter("_copies > 1").select("payload_digest", "_first"))
    rows = rows.join(twice, "payload_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first"))
    return rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"),
                             "refers_to": F.when(revisit, F.col("_first"))}).drop("_first")


def record_bytes(record_id: int | None, kind: str, url: str | None, refers_to: int | None,
                 digest: str, size: int, payload: bytes) -> bytes:
    number = "" if record_id is None else str(record_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{number}>"), ("WARC-Date", WHEN),
            ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="replace") if url else ""),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member_of(record: bytes) -> bytes:
    """A gzip member that ends with a zero byte; without a clock in it, so reruns agree."""
    pack = zlib.compressobj(6, wbits=31)
    member = pack.compress(record) + pack.flush()
    return member if member.endswith(b"\0") else member + EMPTY_MEMBER


def write_archives(rows: DataFrame, key: str, url: str, path: str) -> None:
    """Write rows of ``mark_revisits`` below path."""
    rows = rows.select(F.col(key).cast("long"), "record_type", url, "refers_to", "payload_digest", "payload_bytes",
                       F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *head, payload = (c[i].as_py() for c in batch.columns)
                yield pa.record_batch([pa.array([member_of(record_bytes(*head, payload or b""))[:-1]], pa.binary())], ["value"])

    packed = rows.mapInArrow(members, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


def parsed_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields of a record and where its block starts; None if there is no full header."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


class Window:
    """Bytes of a file from a moving place on, read in steps."""

    def __init__(self, file: io.RawIOBase, start: int, data: bytes = b""):
        self.file, self.start, self.data = file, start, data
        file.seek(start + len(data))

    def more(self) -> bool:
        got = self.file.read(STEP)
        self.data += got
        return bool(got)

    def drop_to(self, place: int) -> None:
        self.data, self.start = self.data[place - self.start:], place


def decoded(window: Window, place: int) -> tuple[bytes, int] | None:
    """The record whose member starts at place, and the place behind it; None if none does.

    The header is decoded first, so a false magic is given up after a few bytes.
    """
    unpack, out, at, accepted = zlib.decompressobj(wbits=31), [], place, False
    while True:
        piece = window.data[at - window.start:]
        if not piece:
            if not window.more():
                return None
            continue
        try:
            got = unpack.decompress(piece)
        except zlib.error:
            return None
        out.append(got)
        at += len(piece) - len(unpack.unused_data)
        if not accepted:
            head = b"".join(out)
            if not b"WARC/1.".startswith(head[:7]) and not head.startswith(b"WARC/1."):
                return None
            accepted = parsed_head(head) is not None
        if unpack.eof:
            return (b"".join(out), at) if accepted else None
        window.drop_to(at)


def records_in(file: io.RawIOBase, start: int, end: int) -> Iterator[bytes]:
    """Records whose members start in [start, end)."""
    window, place = Window(file, start), start
    while place < end:
        found = window.data.find(MAGIC, place - window.start)
        if found < 0:
            place = max(place, window.start + len(window.data) - len(MAGIC) + 1)
            if place >= end:
                return
            window.drop_to(place)
            if not window.more():
                return
            continue
        place = window.start + found
        if place >= end:
            return
        window.drop_to(place)
        held = Window(file, place, window.data)
        record = decoded(held, place)
        if record is None:
            place += 1
        else:
            yield record[0]
            place = record[1]
            # go on with the bytes that were read behind the record
            window = held
            window.drop_to(place)
            continue
        file.seek(window.start + len(window.data))


def number(field: str | None) -> int | None:
    text = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def as_row(record: bytes) -> dict:
    """Fields of a record; the payload of a response must have the digest its header names."""
    fields, start = parsed_head(record)
    block = record[start:start + int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {"record_id": number(fields["warc-record-id"]), "record_type": kind,
            "url": unquote(fields.get("warc-target-uri", "")) or None, "refers_to": number(fields.get("warc-refers-to")),
            "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


def read_archives(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """All records below path, read in ranges of ``split_bytes``.

    Files are listed by Spark; only names and lengths are read there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranges = files.filter("length > 0").select("path", "length", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least("length", F.col("start") + split_bytes).alias("end"))
    # a given number, as adaptive execution would join these few small rows into one task
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path", "start"))
    schema = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()),
                        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for place, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = place if "://" in place else place.replace("file:/", "file:///", 1)
                store, name = fs.FileSystem.from_uri(quote(place, safe="/:%"))
                with store.open_input_file(name) as file:
                    held, size = [], 0
                    for record in records_in(file, start, end):
                        held.append(as_row(record))
                        size += len(record)
                        if size > STEP * 16:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return ranges.mapInArrow(read, RECORD)
