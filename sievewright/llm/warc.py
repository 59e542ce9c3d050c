"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames of whole WARC records, and a seek table at its end
(a skippable frame by the public seekable format: sizes of all frames, their number, a magic number),
so that any frame can be read by itself. An index, written as Parquet beside the bundles, maps each
record's id to its bundle, frame and offset within the frame. Tasks write bundles under names of their
own and report them in index rows; a bundle counts only if the committed index names it, so attempts
that were lost or repeated leave nothing that a reader sees.

Of pages with equal payloads of ``least`` bytes or more, the one with the smallest id is a response and
the others are revisits, which carry the payload's digest and length but not the payload. Equal payloads are found
by digest on narrow rows, widely shared ones in slices; payloads move once, spread by id and digest.

Odd input: null html is an empty payload; null urls have no target header, and control characters and
blanks of urls are percent-encoded; rows without an id are responses, or revisits of an equal page that
has one; rows that share the smallest id of their group are all responses, and so are rows repeated
below the limit; an empty table gives an empty archive; a page of any length is one record in a frame
of its own length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.common import attach

#: Bytes of records in a frame, and of frames in a bundle, at which it is closed.
FRAME, BUNDLE = 1 << 20, 256 << 20
#: Payloads below this many bytes are always written.
LEAST = 100
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
INDEX = "bundle string, frame int, record_id string, offset long, length long"
FRAMES = "bundle string, frame int, at long, size long, raw long"
RECORDS = "record_id string, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def record(page_id: str | None, url: str | None, digest: str, size: int, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of another page's."""
    name = lambda x: f"<urn:page:{'null' if x is None else quote(x, safe='')}>"
    headers = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        headers.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    headers.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head = HTTP.format(size).encode()
    block = head + payload if refers_to is None else head
    headers += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(headers) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at``, and the place after it. Payloads are held against their digest."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record begins at {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    length = int(headers["Content-Length"])
    head, _, payload = data[end + 4 : end + 4 + length].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
    name = lambda x: None if x in (None, "<urn:page:null>") else unquote(x[10:-1])
    found = {"record_id": headers["WARC-Record-ID"], "page_id": name(headers["WARC-Record-ID"]), "url": headers.get("WARC-Target-URI"), "record_type": headers["WARC-Type"], "refers_to": name(headers.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": digest, "payload": payload if headers["WARC-Type"] == "response" else None}
    return found, end + 4 + length + 4


class Bundle:
    """Writes one bundle: records into frames, frames into a file, the seek table at its end."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.files.create_dir(self.folder, recursive=True)
        self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.squeeze = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.sizes, self.written, self.held, self.held_bytes = [], 0, [], 0

    def add(self, record_id: str, data: bytes) -> tuple:
        place = (self.name, len(self.sizes), record_id, self.held_bytes, len(data))
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= FRAME:
            self._frame()
        return place

    def _frame(self) -> None:
        packed = self.squeeze.compress(b"".join(self.held))
        self.out.write(packed)
        self.sizes.append((len(packed), self.held_bytes))
        self.written += len(packed)
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def _writer(folder: str, date: str):
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            places = []
            for row in batch.to_pylist():
                if bundle is None:
                    bundle = Bundle(folder)
                data = record(row["page_id"], row["url"], row["digest"], row["bytes"], row["refers_to"], (row["html"] or "").encode(), date)
                places.append(bundle.add("urn:page:" + ("null" if row["page_id"] is None else quote(row["page_id"], safe="")), data))
                if bundle.written >= BUNDLE:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in places], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["bundle", "frame", "record_id", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return put


def verdicts(pages: DataFrame, least: int = LEAST, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, digest, bytes, refers_to): of pages with equal payloads of ``least`` bytes or more, which one
    the others revisit."""
    rows = pages.select(pages[page_id].alias("page_id"), F.sha2(F.coalesce(pages[html], F.lit("")).cast("binary"), 256).alias("digest"), F.coalesce(F.octet_length(pages[html]), F.lit(0)).cast("long").alias("bytes"))
    groups = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    found = attach(rows, "digest", groups, "n", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return found.select("page_id", "digest", "bytes", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes the archive of a table of pages into the folder ``path``: bundles, and their index."""
    given = pages.select(pages[page_id].alias("page_id"), pages[url].cast("string").alias("url"), pages[html].alias("html"))
    found = verdicts(given, least).filter("refers_to is not null").select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"), "digest", "refers_to").distinct()
    keyed = given.withColumns({"digest": F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256), "bytes": F.coalesce(F.octet_length("html"), F.lit(0)).cast("long"), "key": F.coalesce(F.col("page_id").cast("string"), F.lit(""))})
    records = keyed.join(found, ["key", "digest"], "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "digest", "bytes", F.col("refers_to").cast("string").alias("refers_to"), F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))
    records.mapInArrow(_writer(f"{path}/bundles", date), INDEX).write.mode("overwrite").parquet(f"{path}/index")


def _seek_table(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for name in batch["bundle"].to_pylist():
                with files.open_input_file(f"{root}/{name}") as file:
                    end = file.size()
                    count, _, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
                    if magic != SEEKABLE:
                        raise ValueError(f"{name} has no seek table")
                    sizes = struct.unpack(f"<{2 * count}I", file.read_at(8 * count, end - 9 - 8 * count))
                at = 0
                for frame in range(count):
                    rows.append((name, frame, at, sizes[2 * frame], sizes[2 * frame + 1]))
                    at += sizes[2 * frame]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["bundle", "frame", "at", "size", "raw"])

    return read


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, frame, at, size, raw): all frames of the bundles that the index names, by their seek tables."""
    names = spark.read.parquet(f"{path}/index").select("bundle").distinct()
    return names.mapInArrow(_seek_table(f"{path}/bundles"), FRAMES)


def _frame_reader(folder: str, chosen: bool):
    """Reads whole frames, or where ``chosen`` only the records at the offsets that a row lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        expand = zstandard.ZstdDecompressor()
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for n, t in (c.split() for c in RECORDS.split(", "))])
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{root}/{row['bundle']}") as file:
                    data = expand.decompress(file.read_at(row["size"], row["at"]), max_output_size=row["raw"])
                found, at = [], 0
                if chosen:
                    found = [parse(data, offset)[0] for offset in sorted(row["offsets"])]
                while not chosen and at < len(data):
                    one, at = parse(data, at)
                    found.append(one)
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return read


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of an archive, frame by frame."""
    return frames(spark, path).repartition("bundle", "frame").mapInArrow(_frame_reader(f"{path}/bundles", False), RECORDS)


def look_up(spark: SparkSession, path: str, page_ids: DataFrame, page_id: str = "page_id") -> DataFrame:
    """The records of the pages asked for, reading only the frames that hold one."""
    coded = F.url_encode(page_ids[page_id].cast("string"))
    for java, uri in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(java), F.lit(uri))
    asked = page_ids.select(F.concat(F.lit("urn:page:"), F.coalesce(coded, F.lit("null"))).alias("record_id")).distinct()
    places = spark.read.parquet(f"{path}/index").join(asked, "record_id", "left_semi").groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))
    return frames(spark, path).join(places, ["bundle", "frame"]).mapInArrow(_frame_reader(f"{path}/bundles", True), RECORDS)


def digest_rows(records: DataFrame) -> DataFrame:
    """One row per record without its payload, ids as whole numbers."""
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
