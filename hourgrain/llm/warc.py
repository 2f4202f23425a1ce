"""WARC archives in seekable Zstandard bundles.

A bundle is one ``.warc.zst`` file: records grouped into independent frames of about ``FRAME_BYTES``, then a seek table in a
skippable frame (the public seekable format: sizes of each frame, and a footer from which it is read backwards). The index
maps each record to its bundle, frame and offset inside the decompressed frame, so one record costs one frame.

``write`` finds repeated payloads from digests alone (a per-digest minimum combined before the shuffle), joins the decision to
the pages and packs each task's records as they come. A bundle's name holds a fresh token, so a repeated task never
touches the files of another attempt; only bundles that the stored index names are read. Files go to the shared folder through
``pyarrow.fs``, which takes local, HDFS and object-store URIs, and come back through Spark's ``binaryFile`` reader.

Defined results: null html is an empty payload; payloads under ``least`` bytes are always responses; of equal longer
payloads every row with the smallest page_id is a response and the others refer to it; rows without page_id are responses and
nothing refers to them; repeated rows get a record each; null urls give a record without target URI; an empty table gives an
empty index and result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrain.llm.common import hinted, scratch_path, stored

#: Uncompressed bytes after which a frame or a bundle is closed; a longer record has a frame of its own.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
#: Fixed values of the seekable Zstandard format: magic of the skippable frame and of the footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id bigint, bundle string, frame int, frame_offset bigint, record_offset bigint, record_bytes bigint"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block but names the response and the payload's digest and length."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *([] if not url else ["WARC-Target-URI: " + "".join(url.split())]),
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record that starts at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not at the start of a record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, n = end + 4, int(head["Content-Length"])
    return head, data[start : start + n], start + n + 4


class Bundle:
    """Collects records into frames and frames into one file."""

    def __init__(self):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.frames: list[tuple[bytes, int]] = []
        self.open: list[bytes] = []
        self.size = self.written = self.total = 0
        self.places: list[tuple] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.places.append((page_id, self.name, len(self.frames), self.written, self.size, len(data)))
        self.open.append(data)
        self.size += len(data)
        self.total += len(data)
        if self.size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(self.open))
            self.frames.append((packed, self.size))
            self.written += len(packed)
            self.open, self.size = [], 0

    def content(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", len(packed), size) for packed, size in self.frames)
        foot = table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join(packed for packed, _ in self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(foot)) + foot


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, read from the footer backwards."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    at, out = 0, []
    for i in range(count):
        packed, size = struct.unpack_from("<II", data, len(data) - 9 - 8 * (count - i))
        out.append((at, packed, size))
        at += packed
    return out


def read_record(data: bytes, frame: int, record_offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle by its place in the index; only its frame is decompressed."""
    at, packed, size = seek_table(data)[frame]
    head, block, _ = parse(zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size), record_offset)
    return head, block


def write(pages: DataFrame, folder: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives of ``pages`` below ``folder`` and return the stored index, one row per record."""
    rows = pages.select(pages[id_col].cast("bigint").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where((F.octet_length("html") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    decided = rows.join(first.select(F.col("digest").alias("digest_"), "first"), F.col("digest") == F.col("digest_"), "left")
    decided = decided.select("id", "url", "html", "digest", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def flush(bundle: Bundle) -> pa.RecordBatch:
            data = bundle.content()
            with store.open_output_stream(f"{root}/{bundle.name}", compression=None) as out:
                out.write(data)
            schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("record_offset", pa.int64()), ("record_bytes", pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*bundle.places), schema)], schema=schema)

        bundle = Bundle()
        for batch in batches:
            for one in range(batch.num_rows):
                page, url, html, digest, refers = (batch.column(c)[one].as_py() for c in range(5))
                bundle.add(page, record(page, url, html.encode(), digest, refers))
                if bundle.total >= BUNDLE_BYTES:
                    yield flush(bundle)
                    bundle = Bundle()
        if bundle.places:
            yield flush(bundle)

    return stored(decided.mapInArrow(run, INDEX), "warc-index")


def read(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, frame by frame: headers as columns, and the payload.

    Only names meet the index, so that no bundle is moved unless the names are too many to broadcast.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")
    names = index.select("bundle").distinct()
    found = files.join(hinted(names, names.count()), "bundle", "left_semi").select("content")
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                for at, packed, size in seek_table(data):
                    text = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size)
                    out, place = [], 0
                    while place < len(text):
                        head, block, place = parse(text, place)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                        number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
                        out.append((number("X-Page-ID"), head.get("WARC-Target-URI"), head["WARC-Type"], number("X-Refers-To-Page"), number("X-Payload-Length"), digest, block))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return found.mapInArrow(run, schema)


def archive(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write ``pages`` below the shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    if ":" not in folder.split("/")[0]:
        folder = f"file://{folder}"
    index = write(pages, folder, least)
    if index.isEmpty():  # no bundle, so no folder to list
        return spark.createDataFrame([], "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")
    return read(spark, folder, index)
