"""WARC archives as seekable Zstandard bundles, with an index of record identifiers.

A bundle is a file of independent frames, each with whole records, and a last skippable frame that holds the sizes of
all others (the published seekable format). The index maps a record identifier to its bundle, frame, and the record's
offset within the frame's content, so a reader decompresses one frame to get one record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.shared import broadcast_if_small, shared_folder
from fieldlens.session import cut_lineage

# fixed values of the seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
MIN_REVISIT_BYTES = 100

PLANNED = "page_id long, url string, payload binary, digest string, first long"
BUNDLES = "bundle string, data binary, entries array<struct<record_id:string,frame:int,offset:long,length:long>>"
RECORDS = (
    "record_id string, page_id long, url string, record_type string, refers_to_record string, "
    "declared_digest string, payload binary"
)


def record_id(page_id: int | None, digest: str) -> str:
    name = hashlib.md5(f"{'' if page_id is None else page_id}|{digest}".encode()).digest()
    return f"urn:uuid:{uuid.UUID(bytes=name)}"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with the compressed and plain size of every frame."""
    body = b"".join(struct.pack("<II", *pair) for pair in sizes)
    body += struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_places(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of every frame, from the seek table at the end."""
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    table, start, out = len(data) - 9 - count * width, 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", data, table + i * width)
        out.append((start, packed, plain))
        start += packed
    return out


def header_value(text: str) -> str:
    """Control signs, blanks and signs beyond ASCII as percent codes, so that a value stays on its line."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id, url, payload: bytes, digest: str, first, date: str) -> tuple[str, bytes]:
    """Identifier and bytes of one record; with `first`, the page whose equal payload it refers to, a revisit."""
    name = record_id(page_id, digest)
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", header_value(url)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_id(first, digest)}>")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return name, head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and end of the record that starts at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("a record does not start here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    stop = end + 4 + int(fields["Content-Length"])
    body = data.index(b"\r\n\r\n", end + 4, stop) + 4
    return fields, data[body:stop], stop + 4


def pack(records: Iterator[tuple[str, bytes]], part: int, frame_bytes: int, bundle_bytes: int):
    """Bundles of (name, data, entries); a frame closes with the record that fills it."""
    press = zstandard.ZstdCompressor(level=3)
    frames, sizes, entries, number = [], [], [], 0
    open_frame, held = [], 0

    def close_frame():
        nonlocal open_frame, held
        plain = b"".join(open_frame)
        frames.append(press.compress(plain))
        sizes.append((len(frames[-1]), len(plain)))
        open_frame, held = [], 0

    def close_bundle():
        nonlocal frames, sizes, entries, number
        out = (f"{part:06d}-{number:05d}", b"".join(frames) + seek_table(sizes), entries)
        frames, sizes, entries, number = [], [], [], number + 1
        return out

    for name, data in records:
        entries.append({"record_id": name, "frame": len(frames), "offset": held, "length": len(data)})
        open_frame.append(data)
        held += len(data)
        if held >= frame_bytes:
            close_frame()
            if sum(p for p, _ in sizes) >= bundle_bytes:
                yield close_bundle()
    if open_frame:
        close_frame()
    if frames:
        yield close_bundle()


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest and `first`: the smallest page_id of equal payloads, null if the page is that one.

    Only digests that several rows share are looked up; the payloads are not shuffled while those are few. Rows that
    repeat the smallest page_id are all responses, and so are rows without a page_id.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = rows.filter(F.octet_length("payload") >= min_bytes)
    shared = long_enough.groupBy("digest").agg(F.min("page_id").alias("smallest"), F.count("*").alias("n"))
    shared = broadcast_if_small(shared.filter("n > 1 and smallest is not null").drop("n"))
    first = F.when(F.col("page_id") != F.col("smallest"), F.col("smallest"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", first.alias("first"))


def write_bundles(
    planned: DataFrame,
    folder: str,
    date: str = "1970-01-01T00:00:00Z",
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> None:
    """Write bundles under `folder`/archives and the index of record identifiers under `folder`/index.

    Spark's own writer puts the files in place, so they may lie in any store it reaches and a task that is lost is
    written again. It ends every file with a separator; the separator chosen is the last field of the seek table.
    """

    def to_bundles(batches):
        def records():
            for batch in batches:
                for row in batch.to_pylist():
                    yield record(row["page_id"], row["url"], row["payload"], row["digest"], row["first"], date)

        for bundle in pack(records(), TaskContext.get().partitionId(), frame_bytes, bundle_bytes):
            columns = [pa.array([x], t.type) for x, t in zip(bundle, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    entry = pa.struct(
        [("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
    )
    arrow = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("entries", pa.list_(entry))])
    bundles = cut_lineage(planned.mapInArrow(to_bundles, BUNDLES))
    end = struct.pack("<I", SEEKABLE_MAGIC)
    body = F.expr(f"substring(data, 1, octet_length(data) - {len(end)})").cast("string")
    files = bundles.select("bundle", body.alias("value"))
    files.write.partitionBy("bundle").option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(
        f"{folder}/archives"
    )
    bundles.select("bundle", F.inline("entries")).write.parquet(f"{folder}/index")


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/archives")
    return files.select(F.regexp_extract("path", "bundle=([^/]+)", 1).alias("bundle"), F.col("content").alias("data"))


def _row(fields: dict[str, str], payload: bytes) -> dict:
    strip = lambda x: x and x.strip("<>")
    page = fields.get("Page-ID")
    return {
        "record_id": strip(fields["WARC-Record-ID"]),
        "page_id": None if page is None else int(page),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to_record": strip(fields.get("WARC-Refers-To")),
        "declared_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": payload,
    }


_ROW_TYPES = pa.schema(
    [(c, pa.int64() if c == "page_id" else pa.binary() if c == "payload" else pa.string())
     for c in ("record_id", "page_id", "url", "record_type", "refers_to_record", "declared_digest", "payload")]
)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of every bundle, frame by frame; the payload of a revisit is empty."""

    def read(batches):
        for batch in batches:
            for data in batch.column("data"):
                data = data.as_py()
                for start, packed, plain in frame_places(data):
                    frame = zstandard.ZstdDecompressor().decompress(data[start : start + packed], plain)
                    rows, at = [], 0
                    while at < len(frame):
                        fields, payload, at = parse_record(frame, at)
                        rows.append(_row(fields, payload))
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROW_TYPES)

    return _archives(spark, folder).select("data").mapInArrow(read, RECORDS)


def find_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records whose `record_id` is in `wanted`: only frames that hold one are decompressed."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                places, rows, held = frame_places(row["data"]), [], {}
                for at in sorted(row["places"], key=lambda x: (x["frame"], x["offset"])):
                    if at["frame"] not in held:
                        start, packed, plain = places[at["frame"]]
                        whole = row["data"][start : start + packed]
                        held = {at["frame"]: zstandard.ZstdDecompressor().decompress(whole, plain)}
                    fields, payload, _ = parse_record(held[at["frame"]], at["offset"])
                    rows.append(_row(fields, payload))
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW_TYPES)

    index = spark.read.parquet(f"{folder}/index").join(wanted.select("record_id").distinct(), "record_id")
    # at most the entries of one bundle are gathered, which its size bounds
    places = index.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))
    return _archives(spark, folder).join(places, "bundle").select("data", "places").mapInArrow(read, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """One row per record with the size and digest of its full payload; a revisit's are those of its response.

    Raises if a response's payload does not have the digest that its header declares.
    """
    payload = records.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    payload = payload.withColumn("payload_digest", F.sha2("payload", 256)).drop("payload")
    payload = cut_lineage(payload)
    responses = payload.filter("record_type = 'response'")
    sound = F.when(
        F.col("payload_digest") != F.col("declared_digest"), F.raise_error(F.lit("a payload differs from its digest"))
    ).otherwise(F.col("payload_digest"))
    own = responses.select(
        "page_id", "payload_bytes", sound.alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = payload.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to_record")
    targets = revisits.select(F.col("refers_to_record").alias("record_id")).distinct()
    # rows that repeat the response's page share its record
    origin = responses.join(broadcast_if_small(targets), "record_id").groupBy("record_id")
    origin = origin.agg(*[F.first(c).alias(c) for c in ("page_id", "payload_bytes", "payload_digest")])
    origin = broadcast_if_small(
        origin.withColumnsRenamed({"record_id": "refers_to_record", "page_id": "refers_to"})
    )
    found = revisits.join(origin, "refers_to_record", "left")
    return own.unionByName(found.select(own.columns))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_bundles(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return resolve(read_records(spark, folder))
