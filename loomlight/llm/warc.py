"""WARC archives of gzip members, one for each record, and a reader that splits them by bytes.

Writing: each task writes its own archives. Of records with equal payloads of at least
MIN_REVISIT bytes, the one with the largest page id is a response; the others are revisits that
refer to it and keep the payload's digest and length but not the payload.

Reading: a task gets a range of bytes of an archive. It looks for the magic number of gzip, takes a
place for a record only if a WARC header can be inflated there, and reads every record that starts
inside its range, to its end even where that lies beyond.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm import files
from loomlight.llm.shared import cut, scratch, sized

MIN_REVISIT = 1000
#: An archive is closed beyond this many bytes; a task reads this many bytes' worth of records.
ARCHIVE_BYTES, SPLIT_BYTES = 128 << 20, 4 << 20
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LOW = (1 << 64) - 1


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=page_id & _LOW) if page_id is not None else uuid.uuid4()}>"


def page_of(record: str) -> int:
    x = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    return x - (1 << 64) if x >> 63 else x


def member(page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, refers_to: int | None, date: str, level: int) -> bytes:
    """A record as a gzip member. refers_to: None for a response; payload: empty for a revisit, whose n bytes the response has."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def write(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html; other columns are ignored) and returns the list of archives: uri, n_bytes.

    A null html is an empty payload; a null url or page_id leaves its header out. Rows that share
    page id and payload are all what the id's record is. A response among records without any page
    id is each of them. An empty table gives no archives.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).select("*", F.octet_length("html").cast("long").alias("n"), F.sha1(F.encode("html", "utf-8")).alias("digest"))
    repeated = cut(
        rows.where(F.col("n") >= MIN_REVISIT).groupBy("digest", "n").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies")).where((F.col("copies") > 1) & F.col("kept").isNotNull()).drop("copies")
    )
    known = rows.join(sized(repeated, 80), ["digest", "n"], "left").select(
        "page_id", "url", "html", "n", "digest", F.when(F.coalesce(F.col("kept") != F.col("page_id"), F.col("kept").isNotNull()), F.col("kept")).alias("refers_to")
    )

    def run(batches):
        stem, seq = f"{folder}/{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", 0

        def members() -> Iterator[bytes]:
            for batch in batches:
                for x in batch.to_pylist():
                    payload = b"" if x["refers_to"] is not None else x["html"].encode("utf-8")
                    yield member(x["page_id"], x["url"], payload, x["n"], x["digest"], x["refers_to"], date, level)

        pending, size = members(), 0
        item = next(pending, None)
        while item is not None:
            uri, size = f"{stem}-{seq:04d}.warc.gz", 0
            with files.publish(uri) as out:
                while item is not None and size < ARCHIVE_BYTES:
                    out.write(item)
                    size += len(item)
                    item = next(pending, None)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_bytes": [size]})
            seq += 1

    return cut(known.mapInArrow(run, "uri string, n_bytes long"))


def inflate(f, at: int, length: int) -> tuple[bytes, int] | None:
    """The record at a byte and where it ends, or None if none begins there."""
    f.seek(at)
    z, out, chunk = zlib.decompressobj(31), [], 1 << 13
    try:
        while not z.eof:
            data = f.read(chunk)
            if not data:
                return None
            at += len(data)
            out.append(z.decompress(data))
            if len(out) == 1:
                if not out[0].startswith(b"WARC/1."):
                    return None
                chunk = 1 << 16
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def records(f, begin: int, end: int, length: int) -> Iterator[bytes]:
    """The records that start in [begin, end)."""
    at = begin
    while at < end:
        found = inflate(f, at, length) if at != begin or at == 0 else None
        if found is None:
            f.seek(at)
            window = f.read(min(1 << 20, end - at) + len(MAGIC) - 1)
            k = window.find(MAGIC)
            while k >= 0 and (found := inflate(f, at + k, length)) is None:
                k = window.find(MAGIC, k + 1)
            if found is None:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
        data, at = found
        yield data


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
        "url": fields.get("WARC-Target-URI"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
        "payload_bytes": n,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def archives(spark, folder: str) -> DataFrame:
    """The archives of a folder: uri, n_bytes; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.col("path").alias("uri"), F.col("length").alias("n_bytes"))


def read(listed: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Every record of the archives listed (uri, n_bytes), each read by the one task whose range of bytes it starts in; responses are checked against their digest and length."""
    splits = listed.where(F.col("n_bytes") > 0).select("uri", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("begin"))
    schema = SCHEMA if payloads else SCHEMA.replace("payload binary, ", "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                rows, size = [], 0
                with files.open_at(x["uri"]) as f:
                    for data in records(f, x["begin"], min(x["begin"] + split_bytes, x["n_bytes"]), x["n_bytes"]):
                        rows.append(parse(data))
                        size += len(data) if payloads else 200
                        if size > 8 << 20:
                            yield _batch(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return splits.repartition(max(2, 2 * listed.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload": pa.binary(), "url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to new archives and reads them back, without the payloads themselves."""
    listed = write(pages, scratch(pages.sparkSession, "warc"))
    return read(listed, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
