"""WARC archives of pages, compressed record by record with a Zstandard dictionary of their own.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, built from records of that archive;
then each record is a frame of its own, so any record can be read with the dictionary and its offset. Of pages with equal
payloads the one with the largest page_id is a response, the others are revisits that name it. Archives are rows of a
Parquet table in the shared folder, written and read by Spark alone; ``export`` copies them out as files.

Edge cases: a null html is an empty payload; rows with equal page_id and payload as their group's largest are responses
each; a null page_id never is the largest beside others, and such rows are responses only where no other has the payload;
a null url has no target; an empty table gives no archives and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import batch_of, mapped, slices, stored, table

SKIPPABLE = 0x184D2A5D
#: Bytes of payload after which an archive is closed; of the dictionary; of records it is built from; the level.
ARCHIVE, DICTIONARY, SAMPLES, LEVEL = 8 << 20, 32 << 10, 2 << 20, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response, or a revisit without payload that names the page it repeats."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return header(fields) + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on records; where they are too few or too much alike to train on, their own bytes."""
    samples, total = [], 0
    for r in records[:: max(1, sum(map(len, records)) // SAMPLES)]:
        samples.append(r[: 64 << 10])
        total += len(samples[-1])
        if total > SAMPLES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The dictionary's frame and a frame for each record."""
    held = dictionary(records)
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=True, write_checksum=True)
    raw = held.as_bytes()
    return b"".join([SKIPPABLE.to_bytes(4, "little"), len(raw).to_bytes(4, "little"), raw, *map(coder.compress, records)])


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record of an archive."""
    if int.from_bytes(data[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary frame")
    at = 8 + int.from_bytes(data[4:8], "little")
    raw = data[8:at]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    step = 1 << 14
    while at < len(data):
        one, out, begin = decoder.decompressobj(), [], at
        while not one.eof:
            if at >= len(data):
                raise ValueError("the last record is cut off")
            out.append(one.decompress(data[at : at + step]))
            at += step
        at = min(at, len(data)) - len(one.unused_data)
        yield begin, b"".join(out)


def parsed(raw: bytes) -> dict[str, str | bytes]:
    """Header fields (names in lower case), the block, and the HTTP payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"version": lines[0], "block": block, "http": http, "payload": payload}


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds the page each repeats, and whether it does. Digests are grouped with partial aggregation; the join can split a hot one."""
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select("page_id", "url", "html", F.sha1(raw).alias("key"), (F.octet_length(raw) >= least).alias("large"))
    largest = keyed.where("large").groupBy("key").agg(F.max("page_id").alias("largest"))
    both = keyed.join(largest, "key", "left")
    revisit = F.col("large") & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return both.select("page_id", "url", "html", F.col("largest").alias("refers_to"), revisit.alias("revisit"))


def archives(pages: DataFrame, least: int = 0, date: str = DATE) -> DataFrame:
    """Archives of all pages: a name, the number of records and the bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("data", pa.binary())])
        part, held, total, n = TaskContext.get().partitionId(), [], 0, 0
        for batch in slices(batches, "html"):
            for page, url, html, refers, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                held.append(record(page, url, (html or "").encode(), refers, revisit, date))
                total += len(held[-1])
                if total > ARCHIVE:
                    yield batch_of(schema, [f"pages-{part:06d}-{n:06d}.warc.zst"], [len(held)], [archive(held)])
                    held, total, n = [], 0, n + 1
        if held:
            yield batch_of(schema, [f"pages-{part:06d}-{n:06d}.warc.zst"], [len(held)], [archive(held)])

    return mapped(with_types(pages, least), write, "archive string, n_records long, data binary")


def records(files: DataFrame) -> DataFrame:
    """One row per record of the archives, read from their bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, strings = pa.int64(), pa.string()
        schema = pa.schema([("page_id", longs), ("payload_bytes", longs), ("payload_digest", strings), ("record_type", strings), ("refers_to", longs), ("url", strings), ("archive", strings), ("offset", longs)])
        for batch in batches:
            for name, data in zip(batch.column("archive"), batch.column("data"), strict=True):
                out = []
                for at, raw in frames(data.as_py()):
                    r = parsed(raw)
                    said = r["warc-payload-digest"].removeprefix("sha1:")
                    size = int(next(x for x in r["http"].split(b"\r\n") if x.startswith(b"Content-Length:")).partition(b":")[2])
                    if r["warc-type"] == "response" and (digest(r["payload"]) != said or len(r["payload"]) != size):
                        raise ValueError(f"the payload of {r['warc-record-id']} is not what its header says")
                    page, refers = (r.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to"))
                    out.append((int(page) if page else None, size, said, r["warc-type"], int(refers) if refers else None, r.get("warc-target-uri"), name.as_py(), at))
                    if len(out) == 1000:
                        yield batch_of(schema, *zip(*out, strict=True))
                        out = []
                if out:
                    yield batch_of(schema, *zip(*out, strict=True))

    return mapped(files, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long")


def export(files: DataFrame, folder: str) -> list[str]:
    """Copies archives to a folder of the driver one at a time; returns their names."""
    names = []
    for row in files.select("archive", "data").toLocalIterator():
        with io.open(Path(folder) / row.archive, "wb") as f:
            f.write(row.data)
        names.append(row.archive)
    return names


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, and what the archives say of it."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return records(stored(archives(pages), "archives")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
