"""WARC archives written and read as tables of chunks.

A payload longer than ``chunk`` bytes is written as segments: the first record
carries segment number 1, the others are ``continuation`` records with their number
and the identifier of the first. So every row, on the way in and out, holds one chunk
of bounded size and never a whole large payload. Archives are written by Spark's
text writer, whose line separator is the end of a WARC record, and read by Spark's
binary reader, so any file system that Spark reaches will do.

The digest of a payload in several chunks is carried from chunk to chunk over rows
that come sorted by record and number; nothing but the state of the hash is kept.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parvis.llm.common import stage

CHUNK = 1 << 16  # bytes of a payload in one record
FILE_RECORDS = 1024  # records of an archive file: with CHUNK, a bound on what one reading task holds
BREAK = "\r\n\r\n"


def base32_of_hex(hexed: Column) -> Column:
    """A 160-bit digest in hexadecimal as base-32 text of 32 characters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):  # 20 bits at a time
        number = F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 10).cast("int")
        parts += [F.substring(alphabet, F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page with what its record needs: record_id, page_id, url, body, digest, size, record_type, refers_to.

    The payload is ``html`` in UTF-8, a null one is empty. Of pages with equal payloads of
    at least ``least`` bytes the one with the largest key is the response (all of them, if
    the key is repeated); others, and pages without a key, revisit it. If no page of the
    group has a key, all are responses.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("body"),
        base32_of_hex(F.sha1(body.cast("binary"))).alias("digest"), F.octet_length(body).cast("long").alias("size"),
    )
    # payloads that occur once need no partner: only repeated ones are joined
    last = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(last, "digest", "left")
    again = F.col("last").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("last"), F.lit(False))
    rows = rows.withColumns({
        "record_type": F.when(again, "revisit").otherwise("response"),
        "refers_to": F.when(again, F.col("last")),
        "record_id": F.concat_ws("-", F.lit("row"), F.monotonically_increasing_id().cast("string")),
    })
    return rows.drop("last")


def _framed(batches: Iterator, chunk: int) -> Iterator:
    """The records of rows of ``records``, one chunk each, without the separator that ends them."""
    import pandas as pd

    for frame in batches:
        lines: list[str] = []
        for r in frame.itertuples(index=False):
            payload = b"" if r.record_type == "revisit" else r.body.encode("utf-8", "surrogatepass")
            first = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r.record_id}/{r.page_id}')}>"
            cuts = _cuts(payload, chunk)
            for number, (start, stop) in enumerate(cuts, 1):
                kind = r.record_type if number == 1 else "continuation"
                head = ["WARC/1.1", f"WARC-Type: {kind}", "Content-Type: text/html; charset=utf-8"]
                head.append(f"WARC-Record-ID: {first if number == 1 else first[:-1] + f'/{number}>'}")
                if isinstance(r.url, str):
                    head.append(f"WARC-Target-URI: {' '.join(r.url.split())}")
                if isinstance(r.page_id, str):
                    head.append(f"X-Page-ID: {r.page_id}")
                if isinstance(r.refers_to, str):
                    head.append(f"WARC-Refers-To: <urn:x-page:{r.refers_to}>")
                if number == 1:
                    head.append(f"WARC-Payload-Digest: sha1:{r.digest}")
                if len(cuts) > 1:
                    head.append(f"WARC-Segment-Number: {number}")
                    if number > 1:
                        head.append(f"WARC-Segment-Origin-ID: {first}")
                    if number == len(cuts):
                        head.append(f"WARC-Segment-Total-Length: {len(payload)}")
                head.append(f"Content-Length: {stop - start}")
                lines.append("\r\n".join(head) + BREAK + payload[start:stop].decode("utf-8", "surrogatepass"))
            if len(lines) >= FILE_RECORDS:
                yield pd.DataFrame({"value": lines})
                lines = []
        yield pd.DataFrame({"value": lines})


def _cuts(payload: bytes, chunk: int) -> list[tuple[int, int]]:
    """Ranges of at most ``chunk`` bytes that begin at characters; one empty range for an empty payload."""
    cuts, at = [], 0
    while len(payload) - at > chunk:
        stop = at + chunk
        while payload[stop] & 0xC0 == 0x80:
            stop -= 1
        cuts.append((at, stop))
        at = stop
    return [*cuts, (at, len(payload))]


def write_archives(rows: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Writes rows of ``records`` as WARC files below ``path``; at most ``FILE_RECORDS`` records in a file."""
    plain = rows.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    plain = plain.select("record_id", "page_id", "url", "body", "digest", "record_type", "refers_to")
    framed = plain.mapInPandas(lambda batches: _framed(batches, chunk), "value string")
    framed.write.option("lineSep", BREAK).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def _parsed(batches: Iterator) -> Iterator:
    """Chunk rows of archive files. The content length of each record leads to the next one."""
    import pyarrow as pa

    names = {"WARC-Record-ID": "id", "X-Page-ID": "page_id", "WARC-Target-URI": "url", "WARC-Type": "type", "WARC-Refers-To": "refers_to",
             "WARC-Payload-Digest": "digest", "WARC-Segment-Number": "number", "WARC-Segment-Origin-ID": "origin",
             "WARC-Segment-Total-Length": "total", "Content-Length": "length"}
    schema = pa.schema([
        ("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
        ("digest", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("payload", pa.binary()),
    ])
    for batch in batches:
        for content in batch.column("content"):
            data, at, out = memoryview(gzip.decompress(content.as_py())), 0, []
            while at < len(data):
                stop = _find(data, at)
                head = {}
                for line in bytes(data[at:stop]).decode().split("\r\n")[1:]:
                    name, _, value = line.partition(": ")
                    if name in names:
                        head[names[name]] = value
                start = stop + len(BREAK)
                end = start + int(head["length"])
                out.append({
                    "record_id": head.get("origin", head["id"]), "page_id": head.get("page_id"), "url": head.get("url"),
                    "record_type": head["type"], "refers_to": head["refers_to"][len("<urn:x-page:"):-1] if "refers_to" in head else None,
                    "digest": head["digest"].removeprefix("sha1:") if "digest" in head else None,
                    "chunk": int(head.get("number", 1)), "last": "number" not in head or "total" in head, "payload": bytes(data[start:end]),
                })
                at = end + len(BREAK)
            yield pa.RecordBatch.from_pylist(out, schema)


def _find(data: memoryview, at: int) -> int:
    """Where the header that begins at ``at`` ends."""
    width = 4096
    while True:
        found = bytes(data[at:at + width]).find(BREAK.encode())
        if found >= 0:
            return at + found
        if at + width >= len(data):
            raise ValueError("a WARC header without an end")
        width *= 2


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all archives below ``path``: one row per record or segment, payloads as written."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, (
        "record_id string, page_id string, url string, record_type string, refers_to string, digest string, chunk int, last boolean, payload binary"
    ))


def _sums(batches: Iterator) -> Iterator:
    """Length and digest per record, carried over chunk rows that come in order of record and chunk."""
    import pandas as pd

    record, state, size, head = None, None, 0, None
    columns = ["page_id", "url", "record_type", "refers_to", "written_digest", "payload_bytes", "hexed"]
    for frame in batches:
        done = []
        for r in frame.itertuples(index=False):
            if isinstance(r.hexed, str):  # a record of one chunk, summed where it was read
                done.append((r.page_id, r.url, r.record_type, r.refers_to, r.digest, int(r.size), r.hexed))
                continue
            if r.record_id != record:
                if record is not None:
                    done.append((*head, size, state.hexdigest()))
                record, state, size, head = r.record_id, hashlib.sha1(), 0, (r.page_id, r.url, r.record_type, r.refers_to, r.digest)
            state.update(r.payload)
            size += len(r.payload)
        yield pd.DataFrame(done, columns=columns)
    if record is not None:
        yield pd.DataFrame([(*head, size, state.hexdigest())], columns=columns)


def record_sums(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, written_digest, payload_bytes and payload_digest as read.

    Records of one chunk are summed where they are; payloads travel only as segments, to be put in order.
    """
    alone = (F.col("chunk") == 1) & F.col("last")
    rows = chunks.withColumns({
        "size": F.octet_length("payload").cast("long"), "hexed": F.when(alone, F.sha1("payload")), "payload": F.when(~alone, F.col("payload")),
    })
    summed = rows.repartition("record_id").sortWithinPartitions("record_id", "chunk").mapInPandas(
        _sums, "page_id string, url string, record_type string, refers_to string, written_digest string, payload_bytes long, hexed string"
    )
    return summed.withColumn("payload_digest", base32_of_hex(F.col("hexed"))).drop("hexed")


def page_table(sums: DataFrame) -> DataFrame:
    """One row per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, of the full payload.

    A revisit has the length and the digest read from the response it refers to, whose
    digest must equal the one in its own header, else both are null.
    """
    own = sums.where("record_type = 'response'")
    seen = sums.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    target = own.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("written_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    found = seen.join(target, ["refers_to", "written_digest"], "left")
    found = found.withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("written_digest")))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(columns).unionByName(found.select(columns))


def archived(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Writes the archives of ``pages`` below ``path``, reads them back and gives the page table."""
    write_archives(records(pages, least), path, chunk)
    return page_table(stage(record_sums(read_archives(pages.sparkSession, path))))
