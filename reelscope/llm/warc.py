"""WARC archives: one gzip member per record, written in parallel and read back sequentially.

The reader inflates a file piece by piece, takes each record's length from its header, and verifies the
payload digest, so that it holds one record at a time however long the file is.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reelscope.llm.common import per_group, scratch
from reelscope.llm.files import Replacing, open_for_reading

CHUNK = 1 << 16
#: A record's date; archives of the same table are equal byte for byte.
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(value: str) -> str:
    """A value for one header line: control characters and per cent signs are per-cent encoded."""
    return "".join(c if c >= " " and c not in "%\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, refers_to: str | None, length: int) -> bytes:
    """One gzip member.  A revisit carries no payload; its own length is kept in a header."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{header_value(record_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_value(uri)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {length}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{header_value(refers_to or '')}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


class Inflated:
    """Bytes of concatenated gzip members, inflated as they are asked for."""

    def __init__(self, stream) -> None:
        self.stream, self.rest, self.ready = stream, b"", bytearray()
        self.inflater = zlib.decompressobj(31)
        self.ended = False

    def more(self) -> bool:
        """Inflate one piece; False at the end of the file."""
        while not self.ended:
            data = self.rest or self.stream.read(CHUNK)
            self.rest = b""
            if not data:
                self.ended = True
                if not self.inflater.eof and self.begun:
                    raise EOFError("the last gzip member is cut off")
                return False
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            self.begun = True
            out = self.inflater.decompress(data, CHUNK * 4)
            self.rest = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.begun = False
            if out:
                self.ready += out
                return True
        return False

    begun = False

    def line(self) -> bytes | None:
        while (at := self.ready.find(b"\r\n")) < 0:
            if not self.more():
                if self.ready:
                    raise EOFError("a header is cut off")
                return None
        found = bytes(self.ready[:at])
        del self.ready[: at + 2]
        return found

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise EOFError("a record is cut off")
        found = bytes(self.ready[:n])
        del self.ready[:n]
        return found


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; a wrong digest, version or framing raises ValueError."""
    source = Inflated(stream)
    while (version := source.line()) is not None:
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head: dict[str, str] = {}
        while line := source.line():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        block = source.take(int(head["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record's end is missing")
        if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{payload_digest(block)}":
            raise ValueError(f"wrong digest in {head.get('warc-record-id')}")
        if head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{payload_digest(block)}":
            raise ValueError(f"wrong payload digest in {head.get('warc-record-id')}")
        yield head, block


def marked(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """(id, url, payload, sha, holder): holder is the id whose record has the payload, null for a record of its own.

    Of equal payloads of at least ``least_bytes`` bytes the largest id holds it; rows that repeat that id hold it too.
    A null id holds a payload only where no other id has it.  Equality is that of SHA-1 and length.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    grouped = per_group(keyed, ["sha", "size"], ["id", "url"], [F.max("id").alias("largest")])
    same = F.col("id").eqNullSafe(F.col("largest")) | (F.col("size") < least_bytes)
    return grouped.select("id", "url", "payload", F.when(~same, F.col("largest")).alias("holder"))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, file_bytes: int = 256 << 20) -> tuple[str, DataFrame]:
    """(folder, manifest): one or more archives per partition, of about ``file_bytes``; manifest: file, n_records, n_bytes."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, out, n = TaskContext.get().partitionId(), 0, None, 0

        def close():
            return pa.RecordBatch.from_pylist([{"file": out.name, "n_records": n, "n_bytes": out.done()}], MANIFEST)

        for batch in batches:
            for i in range(batch.num_rows):
                one, uri, payload, holder = (batch.column(c)[i].as_py() for c in range(4))
                if out is None:
                    out, n = Replacing(folder, f"part-{part:06d}-{piece:05d}.warc.gz"), 0
                kind = "response" if holder is None else "revisit"
                out.write(record(kind, "" if one is None else one, uri or "", payload_digest(payload), payload if holder is None else b"", holder, len(payload)))
                n += 1
                if out.size >= file_bytes:
                    yield close()
                    out, piece = None, piece + 1
        if out is not None:
            yield close()

    rows = marked(pages, page_id, url, html, least_bytes)
    text_ids = rows.select(F.col("id").cast("string"), "url", "payload", F.col("holder").cast("string"))
    listed = text_ids.mapInArrow(run, "file string, n_records bigint, n_bytes bigint")
    listed.write.parquet(f"{folder}/manifest")
    return folder, spark.read.schema(listed.schema).parquet(f"{folder}/manifest")


MANIFEST = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record: record_id, url, record_type, refers_to, payload_bytes, payload_digest and, if wanted, payload.

    Each file is read by one task from front to end.  An empty id is a null id.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bare = lambda urn: urn.removeprefix("<urn:page:").removesuffix(">") or None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name in pdf["file"]:
                with open_for_reading(folder, name) as stream:
                    rows, held = [], 0
                    for head, block in records(stream):
                        rows.append((bare(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], bare(head.get("warc-refers-to", "")), int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), *([block] if payloads else [])))
                        held += len(block) if payloads else 200
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    kinds = ["string", "string", "string", "string", "bigint", "string"] + ["binary"] * payloads
    return manifest.select("file").repartition(parts, "file").mapInPandas(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
