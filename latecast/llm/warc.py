"""WARC files of pages: range-sorted shards, deduplicated payloads, a manifest, and the way back.

Every record is a gzip member of its own. Equal payloads of at least ``least`` bytes are stored once, by
the smallest page id; the others revisit it. Headers and digests are made anew from page and payload
alone, so that a task that runs again writes the same bytes; it writes them under a temporary name and
renames the finished file. Only files in the manifest, which is written last, count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.llm import files, memory, ranges
from latecast.llm.shared import Work, shared_folder, whole_text

LEAST_BYTES = 100
RANGE_BYTES = 16 << 20
FILE_BYTES = 128 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, path string, records long, bytes long"
RECORDS = (
    "page_id long, url string, record_type string, payload binary, payload_bytes long, "
    "payload_digest string, refers_to long"
)


def record_id(page_id: int | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}").urn


def uri(url: str | None, page_id: int | None) -> str:
    """A header value: control characters, blanks and what is not ASCII are percent-encoded."""
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return "".join(
        chr(b) if 0x21 <= b < 0x7F else f"%{b:02X}" for b in url.encode("utf-8", "replace")
    )


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, compressed: a response, or a revisit of page ``refers_to``."""
    digest = hashlib.sha256(payload).hexdigest()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri(url, page_id)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    return squeeze.compress(head + block + b"\r\n\r\n") + squeeze.flush()


def parse(raw: bytes) -> dict:
    """A record's fields; digests and lengths must be those of what it holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    kind, payload, size = fields["WARC-Type"], None, int(fields["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size, said = len(payload), digest
        digest = hashlib.sha256(payload).hexdigest()
        if digest != said:
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(fields["X-Page-Id"]), "url": fields["WARC-Target-URI"], "record_type": kind,
        "payload": payload, "payload_bytes": size, "payload_digest": digest,
        "refers_to": number(fields.get("X-Refers-To-Page-Id")),
    }


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part, shard = [], 0, 0
        out = names = None
        size = records = 0
        decided = None

        def closed() -> None:
            out.close()
            files.commit(*names)
            made.append((shard, part, names[2], records, size))

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "is_page", "url", "html", "digest", "refers", "__range")]
            for row in range(batch.num_rows):
                id_, is_page, url, html, digest, refers, shard = (c[row].as_py() for c in columns)
                if not is_page:
                    decided = (id_, digest, refers)
                    continue
                payload = html.encode()
                if out is None:
                    names = files.start(folder, f"pages-{shard:06d}-{part:04d}.warc.gz")
                    out, size, records = names[0].open_output_stream(names[1], compression=None), 0, 0
                known = decided[2] if decided and decided[:2] == (id_, digest) else None
                data = record(id_, url, payload, known)
                out.write(data)
                size += len(data)
                records += 1
                if size >= file_bytes:
                    closed()
                    out, part = None, part + 1
        if out is not None:
            closed()
        columns = list(zip(*made, strict=True)) if made else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["shard", "part", "path", "records", "bytes"],
        )

    return memory.tidy(run)


def revisits(light: DataFrame, work: Work, least: int) -> DataFrame:
    """(id, digest, refers) of the pages whose payload an earlier page holds."""
    groups = work.table(
        light.where(F.col("bytes") >= least).groupBy("digest")
        .agg(F.min("id").alias("refers"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and refers is not null").select("digest", "refers"),
        "groups",
    )
    found = light.join(groups, "digest").where("id is null or id <> refers")
    return work.table(found.select("id", "digest", "refers").distinct(), "revisits")


def write_warc(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least: int = LEAST_BYTES, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row, sorted by id; the manifest: shard, part, path, records, bytes.

    Null html is an empty payload, a null url a ``urn:page:`` name. A null id comes first and is
    nobody's original while another row has an id. Rows that repeat the smallest id of a payload are
    responses all. Very long payloads are one record each, held by one task. No rows give no files. Other
    columns, whatever their names, are not read.
    """
    work = Work(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        whole_text(html_col).alias("html"))
    light = work.table(
        rows.select("id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"),
                    F.octet_length("html").alias("bytes")), "digests",
    )
    decided = revisits(light, work, least)
    both = rows.select(
        "id", F.lit(True).alias("is_page"), "url", "html",
        F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.lit(None).cast("long").alias("refers"),
    ).unionByName(
        decided.select("id", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("url"),
                       F.lit("").alias("html"), "digest", "refers")
    )
    # A decision and the pages it is for have the same digest, so they stay together wherever an id is cut.
    ordered = ranges.by_range(both, "id", F.octet_length("html") + 100, range_bytes, F.col("digest"))
    ordered = ordered.sortWithinPartitions(
        F.col("id").asc_nulls_first(), "__t", "digest", "is_page", "url", "html"
    ).drop("__t")
    return work.table(
        ordered.mapInArrow(_write(f"{work.folder}/files", file_bytes), MANIFEST), "manifest"
    )


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The members of a gzip file, one at a time."""
    open_, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(step)
        if not data:
            if parts:
                raise ValueError("the last member is cut off")
            return
        parts.append(open_.decompress(data))
        data = open_.unused_data
        if open_.eof:
            yield b"".join(parts)
            open_, parts = zlib.decompressobj(31), []


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = files.store(folder)
        names = [part.split()[0] for part in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names
            )

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with found.open_input_stream(path, compression=None) as stream:
                    for raw in members(stream):
                        row = parse(raw)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(raw) if payloads else 200
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return memory.tidy(run)


def read_warc(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of the manifest's files, checked against their digests; a revisit has no payload."""
    rows = ranges.by_file(manifest).select("path")
    return rows.mapInArrow(_read(shared_folder(manifest.sparkSession), payloads), RECORDS)
