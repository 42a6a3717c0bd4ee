"""WARC archives: writing, normalising monolithic gzip files, reading records back.

A monolithic file is one gzip stream over many records, so that no record can be read
without those before it. The normaliser inflates such a stream once, from front to end,
rewrites every record as a gzip member of its own, and writes an offset index beside it.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesflow.llm.util import open_store, stored_table, write_whole

ARCHIVES = "folder string, archive string, records long"
INDEX = "folder string, archive string, offset long, size long, record_id string, record_type string"
RECORDS = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long")
CHUNK = 1 << 20


def record_types(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to) of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest page_id
    are responses, the others revisits of it. NULL html is an empty payload. A NULL page_id
    counts as larger than any. Rows that repeat the smallest id are responses each.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    first = (rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("digest").alias("same"), "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return (rows.join(first, large & (F.col("digest") == F.col("same")), "left")
            .select("page_id", "url", "payload", "digest",
                    F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("first")).alias("refers_to")))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def format_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its headers keep digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        from urllib.parse import quote

        head.append(f"WARC-Target-URI: {quote(url, safe='/:=&?~#+!$,;@()*[]')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}


def parse_record(record: bytes) -> dict:
    """The row of ``RECORDS`` that one record holds; a payload that does not meet its digest raises."""
    from urllib.parse import unquote

    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    page = lambda name: None if fields[name] == "<urn:page:none>" else int(fields[name][10:-1])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    uri = fields.get("warc-target-uri")
    return {"page_id": page("warc-record-id"), "url": None if uri is None else unquote(uri),
            "payload": payload if kind == "response" else None, "payload_bytes": full, "payload_digest": digest,
            "record_type": kind, "refers_to": page("warc-refers-to") if kind == "revisit" else None}


def split_stream(chunks):
    """Records of a stream of inflated bytes, one at a time."""
    buffer = bytearray()
    need = None
    for chunk in chunks:
        buffer += chunk
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(_headers(bytes(buffer[:end]))["content-length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the stream ends inside a record")


def inflated(file):
    """Inflated chunks of a gzip file of one or several members, front to end."""
    inflate = zlib.decompressobj(31)
    while raw := file.read(CHUNK):
        while raw:
            data = inflate.decompress(raw, CHUNK)
            if data:
                yield data
            raw = inflate.unconsumed_tail
            if inflate.eof:
                raw, inflate = inflate.unused_data, zlib.decompressobj(31)
    yield inflate.flush()


def write_monolithic(rows: DataFrame, folder: str, *, archive_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write rows of ``record_types`` as gzip streams of about ``archive_bytes`` inflated bytes; one row per file.

    Store the frame returned once: each run of it writes the same files again.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()

        def records():
            for batch in batches:
                for row in zip(*(c for c in batch.columns), strict=True):
                    yield format_record(*(v.as_py() for v in row))

        source, number = records(), 0
        record = next(source, None)
        while record is not None:
            name, size, n = f"pages-{part:06d}-{number:05d}.warc.gz", 0, 0
            with write_whole(folder, name, attempt) as out:
                deflate = zlib.compressobj(level, wbits=31)
                while record is not None and size < archive_bytes:
                    out.write(deflate.compress(record))
                    size, n = size + len(record), n + 1
                    record = next(source, None)
                out.write(deflate.flush())
            number += 1
            yield pa.RecordBatch.from_pydict({"folder": [folder], "archive": [name], "records": [n]})

    columns = ("page_id", "url", "payload", "digest", "record_type", "refers_to")
    return rows.select(*columns).mapInArrow(write, ARCHIVES)


def normalise(archives: DataFrame, folder: str, *, level: int = 1) -> DataFrame:
    """Rewrite each archive with one gzip member per record and an index ``<name>.idx`` beside it.

    An index line holds offset, size, record type and record id, tab separated. Archives that
    already have several members are rewritten alike; one without records gives empty files.
    Returns the index rows; store the frame once, since each run of it writes the files again.
    """

    def rewrite(batches):
        import posixpath

        import pyarrow as pa
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for source, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = open_store(source)
                lines, offset = [], 0
                with store.open_input_stream(posixpath.join(path, name), compression=None) as file, \
                        write_whole(folder, name, attempt) as out:
                    for record in split_stream(inflated(file)):
                        fields = _headers(record[:record.find(b"\r\n\r\n")])
                        deflate = zlib.compressobj(level, wbits=31)
                        member = deflate.compress(record) + deflate.flush()
                        out.write(member)
                        lines.append((offset, len(member), fields["warc-type"], fields["warc-record-id"]))
                        offset += len(member)
                with write_whole(folder, name + ".idx", attempt) as out:
                    out.write("".join("\t".join(map(str, line)) + "\n" for line in lines).encode())
                columns = list(zip(*lines, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_pydict({
                    "folder": pa.array([folder] * len(lines), pa.string()), "archive": pa.array([name] * len(lines), pa.string()),
                    "offset": pa.array(columns[0], pa.int64()), "size": pa.array(columns[1], pa.int64()),
                    "record_id": pa.array(columns[3], pa.string()), "record_type": pa.array(columns[2], pa.string())})

    return archives.select("folder", "archive").mapInArrow(rewrite, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """The records that index rows point to (``RECORDS``), each read by its offset alone."""

    def read(batches):
        import posixpath

        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in RECORDS.split(", "))])
        opened, file = None, None
        for batch in batches:
            out, size = [], 0
            for at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened != at[:2]:
                    if file is not None:
                        file.close()
                    store, path = open_store(at[0])
                    opened, file = at[:2], store.open_input_file(posixpath.join(path, at[1]))
                out.append(parse_record(zlib.decompress(file.read_at(at[3], at[2]), 31)))
                size += out[-1]["payload_bytes"]
                if size >= 16 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if file is not None:
            file.close()

    return index.select("folder", "archive", "offset", "size").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, folder: str, **sizes) -> DataFrame:
    """Write ``pages`` as monolithic archives below ``folder``, normalise them, read all records back.

    ``pages`` holds page_id, url and html; other columns are ignored. NULL html counts as an
    empty payload, a NULL url is left out of its record, a NULL page_id stays NULL. Repeated
    rows are records each. An empty table gives no rows. Runs jobs: the archives of each
    step are written before the next reads them.
    """
    raw = stored_table(write_monolithic(record_types(pages), f"{folder}/raw", **sizes))
    # One file per task as far as there are tasks.
    spread = raw.repartition(max(1, min(raw.count(), 10_000)), "archive")
    index = stored_table(normalise(spread, f"{folder}/records"))
    return read_records(index)
