"""WARC archives: written as one gzip stream each, then normalised to one gzip member a record with an offset index.

``write`` makes archives the way many tools do, a whole file in one stream, which cannot be read from the middle.
``normalise`` inflates each such stream once, from end to end and a block at a time, writes every record as a gzip
member of its own and beside the archive a sidecar index (JSON lines: offset, length, type, record id, URI, digest), and
returns the index as a table. ``read`` fetches members by offset, inflates just those and checks their digests.

Archives of other tools are taken too: any record type, headers with any blanks after the colon or folded lines, more
blank lines between records, members of any number, and records without a digest, for which ``read`` computes one. What
only ``write`` records (page id, payload length, the page a revisit refers to) is null or taken from the block there.
A digest is checked where it is a SHA-256 of the block, so not for HTTP messages, whose digest is of their body.

Equal payloads of at least ``SMALLEST`` bytes are stored once: the record with the smallest page_id is the response,
the others are revisits that refer to it. The join that decides this is by digest; both its sides are written tables or
scans, so that adaptive execution can split a digest with a third of all rows.

Files go to the shared folder through pyarrow's file systems. Every attempt of a task writes files of its own names;
only those in the manifest that is written at the end of the stage count, so lost executors and repeated tasks leave
unused files at worst. A task holds one record and one block of a stream. Archives are dealt one by one to as many tasks
as there are archives, up to ``TASKS``, and each writes its part of the index, so reading is dealt as finely.

Defined results: a null html is an empty payload; a null page_id counts as the largest and is stored as no header; a
null url is no header; rows with the smallest page_id of their payload are all responses, also where that id repeats;
blanks and control characters of a url are percent-encoded in the URI and kept in a header beside it; an empty table
gives no archive and an empty table; a stream that ends within a gzip member, its trailer or a record is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.shared import cut, new_path

SMALLEST, ARCHIVE_BYTES, BLOCK, TASKS = 100, 64 << 20, 1 << 20, 20_000
NO_ID = 2**63 - 1
SHA256 = re.compile("[0-9a-f]{64}")
INDEX = "path string, offset long, length long, type string, record_id string, page_id long, uri string, digest string"
PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to and that page's url (refers_url) of each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    id_ = F.coalesce("page_id", F.lit(NO_ID))
    large = rows.where(F.octet_length("payload") >= SMALLEST).select("digest", F.struct(id_.alias("id"), "url").alias("at"))
    firsts = large.groupBy("digest").agg(F.min("at").alias("at"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts.select("digest", F.col("at.id").alias("first"), F.col("at.url").alias("first_url")), "firsts")
    revisit = F.col("first").isNotNull() & (id_ > F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"))


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head += [f"WARC-Target-URI: {uri}"] + [f"X-Target-JSON: {json.dumps(url)}"] * (uri != url)
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"X-Refers-To-Page: {refers_to}"]
    block = payload if kind == "response" else b""
    return "\r\n".join([*head, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Names in lower case -> values, of a record from its first line to the empty one."""
    lines, out, last = raw.decode("utf-8", "replace").split("\r\n"), {}, ""
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
    for x in lines[1:]:
        if x[:1] in (" ", "\t") and last:  # a folded line
            out[last] += " " + x.strip()
        elif x:
            name, _, value = x.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, up to the blank lines that end them, from inflated blocks; the rest of a record is awaited, never more than one."""
    parts, have, need = bytearray(), 0, None
    for block in stream:
        parts += block
        while True:
            if need is None:
                if parts[:1] in (b"\r", b"\n"):  # more blank lines than need be
                    del parts[: len(parts) - len(parts.lstrip(b"\r\n"))]
                    have = 0
                end = parts.find(b"\r\n\r\n", max(0, have - 3))
                if end < 0:
                    have = len(parts)
                    break
                need = end + 8 + int(headers(bytes(parts[:end]))["content-length"])
            if len(parts) < need:
                break
            if parts[need - 4 : need] != b"\r\n\r\n":
                raise ValueError("a record is longer than its Content-Length")
            yield bytes(parts[:need])
            del parts[:need]
            have, need = 0, None
    if parts.lstrip(b"\r\n"):
        raise ValueError(f"the archive ends inside a record: {len(parts)} bytes are left")


def inflated(source: pa.NativeFile) -> Iterator[bytes]:
    """Blocks of a gzip file of one member or many, each read once."""
    z, inside = zlib.decompressobj(31), False
    while raw := source.read(BLOCK):
        while raw:
            inside = True
            yield z.decompress(raw, BLOCK)
            raw = z.unconsumed_tail
            if z.eof:
                raw, inside = z.unused_data, False
                z = zlib.decompressobj(31)
    if inside:
        if tail := z.flush():
            yield tail
        if not z.eof:
            raise ValueError("the archive ends inside a gzip member")


def given_digest(h: dict[str, str]) -> str | None:
    """The hex of a SHA-256, another digest as it stands, or None."""
    found = h.get("warc-payload-digest")
    return found.removeprefix("sha256:") if found else None


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Manifest (path, records) of archives in folder, each one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        done, out, name = [], None, ""

        def close() -> None:
            out.write(z.flush())
            out.close()
            done.append((f"{folder}/{name}", n))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, z, n, size = f"raw-{uuid.uuid4().hex}.warc.gz", zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                x = record(*row)
                out.write(z.compress(x))
                n, size = n + 1, size + len(x)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return cut(decided.mapInArrow(run, "path string, records long"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The index (INDEX) of the archives' records, after each is rewritten in folder as a member of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, at = open_fs(path)
                name, offset, index = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with source.open_input_stream(at, compression=None) as raw, fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for x in records(inflated(raw)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(x) + z.flush()
                        out.write(member)
                        h = headers(x[: x.index(b"\r\n\r\n")])
                        id_ = h.get("x-page-id")
                        index.append((f"{folder}/{name}", offset, len(member), h.get("warc-type"), h.get("warc-record-id"), None if id_ is None else int(id_), h.get("warc-target-uri"), given_digest(h)))
                        offset += len(member)
                with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as out:
                    for _, offset, length, kind, name_, _, uri, digest in index:
                        out.write(json.dumps({"offset": offset, "length": length, "type": kind, "record_id": name_, "uri": uri, "digest": digest}).encode() + b"\n")
                columns = list(zip(*index)) or [()] * 8
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in INDEX.split(", ")])

    tasks = min(TASKS, max(1, archives.count()))  # a number, as the paths are too few bytes for adaptive execution to keep them apart
    return cut(archives.select("path").repartition(tasks).mapInArrow(run, INDEX), "index")


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """PAGE rows of the index's records, each fetched by its offset; a response's payload is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            out = []
            for p, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if p != path:
                    fs, at = open_fs(p)
                    path, source = p, fs.open_input_file(at)
                source.seek(offset)
                x = zlib.decompress(source.read(length), 31)
                end = x.index(b"\r\n\r\n")
                h, body = headers(x[:end]), x[end + 4 : -4]
                digest, kind = given_digest(h), h.get("warc-type")
                own = not h.get("content-type", "").startswith("application/http")
                if digest is None:
                    digest = hashlib.sha256(body).hexdigest()
                elif kind == "response" and own and SHA256.fullmatch(digest) and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"{p} at {offset}: the payload isn't that of its digest")
                number = lambda k: int(h[k]) if k in h else None
                url = json.loads(h["x-target-json"]) if "x-target-json" in h else h.get("warc-target-uri")
                out.append((number("x-page-id"), url, number("x-payload-length") if "x-payload-length" in h else len(body), digest, kind, number("x-refers-to-page"), body if payloads else None))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in PAGE.split(", ")])

    return index.select("path", "offset", "length").mapInArrow(run, PAGE)


def archive(pages: DataFrame) -> DataFrame:
    """The index of pages, written to new archives in the shared folder and normalised."""
    folder = new_path(pages.sparkSession, "warc")
    return normalise(write(decide(pages), f"{folder}/raw"), f"{folder}/records")
