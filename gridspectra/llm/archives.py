"""Legacy archive converter: ARC files to equivalent WARC files.

ARC 1 and 2 files start with a version block that names the fields of the header lines; each record is
such a line, with the length of its content, and the content. The converter reads lines and lengths,
and writes WARC 1.1 records with synthesised identifiers, dates, types and digests. Contents that
occur before become revisits: only digests meet in a shuffle, the contents stay in the files.

Archives live in the shared folder, written under a temporary name and moved, so that a task that
runs again leaves the same files.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, table, written

#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
#: Tasks that a table of files is dealt to at most; beyond it a task takes several files, one after another.
MOST_TASKS = 20_000
DATE = "20240101000000"
# Fixed values of the formats: field names of the ARC versions and the WARC revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gridspectra:archive")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def read_file(path: str) -> bytes:
    store, at = _open(path)
    with store.open_input_stream(at, compression=None) as f:
        return f.read()


def write_file(path: str, data: bytes) -> None:
    store, at = _open(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as f:
        f.write(data)
    store.move(part, at)


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after another; each byte is fed once, but for less than a piece a member."""
    view, at, piece = memoryview(data), 0, 1 << 14
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a gzip member ends early")
            out.append(d.decompress(view[at : at + piece]))
            at = min(len(view), at + piece) - len(d.unused_data)
        yield b"".join(out)


def _member(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=1, mtime=0)


# ---- ARC


def arc_version_block(version: int, name: str) -> bytes:
    text = f"{version} 0 gridspectra\n{ARC_FIELDS[version]}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain{extra} {len(text)}\n".encode() + text + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, content: bytes) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    extra = f" 200 {zlib.crc32(content):08x} - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {DATE} text/html{extra} {len(content)}\n".encode() + content + b"\n"


def parse_arc(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of every record of an ARC file, the version block first.

    The block's own version line says how header lines are divided. URLs may hold blanks: fields are
    counted from the right. A length beyond the data raises ValueError.
    """
    fields: list[str] = []
    for block in blocks:
        while block:
            line, _, rest = bytes(block).partition(b"\n")
            if not line.strip():
                block = rest
                continue
            if not fields:
                at = rest.split(b"\n", 2)
                version = int(at[0].split()[0])
                fields = at[1].decode().split() if len(at) > 1 else ARC_FIELDS[version].split()
            values = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(fields) - 1)
            if len(values) != len(fields):
                raise ValueError(f"ARC header line with {len(values)} of {len(fields)} fields")
            head = dict(zip(fields, values))
            length = int(head["Archive-length"])
            if length > len(rest):
                raise ValueError("ARC record longer than its file")
            yield head, rest[:length]
            block = rest[length:]


def http_response(page_id: int | None, html: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html)}\r\n\r\n".encode() + html


def http_parts(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields in lower case, the header block and the payload of an HTTP message; a bare content is all payload."""
    if not content.startswith(b"HTTP/"):
        return {}, b"", content
    head, mark, payload = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + mark, payload


# ---- WARC


def record_id(name: str, index: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name}#{index}')}>"


def warc_date(arc_date: str) -> str:
    """ISO 8601 of an ARC date of 8 to 14 digits, missing digits as zeros."""
    digits = re.sub(r"\D", "", arc_date)[:14].ljust(14, "0")
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def warc_record(head: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": len(block)}).items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    for block in blocks:
        block = bytes(block)
        while block.strip(b"\r\n"):
            head, _, rest = block.lstrip(b"\r\n").partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(fields["Content-Length"])
            if length > len(rest):
                raise ValueError("WARC record longer than its file")
            yield fields, rest[:length]
            block = rest[length:]


def convert(name: str, records: Iterator[tuple[dict[str, str], bytes]], refers: dict[int, tuple[str, str]]) -> Iterator[bytes]:
    """WARC records of an ARC file; only its first record is a version block. refers: record index -> (record id, page id) of the content it repeats."""
    for i, (head, content) in enumerate(records):
        base = {"WARC-Record-ID": record_id(name, i), "WARC-Date": warc_date(head["Archive-date"])}
        if i == 0 and head["URL"].startswith("filedesc://"):
            yield warc_record({"WARC-Type": "warcinfo", **base, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, f"software: gridspectra\r\nsource: ARC {head['URL']}\r\n".encode())
            continue
        _, http, payload = http_parts(content)
        base |= {"WARC-Target-URI": head["URL"], "WARC-IP-Address": head["IP-address"], "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}"}
        kind = "application/http;msgtype=response" if http else head["Content-type"]
        if i in refers:
            to, page = refers[i]
            yield warc_record({"WARC-Type": "revisit", **base, "WARC-Refers-To": to, "X-Refers-To-Page": page, "WARC-Profile": PROFILE, "Content-Type": kind}, http)
        else:
            yield warc_record({"WARC-Type": "response" if http else "resource", **base, "Content-Type": kind}, content)


# ---- distributed steps


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """ARC files of the pages (page_id, url, html), versions 1 and 2 in turn; one row (path) per file."""

    def run(batches):
        part = TaskContext.get().partitionId()
        out, name, size, count = [], "", 0, 0

        def close():
            write_file(f"{folder}/{name}", b"".join(out))
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                if not out:
                    version = 1 + (part + count) % 2
                    name = f"pages-{part:06d}-{count:06d}.arc.gz"
                    out = [_member(arc_version_block(version, name))]
                content = http_response(page_id.as_py(), (html.as_py() or "").encode())
                out.append(_member(arc_record(version, name, size, url.as_py() or f"urn:page:{page_id.as_py()}", content)))
                size += len(content)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out, size, count = [], 0, count + 1
        if out:
            yield close()

    return written(pages.select("page_id", "url", "html").mapInArrow(run, "path string"))


def spread(files: DataFrame) -> DataFrame:
    """`files`, a written table of paths, one to a task (of up to MOST_TASKS): a table of paths is so small that it would be one task."""
    return files.repartition(min(MOST_TASKS, max(1, files.count())))


def _page(head: dict[str, str]) -> int | None:
    return int(head["x-page-id"]) if "x-page-id" in head else None


def scan_arcs(arcs: DataFrame) -> DataFrame:
    """One row per content record: path, index, page_id, digest, bytes."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for i, (head, content) in enumerate(parse_arc(members(read_file(path)))):
                    if i or not head["URL"].startswith("filedesc://"):
                        fields, _, payload = http_parts(content)
                        rows.append((path, i, _page(fields), hashlib.sha256(payload).hexdigest(), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["path", "index", "page_id", "digest", "bytes"])

    return spread(arcs).mapInArrow(run, "path string, index long, page_id long, digest string, bytes long")


def write_warcs(arcs: DataFrame, folder: str) -> DataFrame:
    """WARC files of the ARC files, contents of REVISIT_BYTES or more once; one row (path) per file."""
    seen = written(scan_arcs(arcs))
    long = seen.where(F.col("bytes") >= REVISIT_BYTES)
    at = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "path", "index")
    first = written(long.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))  # apart from the join, whose skew can then be split
    repeats = long.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    per_file = repeats.groupBy("path").agg(F.collect_list(F.struct("index", F.col("first.path").alias("to"), F.col("first.index").alias("to_index"), F.col("first.page_id").alias("page"))).alias("repeats"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                name = row["path"].rpartition("/")[2]
                refers = {r["index"]: (record_id(r["to"].rpartition("/")[2], r["to_index"]), str(r["page"])) for r in row["repeats"] or ()}
                to = f"{folder}/{name.removesuffix('.arc.gz')}.warc.gz"
                write_file(to, b"".join(map(_member, convert(name, parse_arc(members(read_file(row["path"]))), refers))))
                yield pa.RecordBatch.from_pydict({"path": [to]})

    return written(spread(written(arcs.join(per_file, "path", "left"))).mapInArrow(run, "path string"))


def read_warcs(warcs: DataFrame) -> DataFrame:
    """One row per content record of the WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, date.

    The payload of a response is digested again; one that differs from its record's digest raises ValueError.
    """
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "date")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for head, block in parse_warc(members(read_file(path))):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    fields, _, payload = http_parts(block)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: payload and digest differ")
                    size = int(fields.get("content-length", len(payload))) if kind == "revisit" else len(payload)
                    to = head.get("X-Refers-To-Page")
                    rows.append((_page(fields), size, digest, kind, None if to in (None, "None") else int(to), head["WARC-Record-ID"], head["WARC-Target-URI"], head["WARC-Date"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))

    return spread(warcs).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the WARC files read again (see read_warcs).

    A null html is an empty payload, a null url stands as urn:page:<id>, rows with null page_id come last among
    equal payloads. Rows with the smallest page_id of a payload, repeated or not, are responses. An empty table gives no rows.
    """
    folder = shared_dir(pages.sparkSession)
    return read_warcs(write_warcs(write_arcs(pages, f"{folder}/arc"), f"{folder}/warc"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {REVISIT_BYTES} and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {REVISIT_BYTES} and page_id <> first then first end as refers_to
from f
"""
