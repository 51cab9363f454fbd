"""WARC archives with a two-level capture index.

Writing: every row becomes a gzip member holding one WARC/1.1 record; each task
writes one archive. Of equal payloads of at least ``MIN_BYTES`` bytes the row of
smallest id is a ``response``, the others are ``revisit`` records that refer to
it and carry no payload.

Index: a line per record, keyed by the URL with its host reversed
(``com,example)/path``), sorted into blocks of ``BLOCK_LINES`` lines that are
compressed one by one. The directory keeps the first key of each block and
where the block lies. A look-up searches the directory by halving, reads one
block, searches it by halving, and then reads the record's byte range.

All files lie in the folder that the session shares (``spark.checkpoint.dir``)
and are put in place by a rename under a name of their content's task and
attempt, so that a task that is run again leaves no torn file. Only files of
committed tasks are named in the tables that the index is made of.

Null html is an empty payload; a null URL is kept as the empty URL. Repeated rows
are separate records: all those of the smallest id are responses, so that a payload
that one page has twice refers to nothing. A row without an id is a revisit where a
row with an id has its payload. Ids may be of any type that has a text form. Columns
other than the three, of whatever name, are ignored. An empty table gives no archive
and no rows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

MIN_BYTES = 100
BLOCK_LINES = 500
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)")


def url_key(url: str | None) -> str:
    """``http://user@www.Example.com:80/a?b#c`` -> ``com,example,www:80)/a?b``."""
    m = _URL.match(url or "")
    if not m:
        return url or ""
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (m[2] or "/")


def record(kind: str, page: str | None, url: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One WARC record, as a gzip member; ids stand percent-encoded, a null id not at all."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}",
        *([] if page is None else [f"X-Page-ID: {quote(page, safe='')}"]), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers is not None:
        head[5:5] = [f"WARC-Refers-To: {name(refers)}", f"X-Refers-To-Page: {quote(refers, safe='')}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, payload without the HTTP head)."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def members(data: bytes, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, gzip member) of a whole archive, a few bytes beyond the member at a time."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, end = zlib.decompressobj(31), at
        while not z.eof:
            if end >= len(data):
                raise ValueError("the archive ends within a record")
            z.decompress(view[end : end + step])
            end = min(end + step, len(data))
        end -= len(z.unused_data)
        yield at, data[at:end]
        at = end


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if "://" in uri or uri.startswith("file:") else "file://" + uri)


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id") -> DataFrame:
    """``id, url, html, digest, record_type, refers_to``.

    Only (digest, id) pairs are aggregated, before the shuffle already. What comes
    of it, a row for each payload that repeats, is written down: Spark then knows its
    size, and moves no html if it is small enough to broadcast. Else the join is an
    ordinary one on the digest, split where one payload holds very many rows.
    """
    p = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    firsts = p.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("response"), F.count("*").alias("n"))
    firsts = common.materialise(firsts.filter("n > 1").select("digest", "response"), "repeated")
    revisit = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("id"))
    return p.join(firsts, "digest", "left").select("id", "url", "html", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns the capture lines (``key, page, file, at, length``).

    Run it once: the result must be materialised before it is read twice.
    """

    def run(batches):
        from pyspark import TaskContext

        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        c = TaskContext.get()
        name = f"{base}/part-{c.partitionId():05d}-{c.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for b in common.bounded(batches):
            keys, ids, where, size = [], [], [], []
            for page, url, html, digest, kind, refers in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                payload = b"" if kind == "revisit" else html
                member = record(kind, text(page), url, payload, digest, text(refers))
                if out is None:
                    out = store.open_output_stream(name + ".open")
                out.write(member)
                keys.append(url_key(url))
                ids.append(page)
                where.append(at)
                size.append(len(member))
                at += len(member)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, kind_of), pa.array([name] * n, pa.string()), pa.array(where, pa.int64()), pa.array(size, pa.int64())], ["key", "page", "file", "at", "length"])
        if out is not None:
            out.close()
            store.move(name + ".open", name)

    text = lambda i: None if i is None else str(i)
    kind_of = to_arrow_type(records.schema["id"].dataType)
    df = records.select("id", "url", F.col("html").cast("binary").alias("html"), "digest", "record_type", "refers_to")
    return df.mapInArrow(run, f"key string, page {df.schema['id'].dataType.simpleString()}, file string, at long, length long")


def build_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted, compressed blocks; returns the directory (``first, file, at, length, n``)."""

    def run(batches):
        from pyspark import TaskContext

        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        c = TaskContext.get()
        name = f"{base}/index-{c.partitionId():05d}-{c.taskAttemptId()}.cdx.gz"
        out, at, held, found = None, 0, [], []

        def block(rows):
            nonlocal out, at
            z = gzip.compress("".join(json.dumps(r, separators=(",", ":"), ensure_ascii=False) + "\n" for r in rows).encode(), 6, mtime=0)
            if out is None:
                out = store.open_output_stream(name + ".open")
            out.write(z)
            found.append((rows[0][0], name, at, len(z), len(rows)))
            at += len(z)

        for b in batches:
            held += zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)
            while len(held) >= lines:
                block(held[:lines])
                held = held[lines:]
        if held:
            block(held)
        if out is not None:
            out.close()
            store.move(name + ".open", name)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["first", "file", "at", "length", "n"])

    df = captures.select("key", F.col("page").cast("string").alias("page"), "file", "at", "length")
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page")
    return df.mapInArrow(run, "first string, file string, at long, length long, n long")


class Reader:
    """Keeps a few files open and reads byte ranges."""

    def __init__(self, keep: int = 64):
        self.open, self.keep = {}, keep

    def range(self, file: str, at: int, length: int) -> bytes:
        f = self.open.get(file)
        if f is None:
            if len(self.open) >= self.keep:
                self.open.pop(next(iter(self.open))).close()
            store, path = _store(file)
            f = self.open[file] = store.open_input_file(path)
        f.seek(at)
        return f.read(length)


def lookup(url: str, directory: list[tuple[str, str, int, int]], reader: Reader | None = None) -> list[tuple[dict[str, str], bytes]]:
    """All captures of a URL: directory (sorted by first key), block, byte range."""
    reader, key, out = reader or Reader(), url_key(url), []
    firsts = [d[0] for d in directory]
    i = max(0, bisect.bisect_left(firsts, key) - 1)
    while i < len(directory) and firsts[i] <= key:
        _, file, at, length = directory[i]
        rows = [json.loads(x) for x in gzip.decompress(reader.range(file, at, length)).decode().split("\n")[:-1]]
        keys = [r[0] for r in rows]
        for r in rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
            out.append(parse(reader.range(r[2], r[3], r[4])))
        i += 1
    return out


def read_all(directory: DataFrame, id_type: str = "long") -> DataFrame:
    """Every record through the index: each block's lines, each line's byte range.

    Lines of a block are read file by file, by ascending offset.
    """

    def run(batches):
        reader = Reader()
        for b in batches:
            for file, at, length in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                rows = [json.loads(x) for x in gzip.decompress(reader.range(file, at, length)).decode().split("\n")[:-1]]
                got = []
                for _, _, archive, start, size in sorted(rows, key=lambda r: (r[2], r[3])):
                    h, payload = parse(reader.range(archive, start, size))
                    kind = h["warc-type"]
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of page {h.get('x-page-id')} is damaged")
                    got.append((named(h, "x-page-id"), len(payload) if kind == "response" else None, digest, kind, named(h, "x-refers-to-page")))
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if n == "payload_bytes" else pa.string()) for n, x in zip(names, zip(*got))], names)

    named = lambda h, k: unquote(h[k]) if k in h else None
    df = directory.select("first", "file", "at", "length")
    n = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(n).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, *, folder: str | None = None, min_bytes: int = MIN_BYTES, id_col: str = "page_id") -> DataFrame:
    """Writes archives and index under ``folder``; returns the directory."""
    spark: SparkSession = pages.sparkSession
    folder = folder or common.fresh_path(spark, "warc")
    captures = common.materialise(write(plan_records(pages, min_bytes, id_col), folder + "/archive"), "captures")
    directory = common.materialise(build_index(captures, folder + "/index"), "directory")
    common.discard(captures)
    return directory


def report(pages: DataFrame) -> DataFrame:
    """Archives the pages and describes each record as it is read back.

    A revisit carries no payload: its size is that of the response it refers to,
    looked up by its page and digest, one row for each.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    directory = archive(pages)
    back = common.materialise(read_all(directory, kind), "records")
    common.discard(directory)
    key = [F.col("refers_to") == F.col("r"), F.col("payload_digest") == F.col("d")]
    whole = back.filter("record_type = 'response'").groupBy(F.col("page_id").alias("r"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("whole"))
    revisits = back.filter("record_type = 'revisit'").join(whole, key, "left")
    revisits = revisits.withColumn("payload_bytes", F.col("whole")).select(back.columns)
    return back.filter("record_type = 'response'").unionByName(revisits)
