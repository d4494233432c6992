"""WARC archives: a deterministic sharded writer and a reader.

Pages are range-sorted by id.  Each task writes its range as gzip members, one a record, and begins a new
file when the compressed size passes ``roll_bytes``.  Headers, digests and record ids are made from the
page alone, so a repeated task writes the same bytes.  A file is written under a temporary name of the
attempt and then moved to its own; the manifest, written last by Spark's own commit, lists the files that
count.  Equal payloads are archived once: the smallest page id is the response, others revisit it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.llm.common import prepared, table, written
from quotelab.session import shared_folder

ROLL_BYTES = 32 << 20
LEAST_REVISIT = 0
#: The capture time of every record: archives must not depend on when they are written.
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_page long, last_page long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(folder: str):
    """The file system of a shared folder and the path in it; executors and readers open it alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else fs.FileSystem.from_uri("file://" + folder.removeprefix("file:"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int, kind: str, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{kind}/{payload}')}>"


def member(page: int | None, url: str | None, html: bytes, first: int | None) -> bytes:
    """One gzip member: the record of a page; ``first`` is the page that it revisits, if any."""
    sha = digest(html)
    kind = "response" if first is None else "revisit"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + (html if first is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, kind, sha)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Page-ID: {'' if page is None else page}",
    ]
    if first is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(first, 'response', sha)}", f"X-Refers-To-Page: {first}",
        ]
    head = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)


class Shard:
    """Files of one range of pages."""

    def __init__(self, folder: str, shard: int, roll: int) -> None:
        self.system, self.path = file_system(folder)
        self.shard, self.roll, self.part, self.out = shard, roll, 0, None
        self.attempt = uuid.uuid4().hex

    def _names(self) -> tuple[str, str]:
        name = f"pages-{self.shard:06d}-{self.part:06d}.warc.gz"
        return f"{self.path}/_tmp-{self.attempt}-{name}", f"{self.path}/{name}"

    def add(self, page: int | None, record: bytes) -> Iterator[tuple]:
        if self.out is not None and self.size + len(record) > self.roll:
            yield self.close()
        if self.out is None:
            self.out = self.system.open_output_stream(self._names()[0], compression=None)
            self.size, self.records, self.sha, self.first = 0, 0, hashlib.sha256(), page
        self.out.write(record)
        self.sha.update(record)
        self.size, self.records, self.last = self.size + len(record), self.records + 1, page

    def close(self) -> tuple:
        self.out.close()
        temporary, name = self._names()
        self.system.move(temporary, name)
        self.out, self.part = None, self.part + 1
        return name.rsplit("/", 1)[1], self.shard, self.records, self.size, self.sha.hexdigest(), self.first, self.last


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def archive(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write ``page_id, url, html`` to ``folder`` (seen by all executors); returns the manifest.

    Null html is an empty payload.  Of equal payloads of ``least_revisit`` bytes or more, rows of the
    smallest page id are responses (a repeat of such a row too), all others revisit it.  Pages without
    an id come first and are always responses.  Other columns are not archived.
    """
    prepared(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    known = pages.where("page_id IS NOT NULL").select("page_id", F.sha2("html", 256).alias("sha"), F.length("html").alias("size"))
    known = written(known.where(F.col("size") >= least_revisit), "payloads")
    firsts = known.groupBy("sha", "size").agg(F.min("page_id").alias("first"))
    again = known.join(firsts, ["sha", "size"]).where("page_id > first").select("page_id", "first", "sha").distinct()
    again = written(again, "revisits")
    # A page's revisit notes sort right before its rows, so that neither side needs a second shuffle.
    notes = again.select("page_id", F.lit(0).alias("kind"), F.col("sha").alias("url"), F.lit(None).cast("binary").alias("html"), "first")
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("first")).unionByName(notes)
    rows = rows.repartitionByRange("page_id").sortWithinPartitions("page_id", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, current, seen = Shard(folder, TaskContext.get().partitionId(), roll_bytes), None, {}
        for batch in batches:
            done = []
            for page, kind, url, html, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                page = page.as_py()
                if page != current:
                    current, seen = page, {}
                if kind.as_py() == 0:
                    seen[url.as_py()] = first.as_py()
                    continue
                payload = html.as_py()
                source = seen.get(hashlib.sha256(payload).hexdigest()) if seen else None
                done += shard.add(page, member(page, url.as_py(), payload, source))
            yield _rows(done, MANIFEST)
        yield _rows([shard.close()] if shard.out is not None else [], MANIFEST)

    return written(rows.mapInArrow(write, MANIFEST), "manifest")


def members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one in memory at a time."""
    data = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while True:
        line = data.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        headers = {}
        while (line := data.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            headers[name.lower()] = value
        yield headers, data.read(int(headers["content-length"]))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """``RECORD`` rows of the files that the manifest lists; digests are checked on the way.

    A revisit's payload length is that of its HTTP header, its digest that of the page it revisits.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in members(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
                        sha = headers["warc-payload-digest"].removeprefix("sha1:")
                        kind = headers["warc-type"]
                        if headers["warc-block-digest"] != f"sha1:{digest(block)}" or kind == "response" and (digest(payload) != sha or len(payload) != size):
                            raise ValueError(f"{name}: record {headers['warc-record-id']} does not match its digest")
                        page, first = headers["x-page-id"], headers.get("x-refers-to-page")
                        rows.append((int(page) if page else None, size, sha, kind, int(first) if first else None))
                        if len(rows) >= 4096:
                            yield _rows(rows, RECORD)
                            rows = []
                yield _rows(rows, RECORD)

    files = manifest.select("file").repartition(max(1, min(manifest.count(), 10_000)), "file")
    return files.mapInArrow(read, RECORD)


def op7_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    system, path = file_system(place)
    system.create_dir(path)
    return read_archives(archive(table(spark, folder, "pages"), place), place)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages),
b AS (  -- 160 bits
  SELECT *, array_to_string(list_transform(regexp_extract_all(h, '.'),
    lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits
  FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(generate_series(0, 4), lambda j: substr(bits, 5 * i + j + 1, 1)::INT * (16 >> j)))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
