"""WARC archives: one gzip member per record, written and read in parallel.

Writing tasks name their files by attempt and report them; the list of the
reported files says what belongs to the archive, so a lost task's file is
ignored.  Reading tasks get byte ranges: each looks for gzip's magic bytes,
takes a place for a record once its header decodes as one, and owns the
records that start inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
URN = "urn:wirebook:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 16
SPLIT_BYTES = 8 << 20
#: Tasks of a read at most; beyond it each takes several ranges.
MAX_TASKS = 20_000
MANIFEST = "file string, bytes bigint, records bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A record as a gzip member; a revisit keeps the HTTP header only."""
    name = lambda i: f"<{URN}{'null' if i is None else i}>"
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    return squeeze.compress(data) + squeeze.flush()


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write every page; of equal payloads the smallest id is a response, the others revisit it.

    Null html is an empty payload.  Payloads below ``min_revisit_bytes`` are
    always responses.  Rows that repeat the smallest id are responses too; a
    null id is a revisit if an equal payload has an id, a response otherwise.
    A null url leaves its header out; control characters in one are escaped.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha2("payload", 256))
    firsts = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    later = (F.octet_length("payload") >= min_revisit_bytes) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    rows = rows.join(firsts, "sha").select("page_id", "url", "payload", F.when(later, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size, n, out = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page, where, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, at = _store(file)
                    store.create_dir(at.rsplit("/", 1)[0])
                    out = store.open_output_stream(at, compression=None)
                data = record(page, where, payload, refers, date)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([size]), pa.array([n])], names=["file", "bytes", "records"]
            )

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")


class _Window:
    """Bytes of a file from a moving place on, read block by block."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(BLOCK)
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.at, self.data = self.at + n, self.data[n:]


def _member(window: _Window) -> bytes | None:
    """Decoded member at the window's start, which moves past it; None, unmoved, if it isn't a record."""
    while len(window.data) < len(MAGIC) and window.more():
        pass
    if not window.data.startswith(MAGIC):
        return None
    unzip, used, out = zlib.decompressobj(31), 0, []
    try:
        while not unzip.eof:
            if used == len(window.data) and not window.more():
                return None
            out.append(unzip.decompress(window.data[used:]))
            used = len(window.data)
            if sum(map(len, out)) >= len(VERSION) and len(out) < 3 and not b"".join(out).startswith(VERSION):
                return None
    except zlib.error:
        return None
    body = b"".join(out)
    if not body.startswith(VERSION) or b"\r\n\r\n" not in body:
        return None
    window.skip(used - len(unzip.unused_data))
    return body


def members(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    """Records whose first byte is in [start, stop)."""
    window = _Window(file, start)
    while window.at < stop:
        if (body := _member(window)) is not None:
            yield body
            continue
        # Not a record here: go to the next place that may be one, past this one only.
        begin = 1
        while (found := window.data.find(MAGIC, begin)) < 0:
            window.skip(max(0, len(window.data) - len(MAGIC) + 1))
            begin = 0
            if window.at >= stop or not window.more():
                return
        window.skip(found)


def parse(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers with lower-case names, the HTTP header and the payload."""
    head, _, block = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def read_archives(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """Every record of the listed files, read in ranges of ``split_bytes``.

    A response's size and digest are taken from the payload itself, which must
    agree with its header; a revisit's are those of the full payload as its
    headers give them.  ``payload`` adds the payload (null for a revisit).  The
    records found in each file are counted in a pass of their own; if they are
    not as many as the manifest says, the query fails.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    ranges = files.where("bytes > 0").select(
        "file", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start")
    )
    # A fixed number, as the rows are too small for Spark to see the work behind them.
    tasks = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    number = lambda text: None if text.endswith(":null>") else int(text[len(URN) + 1 : -1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                store, at = _store(name)
                with store.open_input_file(at) as file:
                    for body in members(file, start, start + split_bytes):
                        fields, http, content = parse(body)
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        if kind == "response" and (size != len(content) or digest != payload_digest(content)):
                            raise ValueError(f"{name}: a damaged record of page {fields['warc-record-id']}")
                        refers = fields.get("warc-refers-to")
                        row = (number(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind)
                        row += (number(refers) if refers else None,)
                        rows.append(row + ((content if kind == "response" else None),) * payload)
                        if len(rows) >= 500:
                            yield _batch(rows, layout)
                            rows = []
                if rows:
                    yield _batch(rows, layout)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = batch.column(0).to_pylist(), []
            for name, start in zip(names, batch.column(1).to_pylist(), strict=True):
                store, at = _store(name)
                with store.open_input_file(at) as file:
                    found.append(sum(1 for _ in members(file, start, start + split_bytes)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.int64())], names=["file", "found"])

    layout = RECORDS + ", payload binary" * payload
    dealt = ranges.repartition(min(int(tasks), MAX_TASKS), "file", "start")
    found = dealt.mapInArrow(count, "file string, found bigint").groupBy("file").agg(F.sum("found").alias("found"))
    said = F.concat("file", F.lit(": records listed, found: "), F.concat_ws(", ", "records", F.coalesce("found", F.lit(0))))
    lost = files.join(found, "file", "left").where(~F.col("records").eqNullSafe(F.coalesce("found", F.lit(0))))
    # A row here fails the query, so this part adds none.
    lost = lost.where(F.raise_error(said).cast("string").isNotNull())
    names = [x.split(" ") for x in layout.split(", ")]
    return dealt.mapInArrow(read, layout).unionByName(lost.select(*[F.lit(None).cast(t).alias(n) for n, t in names]))


def _batch(rows: list[tuple], layout: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split(" ") for x in layout.split(", ")), strict=True)
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))
