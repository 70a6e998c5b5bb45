"""WARC writing, reading and transaction assembly.

Writing makes three records of every page: a response (or a revisit of the
response with the same payload), a request and a metadata record, tied to the
first by ``WARC-Concurrent-To``. Files are gzip with one member a record. A
file's name carries the writing attempt; only files named by the written
manifest count. Reading streams members and yields one row a record, of our archives by their manifest or of
any by their paths. ``assemble`` joins requests and metadata to their captures through all
concurrent-to identifiers, whichever record states them, and gives one nested row a capture.

Record ids are hashes of page id, url, payload and the number among rows alike in all
three, so that each row is a capture of its own and a revisit can name its response
without meeting it. Rows alike in all three are written from one of them.

Defined cases: null html is the empty payload; a null url becomes
``urn:x-none:``; of rows that share a payload's largest page id all are responses, and revisits name that
with the largest url; where all page ids of a payload are null, all are responses; repeated pages each keep their own capture; a request or
metadata record without its capture gives a capture with a null response;
an archive that can't be read further, or at all, gives the records before that and one of type ``error`` with the reason
in ``fields``; chunked bodies are joined; an empty table gives no archive; payloads of any length are written whole;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, join_hot, materialise, open_fs, shared_dir

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcConfig:
    revisit_bytes: int = 1000  # smaller payloads are never revisits
    file_bytes: int = 64 * 1024 * 1024
    level: int = 3
    date: str = "2000-01-01T00:00:00Z"


# ------------------------------------------------------------ records


def record(kind: str, record_id: str, block: bytes, date: str, content_type: str, extra: list[tuple[str, str]] = ()) -> bytes:
    """One WARC/1.1 record, not compressed."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *extra, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Source:
    """Lines and bytes of a stream of gzip members, or of plain bytes."""

    def __init__(self, raw: io.RawIOBase):
        self.raw, self.buf = raw, bytearray()
        start = raw.read(2)
        self.rest, self.gz = start, start == b"\x1f\x8b"
        self.z = zlib.decompressobj(31) if self.gz else None

    def _more(self) -> bool:
        chunk = self.rest or self.raw.read(1 << 18)
        self.rest = b""
        if not chunk:
            if self.gz and not self.z.eof and self.z.unconsumed_tail == b"" and getattr(self, "open", False):
                raise ValueError("a gzip member ends early")
            return False
        if not self.gz:
            self.buf += chunk
            return True
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.buf += self.z.decompress(chunk)
        self.open = not self.z.eof
        self.rest = self.z.unused_data
        return True

    def line(self) -> bytes | None:
        at = 0
        while (k := self.buf.find(b"\n", at)) < 0:
            at = len(self.buf)
            if not self._more():
                if not self.buf:
                    return None
                k = len(self.buf) - 1
                break
        out = bytes(self.buf[: k + 1])
        del self.buf[: k + 1]
        return out.rstrip(b"\r\n")

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self._more():
                raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def _headers(next_line) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    last = None
    while (line := next_line()):
        if line[:1] in b" \t" and last:
            out[last][-1] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        out.setdefault(last, []).append(value.strip())
    return out


def parse(raw: io.RawIOBase) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers, block) of every record of an open archive; header names in lower case."""
    src = _Source(raw)
    while (line := src.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _headers(src.line)
        yield head, src.take(int(head.get("content-length", ["0"])[0]))


def _http(block: bytes) -> tuple[str, dict[str, list[str]], bytes]:
    head, sep, payload = block.partition(b"\r\n\r\n")
    lines = iter(head.split(b"\r\n") + [b""])
    first = next(lines).decode("latin-1")
    headers = _headers(lambda: next(lines, b""))
    return first, headers, _joined(payload) if "chunked" in headers.get("transfer-encoding", [""])[-1].lower() else payload


def _joined(body: bytes) -> bytes:
    """A chunked body without its chunk sizes; as it is where it isn't one."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return body


def _hex_digest(value: str | None) -> str | None:
    """A payload digest as bare lower-case hex, from base32 or hex."""
    if not value:
        return None
    text = value.rpartition(":")[2]
    if len(text) == 40:
        return text.lower()
    try:
        return base64.b32decode(text.upper()).hex()
    except ValueError:
        return None


def _bare(value: list[str] | None) -> str | None:
    return value[0].strip("<> ") if value else None


# ------------------------------------------------------------ writing


def plan_captures(pages: DataFrame, config: WarcConfig = WarcConfig()) -> DataFrame:
    """page_id, url, html, digest, copy (number among rows alike) and, of a revisit, original: struct(page_id, url) of the
    response it refers to. Pages stay where they are unless more payloads repeat than may be broadcast."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", html.alias("html")).withColumns({"n": F.octet_length("html"), "digest": F.sha1(F.col("html").cast("binary"))})
    slim = materialise(base.groupBy("page_id", "url", "n", "digest").agg(F.count("*").alias("copies")), "captures")
    big = F.col("n") >= config.revisit_bytes
    one = F.struct("page_id", "url")
    equal = slim.where(big).groupBy("digest").agg(F.max(one).alias("first"), F.sum("copies").alias("rows")).where("rows > 1 AND first.page_id IS NOT NULL")
    equal = materialise(equal, "payloads")
    alike = slim.where("copies > 1").select(F.col("page_id").alias("__p"), F.col("url").alias("__u"), F.col("digest").alias("__g"), "copies")
    rows, many = base, alike.agg(F.count("*").alias("n"), F.max("copies").alias("most")).first()
    if many["n"]:
        table = F.broadcast(alike) if many["n"] <= BROADCAST_ROWS else alike
        same = F.col("page_id").eqNullSafe(F.col("__p")) & F.col("url").eqNullSafe(F.col("__u")) & (F.col("digest") == F.col("__g"))
        met = base.join(table, same, "left").drop("__p", "__u", "__g")
        names = ["page_id", "url", "n", "digest", "copies"]
        once = met.where("copies IS NOT NULL").groupBy(*names).agg(F.any_value("html").alias("html"))  # each task keeps one before any is moved
        if many["most"] > 1000:
            once = once.withColumn("__a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(1000).cast("long")))).repartition()
            once = once.withColumn("copy", F.explode(F.sequence("__a", F.least(F.col("__a") + 1000, "copies") - 1)))
        else:
            once = once.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        rows = met.where("copies IS NULL").withColumn("copy", F.lit(0).cast("long")).select(*base.columns, "copy").unionByName(once.select(*base.columns, "copy"))
    else:
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    # Small pages get a key of their own, so that they neither match nor meet in one task.
    keyed = rows.withColumn("__k", F.when(big, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url", "copy").cast("string"))))
    met = join_hot(keyed, equal.withColumnRenamed("digest", "__k"), "__k", "rows", slim.agg(F.sum("copies")).first()[0] or 0, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return met.select("page_id", "url", "html", "digest", "copy", F.when(revisit, F.col("first")).alias("original"))


def _uuid(*parts) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode('utf-8', 'surrogatepass')).digest()[:16])}"


def page_records(page_id, url, html: str, digest: str, copy: int, original: dict | None, config: WarcConfig) -> list[bytes]:
    """The three records of one page, each a gzip member."""
    payload = html.encode("utf-8", "surrogatepass")
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "urn:x-none:"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    base = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    mine = _uuid("capture", page_id, url, digest, copy)
    if original is None:
        first = record("response", mine, http + payload, config.date, "application/http;msgtype=response", base)
    else:
        extra = [*base, ("WARC-Refers-To", f"<{_uuid('capture', original['page_id'], original['url'], digest, 0)}>"), ("WARC-Profile", REVISIT)]
        first = record("revisit", mine, http, config.date, "application/http;msgtype=response", extra)
    parts = urlsplit(uri)
    tie = [("WARC-Target-URI", uri), ("WARC-Concurrent-To", f"<{mine}>")]
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    request = record("request", _uuid("request", mine), f"GET {path} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode(), config.date, "application/http;msgtype=request", tie)
    metadata = record("metadata", _uuid("metadata", mine), f"page-id: {'' if page_id is None else page_id}\r\n".encode(), config.date, "application/warc-fields", tie)
    return [member(x, config.level) for x in (first, request, metadata)]


def write_archives(pages: DataFrame, path: str, config: WarcConfig = WarcConfig()) -> None:
    """Write archives/*.warc.gz and a manifest into the shared folder ``path``."""
    fs, p = open_fs(path)
    fs.create_dir(f"{p}/archives", recursive=True)

    def write(batches):
        from pyspark import TaskContext

        fs, root = open_fs(path)
        part, out, size, name, n, done = TaskContext.get().partitionId(), None, 0, "", 0, []
        for b in batches:
            for page_id, url, html, digest, copy, original in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size, n = f"archives/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                for m in page_records(page_id, url, html, digest, copy, original, config):
                    out.write(m)
                    size, n = size + len(m), n + 1
                if size >= config.file_bytes:
                    out.close()
                    out = done.append((name, size, n))
        if out is not None:
            out.close()
            done.append((name, size, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "records"])

    plan_captures(pages, config).mapInArrow(write, "file string, bytes long, records long").write.parquet(f"{path}/manifest")


# ------------------------------------------------------------ reading

_TEXT = ["warc_type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "fields"]
RECORD_TYPE = ", ".join(f"{c} string" for c in _TEXT) + ", http_status int, payload_bytes long, payload binary"


def record_row(head: dict[str, list[str]], block: bytes, payloads: bool) -> tuple:
    """A record as a row. Payload size and digest are those of the bytes read, or, for a
    revisit, what its headers say of the payload it refers to."""
    kind = head.get("warc-type", [""])[0].lower()
    status = size = digest = fields = None
    payload = block
    if kind in ("response", "request", "revisit") and "http" in head.get("content-type", [""])[0]:
        line, http, payload = _http(block)
        parts = line.split(" ", 2)
        status = int(parts[1]) if kind != "request" and len(parts) > 1 and parts[1].isdigit() else None
        size = len(payload)
        if kind == "revisit":
            said = http.get("content-length", [""])[0]
            size, digest = int(said) if said.isdigit() else None, _hex_digest(head.get("warc-payload-digest", [None])[0])
    elif kind in ("metadata", "warcinfo"):
        fields = block.decode("utf-8", "replace")
    if kind in ("response", "resource"):
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    get = lambda k: head.get(k, [None])[0]
    return (kind, _bare(head.get("warc-record-id")), " ".join(x.strip("<> ") for x in head.get("warc-concurrent-to", [])) or None, _bare(head.get("warc-refers-to")), get("warc-target-uri"), get("warc-date"), digest, fields, status, size, payload if payloads and kind in ("response", "resource") else None)


def read_paths(spark: SparkSession, files: DataFrame, payloads: bool = True) -> DataFrame:
    """One row a record of the archives whose full paths are in the first column of ``files``."""
    types = [pa.string()] * 8 + [pa.int32(), pa.int64(), pa.binary()]
    names = [*_TEXT, "http_status", "payload_bytes", "payload"]
    batch = lambda buf: pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*buf, strict=True), types, strict=True)], names)

    def rows(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                buf, held, last = [], 0, ""
                try:
                    fs, path = open_fs(name)
                    with fs.open_input_stream(path, compression=None) as f:
                        for head, block in parse(f):
                            buf.append(record_row(head, block, payloads))
                            last, held = buf[-1][1], held + (len(block) if payloads else 0)
                            if len(buf) >= 5000 or held > 16 << 20:
                                yield batch(buf)
                                buf, held = [], 0
                except FileNotFoundError:
                    raise  # lost, not damaged: the task must fail
                except (ValueError, zlib.error, EOFError) as e:
                    buf.append(("error", None, None, None, name, None, None, f"after {last}: {e}", None, None, None))
                if buf:
                    yield batch(buf)

    return files.repartition(max(1, min(10_000, files.count()))).mapInArrow(rows, RECORD_TYPE)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of the archives that the manifest names."""
    files = spark.read.parquet(f"{path}/manifest")
    return read_paths(spark, files.select(F.concat(F.lit(f"{path.rstrip('/')}/"), "file").alias("file")), payloads)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: response (or revisit, resource), its request and its metadata.

    Requests and metadata name their captures by WARC-Concurrent-To, or are named so by them; metadata may
    also name the request. A record that names several captures is shown with each. Of several requests or metadata records, and of
    answers with one id, the least record is shown and all are counted.
    """
    names = F.split(F.coalesce("concurrent_to", F.lit("")), " ")
    slim = records.where(F.col("warc_type").isin("request", "metadata")).select("warc_type", F.struct("record_id", "target_uri", "date", "fields").alias("shown"), "record_id", F.filter(names, lambda x: x != "").alias("refs"))
    answers = records.where(F.col("warc_type").isin("response", "revisit", "resource"))
    ids = answers.select(F.col("record_id").alias("target"), F.col("record_id").alias("capture")).distinct()
    said = answers.where("concurrent_to IS NOT NULL").select(F.explode(F.filter(names, lambda x: x != "")).alias("target"), F.col("record_id").alias("capture"))
    known = ids.unionByName(said).distinct()

    def placed(kind: str, known: DataFrame) -> DataFrame:
        """(record_id, shown, capture) of the records of a kind; one whose captures are unknown goes by the least id it names, or its own."""
        each = slim.where(F.col("warc_type") == kind).select("record_id", "shown", F.explode(F.array_distinct(F.concat("refs", F.array("record_id")))).alias("target"), F.array_min("refs").alias("least"))
        met = each.join(known, "target", "left").groupBy("record_id", "shown").agg(F.collect_set("capture").alias("captures"), F.min("least").alias("least"))
        return met.select("record_id", "shown", F.explode(F.when(F.size("captures") > 0, F.col("captures")).otherwise(F.array(F.coalesce("least", "record_id")))).alias("capture"))

    requests = placed("request", known)
    metadata = placed("metadata", known.unionByName(requests.select(F.col("record_id").alias("target"), "capture")).distinct())
    answer = F.struct("record_id", "warc_type", "target_uri", "date", "refers_to", "http_status", "payload_digest", "payload_bytes", "payload")
    kinds = {"response": answers.select(F.col("record_id").alias("capture"), answer.alias("response")), "request": requests.select("capture", F.col("shown").alias("request")), "metadata": metadata.select("capture", F.col("shown").alias("metadata"))}
    rows = kinds["response"].unionByName(kinds["request"], True).unionByName(kinds["metadata"], True)
    counted = [F.count(k).alias(f"n_{k}s" if k != "metadata" else "n_metadata") for k in ("request", "metadata")]
    return rows.groupBy("capture").agg(*[F.min(k).alias(k) for k in ("request", "response", "metadata")], *counted)


def archive_pages(pages: DataFrame, config: WarcConfig = WarcConfig(), payloads: bool = False) -> DataFrame:
    """Write pages as archives, read them back and assemble: page_id, the capture and refers_to
    (the page_id of the response that a revisit names)."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, config)
    # One parse of the archives: the record rows without payloads are small and read several times.
    records = read_archives(spark, path, payloads)
    records.write.option("compression", "zstd").parquet(f"{path}/records")
    page = F.regexp_extract("metadata.fields", r"(?m)^page-id: *(-?\d+)\r?$", 1)
    captures = materialise(assemble(spark.read.parquet(f"{path}/records")).withColumn("page_id", F.nullif(page, F.lit("")).cast("long")), "transactions")
    # A response that many revisits name is met by id: few names, so broadcast, or dealt with hot ones apart.
    named = captures.where("response.refers_to IS NOT NULL").groupBy(F.col("response.refers_to").alias("__c")).agg(F.count("*").alias("__n"))
    heads = named.join(captures.where("response.warc_type = 'response'").select(F.col("capture").alias("__c"), F.col("page_id").alias("refers_to")), "__c")
    rows = captures.withColumn("__c", F.coalesce("response.refers_to", F.concat(F.lit("none "), "capture")))
    return join_hot(rows, materialise(heads, "heads"), "__c", "__n", captures.count(), "left").drop("__c", "__n")
