"""Sources: raw files with charset decoding, a guarded fetch data source, request lines, settings."""

from __future__ import annotations

import functools
import json
import os
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import web as W
from ..operators.pages import blocked_ip, convert_pages
from .transport import USER_AGENT, Tls, opener, transient, truth

#: Python codecs that decode as the web platform does.
CODECS = {"Shift_JIS": "cp932", "GBK": "gb18030", "gb18030": "gb18030", "Big5": "big5hkscs", "EUC-KR": "cp949", "EUC-JP": "euc_jp", "ISO-2022-JP": "iso2022_jp", "UTF-16LE": "utf_16_le", "UTF-16BE": "utf_16_be", "macintosh": "mac_roman", "windows-874": "cp874", "IBM866": "cp866", "KOI8-R": "koi8_r", "KOI8-U": "koi8_u", "ISO-8859-8-I": "iso8859_8", "x-mac-cyrillic": "mac_cyrillic", "UTF-8": "utf-8"}


@functools.cache
def _single_bytes(codec: str) -> dict[int, str]:
    return {b: bytes((b,)).decode(codec, "ignore") or chr(b) for b in range(128, 256)}


def decode_bytes(raw: bytes, label: str | None) -> tuple[str, str | None]:
    """Text, and the label if no decoder is known for it."""
    t = (label or "").strip().strip('"')
    if t.lower() in W.UTF8_LABELS:
        return raw.decode("utf-8", "replace"), None
    name = W.charset_names().get(t.lower())
    if name is None:
        return raw.decode("utf-8", "replace"), t
    for bom, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf_16_le"), (b"\xfe\xff", "utf_16_be")):
        if raw.startswith(bom):
            return raw[len(bom) :].decode(codec, "replace"), None
    if name == "x-user-defined":  # ASCII, and the upper half in a private range
        return "".join(chr(b if b < 128 else 0xF780 + b - 128) for b in raw), None
    if name == "replacement":  # encodings that are never decoded: one sign for any content
        return "\ufffd" if raw else "", None
    codec = CODECS.get(name) or name.lower().replace("windows-", "cp").replace("iso-", "iso")
    if codec.startswith("cp125"):  # bytes without a character stand for themselves
        return raw.decode("latin-1").translate(_single_bytes(codec)), None
    return raw.decode(codec, "replace"), None


def header_charset(header: str | None) -> str | None:
    """``charset_header`` of one header."""
    for part in (header or "").split(";"):
        m = re.match(r"(?i)\s*charset=(.*)$", part)
        if m and m[1].replace('"', "").strip(" "):
            return m[1].replace('"', "").strip(" ")
    return None


def sniffed_charset(raw: bytes) -> str | None:
    """``charset_meta`` of one body."""
    _, found, rest = raw[:2048].decode("utf-8", "replace").lower().partition("charset")
    m = re.match(r"\s*=\s*[\"']*([a-z0-9_-]+)", rest) if found else None
    return m[1] if m else None


def charset_decode(raw: Column, label: Column) -> Column:
    """struct(text, undecodable); null bytes give null. UTF-8 and unknown labels stay in built-in expressions."""

    def column(raw: pa.Array, label: pa.Array) -> pa.Array:
        return pa.array([None if r is None else decode_bytes(r, x)[0] for r, x in zip(raw.to_pylist(), label.to_pylist(), strict=True)], pa.string())

    named = W.charset_classify(F.coalesce(label, F.lit("")))
    other = named["kind"] == "supported"
    text = F.when(other, F.arrow_udf(column, "string").asNondeterministic()(F.when(other, raw), label)).otherwise(F.make_valid_utf8(raw.cast("string")))
    return F.when(raw.isNotNull(), F.struct(text.alias("text"), F.when(named["kind"] == "unknown", named["label"]).alias("undecodable")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, body, undecodable of whole raw files: the label comes from the bytes alone."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("raw"))
    return files.withColumn("d", charset_decode(F.col("raw"), W.charset_meta(F.col("raw")))).select("path", F.col("d.text").alias("body"), F.col("d.undecodable").alias("undecodable"))


def request_lines(lines: DataFrame, col: str = "value", most: int = 8 * 1024 * 1024) -> DataFrame:
    """id, id_json (as it was written), method, params of the lines that are requests: blank, oversized, malformed and id-less lines go."""
    text = F.col(col)
    parsed = lines.where((F.trim(text) != "") & (F.octet_length(text) <= most)).withColumn("__v", F.try_parse_json(text))
    ident = F.get_json_object(text, "$.id")
    given = F.try_variant_get("__v", "$.id", "variant")  # an id of JSON null is an id
    rows = parsed.where(F.col("__v").isNotNull() & given.isNotNull())
    literal = F.to_json(given)
    return rows.select(ident.alias("id"), literal.alias("id_json"), F.coalesce(F.get_json_object(text, "$.method"), F.lit("")).alias("method"), F.get_json_object(text, "$.params").alias("params"))


# ------------------------------------------------------------ fetch


def vet(url: str, allow_private: bool = False) -> tuple[str | None, list[str]]:
    """Why a URL may not be fetched, or None, and the addresses that its name was found to have.
    Every address must be public; connections go to these, so that a second lookup can't differ."""
    import socket
    from urllib.parse import urlsplit

    try:
        u = urlsplit(url)
        port = u.port
    except ValueError as e:
        return f"blocked URL: {e}", []
    if u.scheme.lower() not in ("http", "https"):
        return f"blocked URL: scheme `{u.scheme}` not allowed", []
    if port in W.BLOCKED_PORTS:
        return f"blocked URL: port {port} is not an HTTP service and is not fetchable", []
    if allow_private:
        return None, []
    host = (u.hostname or "").lower()
    if not host:
        return f"blocked URL: no host in {url}", []
    literal = blocked_ip(host)
    if literal is not None:
        return (f"blocked URL: host IP {host} is not public" if literal else None), []
    if host == "localhost" or host.endswith(".localhost"):
        return f"blocked URL: host `{host}` is local", []
    try:
        found = {a[4][0] for a in socket.getaddrinfo(host, port or (443 if u.scheme == "https" else 80), type=socket.SOCK_STREAM)}
    except OSError as e:
        return f"blocked URL: cannot resolve `{host}`: {e}", []
    why = next((f"blocked URL: `{host}` resolves to {a}, which is not public" for a in sorted(found) if blocked_ip(a.split("%")[0])), None)
    return why, sorted(found)


def guard(url: str, allow_private: bool = False) -> str | None:
    """Why a URL may not be fetched, or None."""
    return vet(url, allow_private)[0]


def fetch_one(url: str, timeout: float = 10, allow_private: bool = False, redirects: int = 5, tries: int = 3, tls: Tls = Tls()) -> dict:
    """One page as a row; errors are a column, not an exception. Redirects are followed by hand
    so that each hop passes the guard; transient failures are tried again within the deadline."""
    import time
    import urllib.error
    import urllib.request
    from urllib.parse import urljoin

    until, at = time.monotonic() + 3 * timeout, url
    fail = lambda e: {"url": url, "final_url": at, "content_type": None, "body": None, "error": e}
    for _ in range(redirects + 1):
        why, found = vet(at, allow_private)
        if why:
            return fail(why)
        try:
            client = opener(tls, found)
        except OSError as e:
            return fail(str(e))
        for k in range(tries):
            if time.monotonic() > until:
                return fail("total time budget exceeded")
            try:
                with client.open(urllib.request.Request(at, headers={"User-Agent": USER_AGENT, "Accept": "text/html,application/xhtml+xml,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9"}), timeout=timeout) as r:
                    raw = r.read(W.BODY_CAP)
                    return {"url": url, "final_url": at, "content_type": r.headers.get("Content-Type"), "body": raw, "error": None}
            except urllib.error.HTTPError as e:
                if 300 <= e.code < 400:
                    to = e.headers.get("Location")
                    if not to:
                        return fail(f"redirect {e.code} without a location")
                    at = urljoin(at, to)
                    break
                if not transient(e.code) or k == tries - 1:
                    return fail(f"HTTP {e.code}")
            except OSError as e:
                if k == tries - 1:
                    return fail(str(e))
            time.sleep(0.2 * 2**k)
    return fail("too many redirects")


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class FetchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.timeout, self.size = float(options.get("timeout_secs", 10)), int(options.get("batch", 16))
        self.private = truth(options.get("allow_private"))
        self.tls = Tls.of(options)

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[k : k + self.size]) for k in range(0, len(self.urls), self.size)]

    def read(self, partition):
        for u in partition.urls:
            r = fetch_one(u, self.timeout, self.private, tls=self.tls)
            yield r["url"], r["final_url"], r["content_type"], r["body"], r["error"]


class FetchSource(DataSource):
    """``spark.read.format("fetch").option("urls", json list)``; register with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return "url string, final_url string, content_type string, body binary, error string"

    def reader(self, schema) -> FetchReader:
        return FetchReader(self.options)


def fetch_pages(spark: SparkSession, urls: list[str], output: str = "text", max_tokens: int | None = None, **options: str) -> DataFrame:
    """Fetched and converted pages: source, error, undecodable and the columns of ``convert_pages``.
    The label of the header outranks the one in the bytes. Options: those of the fetch source."""
    spark.dataSource.register(FetchSource)
    raw = spark.read.format("fetch").options(urls=json.dumps(urls), **options).load()
    label = F.coalesce(W.charset_header(F.col("content_type")), W.charset_meta(F.col("body")))
    read = raw.withColumn("__d", charset_decode(F.col("body"), label))
    read = read.select(F.col("url").alias("source"), "error", F.col("final_url").alias("__at"), F.col("content_type").alias("__type"), F.col("__d.text").alias("__text"), F.col("__d.undecodable").alias("undecodable"))
    return convert_pages(read, "__text", "__at", "__type", output, max_tokens).drop("__at", "__type", "__text")


# ------------------------------------------------------------ settings


@dataclass
class Provider:
    name: str = "duckduckgo"
    api_key: str | None = None
    base_url: str | None = None

    def __repr__(self) -> str:
        return f"Provider(name={self.name!r}, api_key={'***' if self.api_key else None}, base_url={self.base_url!r})"


@dataclass
class Settings:
    timeout_secs: int = 10
    max_tokens: int | None = None
    ca_certs: list[str] = field(default_factory=list)
    provider: str | None = None
    fallback: str | None = None
    providers: dict = field(default_factory=dict)


def load_settings(path: str | None = None) -> tuple[Settings, str | None]:
    """Settings and a warning that names a place in the file but never its contents."""
    path = path or os.environ.get("THRESHER_CONFIG") or os.path.expanduser("~/.thresher/settings.json")
    try:
        with open(path, encoding="utf-8") as f:
            tree = json.load(f).get("thresher", {})
    except FileNotFoundError:
        return Settings(), None
    except json.JSONDecodeError as e:
        return Settings(), f"{path}: malformed settings at line {e.lineno} column {e.colno}"
    s, f_ = tree.get("search", {}), tree.get("fetch", {})
    return Settings(f_.get("timeout_secs", 10), f_.get("max_tokens"), f_.get("ca_certs", []), s.get("provider"), s.get("fallback"), s.get("providers", {})), None


def _env(name: str) -> str | None:
    value = os.environ.get(name, "")
    return value if value.strip() else None


def provider_for(name: str, settings: Settings) -> Provider:
    """A usable provider; raises if its key or address is missing. The environment outranks the file."""
    known = W.PROVIDERS.get(name.strip().lower())
    if known is None:
        raise ValueError(f"unknown search provider `{name}`")
    own = settings.providers.get(known) or {}
    if known == "duckduckgo":
        return Provider()
    key = _env(f"THRESHER_{known.upper()}_API_KEY") or (_env(f"{known.upper()}_API_KEY") if known != "searxng" else None) or own.get("api_key")
    if known in ("brave", "tavily"):
        if not key:
            raise ValueError(f"provider `{known}` needs an API key")
        return Provider(known, key)
    base = _env("THRESHER_SEARXNG_URL") or own.get("base_url")
    if not base:
        raise ValueError("provider `searxng` needs a base_url")
    return Provider(known, key, base)


def primary_provider(settings: Settings, flag: str | None = None) -> Provider:
    """The provider by flag, environment, settings, or the one without a key; an unusable one raises."""
    return provider_for(flag or _env("THRESHER_SEARCH_PROVIDER") or settings.provider or "duckduckgo", settings)


def fallback_provider(settings: Settings, primary: Provider) -> tuple[Provider | None, str | None]:
    """The fallback and a warning: an unusable one is left out, and so are ``none``, unknown names and the primary."""
    asked = _env("THRESHER_SEARCH_FALLBACK") or settings.fallback or "none"
    name = W.PROVIDERS.get(asked.strip().lower())
    if name is None or name == primary.name:
        return None, None
    try:
        return provider_for(name, settings), None
    except ValueError as e:
        return None, f"ignoring search fallback: {e}"
