"""Queries of the web-content operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..operators import dom, pages, search
from ..sources import readers
from ..streaming import rpc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


# ------------------------------------------------------------ shared inputs

#: Text with glyphs, links and markers, made alike by both engines.
MARKED = "concat('▶ ', text, ' [', doc_id % 7, ']  \t[', doc_id % 3, '] https://h.example/', doc_id, '?a=b&c=%20~d •\n\n\n x ')"
WS = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SQ = lambda s: "'" + s.replace("'", "''") + "'"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr(MARKED).alias("t"))


def _compress(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[{T.DECORATIVE}]', '', 'g'), '{WS}+', ' ', 'g'))"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _block(x: str) -> str:
    return _trim(f"regexp_replace(array_to_string(list_transform(string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10)), lambda l: {_compress('l')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _cost(x: str) -> str:
    return f"(strlen({x}) + 2 * (strlen({x}) - strlen(translate({x}, '{T.COSTLY}', ''))))"


_DOCS = f"WITH m AS (SELECT doc_id, {MARKED} AS t FROM documents) "

# ------------------------------------------------------------ text and budget


@query(_DOCS + f"SELECT doc_id, {_compress('t')} AS c FROM m")
def compress_text(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.compress_text(F.col("t")).alias("c"))


@query(_DOCS + f"SELECT doc_id, {_block('t')} AS c FROM m")
def compress_block(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.compress_block(F.col("t")).alias("c"))


@query(_DOCS + f"SELECT doc_id, {_cost('t')}::BIGINT AS cost FROM m")
def token_cost(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.token_cost(F.col("t")).alias("cost"))


@query(_DOCS + f"SELECT doc_id, ({_cost('t')} // 4)::BIGINT AS tokens FROM m")
def token_estimate(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.token_estimate(F.col("t")).alias("tokens"))


@query(
    _DOCS
    + f""", s AS (SELECT doc_id, concat('https://h.example/?', t) AS t FROM m),
w AS (SELECT doc_id, t, {_cost('t')} AS full_cost, list_transform(generate_series(1, least(length(t), 400)), lambda n: {_cost('substr(t, 1, n)')}) AS costs FROM s)
SELECT doc_id, CASE WHEN full_cost // 4 <= 50 THEN t ELSE substr(t, 1, len(list_filter(costs, lambda c: c <= 185))) || chr(10) || '…[truncated]' END AS c FROM w"""
)
def truncate_tokens(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.truncate_tokens(F.concat(F.lit("https://h.example/?"), F.col("t")), 50).alias("c"))


@query(_DOCS + r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '\[([0-9]+)\]', 1), lambda x: x::BIGINT))), ',') AS refs FROM m")
def cited(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", F.array_join(T.cited(F.col("t")).cast("array<string>"), ",").alias("refs"))


@query("SELECT n_regionkey::BIGINT AS k, 'Body' || chr(10) || chr(10) || 'References:' || chr(10) || string_agg('[' || n_nationkey || '] https://n.example/' || n_name, chr(10) ORDER BY n_nationkey) AS block FROM nation GROUP BY 1")
def ref_block(spark, sf_dir):
    ref = F.struct(F.col("n_nationkey").cast("bigint").alias("index"), F.concat(F.lit("https://n.example/"), "n_name").alias("url"))
    refs = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("k")).agg(F.array_sort(F.collect_list(ref)).alias("r"))
    return refs.select("k", T.assemble(F.lit("Body"), T.ref_block(F.col("r"))).alias("block"))


_REFS = "sequence(1, 5)"


@query(_DOCS + "SELECT doc_id, array_to_string(list_filter([1, 2, 3, 4, 5], lambda i: contains(t, '[' || i || ']')), ',') AS kept FROM m")
def ref_semi(spark, sf_dir):
    refs = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(i.alias("index"), F.concat(F.lit("u"), i.cast("string")).alias("url")))
    return marked(spark, sf_dir).select("doc_id", F.array_join(F.transform(T.refs_cited(refs, F.col("t")), lambda r: r["index"].cast("string")), ",").alias("kept"))


@query(_DOCS + "SELECT doc_id, array_to_string(list_filter([0, 1, 2, 3], lambda i: contains(t, 'https://h.example/' || i)), ',') AS kept FROM m")
def ref_contains(spark, sf_dir):
    refs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("index"), F.concat(F.lit("https://h.example/"), i.cast("string")).alias("url")))
    return marked(spark, sf_dir).select("doc_id", F.array_join(F.transform(T.refs_contained(refs, F.col("t")), lambda r: r["index"].cast("string")), ",").alias("kept"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE ltrim(substr('Title ▶ x' || chr(10) || chr(10) || text, 10), chr(10)) END AS body FROM documents")
def title_dedup(spark, sf_dir):
    odd = F.col("doc_id") % 2 != 0
    body = F.when(odd, F.concat(F.lit("Title ▶ x\n\n"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.title_dedup(body, F.when(odd, "Title x").otherwise("")).alias("body"))


@query(_DOCS + f"SELECT doc_id, {_trim('t')} AS c FROM m")
def text_pass(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.trim_space(F.col("t")).alias("c"))


# ------------------------------------------------------------ media, charset, status

_CT = "CASE doc_id % 7 WHEN 0 THEN 'Text/HTML; charset=x' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/markdown' WHEN 3 THEN ' Image/PNG ;q=1' WHEN 4 THEN '' ELSE NULL END"
_BODY = "CASE doc_id % 5 WHEN 0 THEN concat(' <p>', text) WHEN 1 THEN concat('{\"a\": ', doc_id, '}') WHEN 2 THEN concat('{', text) WHEN 3 THEN '' ELSE text END"
_MEDIA = "CASE WHEN e LIKE '%html%' THEN 'html' WHEN e LIKE '%json%' THEN 'json' WHEN starts_with(e, 'text/') THEN 'text' WHEN e <> '' THEN e WHEN starts_with(ltrim(b), '<') THEN 'html' WHEN left(ltrim(b), 1) IN ('{', '[') AND json_valid(b) THEN 'json' ELSE 'text' END"


@query(f"WITH x AS (SELECT doc_id, lower(trim(split_part(coalesce({_CT}, ''), ';', 1))) AS e, {_BODY} AS b FROM documents) SELECT doc_id, {_MEDIA} AS media FROM x")
def media_classify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.media_type(F.expr(_CT), F.expr(_BODY)).alias("media"))


@query("SELECT doc_id, '[non-text content: image/png, ' || strlen(text) || ' bytes — not rendered]' AS c FROM documents")
def binary_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.binary_summary(F.lit("image/png"), F.col("text")).alias("c"))


_HEAD = "CASE doc_id % 6 WHEN 0 THEN 'text/html; charset=UTF-8' WHEN 1 THEN 'text/html;CHARSET=\"Shift_JIS\"' WHEN 2 THEN 'text/html; charset=' WHEN 3 THEN 'text/html; x=y; charset= gbk ' WHEN 4 THEN 'text/html' ELSE NULL END"


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'Shift_JIS' WHEN 3 THEN 'gbk' END AS label FROM documents")
def charset_header(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.charset_header(F.expr(_HEAD)).alias("label"))


@query(r"SELECT page_id, nullif(regexp_extract(lower(substr(html, 1, 200)), 'charset\s*=\s*[\x22\x27]*([a-z0-9_-]+)', 1), '') AS label FROM pages")
def charset_meta(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.charset_meta(F.col("html").cast("binary")).alias("label"))


_LABELS = {" UTF8 ": ("utf8", "UTF-8"), "latin1": ("supported", "windows-1252"), "SJIS": ("supported", "Shift_JIS"), "x-gbk": ("supported", "GBK"), "korean": ("supported", "EUC-KR"), "iso-2022-jp": ("supported", "ISO-2022-JP"), "windows-949": ("supported", "EUC-KR"), "nope": ("unknown", "nope")}
_LABEL = "CASE n_nationkey % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_LABELS)) + " END"


@query("SELECT n_nationkey, " + ", ".join("CASE n_nationkey % 8 " + " ".join(f"WHEN {k} THEN '{v[i]}'" for k, v in enumerate(_LABELS.values())) + f" END AS {name}" for i, name in enumerate(("kind", "label"))) + " FROM nation")
def charset_classify(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", W.charset_classify(F.expr(_LABEL)).alias("c")).select("n_nationkey", "c.kind", "c.label")


@query(r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[^\x00-\x7F]', 'é', 'g') ELSE text END AS text, NULL::VARCHAR AS undecodable FROM documents")
def charset_decode(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", "é"), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    label = F.when(F.col("doc_id") % 2 == 0, "latin1").otherwise("utf-8")
    return table(spark, sf_dir, "documents").select("doc_id", readers.charset_decode(raw, label).alias("d")).select("doc_id", "d.text", "d.undecodable")


@query("SELECT page_id, contains(lower(html), '<script') AS has_scripts FROM pages")
def has_scripts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.has_scripts(F.col("html")).alias("has_scripts"))


_CONTENT = "CASE page_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '{\"blocks\": [], \"references\": []}' ELSE html END"
_SHELL = "CASE page_id % 2 WHEN 0 THEN html ELSE '<p></p>' END"


@query(f"WITH x AS (SELECT page_id, {_CONTENT} AS c, {_SHELL} AS h FROM pages) SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'ok' WHEN contains(lower(h), '<script') THEN 'needs_js' ELSE 'empty' END AS status FROM x")
def content_status(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.content_status(F.lit("html"), F.expr(_CONTENT), F.expr(_SHELL), F.lit(True)).alias("status"))


@query("SELECT k, s AS status, s <> 'ok' AS is_failure, CASE s WHEN 'empty' THEN 'the page parsed but contains no text' WHEN 'needs_js' THEN 'no text content: the page renders its body with JavaScript, which is not executed here' WHEN 'too_complex' THEN 'the document is too deeply nested to parse safely and was refused' END AS note FROM (SELECT n_nationkey AS k, ['ok', 'empty', 'needs_js', 'too_complex'][n_nationkey % 4 + 1] AS s FROM nation)")
def status_flags(spark, sf_dir):
    s = F.element_at(F.array(*[F.lit(x) for x in ("ok", "empty", "needs_js", "too_complex")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), s.alias("status")).select("k", "status", (F.col("status") != "ok").alias("is_failure"), W.status_note(F.col("status")).alias("note"))


@query("SELECT event_id, (event_id % 600) BETWEEN 500 AND 599 OR event_id % 600 = 429 AS transient FROM events")
def retry_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", W.retry_class(F.col("event_id") % 600).alias("transient"))


@query("SELECT page_id, least(strlen(html), 1000)::BIGINT AS n, sha256(from_hex(left(hex(encode(html)), 2000))) AS h FROM pages")
def body_cap(spark, sf_dir):
    kept = W.body_cap(F.col("html").cast("binary"), 1000)
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(kept).cast("bigint").alias("n"), F.sha2(kept, 256).alias("h"))


#: Pages whose comments, declarations and tags hide in one another, and their depths.
_DEEP = [('<a title="<!--"><div><div>', 3), ("<!-- <div> --><p>", 1), ("<div><!-- > <div>", 1), ("<!doctype html><div><br><img/><p/></div>", 1), ("</div></div><div>", 0), ("<?x <div> ?><b><i>", 2), ("<div <span>x", 1), ("<div><div", 1), ("", 0)]
_DEEP_ROWS = ", ".join(f"({-k - 1}, {d})" for k, (_, d) in enumerate(_DEEP))
_TAGS = r"regexp_extract_all(regexp_replace(regexp_replace(html, '<!--(?s:.*?)-->', '', 'g'), '<[!?][^>]*>', '', 'g'), '</?[A-Za-z0-9]+[^>]*>')"
_MOVES = "list_transform(" + _TAGS + f", lambda t: CASE WHEN starts_with(t, '</') THEN -1 WHEN ends_with(t, '/>') OR regexp_matches(lower(t), '^<({'|'.join(W.VOID)})\\b') THEN 0 ELSE 1 END)"


@query(f"WITH m AS (SELECT page_id, {_MOVES} AS mv FROM pages), u AS (SELECT page_id, unnest(mv) AS d, generate_subscripts(mv, 1) AS i FROM m), r AS (SELECT page_id, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS s FROM u) SELECT page_id, greatest(max(s), 0)::INT AS depth FROM r GROUP BY 1 UNION ALL SELECT k::BIGINT, d FROM (VALUES {_DEEP_ROWS}) AS v(k, d)")
def nesting_depth(spark, sf_dir):
    made = spark.createDataFrame([(-k - 1, h) for k, (h, _) in enumerate(_DEEP)], "page_id long, html string")
    return table(spark, sf_dir, "pages").select("page_id", "html").unionByName(made).select("page_id", W.nesting_depth(F.col("html")).alias("depth"))


# ------------------------------------------------------------ guard

_URL = "CASE event_id % 8 WHEN 0 THEN concat('http://10.0.', event_id % 256, '.1/a') WHEN 1 THEN concat('https://h.example:', event_id % 12000, '/x') WHEN 2 THEN 'ftp://h.example/' WHEN 3 THEN concat('HTTP://8.8.', event_id % 256, '.8:8080/?q') WHEN 4 THEN 'http://Localhost/' WHEN 5 THEN 'http://a.localhost:3306/' WHEN 6 THEN concat('https://172.', event_id % 64, '.0.1') ELSE 'javascript:alert(1)' END"
_EV = f"WITH u AS (SELECT event_id, {_URL} AS u FROM events) "


def urls(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(_URL).alias("u"))


@query(_EV + "SELECT event_id, lower(regexp_extract(u, '^([A-Za-z]+):', 1)) IN ('http', 'https') AS ok FROM u")
def guard_scheme(spark, sf_dir):
    return urls(spark, sf_dir).select("event_id", W.guard_scheme(F.col("u")).alias("ok"))


@query(_EV + f"SELECT event_id, coalesce(try_cast(regexp_extract(u, '//[^/:]*:([0-9]+)', 1) AS INT) NOT IN ({', '.join(map(str, W.BLOCKED_PORTS))}), true) AS ok FROM u")
def guard_port(spark, sf_dir):
    return urls(spark, sf_dir).select("event_id", W.guard_port(F.col("u")).alias("ok"))


@query(_EV + r", h AS (SELECT event_id, lower(regexp_extract(u, '//([^/:?]*)', 1)) AS h FROM u) SELECT event_id, CASE WHEN NOT regexp_matches(h, '^\d+\.\d+\.\d+\.\d+$') THEN NULL WHEN starts_with(h, '10.') THEN true WHEN starts_with(h, '172.') THEN split_part(h, '.', 2)::INT BETWEEN 16 AND 31 ELSE false END AS blocked FROM h")
def guard_ipv4(spark, sf_dir):
    return urls(spark, sf_dir).select("event_id", W.guard_ipv4(W.url_host(F.col("u"))).alias("blocked"))


@query(_EV + ", h AS (SELECT event_id, lower(regexp_extract(u, '//([^/:?]*)', 1)) AS h FROM u) SELECT event_id, h = 'localhost' OR ends_with(h, '.localhost') AS local FROM h")
def guard_localname(spark, sf_dir):
    return urls(spark, sf_dir).select("event_id", W.guard_localname(W.url_host(F.col("u"))).alias("local"))


#: IPv6 literals, and whether each is refused.
_SIX = {"::1": 1, "::": 1, "ff02::1": 1, "fe80::1": 1, "fc00::1": 1, "2001:db8::1": 1, "2606:4700::1111": 0, "64:ff9b::a00:1": 1, "64:ff9b::808:808": 0, "2002:a00:1::": 1, "::ffff:10.0.0.1": 1, "::ffff:8.8.8.8": 0}


@query(f"SELECT n_nationkey, host, blocked = 1 AS blocked FROM nation JOIN (VALUES {', '.join(f'({k}, {_SQ(h)}, {b})' for k, (h, b) in enumerate(_SIX.items()))}) AS v(k, host, blocked) ON n_nationkey % {len(_SIX)} = k")
def guard_ipv6(spark, sf_dir):
    pick = F.element_at(F.array(*[F.lit(h) for h in _SIX]), (F.col("n_nationkey") % len(_SIX) + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", pick.alias("host")).withColumn("blocked", pages.guard_ip(F.col("host")))


#: Literal hosts in every form that reads as an address, with why each URL is refused ('' where it is not).
_HOSTS = [
    ("http://[::1]/", "address"), ("http://[::ffff:10.0.0.1]/", "address"), ("http://[fe80::1]:8080/", "address"), ("http://[2606:4700::1111]/", ""), ("http://[64:ff9b::a00:1]/", "address"),
    ("http://2130706433/", "address"), ("http://0x7f.1/", "address"), ("http://127.1", "address"), ("http://0177.0.0.1/", "address"), ("http://0x7f000001/", "address"), ("http://%31%32%37.0.0.1/", "address"),
    ("http://127.0.0.1./", "address"), ("http://134744072/", ""), ("http://8.8.8.8/", ""), ("http://user:pw@10.0.0.1/", "address"), ("http://LOCALHOST./", "local name"), ("https://a.b.localhost", "local name"),
    ("https://example.org:22/", "port"), ("gopher://example.org/", "scheme"), ("https://example.org/", ""), ("http://256.1.1.1.1/", ""), ("http://[::1]:25/", "port"), ("http://1.2.3/", ""), ("http://0/", "address"),
]
_HOST_ROWS = ", ".join(f"({-k - 1}, {_SQ(u)}, {_SQ(why)})" for k, (u, why) in enumerate(_HOSTS))


@query(f"SELECT event_id, {_URL} AS u, CASE WHEN event_id % 8 IN (2, 7) THEN 'scheme' WHEN event_id % 8 = 1 AND event_id % 12000 IN ({', '.join(map(str, W.BLOCKED_PORTS))}) THEN 'port' WHEN event_id % 8 = 5 THEN 'port' WHEN event_id % 8 = 0 THEN 'address' WHEN event_id % 8 = 6 AND event_id % 64 BETWEEN 16 AND 31 THEN 'address' WHEN event_id % 8 = 4 THEN 'local name' END AS block_reason FROM events UNION ALL SELECT k::BIGINT, u, nullif(why, '') FROM (VALUES {_HOST_ROWS}) AS v(k, u, why)")
def guard_url(spark, sf_dir):
    """Why each URL is refused before any name is looked up; null where it is not."""
    literal = spark.createDataFrame([(-k - 1, u) for k, (u, _) in enumerate(_HOSTS)], "event_id long, u string")
    u = urls(spark, sf_dir).unionByName(literal)
    return u.withColumn("block_reason", pages.guard_url(F.col("u")))


# ------------------------------------------------------------ pages

_ENT = "replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&middot;', '·'), '&amp;', '&'), '&amp', '&')"
_PAGE = r"""WITH a AS (SELECT page_id, html, regexp_extract(html, '<title>((?s:.*?))</title>', 1) AS rt, regexp_extract(html, '<article>((?s:.*?))</article>', 1) AS art FROM pages),
b AS (SELECT page_id, """ + _trim(_ENT.format(x="rt")) + " AS title, art FROM a)"
_TEXT = r"regexp_replace(replace(regexp_replace(art, '</?b>', '', 'g'), '<br>', chr(10)), '\n?(</?(p|h1)>)+', chr(10), 'g')"


@query(_PAGE + ", t AS (SELECT page_id, title, " + _block(_ENT.format(x=_TEXT)) + " AS body FROM b) SELECT page_id, title, CASE WHEN " + _compress("split_part(body, chr(10), 1)") + " = " + _compress("title") + " THEN ltrim(substr(body, length(split_part(body, chr(10), 1)) + 1), chr(10)) ELSE body END AS content FROM t")
def text_convert(spark, sf_dir):
    return pages.convert_pages(table(spark, sf_dir, "pages")).select("page_id", "title", "content")


@query(_PAGE + " SELECT page_id, title FROM b")
def page_title(spark, sf_dir):
    return pages.convert_pages(table(spark, sf_dir, "pages")).select("page_id", "title")


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_lang(spark, sf_dir):
    return pages.convert_pages(table(spark, sf_dir, "pages")).select("page_id", F.col("metadata.lang").alias("lang"))


_MD = r"replace(regexp_replace(replace(replace(replace(replace(regexp_replace(art, '</?b>', '', 'g'), '<br><p>', '<br></p><p>'), '<br>', chr(10)), '<h1>', chr(10) || '# '), '</h1>', chr(10)), '<p>', '', 'g'), '</p>', chr(10))"


@query(_PAGE + " SELECT page_id, " + _block(_ENT.format(x=_MD)) + " AS content FROM b")
def markdown_convert(spark, sf_dir):
    return pages.convert_pages(table(spark, sf_dir, "pages"), output="markdown").select("page_id", "content")


_SEG = r"string_split_regex(replace(regexp_replace(art, '</?b>', '', 'g'), '<br>', ' '), '(</?(p|h1)>)+')"


@query(_PAGE + ", s AS (SELECT page_id, list_filter(list_transform(" + _SEG + ", lambda x: " + _compress(_ENT.format(x="x")) + "), lambda x: x <> '') AS xs FROM b), u AS (SELECT page_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS text FROM s) SELECT page_id, (i - 1)::INT AS pos, CASE i WHEN 1 THEN 'heading' ELSE 'paragraph' END AS kind, CASE i WHEN 1 THEN 1 END::INT AS level, text FROM u")
def structured_blocks(spark, sf_dir):
    out = pages.convert_pages(table(spark, sf_dir, "pages"), output="structured")
    blocks = F.from_json(F.get_json_object("content", "$.blocks"), "array<struct<kind:string,level:int,text:string>>")
    return out.select("page_id", F.posexplode(blocks).alias("pos", "b")).select("page_id", "pos", "b.*")


@query()
def convert_pages(spark, sf_dir):
    return pages.convert_pages(_nav(spark, sf_dir), max_tokens=200).select("page_id", "title", "content", "token_estimate", "status", "media", F.size("references").alias("n_refs"))


@query()
def fit_budget(spark, sf_dir):
    return pages.convert_pages(_nav(spark, sf_dir), max_tokens=120).select("page_id", "content", "token_estimate")


@query()
def structured_budget(spark, sf_dir):
    return pages.convert_pages(_nav(spark, sf_dir), output="structured", max_tokens=150).select("page_id", "content", "token_estimate")


@query("SELECT page_id, NULL::VARCHAR AS description, NULL::VARCHAR AS author, NULL::VARCHAR AS published, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, NULL::VARCHAR AS site_name FROM pages")
def page_meta(spark, sf_dir):
    return pages.convert_pages(table(spark, sf_dir, "pages")).select("page_id", "metadata.*")


@query()
def content_root(spark, sf_dir):
    return pages.convert_pages(_nav(spark, sf_dir), output="markdown").select("page_id", "content")


@query("SELECT page_id, title || chr(10) || url || chr(10) || chr(10) || 'body' AS out FROM (" + _PAGE + " SELECT page_id, title, p.url FROM b JOIN pages p USING (page_id)) WHERE title <> ''")
def render_fetch(spark, sf_dir):
    out = pages.convert_pages(table(spark, sf_dir, "pages"))
    return out.where("title <> ''").select("page_id", pages.render(F.col("title"), F.col("final_url"), F.lit("body")).alias("out"))


@query()
def json_sink(spark, sf_dir):
    out = pages.convert_pages(table(spark, sf_dir, "pages"), max_tokens=60)
    return out.select("page_id", F.to_json(F.struct("title", "final_url", "content", "content_type", "media", "token_estimate", "status", "references", "metadata")).alias("line"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN " + _trim("'{bad ' || text") + " ELSE '{' || chr(10) || '  \"a\": ' || doc_id || ',' || chr(10) || '  \"z\": ' || to_json(source)::VARCHAR || chr(10) || '}' END AS c FROM documents")
def json_pretty(spark, sf_dir):
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("{bad "), "text")).otherwise(F.to_json(F.struct(F.col("source").alias("z"), F.col("doc_id").alias("a"))))
    return table(spark, sf_dir, "documents").select("doc_id", pages.json_pretty(body).alias("c"))


def _nav(spark, sf_dir):
    """Pages whose content root is ``main`` with the navigation inside, so that links count."""
    html = F.regexp_replace(F.regexp_replace("html", "</?article>", ""), "<body>", "<body><main>")
    return table(spark, sf_dir, "pages").withColumn("html", html)


_LINKS = r"""WITH n AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
l AS (SELECT page_id, origin, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM n),
r AS (SELECT page_id, pos, origin || replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%27', '''') AS url FROM l)"""


@query(_LINKS + " SELECT page_id, pos::INT AS pos, url FROM r")
def link_resolve(spark, sf_dir):
    return pages.explode_links(_nav(spark, sf_dir), "page_id", "html", "url").select("page_id", "pos", "url")


@query(_LINKS + ", f AS (SELECT page_id, url, min(pos) AS p FROM r GROUP BY 1, 2) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p) AS \"index\", url FROM f")
def ref_number(spark, sf_dir):
    links = pages.explode_links(_nav(spark, sf_dir), "page_id", "html", "url").where("url IS NOT NULL")
    return pages.number_links(links, "page_id", "pos", "url", "text").select("page_id", "index", "url")


@query("SELECT strlen(html)::BIGINT AS n, NULL::VARCHAR AS undecodable FROM pages")
def scan_files(spark, sf_dir):
    """Stored pages written as raw files in the shared folder, one a page, and read back as such: one row a page."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/thresher-files"
    path = f"{base.rstrip('/')}/files-{uuid.uuid4().hex[:12]}"
    table(spark, sf_dir, "pages").select(F.col("html").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    page = F.regexp_replace("body", "\n\\z", "")  # the writer ends each file with a newline
    return readers.read_files(spark, f"{path}/part-*").select(F.octet_length(page).cast("bigint").alias("n"), "undecodable")


# ------------------------------------------------------------ search


@query("SELECT doc_id, 'https://lite.duckduckgo.com/lite/?q=' || url_encode(text) || CASE doc_id % 3 WHEN 0 THEN '&kp=1' WHEN 1 THEN '&kp=-1' ELSE '' END AS url FROM documents")
def ddg_url(spark, sf_dir):
    safe = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)
    return table(spark, sf_dir, "documents").select("doc_id", W.ddg_url(F.col("text"), safe).alias("url"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://d.example/x' WHEN 2 THEN 'https://d.example/' WHEN 3 THEN 'http://d.example:81/A%20b?q=1' ELSE '' END AS url FROM pages")
def ddg_unwrap(spark, sf_dir):
    k = F.col("page_id") % 5
    href = F.when(k == 0, F.concat(F.lit(" //d.example/l/?x=1&uddg="), F.url_encode("url"), F.lit("&rut=z"))).when(k == 1, "//d.example/x").when(k == 2, F.when(F.col("page_id") % 2 == 0, "//D.example").otherwise("HTTPS://D.example:443")).when(k == 3, "Http://d.example:81/A b?q=1").otherwise("  ")
    return table(spark, sf_dir, "pages").select("page_id", W.ddg_unwrap(href).alias("url"))


_SERP = "concat('<table><tr><td class=\"result-snippet\">orphan</td></tr>', CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE concat('<a class=\"result-link\" href=\"//d/l/?uddg=https%3A%2F%2Fn.example%2F', n_nationkey, '\">', n_name, ' ▶</a><td class=\"result-snippet\"></td><td class=\"result-snippet\">About ', n_name, '</td><a class=\"result-link\" href=\"https://two.example/\">Two</a>') END, CASE n_nationkey % 8 WHEN 3 THEN '<p class=\"no-results\">' ELSE '' END, '</table>')"


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 3 THEN 'ok' WHEN n_nationkey % 8 = 3 THEN 'empty' ELSE 'blocked' END AS status, CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE n_name || ' [1]' || chr(10) || 'About ' || n_name || chr(10) || chr(10) || 'Two [2]' END AS body FROM nation")
def ddg_parse(spark, sf_dir):
    hits = search.parse_pages(table(spark, sf_dir, "nation").select("n_nationkey", F.expr(_SERP).alias("h")), "n_nationkey", "h", 10)
    return hits.select("n_nationkey", "status", search.body(F.col("results")).alias("body"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'ok' WHEN page_id % 5 = 1 THEN 'blocked' WHEN page_id % 2 = 0 THEN 'empty' ELSE 'blocked' END AS status FROM pages")
def serp_status(spark, sf_dir):
    html = F.when(F.col("page_id") % 5 == 1, F.concat("html", F.lit("Unusual TRAFFIC"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", W.serp_status(html, F.when(F.col("page_id") % 5 == 0, 1).otherwise(0), F.col("page_id") % 2 == 0).alias("status"))


def _json(provider: str) -> str:
    items = {"brave": '{"web":{"results":%s}}'}.get(provider, '{"results":%s}')
    snippet = {"brave": "description", "tavily": "content", "searxng": "content"}[provider]
    row = '[{"title":"A ▶ ", "url":"https://a.example/", "%s":"first  one"}, {"title":"no url"}, {"title":"B","url":"https://b.example/"}]' % snippet
    left, right = (items % row).split("A ▶ ")
    return f"CASE WHEN n_nationkey % 5 = 4 THEN 'broken' ELSE concat('{left}', n_name, '{right}') END"


def _hits(provider):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "nation").select("n_nationkey", F.expr(_json(provider)).alias("j"))
        hits = search.hits_json(F.col("j"), provider, 5)
        return df.select("n_nationkey", search.json_status(F.col("j"), hits).alias("status"), F.coalesce(search.body(hits), F.lit("")).alias("body"))

    run.__name__ = f"hits_{provider}"
    return run


for _p in search.LAYOUT:
    query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN 'blocked' ELSE 'ok' END AS status, CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE n_name || ' [1]' || chr(10) || 'first one' || chr(10) || chr(10) || 'B [2]' END AS body FROM nation")(_hits(_p))


def _results(spark, sf_dir):
    one = lambda k, extra: F.struct(F.concat(F.col("n_name"), F.lit(extra)).alias("title"), F.lit("snip" if k == 1 else "").alias("snippet"), F.concat(F.lit(f"https://{k}.example/"), "n_nationkey").alias("url"), F.lit(k).cast("bigint").alias("ref_index"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("ok", "empty", "blocked")]), (F.col("n_nationkey") % 3 + 1).cast("int"))
    rows = F.when(F.col("n_nationkey") % 3 == 0, F.array(one(1, ""), one(2, "b"))).otherwise(F.array().cast(f"array<{search.HIT}>"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("query"), rows.alias("results"), status.alias("status"), F.lit("brave").alias("provider"))


_RBODY = "n_name || ' [1]' || chr(10) || 'snip' || chr(10) || chr(10) || n_name || 'b [2]'"
_RREFS = "'References:' || chr(10) || '[1] https://1.example/' || n_nationkey || chr(10) || '[2] https://2.example/' || n_nationkey"


@query(f"SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN {_RREFS} ELSE '' END AS refs FROM nation")
def search_refs(spark, sf_dir):
    return _results(spark, sf_dir).select("n_nationkey", T.ref_block(search.references(F.col("results"))).alias("refs"))


@query(f"SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN {_RBODY} ELSE '' END AS body FROM nation")
def search_body(spark, sf_dir):
    return _results(spark, sf_dir).select("n_nationkey", search.body(F.col("results")).alias("body"))


@query(f"WITH w AS (SELECT n_name AS query, n_nationkey % 3 AS m, {_RBODY} || chr(10) || chr(10) || {_RREFS} AS t FROM nation) SELECT query, CASE m WHEN 0 THEN 2 ELSE 0 END::BIGINT AS result_count, CASE m WHEN 0 THEN ({_cost('t')}) // 4 ELSE 0 END::BIGINT AS token_estimate, ['ok', 'empty', 'blocked'][m + 1] AS status FROM w")
def search_output(spark, sf_dir):
    return search.output(_results(spark, sf_dir), "query", "results", "status", "provider").select("query", "result_count", "token_estimate", "status")


@query(f"SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN {_RBODY} || chr(10) || chr(10) || {_RREFS} WHEN 1 THEN 'No results for `' || n_name || '` (provider: brave).' ELSE 'Search was blocked or returned an unrecognized page (provider: brave). This is not the same as having no results — the query was not answered.' END AS out FROM nation")
def search_render(spark, sf_dir):
    return _results(spark, sf_dir).select("n_nationkey", search.render(F.col("query"), F.col("results"), F.col("status"), F.col("provider")).alias("out"))


@query("SELECT n_name AS query, CASE WHEN n_nationkey % 3 = 2 AND n_nationkey % 2 = 0 THEN 'empty' ELSE ['ok', 'empty', 'blocked'][n_nationkey % 3 + 1] END AS status, CASE WHEN n_nationkey % 3 = 2 AND n_nationkey % 2 = 0 THEN 'ddg' ELSE 'brave' END AS provider FROM nation")
def search_fallback(spark, sf_dir):
    first = _results(spark, sf_dir).withColumn("payload", F.lit(""))
    other = first.where("n_nationkey % 2 = 0").select("query", F.lit("empty").alias("status"), F.lit("ddg").alias("provider"), "payload")
    return search.fallback(first.select("query", "status", "provider", "payload"), other).select("query", "status", "provider")


@query("SELECT k, ['duckduckgo', 'brave', 'searxng', NULL, 'tavily'][k % 5 + 1] AS name FROM (SELECT n_nationkey AS k FROM nation)")
def provider_name(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" DDG ", "Brave", "searx", "bing", "tavily")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), W.provider_name(raw).alias("name"))


# ------------------------------------------------------------ requests

_LINE = "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN concat('{\"id\":', event_id, ',\"method\":\"ping\"}') WHEN 2 THEN '{bad' WHEN 3 THEN '{\"method\":\"notify\"}' WHEN 4 THEN concat('{\"id\":', event_id, ',\"method\":\"initialize\",\"params\":{\"protocolVersion\":\"2025-03-26\"}}') WHEN 5 THEN concat('{\"id\":', event_id, ',\"method\":\"nope\"}') ELSE concat('{\"id\":', event_id, ',\"method\":\"initialize\",\"params\":{\"protocolVersion\":\"1999\"}}') END"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.expr(_LINE).alias("value"))


@query("SELECT event_id::VARCHAR AS id, CASE event_id % 7 WHEN 1 THEN 'ping' WHEN 5 THEN 'nope' ELSE 'initialize' END AS method FROM events WHERE event_id % 7 IN (1, 4, 5, 6)")
def rpc_filter(spark, sf_dir):
    return readers.request_lines(_lines(spark, sf_dir)).select("id", "method")


@query("SELECT event_id::VARCHAR AS id, CASE event_id % 7 WHEN 1 THEN 'ping' WHEN 5 THEN 'error:-32601' ELSE 'initialize' END AS route FROM events WHERE event_id % 7 IN (1, 4, 5, 6)")
def rpc_route(spark, sf_dir):
    return rpc.reply(readers.request_lines(_lines(spark, sf_dir))).select("id", "route")


@query("SELECT event_id::VARCHAR AS id, CASE event_id % 7 WHEN 4 THEN '2025-03-26' ELSE '2024-11-05' END AS version FROM events WHERE event_id % 7 IN (4, 6)")
def rpc_negotiate(spark, sf_dir):
    r = readers.request_lines(_lines(spark, sf_dir)).where("method = 'initialize'")
    return r.select("id", W.rpc_protocol(F.get_json_object("params", "$.protocolVersion")).alias("version"))


# Calls that need no network: refused addresses and unknown tools.
_CALL = """concat('{"id":', n_nationkey, ',"method":"tools/call","params":{"name":"', CASE WHEN n_nationkey % 5 = 0 THEN 'nope' ELSE 'fetch' END, '","arguments":{"url":"http://10.0.0.', n_nationkey, '/"}}}')"""


@query("""SELECT n_nationkey::VARCHAR AS id, '{"jsonrpc":"2.0","id":' || n_nationkey || ',"result":{"content": [{"type": "text", "text": "' || CASE WHEN n_nationkey % 5 = 0 THEN 'unknown tool: nope' ELSE 'blocked URL: host IP 10.0.0.' || n_nationkey || ' is not public' END || '"}], "isError": true}}' AS line FROM nation""")
def rpc_call(spark, sf_dir):
    calls = table(spark, sf_dir, "nation").select(F.expr(_CALL).alias("value"))
    return rpc.reply(readers.request_lines(calls), rpc.Service()).select("id", "line")
