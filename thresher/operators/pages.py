"""Page conversion at table scale: one row a page in, one result row out.

Media, depth and size tests are built-in expressions that run before the one
Python boundary; only html rows shallow enough reach it, once each, in Arrow
batches. Status, estimate, rendering and filters after it are built-in again.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from . import dom

_REF = pa.list_(pa.struct([("index", pa.int64()), ("url", pa.string()), ("text", pa.string())]))
_META = pa.struct([(k, pa.string()) for k in ("description", "author", "published", "lang", "site_name")])
_BLOCK = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
_OUT = pa.struct([("title", pa.string()), ("metadata", _META), ("content", pa.string()), ("references", _REF), ("blocks", _BLOCK)])
OUT_TYPE = "struct<title:string,metadata:struct<description:string,author:string,published:string,lang:string,site_name:string>,content:string,references:array<struct<index:bigint,url:string,text:string>>,blocks:array<struct<kind:string,level:int,text:string>>>"
OUTPUTS = {"text": "text", "markdown": "markdown", "md": "markdown", "structured": "structured", "json": "structured"}


def output_name(name: str | None) -> str:
    """Output option: aliases accepted, anything else is text."""
    return OUTPUTS.get((name or "").strip().lower(), "text")


def convert_one(html: str, url: str, output: str, most: int | None) -> dict:
    doc = dom.parse(html)
    index = dom.Index(doc)
    name, blocks = dom.title(doc, index), None
    if output == "structured":
        blocks, refs = dom.to_blocks(doc, url, index)
        content, refs = dom.fit_blocks(blocks, refs, most)
        blocks = json.loads(content)["blocks"]
        blocks = [{"kind": b["kind"], "level": b.get("level"), "text": b["text"]} for b in blocks]
    elif output == "markdown":
        body, refs = dom.to_markdown(doc, url, index)
        content = dom.compress_block(body)
        if most is not None:
            content = dom.truncate(content, most)
            refs = [r for r in refs if r["url"] in content]
    else:
        body, refs = dom.to_text(doc, url, index)
        body = dom.compress_block(body)
        first, _, rest = body.partition("\n")
        if name and dom.compress(first) == dom.compress(name):
            body = rest.lstrip("\n")
        content, refs = dom.fit(body, refs, most)
    return {"title": name, "metadata": dom.metadata(doc, index), "content": content, "references": refs, "blocks": blocks}


def _converter(output: str, most: int | None):
    def column(body: pa.Array, url: pa.Array, media: pa.Array) -> pa.Array:
        out = []
        for h, u, kind in zip(body.to_pylist(), url.to_pylist(), media.to_pylist(), strict=True):
            if h is None:
                out.append(None)
            elif kind == "json":
                out.append({"content": _pretty_one(h)})
            else:
                out.append(convert_one(h, u or "", output, most))
        return pa.array(out, _OUT)

    return column


def converted(body: Column, url: Column, media: Column, output: str = "text", most: int | None = None) -> Column:
    """The html and JSON branches as one struct column (null bodies: null), so that rows cross into Python once. JSON has its content only, before any budget."""
    return F.arrow_udf(_converter(output_name(output), most), OUT_TYPE).asNondeterministic()(body, url, media)


def _pretty_one(body: str) -> str:
    try:
        return json.dumps(json.loads(body), indent=2, sort_keys=True, ensure_ascii=False)
    except ValueError:
        return dom.trim(body)


def _pretty(body: pa.Array) -> pa.Array:
    return pa.array([None if b is None else _pretty_one(b) for b in body.to_pylist()], pa.string())


def json_pretty(body: Column) -> Column:
    """Parsed JSON with sorted keys and two spaces; else the trimmed body."""

    def column(body: pa.Array) -> pa.Array:
        return _pretty(body)

    return F.arrow_udf(column, "string").asNondeterministic()(body)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores, two partitions each, if it has less than four partitions a core: splits of a
    file may be empty but for one, as row groups can't be cut. A larger input keeps its scan partitions and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 4 * cores else df


def convert_pages(df: DataFrame, body: str = "html", url: str = "url", content_type: str | None = None, output: str = "text", max_tokens: int | None = None) -> DataFrame:
    """``df`` with title, final_url, content, content_type, media, token_estimate, status,
    references, metadata, note. A null body gives an empty text result. Columns of ``df`` with
    those names are replaced."""
    kind = output_name(output)
    names = ["title", "final_url", "content", "content_type", "media", "token_estimate", "status", "references", "metadata", "note"]
    header = F.col(content_type) if content_type else F.lit(None).cast("string")
    raw = F.coalesce(F.col(body), F.lit(""))
    base = spread(df).withColumns({"__body": raw, "__url": F.coalesce(F.col(url), F.lit("")), "__ct": header}).withColumn("__media", W.media_type(F.col("__ct"), F.col("__body")))
    # So deep a page has a tag of three bytes or more a level: shorter ones needn't be scanned.
    long = F.octet_length("__body") > 3 * W.MAX_DEPTH
    base = base.withColumn("__depth", F.when((F.col("__media") == "html") & long, W.nesting_depth(F.col("__body"))))
    deep = F.coalesce(F.col("__depth") > W.MAX_DEPTH, F.lit(False))
    crosses = F.when(F.col("__media").isin("html", "json") & ~deep, F.col("__body"))
    base = base.withColumn("__c", converted(crosses, F.col("__url"), F.col("__media"), kind, max_tokens))
    budget = lambda c: T.truncate_tokens(c, max_tokens) if max_tokens is not None else c
    refused = F.format_string(f"[document refused: nesting depth %d exceeds the limit of {W.MAX_DEPTH} — parsing it would take minutes]", F.col("__depth"))
    is_json, is_text = F.col("__media") == "json", F.col("__media") == "text"
    content = F.when(deep, refused).when(F.col("__media") == "html", F.col("__c.content")).when(is_json, budget(F.col("__c.content"))).when(is_text, budget(T.trim_space(F.col("__body")))).otherwise(W.binary_summary(F.col("__ct"), F.col("__body")))
    base = base.withColumn("__content", content)
    status = F.when(deep, "too_complex").otherwise(W.content_status(F.when(F.col("__media") == "html", "html").otherwise("other"), F.col("__content"), F.col("__body"), F.lit(kind == "structured")))
    status = F.when(F.col("__media").isin("html") | deep, status).when(T.trim_space(F.col("__content")) == "", "empty").otherwise("ok")
    none = F.array().cast("array<struct<index:bigint,url:string,text:string>>")
    out = {
        "title": F.coalesce(F.col("__c.title"), F.lit("")),
        "final_url": F.col("__url"),
        "content": F.col("__content"),
        "content_type": F.when(is_json, "structured").when(is_text, "text").otherwise(kind),
        "media": F.col("__media"),
        "token_estimate": T.token_estimate(F.col("__content")),
        "status": status,
        "references": F.coalesce(F.col("__c.references"), none),
        "metadata": F.when(~is_json, F.col("__c.metadata")),
        "note": W.status_note(status),
    }
    keep = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return base.select(*keep, *[v.alias(k) for k, v in out.items()])


def media_of(content_type: str | None, body: str) -> str:
    """``media_type`` of one body."""
    essence = dom.trim((content_type or "").partition(";")[0]).lower()
    if essence:
        return "html" if "html" in essence else "json" if "json" in essence else "text" if essence.startswith("text/") else essence
    first = dom.trim(body)[:1]
    if first in ("{", "["):
        try:
            json.loads(body)
            return "json"
        except ValueError:
            return "text"
    return "html" if first == "<" else "text"


def convert_row(body: str, url: str, content_type: str | None = None, output: str = "text", max_tokens: int | None = None) -> dict:
    """One page by the rules of ``convert_pages``, for callers with a request at a time."""
    kind, media = output_name(output), media_of(content_type, body)
    row = {"title": "", "final_url": url, "content": "", "content_type": kind, "media": media, "token_estimate": 0, "status": "ok", "references": [], "metadata": {}}
    if media == "html":
        deep = dom.depth(body)
        if deep > W.MAX_DEPTH:
            row |= {"content": f"[document refused: nesting depth {deep} exceeds the limit of {W.MAX_DEPTH} — parsing it would take minutes]", "status": "too_complex"}
        else:
            got = convert_one(body, url, kind, max_tokens)
            blank = not dom.trim(got["content"]) or (kind == "structured" and got["blocks"] == [])
            row |= {k: got[k] for k in ("title", "content", "references")} | {"metadata": {k: v for k, v in got["metadata"].items() if v is not None}}
            row["status"] = ("needs_js" if "<script" in body.lower() else "empty") if blank else "ok"
    else:
        if media == "json":
            text, row["content_type"] = _pretty(pa.array([body])).to_pylist()[0], "structured"
        elif media == "text":
            text, row["content_type"] = dom.trim(body), "text"
        else:
            text = f"[non-text content: {content_type}, {len(body.encode('utf-8', 'replace'))} bytes — not rendered]"
        if max_tokens is not None and media in ("json", "text"):
            text = dom.truncate(text, max_tokens)
        row |= {"content": text, "status": "ok" if dom.trim(text) else "empty"}
    row["token_estimate"] = dom.estimate(row["content"])
    return row


def render(title: Column, url: Column, content: Column) -> Column:
    """Title and url lines where not empty, a blank line if there was either, content."""
    head = F.concat_ws("\n", F.when(title != "", title), F.when(url != "", url))
    return F.when(head == "", content).otherwise(F.concat(head, F.lit("\n\n"), content))


def number_links(links: DataFrame, doc: str, pos: str, url: str, text: str) -> DataFrame:
    """References of each document in first-seen order: doc, index, url, text of the first anchor."""
    from pyspark.sql import Window

    firsts = links.groupBy(doc, url).agg(F.min(pos).alias("__p"), F.min_by(text, pos).alias("text"))
    order = Window.partitionBy(doc).orderBy("__p")
    return firsts.select(doc, F.row_number().over(order).cast("long").alias("index"), F.col(url).alias("url"), "text")


def explode_links(df: DataFrame, doc: str, html: str, url: str) -> DataFrame:
    """Anchors of the content root with resolved urls: doc, pos, href, url, text."""
    kind = pa.list_(pa.struct([("href", pa.string()), ("url", pa.string()), ("text", pa.string())]))

    def column(html: pa.Array, base: pa.Array) -> pa.Array:
        out = []
        for h, b in zip(html.to_pylist(), base.to_pylist(), strict=True):
            root = dom.content_root(dom.parse(h or ""))
            found = [x for x in dom.walk(root) if isinstance(x, dom.Node) and x.name == "a" and "href" in x.attrs] if root else []
            out.append([{"href": x.attrs["href"], "url": dom.resolve(x.attrs["href"], b or ""), "text": dom.trim(dom.all_text(x))} for x in found])
        return pa.array(out, kind)

    udf = F.arrow_udf(column, "array<struct<href:string,url:string,text:string>>").asNondeterministic()
    return spread(df).select(F.col(doc), F.posexplode(udf(F.col(html), F.col(url))).alias("pos", "a")).select(doc, "pos", "a.*")


def guard_url(url: Column) -> Column:
    """Why a URL is refused before any name is looked up (scheme, port, address, local name); null where it isn't."""
    host = W.url_host(url)
    six = host.startswith("[")
    literal = F.when(six, guard_ip(F.when(six, host))).otherwise(F.coalesce(W.guard_ipv4(host), F.lit(False)))
    return F.when(~F.coalesce(W.guard_scheme(url), F.lit(False)), "scheme").when(~W.guard_port(url), "port").when(literal, "address").when(W.guard_localname(F.regexp_replace(host, r"\.$", "")), "local name")


def guard_ip(host: Column) -> Column:
    """True where an IPv6 (or IPv4) literal is not public; null for other hosts."""

    def column(host: pa.Array) -> pa.Array:
        return pa.array([blocked_ip(h) for h in host.to_pylist()], pa.bool_())

    return F.arrow_udf(column, "boolean")(host)


def blocked_ip(host: str | None) -> bool | None:
    import ipaddress

    try:
        ip = ipaddress.ip_address((host or "").strip("[]"))
    except ValueError:
        return None
    nets4 = [ipaddress.ip_network(f"{b}/{n}") for b, n in W.BLOCKED_V4]
    v4 = lambda x: any(x in n for n in nets4)
    if ip.version == 4:
        return v4(ip)
    n = int(ip)
    if n >> 32 in (0, 0xFFFF) and n > 1 or n >> 32 == 0:
        return v4(ipaddress.IPv4Address(n & 0xFFFFFFFF))
    inner = n & 0xFFFFFFFF if n >> 32 == 0x64FF9B << 64 else (n >> 80) & 0xFFFFFFFF if n >> 112 == 0x2002 else None
    if inner is not None and v4(ipaddress.IPv4Address(inner)):
        return True
    return any(ip in ipaddress.ip_network(x) for x in ("ff00::/8", "fe80::/10", "fc00::/7", "2001:db8::/32"))
