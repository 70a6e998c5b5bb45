"""Search results: parsing stored result pages and provider replies, references, rendering, fallback."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from . import dom

_LINK, _SNIPPET, _PAGE = {"result-link", "result__a"}, {"result-snippet", "result__snippet"}, {"result-count", "no-results", "results"}
_PARTS = pa.struct([("parts", pa.list_(pa.struct([("link", pa.bool_()), ("text", pa.string()), ("href", pa.string())]))), ("is_page", pa.bool_())])
HIT = "struct<title:string,snippet:string,url:string,ref_index:bigint>"


def parts_of(html: str | None) -> tuple[list[dict], bool]:
    """Links and snippets of one result page in document order, and whether it is one at all."""
    parts, page = [], False
    for x in dom.walk(dom.parse(html or "")):
        if not isinstance(x, dom.Node) or "class" not in x.attrs:
            continue
        names = set(x.attrs["class"].split())
        page = page or bool(names & _PAGE)
        if (x.name == "a" and names & _LINK) or names & _SNIPPET:
            parts.append({"link": x.name == "a", "text": dom.compress(dom.all_text(x)), "href": x.attrs.get("href", "")})
    return parts, page


def page_parts(html: Column) -> Column:
    """Links and snippets of a result page in document order, and whether it is a result page at all."""

    def column(html: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("parts", "is_page"), parts_of(h), strict=True)) for h in html.to_pylist()], _PARTS)

    return F.arrow_udf(column, "struct<parts:array<struct<link:boolean,text:string,href:string>>,is_page:boolean>").asNondeterministic()(html)


def parse_pages(df: DataFrame, key: str, html: str, most: int) -> DataFrame:
    """key, results, status: each snippet joins the link before it (an as-of attachment by running count)."""
    found = df.select(F.col(key), F.col(html).alias("__h"), page_parts(F.col(html)).alias("p"))
    each = found.select(key, F.posexplode("p.parts").alias("pos", "x")).select(key, "pos", "x.*").withColumn("url", F.when(F.col("link"), W.ddg_unwrap(F.col("href"))))
    each = each.where(~F.col("link") | (F.col("text") != "") | (F.col("url") != ""))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("hit", F.sum(F.col("link").cast("long")).over(order)).where((F.col("hit") > 0) & (F.col("hit") <= most))
    hits = each.groupBy(key, "hit").agg(F.max(F.when(F.col("link"), F.col("text"))).alias("title"), F.coalesce(F.min_by("text", F.when(~F.col("link") & (F.col("text") != ""), F.col("pos"))), F.lit("")).alias("snippet"), F.max("url").alias("url"))
    listed = hits.groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct("hit", "title", "snippet", "url"))).alias("r"))
    out = found.join(listed, F.col(key).eqNullSafe(F.col("__k")), "left")
    results = F.coalesce(F.transform("r", lambda x: F.struct(x["title"].alias("title"), x["snippet"].alias("snippet"), x["url"].alias("url"), x["hit"].alias("ref_index"))), F.array().cast(f"array<{HIT}>"))
    return out.select(key, results.alias("results"), W.serp_status(F.col("__h"), F.size(results), F.col("p.is_page")).alias("status"))


#: Where each provider keeps its hits and snippets.
LAYOUT = {"brave": ("$.web.results", ["description"]), "tavily": ("$.results", ["content", "snippet"]), "searxng": ("$.results", ["content"])}


def hits_json(body: Column, provider: str, most: int) -> Column:
    """Results of a provider's JSON reply: hits without a url skipped, numbering without gaps."""
    path, snippets = LAYOUT[provider]
    raw = F.from_json(F.get_json_object(body, path), "array<string>")
    text = lambda x, k: F.try_variant_get(F.try_parse_json(x), f"$.{k}", "string")
    quoted = lambda x, k: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), f"$.{k}", "variant")) == "STRING", text(x, k))
    rows = F.transform(raw, lambda x: F.struct(T.compress_text(F.coalesce(quoted(x, "title"), F.lit(""))).alias("title"), T.compress_text(F.coalesce(*[quoted(x, s) for s in snippets], F.lit(""))).alias("snippet"), F.coalesce(quoted(x, "url"), F.lit("")).alias("url")))
    kept = F.slice(F.filter(rows, lambda r: r["url"] != ""), 1, most) if most > 0 else F.slice(rows, 1, 0)
    return F.transform(kept, lambda r, k: F.struct(r["title"].alias("title"), r["snippet"].alias("snippet"), r["url"].alias("url"), (k + 1).cast("bigint").alias("ref_index")))


def json_status(body: Column, hits: Column) -> Column:
    return F.when(F.try_parse_json(body).isNull(), "blocked").when(F.coalesce(F.size(hits), F.lit(0)) > 0, "ok").otherwise("empty")


def references(results: Column) -> Column:
    return F.transform(results, lambda r: F.struct(r["ref_index"].alias("index"), r["url"].alias("url")))


def body(results: Column) -> Column:
    line = lambda r: F.concat(r["title"], F.lit(" ["), r["ref_index"].cast("string"), F.lit("]"), F.when(r["snippet"] != "", F.concat(F.lit("\n"), r["snippet"])).otherwise(""))
    return F.array_join(F.transform(results, line), "\n\n")


def note(query: Column, status: Column, provider: Column) -> Column:
    empty = F.concat(F.lit("No results for `"), query, F.lit("` (provider: "), provider, F.lit(")."))
    blocked = F.concat(F.lit("Search was blocked or returned an unrecognized page (provider: "), provider, F.lit("). This is not the same as having no results — the query was not answered."))
    return F.when(status == "empty", empty).when(status == "blocked", blocked)


def render(query: Column, results: Column, status: Column, provider: Column) -> Column:
    part = lambda c: F.when(c != "", c)
    return F.concat_ws("\n\n", part(body(results)), part(T.ref_block(references(results))), note(query, status, provider))


def output(df: DataFrame, query: str, results: str, status: str, provider: str) -> DataFrame:
    """The whole search row: query, results, references, token_estimate, result_count, status, provider."""
    r = F.col(results)
    whole = F.concat(body(r), F.lit("\n\n"), T.ref_block(references(r)))
    return df.select(F.col(query).alias("query"), r.alias("results"), references(r).alias("references"), T.token_estimate(whole).alias("token_estimate"), F.size(r).cast("long").alias("result_count"), F.col(status).alias("status"), F.col(provider).alias("provider"))


def fallback(primary: DataFrame, other: DataFrame, key: str = "query") -> DataFrame:
    """The primary's answer unless it failed and the other one didn't; both have (key, status, provider, payload)."""
    p, o = primary.alias("p"), other.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("status", "provider", "payload")]).alias("o")
    use = (F.coalesce(F.col("p.status"), F.lit("error")).isin("blocked", "error")) & F.col("__status").isNotNull() & (F.col("__status") != "error")
    pick = lambda c: F.when(use, F.col(f"__{c}")).otherwise(F.col(f"p.{c}")).alias(c)
    return p.join(o, F.col(f"p.{key}") == F.col("__k"), "left").select(F.col(f"p.{key}").alias(key), *[pick(c) for c in ("status", "provider", "payload")])


# ------------------------------------------------------------ one reply at a time (requests, network replies)


def unwrap(href: str) -> str:
    """The target of a result link: the redirect's parameter, else the link itself."""
    h = dom.trim(href)
    if h.startswith("//"):
        h = f"https:{h}"
    target = re.search(r"[?&]uddg=([^&#]*)", h)
    if target and target[1]:
        return unquote_plus(target[1])
    try:
        return dom.normalise_url(h) or h
    except ValueError:
        return h


def _hits(found: list[dict], most: int) -> list[dict]:
    return [{**h, "ref_index": k} for k, h in enumerate(found[: max(0, most)], 1)]


def parse_reply(body: str | None, provider: str, most: int) -> tuple[list[dict], str]:
    """Hits and status of one provider reply; the rules are those of ``parse_pages`` and ``hits_json``."""
    if provider == "duckduckgo":
        parts, is_page = parts_of(body)
        found: list[dict] = []
        for x in parts:
            if x["link"]:
                url = unwrap(x["href"])
                if x["text"] or url:
                    found.append({"title": x["text"], "snippet": "", "url": url})
            elif found and not found[-1]["snippet"]:
                found[-1]["snippet"] = x["text"]
        low, hits = (body or "").lower(), _hits(found, most)
        if hits:
            return hits, "ok"
        return hits, "empty" if is_page and not any(m in low for m in W.CHALLENGE) else "blocked"
    try:
        at = json.loads(body or "")
    except ValueError:
        return [], "blocked"
    path, snippets = LAYOUT[provider]
    for key in path.split(".")[1:]:
        at = at.get(key) if isinstance(at, dict) else None
    text = lambda x, k: x[k] if isinstance(x.get(k), str) else None
    rows = [x for x in at if isinstance(x, dict) and text(x, "url")] if isinstance(at, list) else []
    first = lambda x: next((v for v in (text(x, k) for k in snippets) if v is not None), "")
    hits = _hits([{"title": dom.compress(text(x, "title") or ""), "snippet": dom.compress(first(x)), "url": x["url"]} for x in rows], most)
    return hits, "ok" if hits else "empty"


def parsed(body: Column, provider: str, most: int) -> Column:
    """struct(results, status) of replies, in one pass; null where there is no reply."""
    hit = pa.struct([("title", pa.string()), ("snippet", pa.string()), ("url", pa.string()), ("ref_index", pa.int64())])
    kind = pa.struct([("results", pa.list_(hit)), ("status", pa.string())])

    def column(body: pa.Array) -> pa.Array:
        return pa.array([None if b is None else dict(zip(("results", "status"), parse_reply(b, provider, most), strict=True)) for b in body.to_pylist()], kind)

    return F.arrow_udf(column, f"struct<results:array<{HIT}>,status:string>").asNondeterministic()(body)


def body_row(results: list[dict]) -> str:
    return "\n\n".join(f"{r['title']} [{r['ref_index']}]" + (f"\n{r['snippet']}" if r["snippet"] else "") for r in results)


def output_row(query: str, results: list[dict], status: str, provider: str) -> dict:
    """The search row of one query, fields in the order of ``output``."""
    refs = [{"index": r["ref_index"], "url": r["url"]} for r in results]
    whole = f"{body_row(results)}\n\n{dom.ref_block(refs)}"
    return {"query": query, "results": results, "references": refs, "token_estimate": dom.estimate(whole), "result_count": len(results), "status": status, "provider": provider}


def render_row(row: dict) -> str:
    """``render`` of one search row."""
    q, p = row["query"], row["provider"]
    notes = {"empty": f"No results for `{q}` (provider: {p}).", "blocked": f"Search was blocked or returned an unrecognized page (provider: {p}). This is not the same as having no results — the query was not answered."}
    return "\n\n".join(x for x in (body_row(row["results"]), dom.ref_block(row["references"]), notes.get(row["status"])) if x)
