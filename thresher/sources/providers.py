"""Search providers over the network: one request a query, replies as rows.

``ask`` gives the raw reply and ``answer`` the parsed hits of one query;
``SearchSource`` reads many queries in partitions.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import asdict
from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import web as W
from ..operators import search
from .readers import Provider
from .transport import USER_AGENT, Tls, opener, transient, truth

#: Where the hosted providers answer.
ENDPOINTS = {"duckduckgo": "https://lite.duckduckgo.com/lite/", "brave": "https://api.search.brave.com/res/v1/web/search", "tavily": "https://api.tavily.com/search"}
CHALLENGED = 202


def request_for(provider: Provider, query: str, most: int = 5, safe: bool | None = None) -> urllib.request.Request:
    """The request of one query. A ``base_url`` replaces the provider's own address."""
    head, name = {"User-Agent": USER_AGENT, "Accept": "application/json"}, provider.name
    base = provider.base_url or ENDPOINTS.get(name, "")
    if name == "duckduckgo":
        head |= {"Accept": "text/html,application/xhtml+xml", "Accept-Language": "en-US,en;q=0.9"}
        return urllib.request.Request(f"{base}?q={quote(query, safe='')}" + ("" if safe is None else "&kp=1" if safe else "&kp=-1"), headers=head)
    if name == "brave":
        asked = {"q": query, "count": min(most, 20)} | ({} if safe is None else {"safesearch": "strict" if safe else "off"})
        return urllib.request.Request(f"{base}?{urlencode(asked)}", headers=head | {"X-Subscription-Token": provider.api_key or ""})
    bearer = {"Authorization": f"Bearer {provider.api_key}"} if provider.api_key else {}
    if name == "tavily":  # has no safe search
        body = json.dumps({"query": query, "max_results": most}).encode()
        return urllib.request.Request(base, data=body, method="POST", headers=head | bearer | {"Content-Type": "application/json"})
    asked = {"q": query, "format": "json"} | ({} if safe is None else {"safesearch": "2" if safe else "0"})
    return urllib.request.Request(f"{base.rstrip('/')}/search?{urlencode(asked)}", headers=head | bearer)


def ask(provider: Provider, query: str, most: int = 5, safe: bool | None = None, timeout: float = 10, tls: Tls = Tls()) -> dict:
    """query, provider, body, error of one query. Only the scraped provider is asked again, up to
    three times; a challenge counts as transient there."""
    scraped = provider.name == "duckduckgo"
    tries = 3 if scraped else 1
    fail = lambda e: {"query": query, "provider": provider.name, "body": None, "error": e}
    try:
        client = opener(tls, hops=1 if scraped else 10)
    except OSError as e:
        return fail(str(e))
    for k in range(tries):
        try:
            with client.open(request_for(provider, query, most, safe), timeout=timeout) as r:
                if not (scraped and r.status == CHALLENGED):
                    return {"query": query, "provider": provider.name, "body": r.read(W.BODY_CAP).decode("utf-8", "replace"), "error": None}
                error, again = f"{provider.name} returned {r.status} (rate limited or challenged)", True
        except urllib.error.HTTPError as e:
            told = "" if scraped else e.read(W.BODY_CAP).decode("utf-8", "replace").strip()
            error, again = f"{provider.name} search failed ({e.code}): {told}", transient(e.code)
        except (OSError, ValueError) as e:
            error, again = f"{provider.name} search failed: {e}", True
        if not again or k == tries - 1:
            break
        time.sleep(0.2 * 2**k)
    return fail(error)


def answer(query: str, primary: Provider, fallback: Provider | None = None, most: int = 5, safe: bool | None = None, timeout: float = 10, tls: Tls = Tls()) -> dict:
    """The search row of one query: the primary's unless it failed and the fallback's did not. Raises
    the primary's error if neither answered."""

    def one(provider: Provider) -> dict:
        got = ask(provider, query, most, safe, timeout, tls)
        return got if got["error"] else search.output_row(query, *search.parse_reply(got["body"], provider.name, most), provider.name)

    first = one(primary)
    if fallback is not None and first.get("status", "error") in ("error", "blocked"):
        second = one(fallback)
        if second.get("status", "error") not in ("error", "blocked"):
            return second
    if first.get("error"):
        raise RuntimeError(first["error"])
    return first


class _Queries(InputPartition):
    def __init__(self, queries: list[str]):
        self.queries = queries


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = json.loads(options["queries"])
        self.provider = Provider(**json.loads(options.get("provider", "{}")))
        self.most, self.timeout, self.size = int(options.get("max_results", 5)), float(options.get("timeout_secs", 10)), int(options.get("batch", 16))
        self.safe = truth(options["safe_search"]) if "safe_search" in options else None
        self.tls = Tls.of(options)

    def partitions(self) -> list[InputPartition]:
        return [_Queries(self.queries[k : k + self.size]) for k in range(0, len(self.queries), self.size)]

    def read(self, partition):
        for q in partition.queries:
            r = ask(self.provider, q, self.most, self.safe, self.timeout, self.tls)
            yield r["query"], r["provider"], r["body"], r["error"]


class SearchSource(DataSource):
    """``spark.read.format("websearch").options(queries=json list, provider=json of a Provider)``."""

    @classmethod
    def name(cls) -> str:
        return "websearch"

    def schema(self) -> str:
        return "query string, provider string, body string, error string"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def replies(spark: SparkSession, queries: list[str], provider: Provider, most: int = 5, **options: str) -> DataFrame:
    """query, results, status, provider of each query; an unanswered one has status ``error`` and no results."""
    spark.dataSource.register(SearchSource)
    raw = spark.read.format("websearch").options(queries=json.dumps(queries), provider=json.dumps(asdict(provider)), max_results=str(most), **options).load()
    # Parsed in one pass over the replies: a self-join would ask every query twice.
    got = raw.withColumn("p", search.parsed(F.col("body"), provider.name, most))
    none = F.array().cast(f"array<{search.HIT}>")
    status = F.when(F.col("error").isNotNull(), "error").otherwise(F.col("p.status"))
    return got.select("query", F.coalesce("p.results", none).alias("results"), status.alias("status"), "provider", "error")
