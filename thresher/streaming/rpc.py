"""Request stream: JSON lines in, JSON replies out, without state.

Everything but tool calls is answered by built-in expressions. Tool calls run on
the executors, one row at a time: each waits for the network, and task slots
bound how many are under way.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import web as W
from ..operators import pages, search
from ..sources import providers, readers
from ..sources.readers import request_lines
from ..sources.transport import Tls

MAX_TOKENS = 6000
SERVER = {"name": "thresher", "version": "0.1"}
_INTEGER, _BOOLEAN, _STRING = {"type": "integer"}, {"type": "boolean"}, {"type": "string"}
TOOLS = {
    "tools": [
        {
            "name": "fetch",
            "description": "Read a web page as compact text with numbered references.",
            "inputSchema": {"type": "object", "properties": {"url": _STRING, "output": _STRING | {"enum": ["text", "markdown", "structured"]}, "max_tokens": _INTEGER, "timeout": _INTEGER, "json": _BOOLEAN}, "required": ["url"]},
        },
        {
            "name": "search",
            "description": "Search the web; results carry numbered references.",
            "inputSchema": {"type": "object", "properties": {"query": _STRING, "max_results": _INTEGER, "safe_search": _STRING | {"enum": ["on", "off"]}, "timeout": _INTEGER, "json": _BOOLEAN}, "required": ["query"]},
        },
    ]
}


@dataclass
class Service:
    """What tool calls use; ``allow_private`` lifts the address guard (tests)."""

    settings: readers.Settings = field(default_factory=readers.Settings)
    allow_private: bool = False


def route(method: Column) -> Column:
    known = method.isin("initialize", "tools/list", "tools/call", "ping")
    return F.when(known, method).otherwise("error:-32601")


def _said(text: str, failed: bool) -> str:
    return json.dumps({"content": [{"type": "text", "text": text}]} | ({"isError": True} if failed else {}), ensure_ascii=False)


def _natural(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else None


def _first(*values):
    return next((v for v in values if v is not None), None)


def _fetch(args: dict, service: Service) -> tuple[str, bool]:
    url, own = args.get("url"), service.settings
    if not isinstance(url, str):
        raise ValueError("missing required argument: url")
    timeout = _first(_natural(args.get("timeout")), own.timeout_secs, 10)
    got = readers.fetch_one(url, timeout, service.allow_private, tls=Tls(tuple(own.ca_certs)))
    if got["error"]:
        raise RuntimeError(got["error"])
    head = readers.header_charset(got["content_type"])
    text, bad = readers.decode_bytes(got["body"], head if head is not None else readers.sniffed_charset(got["body"]))
    output = args.get("output") if isinstance(args.get("output"), str) else "text"
    row = pages.convert_row(text, got["final_url"], got["content_type"], output, _first(_natural(args.get("max_tokens")), own.max_tokens, MAX_TOKENS))
    if bad:
        row["metadata"] = row["metadata"] | {"charset": bad}
    row["source"] = url
    head = "\n".join(x for x in (row["title"], row["final_url"]) if x)
    body = json.dumps(row, indent=2, ensure_ascii=False) if args.get("json") is True else (f"{head}\n\n" if head else "") + row["content"]
    if row["status"] == "ok":
        return body, False
    return f"{body}\n\n[{W.NOTES.get(row['status'], 'no content extracted')}]", True


def _search(args: dict, service: Service) -> tuple[str, bool]:
    query, own = args.get("query"), service.settings
    if not isinstance(query, str):
        raise ValueError("missing required argument: query")
    primary = readers.primary_provider(own)
    other, _ = readers.fallback_provider(own, primary)
    most = _first(_natural(args.get("max_results")), 5)
    row = providers.answer(query, primary, other, most, {"on": True, "off": False}.get(str(args.get("safe_search"))), _first(_natural(args.get("timeout")), 10), Tls(tuple(own.ca_certs)))
    return json.dumps(row, indent=2, ensure_ascii=False) if args.get("json") is True else search.render_row(row), row["status"] == "blocked"


def tool_result(params: str | None, service: Service) -> str:
    """The JSON result of one tool call. What goes wrong is a result marked as an error."""
    try:
        p = json.loads(params) if params else {}
        p = p if isinstance(p, dict) else {}
        name, args = p.get("name") if isinstance(p.get("name"), str) else "", p.get("arguments")
        call = {"fetch": _fetch, "search": _search}.get(name)
        if call is None:
            raise ValueError(f"unknown tool: {name}")
        return _said(*call(args if isinstance(args, dict) else {}, service))
    except (ValueError, OSError, RuntimeError) as e:
        return _said(str(e), True)


def tool_results(params: Column, service: Service) -> Column:
    def column(params: pa.Array) -> pa.Array:
        return pa.array([tool_result(p, service) for p in params.to_pylist()], pa.string())

    return F.arrow_udf(column, "string").asNondeterministic()(params)


def reply(requests: DataFrame, service: Service | None = None) -> DataFrame:
    """id, route and the reply line of every request. Tool calls run only if a service is given;
    without one they have no line."""
    version = W.rpc_protocol(F.get_json_object("params", "$.protocolVersion"))
    hello = F.concat(F.lit('{"protocolVersion":"'), version, F.lit('","capabilities":{"tools":{}},"serverInfo":' + json.dumps(SERVER) + "}"))
    fixed = F.when(F.col("method") == "initialize", hello).when(F.col("method") == "tools/list", F.lit(json.dumps(TOOLS))).when(F.col("method") == "ping", F.lit("{}"))
    envelope = lambda result: F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("id_json"), F.lit(',"result":'), result, F.lit("}"))
    bad = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("id_json"), F.lit(',"error":{"code":-32601,"message":"method not found"}}'))
    called = F.col("method") == "tools/call"
    plain = requests.where(~called).select("id", route(F.col("method")).alias("route"), F.coalesce(envelope(fixed), bad).alias("line"))
    calls = requests.where(called)
    result = tool_results(F.col("params"), service) if service else F.lit(None).cast("string")
    return plain.unionByName(calls.withColumn("__r", result).select("id", F.lit("tools/call").alias("route"), envelope(F.col("__r")).alias("line")))


def serve(spark: SparkSession, source: str, sink: str, checkpoint: str, service: Service | None = None) -> StreamingQuery:
    """Answer the request files that arrive in ``source``; replies are JSON lines in ``sink``.
    A batch that is run again replaces its own lines."""
    lines, service = spark.readStream.text(source), service or Service()

    def batch(df: DataFrame, epoch: int) -> None:
        reply(request_lines(df), service).select(F.col("line").alias("value")).write.mode("overwrite").text(f"{sink}/epoch={epoch}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
