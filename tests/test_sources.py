"""Charsets, files, guard, request stream, settings."""

import json

from pyspark.sql import functions as F

from thresher.operators import pages, search
from thresher.plans import registry
from thresher.sources import providers, readers, transport
from thresher.streaming import rpc


def test_decode():
    d = readers.decode_bytes
    assert d(bytes.fromhex("436166E92097206E61EF7665"), "ISO-8859-1")[0] == "Café — naïve"
    assert d(bytes.fromhex("82B182F182C982BF82CD"), "Shift_JIS")[0] == "こんにちは"
    assert d(bytes.fromhex("D6D0CEC4"), "GBK")[0] == "中文" == d(bytes.fromhex("A4A4A4E5"), "Big5")[0]
    assert d(bytes.fromhex("C7D1B1B9"), "EUC-KR")[0] == "한국"
    assert d(bytes.fromhex("FFFE68006900"), "utf-16")[0] == "hi"
    assert d(b"\x81", "windows-1252")[0] == "\x81"
    assert d(b"bytes", "x-not-real") == ("bytes", "x-not-real")


def test_guard():
    assert "scheme" in readers.guard("file:///etc/passwd")
    assert "port 22" in readers.guard("http://example.org:22/")
    assert "not public" in readers.guard("http://127.0.0.1/")
    assert "local" in readers.guard("http://a.localhost/")
    assert readers.guard("http://8.8.8.8/") is None


def test_fetch_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Site(BaseHTTPRequestHandler):
        seen = []

        def do_GET(self):
            self.seen.append(self.path)
            if self.path == "/flaky" and self.seen.count("/flaky") == 1:
                self.send_response(503), self.end_headers()
                return
            if self.path == "/hop":
                self.send_response(302), self.send_header("Location", "/page"), self.end_headers()
                return
            self.send_response(200), self.send_header("Content-Type", "text/html"), self.end_headers()
            self.wfile.write(b"<main>hello</main>")

        def log_message(self, *_):
            pass

    site = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{site.server_port}"
    spark.dataSource.register(readers.FetchSource)
    read = lambda **o: {r["url"]: r for r in spark.read.format("fetch").options(urls=json.dumps([f"{base}/hop", f"{base}/flaky"]), **o).load().collect()}
    got = read(allow_private="true")
    assert got[f"{base}/hop"]["final_url"] == f"{base}/page" and bytes(got[f"{base}/flaky"]["body"]) == b"<main>hello</main>"
    assert all("not public" in r["error"] for r in read().values())
    site.shutdown()


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<meta charset=shift_jis>こ".encode("cp932"))
    (tmp_path / "b.html").write_bytes(b"<meta charset=zzz>x")
    got = {r["path"][-6:]: (r["body"], r["undecodable"]) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.html": ("<meta charset=shift_jis>こ", None), "b.html": ("<meta charset=zzz>x", "zzz")}


def test_files_are_whole(spark, tmp_path):
    big = ("0123456789abcde\n" * (6 << 16))[:-1]
    (tmp_path / "big.txt").write_text(big)
    assert readers.read_files(spark, str(tmp_path / "big.txt")).first()["body"] == big
    stored = [(1, "u", big), (2, "u", "<p>é\n\n</p>\n"), (3, "u", ""), (4, "u", None)]
    spark.createDataFrame(stored, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = [r["n"] for r in registry.QUERIES["scan_files"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(len((h or "").encode()) for _, _, h in stored)


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "x.txt").write_text('{"id":1,"method":"ping"}\n\n{bad\n{"method":"n"}\n{"id":"a","method":"zzz"}\n{"id":null,"method":"ping"}\n[1]\n7\n')
    rpc.serve(spark, str(src), str(out), str(tmp_path / "ck")).awaitTermination()
    lines = sorted(json.loads(r["value"])["id"].__str__() for r in spark.read.text(f"{out}/*").collect())
    assert lines == ["1", "None", "a"]


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / "s.json"
    f.write_text('{"thresher": {"search": {"providers": {"brave": {"api_key": "secret"}}}, "fetch": {"max_tokens": 9}}}')
    s, warn = readers.load_settings(str(f))
    assert s.max_tokens == 9 and warn is None
    assert "secret" not in repr(readers.provider_for("brave", s))
    f.write_text('{"secret')
    assert "secret" not in readers.load_settings(str(f))[1]


def test_media_branches(spark):
    rows = [(1, "application/json", '{"b":1,"a":[2]}'), (2, "image/png", "xx"), (3, None, "  just words "), (4, "application/json", " {not "), (5, "text/html", "<div id=r></div><script>x</script>"), (6, None, None), (7, "text/html", "<div>" * 10001)]
    df = spark.createDataFrame(rows, "k int, ct string, html string").withColumn("url", F.lit(None).cast("string")).withColumn("title", F.lit("clash"))
    got = {r["k"]: r for r in pages.convert_pages(df, content_type="ct").collect()}
    assert got[1]["content"] == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}' and got[1]["content_type"] == "structured"
    assert got[2]["content"] == "[non-text content: image/png, 2 bytes — not rendered]" and got[2]["media"] == "image/png"
    assert got[3]["content"] == "just words" and got[4]["content"] == "{not"
    assert got[5]["status"] == "needs_js" and got[6]["status"] == "empty" and got[7]["status"] == "too_complex"
    assert got[1]["title"] == ""


def _site(routes):
    """A loopback site; ``routes`` maps a path to (status, headers, body) or a list of them by turn."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Site(BaseHTTPRequestHandler):
        seen = []

        def do_GET(self):
            self.seen.append((self.path, dict(self.headers), self.rfile.read(int(self.headers.get("Content-Length") or 0))))
            path = self.path.partition("?")[0]
            got = routes.get(path, (404, {}, b""))
            if isinstance(got, list):
                got = got.pop(0) if len(got) > 1 else got[0]
            self.send_response(got[0])
            for k, v in got[1].items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(got[2])

        do_POST = do_GET

        def log_message(self, *_):
            pass

    site = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    return site, f"http://127.0.0.1:{site.server_port}", Site.seen


SERP = b'<a class="result-link" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx">One</a><td class="result-snippet">first</td><a class="result-link" href="https://b.org/">Two</a>'
HITS = json.dumps({"results": [{"title": "T", "url": "https://a.org", "content": "c"}, {"title": "no url"}, {"url": "https://b.org"}]}).encode()


def test_provider_requests():
    P, ask = readers.Provider, providers.request_for
    assert ask(P(), "a b*~", safe=True).full_url == "https://lite.duckduckgo.com/lite/?q=a%20b%2A~&kp=1"
    r = ask(P("brave", "k"), "q", 50, False)
    assert r.full_url.endswith("?q=q&count=20&safesearch=off") and r.get_header("X-subscription-token") == "k"
    r = ask(P("tavily", "k"), "q", 3, True)
    assert json.loads(r.data) == {"query": "q", "max_results": 3} and r.get_header("Authorization") == "Bearer k"
    r = ask(P("searxng", None, "http://s/x/"), "q", 3, True)
    assert r.full_url == "http://s/x/search?q=q&format=json&safesearch=2" and r.get_header("Authorization") is None


def test_provider_answers(spark):
    site, base, seen = _site({"/ddg": [(202, {}, b""), (503, {}, b""), (200, {}, SERP)], "/s/search": (200, {}, HITS), "/bad/search": (403, {}, b" no quota "), "/odd/search": (200, {}, b"<html>")})
    ddg, searx = readers.Provider(base_url=f"{base}/ddg"), readers.Provider("searxng", None, f"{base}/s")
    got = providers.answer("q", ddg)
    assert [(r["title"], r["snippet"], r["url"]) for r in got["results"]] == [("One", "first", "https://a.org/x"), ("Two", "", "https://b.org/")]
    assert len(seen) == 3 and got["status"] == "ok"
    bad, odd = readers.Provider("searxng", None, f"{base}/bad"), readers.Provider("searxng", None, f"{base}/odd")
    assert "no quota" in providers.ask(bad, "q")["error"]
    assert providers.answer("q", bad, searx)["result_count"] == 2 == providers.answer("q", odd, searx)["result_count"]
    assert providers.answer("q", odd, bad)["status"] == "blocked"
    seen.clear()
    rows = {r["query"]: r for r in providers.replies(spark, ["a", "b"], searx, 1).collect()}
    assert set(rows) == {"a", "b"} and len(seen) == 2 and [h["url"] for h in rows["a"]["results"]] == ["https://a.org"]
    assert {r["status"] for r in providers.replies(spark, ["a"], bad).collect()} == {"error"}
    site.shutdown()


def test_one_reply_equals_columns(spark):
    bodies = [HITS.decode(), "{bad", "{}", json.dumps({"results": [{"url": "u", "content": "", "snippet": "s"}, {"url": 3}, {"title": 4, "url": "v", "snippet": "z  z"}]})]
    df = spark.createDataFrame(enumerate(bodies), "k int, b string")
    for provider in ("tavily", "searxng"):
        hits = search.hits_json(F.col("b"), provider, 5)
        want = {r["k"]: ([h.asDict() for h in r["h"] or []], r["s"]) for r in df.select("k", hits.alias("h"), search.json_status(F.col("b"), hits).alias("s")).collect()}
        assert {k: search.parse_reply(b, provider, 5) for k, b in enumerate(bodies)} == want
    serps = [SERP.decode(), "<p class=no-results>none</p>", "<p>anomaly.js", '<td class="result-snippet">orphan</td>' + SERP.decode()]
    df = spark.createDataFrame(enumerate(serps), "k int, h string")
    want = {r["k"]: ([h.asDict() for h in r["results"]], r["status"]) for r in search.parse_pages(df, "k", "h", 5).collect()}
    assert {k: search.parse_reply(h, "duckduckgo", 5) for k, h in enumerate(serps)} == want
    out = {r["query"]: r for r in search.output(spark.createDataFrame([("q", search.parse_reply(SERP.decode(), "duckduckgo", 5)[0], "ok", "p")], f"query string, results array<{search.HIT}>, status string, provider string"), "query", "results", "status", "provider").collect()}["q"]
    mine = search.output_row("q", search.parse_reply(SERP.decode(), "duckduckgo", 5)[0], "ok", "p")
    assert out.asDict(True) == mine


def test_one_page_equals_columns(spark):
    rows = [("application/json", '{"b":1,"a":[2]}'), ("image/png", "xx"), (None, "  just words "), ("application/json", " {not "), ("text/html", "<div id=r></div><script>x</script>"), (None, ""), ("text/html", "<div>" * 10001), ("text/html", "<title>T</title><main><h1>T</h1><p>a <a href=/x>b</a></p></main>"), (None, "[1")]
    df = spark.createDataFrame([(k, *r, "https://h/") for k, r in enumerate(rows)], "k int, ct string, html string, url string")
    for output, most in (("text", None), ("markdown", 8), ("structured", 50)):
        got = {r["k"]: r for r in pages.convert_pages(df, content_type="ct", output=output, max_tokens=most).collect()}
        for k, (ct, body) in enumerate(rows):
            mine = pages.convert_row(body, "https://h/", ct, output, most)
            assert {c: got[k][c] for c in ("title", "content", "content_type", "media", "token_estimate", "status")} == {c: mine[c] for c in ("title", "content", "content_type", "media", "token_estimate", "status")}, (k, output)


def test_fetch_pages_decodes(spark):
    site, base, _ = _site({"/p": (200, {"Content-Type": "text/html; charset=iso-8859-1"}, b"<main>Caf\xe9</main>"), "/m": (200, {"Content-Type": "text/html"}, "<meta charset=shift_jis><main>こ</main>".encode("cp932"))})
    got = {r["source"][-2:]: r for r in readers.fetch_pages(spark, [f"{base}/p", f"{base}/m", f"{base}/no"], allow_private="true").collect()}
    assert got["/p"]["content"] == "Café" and got["/m"]["content"] == "こ" and got["no"]["error"] == "HTTP 404"
    site.shutdown()


def test_pinned_addresses():
    site, base, seen = _site({"/x": (200, {}, b"ok")})
    port = base.rsplit(":", 1)[1]
    with transport.opener(addresses=["127.0.0.1"]).open(f"http://name.invalid:{port}/x", timeout=5) as r:
        assert r.read() == b"ok"
    assert seen[0][1]["Host"] == f"name.invalid:{port}"
    site.shutdown()


def test_tls(tmp_path):
    import ssl

    assert transport.Tls(insecure=True).context().verify_mode == ssl.CERT_NONE
    assert transport.Tls().context().verify_mode == ssl.CERT_REQUIRED
    got = readers.fetch_one("https://8.8.8.8/", 1, tls=transport.Tls((str(tmp_path / "absent.pem"),)))
    assert "absent.pem" in got["error"]
    assert transport.Tls.of({"ca_certs": "a, b", "insecure": "true"}) == transport.Tls(("a", "b"), True)


def test_provider_settings(monkeypatch):
    S = readers.Settings
    assert readers.primary_provider(S()).name == "duckduckgo" and readers.primary_provider(S(provider="ddg")).name == "duckduckgo"
    tavily = S(provider="tavily", providers={"tavily": {"api_key": "file"}}, fallback="brave")
    assert readers.primary_provider(tavily).api_key == "file"
    monkeypatch.setenv("THRESHER_TAVILY_API_KEY", "env")
    primary = readers.primary_provider(tavily)
    assert primary.api_key == "env"
    other, warning = readers.fallback_provider(tavily, primary)
    assert other is None and "brave" in warning
    assert readers.fallback_provider(S(fallback="ddg"), primary)[0].name == "duckduckgo"
    assert readers.fallback_provider(S(fallback="tavily"), primary) == (None, None) == readers.fallback_provider(S(fallback="none"), primary)


def test_tool_calls(spark, tmp_path):
    site, base, _ = _site({"/p": (200, {"Content-Type": "text/html"}, b"<title>T</title><main><p>hi</p></main>"), "/e": (200, {"Content-Type": "text/html"}, b"<main></main>"), "/s/search": (200, {}, HITS)})
    settings = readers.Settings(provider="searxng", providers={"searxng": {"base_url": f"{base}/s"}})
    call = lambda i, name, **args: json.dumps({"id": i, "method": "tools/call", "params": {"name": name, "arguments": args}})
    src = tmp_path / "in"
    src.mkdir()
    lines = [call(1, "fetch", url=f"{base}/p"), call(2, "fetch", url=f"{base}/e"), call(3, "search", query="q"), call(4, "nope"), call(5, "fetch"), call(6, "fetch", url=f"{base}/p", json=True), json.dumps({"id": 7, "method": "tools/list"}), json.dumps({"id": 8, "method": "initialize", "params": {"protocolVersion": "2025-06-18"}})]
    (src / "x.txt").write_text("\n".join(lines))
    rpc.serve(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), rpc.Service(settings, True)).awaitTermination()
    got = {r["id"]: r["result"] for r in (json.loads(x["value"]) for x in spark.read.text(f"{tmp_path}/out/*").collect())}
    text = lambda i: got[i]["content"][0]["text"]
    assert text(1) == f"T\n{base}/p\n\nhi" and "isError" not in got[1]
    assert got[2]["isError"] and text(2).endswith("no text]")
    assert text(3).startswith("T [1]\nc\n\n [2]\n\nReferences:") and "isError" not in got[3]
    assert got[4]["isError"] and text(4) == "unknown tool: nope" and "url" in text(5)
    assert json.loads(text(6))["content"] == "hi"
    assert [t["name"] for t in got[7]["tools"]] == ["fetch", "search"] and got[8]["protocolVersion"] == "2025-06-18"
    assert "not public" in rpc.tool_result(json.dumps({"name": "fetch", "arguments": {"url": base}}), rpc.Service())
    site.shutdown()
