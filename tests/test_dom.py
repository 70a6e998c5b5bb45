"""Tree building, converters, links and budgets on small documents."""

import json

from hypothesis import given
from hypothesis import strategies as st

from thresher.operators import dom
from thresher.operators.pages import blocked_ip, convert_one

BASE = "https://docs.example/guide/"


def page(body: str, head: str = "") -> str:
    return f"<html lang='en'><head>{head}</head><body>{body}</body></html>"


def text(html: str, most=None) -> dict:
    return convert_one(html, BASE, "text", most)


def test_links_are_numbered_once():
    got = text(page("<nav><a href='/out'>x</a></nav><article><p>See <a href='a'>one</a>, <a href='https://o.example/'>two</a> and <a href='a'>again</a>.</p><ul><li>▶ go <a href='#x'>skip</a></li></ul><script>x()</script></article>"))
    assert [r["url"] for r in got["references"]] == ["https://docs.example/guide/a", "https://o.example/"]
    assert got["content"].startswith("See one [1], two [2] and again [1].\ngo skip")
    assert got["content"].endswith("References:\n[1] https://docs.example/guide/a\n[2] https://o.example/")


def test_title_is_dropped_only_when_repeated():
    assert text(page("<main><h1>T</h1><p>b</p></main>", "<title>T</title>"))["content"] == "b"
    assert text(page("<main><h1>U</h1><p>b</p></main>", "<title>T</title>"))["content"] == "U\nb"


def test_blocks_keep_kinds_and_inner_first():
    html = page("<main><h2>H</h2><p>a</p><ul><li>x<ul><li>y</li></ul></li></ul><pre>c</pre><blockquote>q</blockquote><table><tr><td>a</td><td>b</td></tr></table></main>")
    blocks, _ = dom.to_blocks(dom.parse(html), BASE)
    assert [(b["kind"], b["text"]) for b in blocks] == [("heading", "H"), ("paragraph", "a"), ("paragraph", "x"), ("listitem", "y"), ("code", "c"), ("quote", "q"), ("tablerow", "a b")]
    assert blocks[0]["level"] == 2


def test_markdown_and_cells():
    md, _ = dom.to_markdown(dom.parse(page("<main><h1>T</h1><p>a <code>b</code> <a href='/c'>d</a></p></main>")), BASE)
    assert dom.compress_block(md) == "# T\na `b` [d](https://docs.example/c)"
    assert "Name | Type" in text(page("<main><table><tr><th>Name</th><th>Type</th></tr></table></main>"))["content"]


def test_content_root_order():
    root = lambda b: dom.content_root(dom.parse(page(b))).name
    assert root("<main>a</main><article>b</article>") == "article"
    assert root("<div role='main'>a</div><div>longer text</div>") == "div"
    assert dom.all_text(dom.content_root(dom.parse(page("<div>a</div><div>bbb</div>")))) == "bbb"
    assert root("<p>x</p>") == "body"


def test_implied_end_tags_and_entities():
    doc = dom.parse("<title>A &amp B</title><p><b>one<br><p>two</b><p>three &lt;x&gt;")
    assert dom.title(doc) == "A & B"
    assert dom.compress_block(dom.to_text(doc, "")[0]) == "one\ntwo\nthree <x>"


def test_metadata():
    head = "<meta name=description content=' d '><meta property='article:author' content='w'><meta name='date' content='2020'><meta property='og:site_name' content='s'>"
    assert dom.metadata(dom.parse(page("", head))) == {"description": "d", "author": "w", "published": "2020", "lang": "en", "site_name": "s"}


def test_resolve():
    r = lambda h: dom.resolve(h, BASE)
    assert r("../é?q=ü") == "https://docs.example/%C3%A9?q=%C3%BC"
    assert r("HTTP://EX.org:80/a/./b/../c") == "http://ex.org/a/c"
    assert [r(x) for x in ("javascript:1", "mailto:a@b", "#f", " ", "tel:1", "data:x")] == [None] * 6
    assert dom.resolve("/a", "") is None


def test_depth():
    assert dom.depth("<!doctype html><br><img/><!-- <p><p> --><div></div>") == 1
    assert dom.depth("<div>" * 400) == 400


def test_deep_pages_convert():
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000)["content"] == "deep"


def test_budgets():
    html = page("<main>" + "".join(f"<p>Item {k} <a href='https://long.example/path/{k}?q={k}'>link {k}</a></p>" for k in range(120)) + "</main>")
    for most in (50, 200, 1000):
        got = text(html, most)
        assert dom.estimate(got["content"]) <= most
        assert {r["index"] for r in got["references"]} <= dom.cited(got["content"])
        whole = convert_one(html, BASE, "structured", most)["content"]
        json.loads(whole)
        assert most < 60 or dom.estimate(whole) <= most


@given(st.text(max_size=400), st.integers(4, 60))
def test_truncation_stays_in_budget(s, n):
    assert dom.estimate(dom.truncate(s, n)) <= n or dom.estimate(s) <= n


@given(st.text(alphabet="<>/abp lih1 =\"'&;!-", max_size=200))
def test_any_markup_converts(s):
    for output in ("text", "markdown", "structured"):
        convert_one(s, BASE, output, 50)


def test_addresses():
    assert all(blocked_ip(x) for x in ("127.0.0.1", "10.1.2.3", "::1", "fe80::1", "64:ff9b::a00:1", "2002:7f00:1::", "::ffff:10.0.0.1"))
    assert not any(blocked_ip(x) for x in ("8.8.8.8", "2606:4700::1111", "64:ff9b::808:808"))
    assert blocked_ip("example.org") is None


def test_row_and_column_forms_agree(spark):
    import random

    from pyspark.sql import functions as F

    from thresher.functions import web as W
    from thresher.operators import dom, search

    r = random.Random(3)
    bits = ["<div>", "</div>", "<br>", "<p", ">", "<!--", "-->", "<a title='<!--'>", "<!x>", "x", "<?p", "/>", "<IMG src=a>", "< ", "\n"]
    pages = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(400)]
    links = ["//D.example", "HTTPS://D.example:443/a b", "http://x.example:80?q=é", "/l/?uddg=https%3A%2F%2Fa.example%2Fb", "", "  https://a.example/p/q?x#y ", "mailto:a@b", "https://a.example:8443"]
    rows = [(k, p, links[k % len(links)]) for k, p in enumerate(pages)]
    got = spark.createDataFrame(rows, "k int, h string, u string").select("k", W.nesting_depth(F.col("h")).alias("d"), W.ddg_unwrap(F.col("u")).alias("u")).collect()
    assert [x["d"] for x in sorted(got)] == [dom.depth(p) for p in pages]
    assert [x["u"] for x in sorted(got)] == [search.unwrap(u) for _, _, u in rows]


def test_charset_labels():
    from thresher.functions.web import charset_names
    from thresher.sources.readers import decode_bytes

    names = charset_names()
    for label, name in {"koi8": "KOI8-R", "gb_2312-80": "GBK", "x-euc-jp": "EUC-JP", "ks_c_5601-1987": "EUC-KR", "ucs-2": "UTF-16LE", "logical": "ISO-8859-8-I", "x-mac-cyrillic": "x-mac-cyrillic", "mac": "macintosh", "cn-big5": "Big5", "dos-874": "windows-874", "sun_eu_greek": "ISO-8859-7", "unicode11utf8": "UTF-8", "iso_8859-2:1987": "ISO-8859-2", "cp1251": "windows-1251"}.items():
        assert names[label] == name
    assert all(decode_bytes(b"abc", label)[1] is None for label in names)
