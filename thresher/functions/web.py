"""Predicates and labels of web content: media, charset, guard, status, requests."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

#: Fixed values.
BLOCKED_PORTS = [22, 23, 25, 53, 69, 110, 119, 135, 137, 139, 143, 445, 465, 587, 993, 995, 1433, 3306, 5432, 6379, 11211]
BLOCKED_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
CHALLENGE = ["bots use duckduckgo", "/anomaly", "anomaly.js", "unusual traffic", "are you a robot"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
UTF8_LABELS = ["", "utf-8", "utf8", "unicode-1-1-utf-8", "us-ascii", "ascii"]
PROTOCOLS = ["2024-11-05", "2025-03-26", "2025-06-18"]
PROVIDERS = {"duckduckgo": "duckduckgo", "ddg": "duckduckgo", "brave": "brave", "tavily": "tavily", "searxng": "searxng", "searx": "searxng"}
NOTES = {
    "empty": "the page parsed but contains no text",
    "needs_js": "no text content: the page renders its body with JavaScript, which is not executed here",
    "too_complex": "the document is too deeply nested to parse safely and was refused",
}
MAX_DEPTH = 10_000
BODY_CAP = 5 * 1024 * 1024

any_of = lambda c, xs: c.isin(*xs)


def retry_class(status: Column) -> Column:
    return status.between(500, 599) | (status == 429)


def body_cap(body: Column, most: int = BODY_CAP) -> Column:
    return F.substring(body, 1, most)


def media_type(content_type: Column, body: Column) -> Column:
    """html, json, text or the essence of the header; without a header the body is sniffed."""
    essence = F.lower(trim_space(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    first = F.regexp_extract(body, r"(?U)^\s*(\S)", 1)
    sniffed = F.when(first == "<", "html").when(any_of(first, ["{", "["]) & F.try_parse_json(body).isNotNull(), "json").otherwise("text")
    return F.when(essence.contains("html"), "html").when(essence.contains("json"), "json").when(essence.startswith("text/"), "text").when(essence != "", essence).otherwise(sniffed)


def binary_summary(content_type: Column, body: Column) -> Column:
    return F.format_string("[non-text content: %s, %d bytes — not rendered]", content_type, F.octet_length(body))


def charset_header(header: Column) -> Column:
    found = F.filter(F.transform(F.split(header, ";"), lambda p: F.regexp_extract(p, r"(?i)^\s*charset=(.*)$", 1)), lambda v: F.trim(F.translate(v, '"', "")) != "")
    return F.trim(F.translate(F.get(found, F.lit(0)), '"', ""))


def charset_meta(body: Column) -> Column:
    """The label after the first ``charset`` of the first 2048 bytes, if ``=`` follows."""
    head = F.lower(F.make_valid_utf8(F.substring(body, 1, 2048).cast("string")))
    at = F.instr(head, "charset")
    label = F.regexp_extract(F.substring(head, at + 7, F.length(head)), r"^\s*=\s*[\"']*([a-z0-9_-]+)", 1)
    return F.when((at > 0) & (label != ""), label)


def has_scripts(html: Column) -> Column:
    return F.instr(F.lower(html), "<script") > 0


def content_status(media: Column, content: Column, html: Column, structured: Column | None = None) -> Column:
    blank = trim_space(content) == ""
    if structured is not None:
        blank = blank | (structured & (F.get_json_object(content, "$.blocks") == "[]"))
    return F.when(media != "html", "ok").when(blank & has_scripts(html), "needs_js").when(blank, "empty").otherwise("ok")


def status_note(status: Column) -> Column:
    return F.create_map(*[x for k, v in NOTES.items() for x in (F.lit(k), F.lit(v))])[status]


def nesting_depth(html: Column) -> Column:
    """Deepest open tags: comments, declarations and tags in the order in which they stand, so that none hides in another."""
    marks = F.regexp_extract_all(html, F.lit(r"<!--(?s:.*?)(?:-->|\z)|<[!?][^>]*(?:>|\z)|</?[A-Za-z0-9]+[^>]*>"), F.lit(0))
    still = f"(?i)^<(?:[!?]|(?:{'|'.join(VOID)})(?![A-Za-z0-9]))"
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(s: Column, t: Column) -> Column:
        move = F.when(t.startswith("</"), -1).when(t.rlike(still) | t.endswith("/>"), 0).otherwise(1)
        return F.struct((s["d"] + move).alias("d"), F.greatest(s["m"], s["d"] + move).alias("m"))

    return F.aggregate(marks, start, step, lambda s: s["m"])


def guard_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(trim_space(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https")


def url_host(url: Column) -> Column:
    """The host in lower case, percent escapes decoded."""
    host = F.lower(F.regexp_extract(trim_space(url), r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\\\]{2,}(?:[^/?#@\\\\]*@)?(\[[^\]]*\]|[^/?#:\\\\]*)", 1))
    return F.when(host.contains("%"), F.lower(F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host))).otherwise(host)


def url_port(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):([0-9]+)", 1).try_cast("int")


def guard_port(url: Column) -> Column:
    """False where an explicit port is one of the listed services."""
    return ~F.coalesce(url_port(url).isin(*BLOCKED_PORTS), F.lit(False))


def ipv4_number(host: Column) -> Column:
    """The address that a host is read as: up to four parts, decimal, octal (0) or hexadecimal (0x), the last filling what is left; null where it is none."""
    parts = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    number = lambda p: F.when(p.rlike("^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 16)), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).when(p.rlike("^(?:0|[1-9][0-9]*)$"), p).try_cast("bigint")
    n = F.size(parts)
    numbers = F.transform(parts, number)
    last = F.element_at(numbers, -1)
    fits = (n <= 4) & F.forall(F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), lambda x: x.isNotNull() & (x <= 255)) & (last < F.call_function("shiftleft", F.lit(1).cast("bigint"), (8 * (5 - n)).cast("int")))
    high = F.aggregate(F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    return F.when(host.rlike("^[0-9a-fA-FxX.]+$") & fits, F.call_function("shiftleft", high, (8 * (5 - n)).cast("int")) + last)


def guard_ipv4(host: Column) -> Column:
    """True where the host is an IPv4 literal that is not public; null where it is none."""
    n = ipv4_number(host)
    hit = F.lit(False)
    for base, bits in BLOCKED_V4:
        low = sum(int(x) << (24 - 8 * k) for k, x in enumerate(base.split(".")))
        hit = hit | n.between(low, low + (1 << (32 - bits)) - 1)
    return F.when(n.isNotNull(), hit)


def guard_localname(host: Column) -> Column:
    h = F.lower(host)
    return (h == "localhost") | h.endswith(".localhost")


def ddg_url(query: Column, safe: Column) -> Column:
    q = F.replace(F.replace(F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit("https://lite.duckduckgo.com/lite/?q="), q, F.when(safe, "&kp=1").when(~safe, "&kp=-1").otherwise(""))


def ddg_unwrap(href: Column) -> Column:
    h = trim_space(href)
    absolute = F.when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(h)
    target = F.regexp_extract(absolute, r"[?&]uddg=([^&#]*)", 1)
    return F.when(h == "", "").when(target != "", F.coalesce(F.try_url_decode(target), target)).otherwise(normalised(absolute))


def normalised(url: Column) -> Column:
    """An http or https URL with scheme and host in lower case, no default port and a path; others as they are.
    Blanks and non-ASCII bytes of the rest are percent-encoded."""
    part = lambda k: F.regexp_extract(url, r"^(?i)(https?)://([^/?#]*)([^?#]*)(.*)$", k)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.regexp_replace(host, F.when(scheme == "http", ":(?:80)?$").otherwise(":(?:443)?$"), F.lit(""))
    rest = F.concat(F.when(part(3) == "", "/").otherwise(part(3)), part(4))
    plain, encoded = rest.rlike("^[!-~]*$"), F.replace(F.url_encode(rest), F.lit("+"), F.lit("%20"))
    for c in "!#$%&'()+,/:;=?@[]~^|":
        encoded = F.replace(encoded, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(part(2) != "", F.concat(scheme, F.lit("://"), host, F.when(plain, rest).otherwise(encoded))).otherwise(url)


def serp_status(html: Column, n: Column, has_results_page: Column) -> Column:
    low = F.lower(html)
    hit = F.lit(False)
    for m in CHALLENGE:
        hit = hit | low.contains(m)
    return F.when(n > 0, "ok").when(hit, "blocked").when(has_results_page, "empty").otherwise("blocked")


def provider_name(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv])[F.lower(trim_space(name))]


def rpc_protocol(version: Column) -> Column:
    return F.when(version.isin(*PROTOCOLS), version).otherwise(PROTOCOLS[0])


#: Labels of the web platform's encodings that no rule below gives, by canonical name.
CHARSETS = {
    "UTF-8": "unicode11utf8 unicode20utf8 x-unicode20utf8", "IBM866": "866 cp866 csibm866", "KOI8-R": "cskoi8r koi koi8 koi8_r", "KOI8-U": "koi8-ru",
    "macintosh": "csmacintosh mac x-mac-roman", "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620", "x-mac-cyrillic": "x-mac-ukrainian",
    "windows-1252": "ansi_x3.4-1968 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1",
    "windows-1254": "csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5",
    "GBK": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 iso-ir-58 x-gbk", "Big5": "big5-hkscs cn-big5 csbig5 x-x-big5", "EUC-JP": "cseucpkdfmtjapanese x-euc-jp",
    "ISO-2022-JP": "csiso2022jp", "Shift_JIS": "csshiftjis ms932 ms_kanji shift-jis sjis windows-31j x-sjis", "EUC-KR": "cseuckr csksc56011987 iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "replacement": "csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr", "UTF-16BE": "unicodefffe", "UTF-16LE": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16",
    "ISO-8859-8-I": "csiso88598i logical", "gb18030": "", "x-user-defined": "",
}
#: Registry number, year and further labels of the ISO 8859 parts.
ISO_PARTS = {
    2: ("101", "1987", "l2 latin2 csisolatin2"), 3: ("109", "1988", "l3 latin3 csisolatin3"), 4: ("110", "1988", "l4 latin4 csisolatin4"), 5: ("144", "1988", "cyrillic csisolatincyrillic"),
    6: ("127", "1987", "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i"), 7: ("126", "1987", "csisolatingreek ecma-118 elot_928 greek greek8 sun_eu_greek"),
    8: ("138", "1988", "csiso88598e csisolatinhebrew hebrew iso-8859-8-e visual"), 10: ("157", "", "l6 latin6 csisolatin6"), 13: ("", "", ""), 14: ("", "", ""), 15: ("", "", "l9 csisolatin9 iso_8859-15"), 16: ("", "", ""),
}


@functools.cache
def charset_names() -> dict[str, str]:
    """Charset labels to canonical names: the tables above and the regular spellings of ISO and windows code pages."""
    out = {label: name for name, labels in CHARSETS.items() for label in [name.lower(), *labels.split()]}
    for k, (number, year, more) in ISO_PARTS.items():
        labels = [f"iso-8859-{k}", *([f"iso8859-{k}", f"iso8859{k}"] if k < 16 else []), *([f"iso_8859-{k}"] if k < 9 else []), *([f"iso_8859-{k}:{year}"] if year else []), *([f"iso-ir-{number}"] if number else [])]
        out |= dict.fromkeys([*labels, *more.split()], f"ISO-8859-{k}")
    for k in range(9):
        out |= dict.fromkeys([f"windows-125{k}", f"cp125{k}", f"x-cp125{k}"], f"windows-125{k}")
    return out


def charset_classify(label: Column) -> Column:
    """struct(kind utf8 / supported / unknown, label)."""
    t = F.regexp_replace(F.trim(label), '^"+|"+$', "")
    names = charset_names()
    found = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])[F.lower(t)]
    utf8 = F.lower(t).isin(*UTF8_LABELS)
    return F.struct(F.when(utf8, "utf8").when(found.isNotNull(), "supported").otherwise("unknown").alias("kind"), F.when(utf8, F.lit("UTF-8")).otherwise(F.coalesce(found, t)).alias("label"))
