"""HTML to a tree, and the tree to text, markdown or typed blocks.

The tree builder follows the HTML tree-construction rules that bear on text:
raw text elements, implied end tags, void elements, table scopes and the
reopening of formatting elements. Everything is iterative, so depth is no limit.
"""

from __future__ import annotations

import html as _html
import json
import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

#: Element classes of the output rules.
SKIPPED = {"script", "style", "noscript", "svg", "head", "template", "iframe"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "aside", "nav", "main"}
KINDS = {"li": "listitem", "pre": "code", "blockquote": "quote", "tr": "tablerow", "p": "paragraph"}
DECORATIVE = re.compile("[▶→←▼▲•·◆◇◊✓✗✔✘‣⁃◦]")

SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = re.compile(f"[{SPACE}]+")
_STRIP = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SEPARATORS = re.compile("[\x1c-\x1f]")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "iframe", "xmp", "noembed", "noframes"}
_RCDATA = {"title", "textarea"}
_CLOSES_P = BLOCKS | {"address", "center", "details", "dialog", "dir", "dl", "fieldset", "figcaption", "form", "hgroup", "hr", "menu", "search", "summary", "dd", "dt"} - {"tr"}
_FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
_SCOPE = {"applet", "caption", "html", "table", "td", "th", "marquee", "object", "template"}
_P_SCOPE = _SCOPE | {"button"}
_LI_SCOPE = _P_SCOPE | {"li", "ul", "ol"}
_REOPENING = _FORMATTING | {"span", "br", "img", "input", "label", "sup", "sub"}
_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title", "noscript"}
_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|$)|(?P<decl>[!?][^>]*>?)|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BARE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9=]))")


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), _BARE.sub(lambda e: _html.unescape(e[0]), value) if "&" in value else value)
    return out


class Builder:
    def __init__(self):
        self.root = Node("html")
        self.head = self.body = None
        self.stack = [self.root]
        self.lost: list[Node] = []  # formatting elements closed by their block, to be reopened

    def _body(self) -> Node:
        if self.body is None:
            self.body = Node("body")
            self.root.children.append(self.body)
            self.stack = [self.root, self.body]
        return self.body

    def _push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.stack.append(node)

    def _reopen(self) -> None:
        for n in self.lost:
            self._push(Node(n.name, n.attrs))
        self.lost = []

    def _pop_to(self, name: str, scope=_SCOPE) -> bool:
        for k in range(len(self.stack) - 1, 1, -1):
            if self.stack[k].name == name:
                self.lost += [n for n in self.stack[k + 1 :] if n.name in _FORMATTING and name not in _FORMATTING]
                del self.stack[k:]
                return True
            if self.stack[k].name in scope:
                return False
        return False

    def text(self, data: str) -> None:
        if self.body is None:
            if not data.strip(" \t\n\f\r"):
                return
            self._body()
        if self.lost and data.strip(" \t\n\f\r"):
            self._reopen()
        self.stack[-1].children.append(data)

    def start(self, name: str, raw: str) -> Node | None:
        if name == "html":
            for k, v in _attributes(raw).items():
                self.root.attrs.setdefault(k, v)
            return None
        if name == "head":
            if self.head is None and self.body is None:
                self.head = Node("head", _attributes(raw))
                self.root.children.append(self.head)
                self.stack = [self.root, self.head]
            return None
        if name == "body":
            self._body()
            for k, v in _attributes(raw).items():
                self.body.attrs.setdefault(k, v)
            return None
        node = Node(name, _attributes(raw) if raw and not raw.isspace() else None)
        if self.body is None and name in _HEAD:
            if self.head is None:
                self.head = Node("head")
                self.root.children.append(self.head)
                self.stack = [self.root, self.head]
            elif self.stack[-1] is self.root:
                self.stack = [self.root, self.head]
            self._add(node, name, raw)
            return node
        self._body()
        if name in _CLOSES_P:
            self._pop_to("p", _P_SCOPE)
        if name == "li":
            self._implied({"li"}, {"ul", "ol"} | _SCOPE)
            self._pop_to("p", _LI_SCOPE)
        elif name in ("dd", "dt"):
            self._implied({"dd", "dt"}, {"dl"} | _SCOPE)
        elif name in ("td", "th"):
            self._implied({"td", "th"}, {"tr", "table", "html"})
            if not any(n.name == "tr" for n in self.stack) and any(n.name == "table" for n in self.stack):
                self._push(Node("tr"))
        elif name == "tr":
            self._implied({"td", "th", "caption"}, {"table", "html"})
            self._implied({"tr"}, {"table", "html"})
        elif name in ("tbody", "thead", "tfoot"):
            for inner in ({"td", "th", "caption"}, {"tr"}, {"tbody", "thead", "tfoot"}):
                self._implied(inner, {"table", "html"})
        elif name in ("option", "optgroup"):
            self._implied({"option"}, {"select", "datalist"})
        elif name in _HEADINGS and self.stack[-1].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.stack.pop()
        if name == "a":
            self.lost = [n for n in self.lost if n.name != "a"]
            self._pop_to("a")
        if self.lost and name in _REOPENING:
            self._reopen()
        self._add(node, name, raw)
        return node

    def _add(self, node: Node, name: str, raw: str) -> None:
        if name in _VOID:
            self.stack[-1].children.append(node)
        else:
            self._push(node)

    def _implied(self, names: set[str], stop: set[str]) -> None:
        for k in range(len(self.stack) - 1, 1, -1):
            if self.stack[k].name in names:
                self.lost += [n for n in self.stack[k + 1 :] if n.name in _FORMATTING]
                del self.stack[k:]
                return
            if self.stack[k].name in stop:
                return

    def end(self, name: str) -> None:
        if name == "head":
            if self.stack[-1] is self.head:
                self.stack = [self.root]
            return
        if name in ("html", "body"):
            return
        if name == "br":
            self.start("br", "")
            return
        if self.body is None:
            return
        if name == "p" and not any(n.name == "p" for n in self.stack):
            self.start("p", "")
        if name in _FORMATTING and any(n.name == name for n in self.lost):
            k = max(i for i, n in enumerate(self.lost) if n.name == name)
            del self.lost[k]
            return
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            for k in range(len(self.stack) - 1, 1, -1):
                if self.stack[k].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    name = self.stack[k].name
                    break
        if name in _FORMATTING:
            # What stays open inside is opened again after it.
            for k in range(len(self.stack) - 1, 1, -1):
                if self.stack[k].name == name:
                    inner = [n for n in self.stack[k + 1 :] if n.name in _FORMATTING]
                    if any(n.name in _CLOSES_P for n in self.stack[k + 1 :]):
                        return
                    del self.stack[k:]
                    self.lost = inner + self.lost
                    return
            return
        self._pop_to(name, _SCOPE if name not in ("table", "td", "th", "tr", "caption") else {"html"})


def parse(source: str) -> Node:
    b, at, n = Builder(), 0, len(source)
    source = source.replace("\r\n", "\n").replace("\r", "\n") if "\r" in source else source
    n = len(source)
    while at < n:
        k = source.find("<", at)
        if k < 0:
            b.text(_html.unescape(source[at:]))
            break
        m = _TAG.match(source, k)
        if m is None:
            end = source.find("<", k + 1)
            if end < 0:
                tail = source[at:] if not re.match(r"</?[A-Za-z]", source[k:]) else source[at:k]
                if tail:
                    b.text(_html.unescape(tail))
                break
            b.text(_html.unescape(source[at:end]))
            at = end
            continue
        if k > at:
            data = source[at:k]
            b.text(_html.unescape(data) if "&" in data else data)
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            b.end(name)
            continue
        node = b.start(name, m["attrs"].rstrip("/") if m["attrs"].endswith("/") else m["attrs"])
        if node is not None and (name in _RAW or name in _RCDATA):
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            data = source[at : close.start() if close else n]
            if data:
                node.children.append(_html.unescape(data) if name in _RCDATA else data)
            if b.stack[-1] is node:
                b.stack.pop()
            at = close.end() if close else n
    if b.body is None:
        b._body()
    return b.root


# ------------------------------------------------------------ queries


def walk(node: Node):
    """All nodes and strings below, in document order."""
    stack = list(reversed(node.children))
    while stack:
        x = stack.pop()
        yield x
        if isinstance(x, Node):
            stack.extend(reversed(x.children))


def all_text(node: Node) -> str:
    return "".join(x for x in walk(node) if isinstance(x, str))


def trim(s: str) -> str:
    return s.strip(_STRIP)


def compress(s: str) -> str:
    if s.isascii() and not _SEPARATORS.search(s):  # str.split takes these four for blanks, too
        return " ".join(s.split())
    return _WS.sub(" ", DECORATIVE.sub("", s)).strip(" ")


def compress_block(s: str) -> str:
    lines, blank = [], False
    for raw in s.split("\n"):
        line = compress(raw)
        if line or not blank:
            lines.append(line)
        blank = not line
    return trim("\n".join(lines))


class Index:
    """What the queries of a tree need, from one walk: the first element of each kind, in document order."""

    __slots__ = ("first", "divs", "metas")

    def __init__(self, doc: Node):
        self.first, self.divs, self.metas = {}, [], []
        first, stack = self.first, doc.children[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                continue
            name = x.name
            if name in _INDEXED:
                if name == "meta":
                    self.metas.append(x)
                elif name == "div":
                    self.divs.append(x)
                elif name not in first:
                    first[name] = x
            if x.attrs and x.attrs.get("role") == "main":
                first.setdefault("role", x)
            if x.children:
                stack += x.children[::-1]


_INDEXED = frozenset(("article", "main", "body", "title", "h1", "meta", "div"))


def content_root(doc: Node, index: Index | None = None) -> Node | None:
    """article, else main, else role=main, else the div with most text, else body."""
    index = index or Index(doc)
    for key in ("article", "main", "role"):
        if key in index.first:
            return index.first[key]
    if index.divs:
        sizes = _sizes(doc)
        best = max(index.divs, key=lambda d: sizes[id(d)])
        if sizes[id(best)] > 0:
            return best
    return index.first.get("body")


def _sizes(doc: Node) -> dict[int, int]:
    """Trimmed text bytes below every node, in one pass up."""
    sizes: dict[int, int] = {}
    stack: list[tuple[Node, bool]] = [(doc, False)]
    while stack:
        x, done = stack.pop()
        if not done:
            stack.append((x, True))
            stack.extend((c, False) for c in x.children if isinstance(c, Node))
        else:
            sizes[id(x)] = sum(sizes[id(c)] if isinstance(c, Node) else len(trim(c).encode("utf-8", "replace")) for c in x.children)
    return sizes


def title(doc: Node, index: Index | None = None) -> str:
    index = index or Index(doc)
    for name in ("title", "h1"):
        if name in index.first and (t := trim(all_text(index.first[name]))):
            return t
    return ""


def metadata(doc: Node, index: Index | None = None) -> dict[str, str | None]:
    metas = (index or Index(doc)).metas

    def first(*rules: tuple[str, str]) -> str | None:
        for key, value in rules:
            node = next((m for m in metas if m.attrs.get(key) == value), None)
            if node is not None and (c := trim(node.attrs.get("content", ""))):
                return c
        return None

    return {
        "description": first(("name", "description"), ("property", "og:description")),
        "author": first(("name", "author"), ("property", "article:author")),
        "published": first(("property", "article:published_time"), ("name", "date")),
        "lang": trim(doc.attrs.get("lang", "")) or None,
        "site_name": first(("property", "og:site_name")),
    }


# ------------------------------------------------------------ links

_SAFE_PATH, _SAFE_QUERY = "%!$&'()*+,/:;=@[]|~^", "%!$&()*+,/:;=?@[]|~^`{}\\"
_PORTS = {"http": 80, "https": 443, "ftp": 21}


def resolve(href: str, base: str) -> str | None:
    """An absolute URL, or None for anchors, script and mail links and what can't be resolved."""
    h = trim(href)
    if not h or h.startswith("#") or re.match(r"(?i)(?:javascript|mailto|data|tel):", h):
        return None
    h = re.sub(r"[\t\n\r]", "", h)
    absolute = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", h)
    if not absolute and not re.match(r"https?://[^/]", base or ""):
        return None
    try:
        return normalise_url(h if absolute else urljoin(base, h.replace("\\", "/") if not absolute else h))
    except ValueError:
        return None


def normalise_url(url: str) -> str | None:
    u = urlsplit(url)
    scheme = u.scheme.lower()
    if scheme not in _PORTS:
        return url
    if not u.hostname:
        return None
    host = u.hostname
    if not host.isascii():
        host = host.encode("idna").decode()
    host = f"[{host}]" if ":" in host else host
    port = "" if u.port in (None, _PORTS[scheme]) else f":{u.port}"
    user = f"{u.netloc.rpartition('@')[0]}@" if "@" in u.netloc else ""
    parts: list[str] = []
    segments = (u.path or "/").split("/")
    for k, s in enumerate(segments):
        low = s.lower().replace("%2e", ".")
        if low == "..":
            if len(parts) > 1:
                parts.pop()
            if k == len(segments) - 1:
                parts.append("")
        elif low == ".":
            if k == len(segments) - 1:
                parts.append("")
        else:
            parts.append(s)
    path = "/".join(parts) or "/"
    return urlunsplit((scheme, f"{user}{host}{port}", quote(path, safe=_SAFE_PATH), quote(u.query, safe=_SAFE_QUERY), quote(u.fragment, safe=_SAFE_QUERY))) + ("?" if url.endswith("?") else "")


class Links:
    """First-seen numbering of resolved links of one document."""

    def __init__(self, base: str):
        self.base, self.seen, self.refs = base, {}, []

    def number(self, url: str, text: str) -> int:
        if url not in self.seen:
            self.seen[url] = len(self.refs) + 1
            self.refs.append({"index": self.seen[url], "url": url, "text": text})
        return self.seen[url]


# ------------------------------------------------------------ converters


def _events(root: Node):
    """(node or string, opening) in order; what is skipped gives nothing."""
    stack: list = [(c, True) for c in reversed(root.children)]
    while stack:
        x, opening = stack.pop()
        if isinstance(x, str):
            yield x, True
        elif opening:
            if x.name in SKIPPED:
                continue
            yield x, True
            stack.append((x, False))
            stack.extend((c, True) for c in reversed(x.children))
        else:
            yield x, False


class _Buffer:
    __slots__ = ("parts", "last")

    def __init__(self):
        self.parts, self.last = [], ""

    def add(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.last = s[-1]

    def value(self) -> str:
        return "".join(self.parts)


def to_text(doc: Node, base: str, index: Index | None = None) -> tuple[str, list[dict]]:
    root, links = content_root(doc, index), Links(base)
    out = [_Buffer()]
    for x, opening in _events(root) if root else ():
        top = out[-1]
        if isinstance(x, str):
            top.add(x)
        elif x.name == "br":
            if opening:
                top.add("\n")
        elif x.name == "a":
            if opening:
                out.append(_Buffer())
                continue
            inner = trim(out.pop().value())
            out[-1].add(inner)
            url = resolve(x.attrs["href"], base) if "href" in x.attrs else None
            if url:
                out[-1].add(f" [{links.number(url, inner)}]")
        elif x.name in ("td", "th"):
            if opening and top.last not in ("", "\n"):
                top.add(" | ")
        elif x.name in BLOCKS and top.last != "\n" and (not opening or top.last):
            top.add("\n")
    return out[0].value(), links.refs


_PREFIX = {f"h{k}": "\n" + "#" * k + " " for k in range(1, 7)} | {"li": "\n- ", "blockquote": "\n> "}
_NEWLINE = {"p", "div", "section", "h1", "h2", "h3", "h4", "h5", "h6"}


def to_markdown(doc: Node, base: str, index: Index | None = None) -> tuple[str, list[dict]]:
    root, links = content_root(doc, index), Links(base)
    out = [_Buffer()]
    for x, opening in _events(root) if root else ():
        if isinstance(x, str):
            out[-1].add(x)
        elif x.name == "br":
            if opening:
                out[-1].add("\n")
        elif x.name in ("a", "code"):
            if opening:
                out.append(_Buffer())
                continue
            inner = trim(out.pop().value())
            if x.name == "code":
                out[-1].add(f"`{inner}`")
                continue
            url = resolve(x.attrs["href"], base) if "href" in x.attrs else None
            if url:
                links.number(url, inner)
            out[-1].add(f"[{inner}]({url})" if url else inner)
        elif opening:
            out[-1].add(_PREFIX.get(x.name, ""))
        elif x.name in _NEWLINE:
            out[-1].add("\n")
    return out[0].value(), links.refs


def to_blocks(doc: Node, base: str, index: Index | None = None) -> tuple[list[dict], list[dict]]:
    """Typed blocks; an inner block comes before the block around it."""
    root, links = content_root(doc, index), Links(base)
    blocks: list[dict] = []
    loose: list[list[str]] = [[]]
    anchor = None

    def put(kind: str, level: int | None, parts: list[str]) -> None:
        if t := compress("".join(parts)):
            blocks.append({"kind": kind, "level": level, "text": t})

    for x, opening in _events(root) if root else ():
        if anchor is not None:
            if x is anchor:
                anchor = None
            continue
        if isinstance(x, str):
            loose[-1].append(x)
        elif x.name == "a":
            inner = compress(all_text(x))
            loose[-1].append(inner)
            url = resolve(x.attrs["href"], base) if "href" in x.attrs else None
            if url:
                loose[-1].append(f" [{links.number(url, inner)}]")
            anchor = x
        elif x.name in KINDS or x.name in _PREFIX:
            if opening:
                put("paragraph", None, loose[-1])
                loose[-1] = []
                loose.append([])
            else:
                level = int(x.name[1]) if x.name[0] == "h" else None
                put("heading" if level else KINDS[x.name], level, loose.pop())
        elif opening and x.name in ("br", "td", "th"):
            loose[-1].append(" ")
    put("paragraph", None, loose[-1])
    return blocks, links.refs


def blocks_json(blocks: list[dict], refs: list[dict]) -> str:
    shown = [{k: v for k, v in b.items() if v is not None} for b in blocks]
    return json.dumps({"blocks": shown, "references": refs}, indent=2, ensure_ascii=False)


# ------------------------------------------------------------ budget

MARKER, MARKER_COST, FLOOR, PASSES = "\n…[truncated]", 15, 64, 6
_COST = bytes(3 if chr(b) in "/:.?#&=%~" else 1 for b in range(256))


def estimate(s: str) -> int:
    return sum(s.encode("utf-8", "replace").translate(_COST)) // 4


def truncate(s: str, most: int) -> str:
    if estimate(s) <= most:
        return s
    import numpy as np

    raw = s.encode("utf-8", "replace")
    ends = np.cumsum(np.frombuffer(raw.translate(_COST), np.uint8), dtype=np.int64)
    cut = int(np.searchsorted(ends, max(4 * most - MARKER_COST, 0), "right"))
    return raw[:cut].decode("utf-8", "ignore") + MARKER


_CITED = re.compile(r"\[([0-9]+)\]")


def cited(s: str) -> set[int]:
    return {int(x) for x in _CITED.findall(s)}


def ref_block(refs: list[dict]) -> str:
    return trim("References:\n" + "\n".join(f"[{r['index']}] {r['url']}" for r in refs)) if refs else ""


def assemble(body: str, refs: list[dict]) -> str:
    return f"{body}\n\n{ref_block(refs)}" if refs else body


def fit(body: str, refs: list[dict], most: int | None) -> tuple[str, list[dict]]:
    """Body and references within one budget: the body's share shrinks in proportion, then
    references go from the end."""
    if most is None:
        return assemble(body, refs), refs
    share = most
    for k in range(PASSES):
        cut = truncate(body, share)
        marks = cited(cut)
        kept = [r for r in refs if r["index"] in marks]
        whole = assemble(cut, kept)
        total = estimate(whole)
        if total <= most:
            return whole, kept
        after = max(share * most // total, FLOOR)
        if k == PASSES - 1 or share <= FLOOR or after >= share:
            break
        share = after
    while kept and estimate(assemble(cut, kept)) > most:
        kept = kept[:-1]
    return (assemble(cut, kept), kept) if kept else (cut, [])


def fit_blocks(blocks: list[dict], refs: list[dict], most: int | None) -> tuple[str, list[dict]]:
    """The longest run of leading blocks whose JSON fits; always valid JSON."""
    whole = blocks_json(blocks, kept := _cited_refs(blocks, refs))
    if most is None or estimate(whole) <= most:
        return whole, kept
    # Costs add up: those of the frame, of the blocks so far and of the references they cite so far.
    known = {r["index"]: r for r in refs}
    cost = lambda b, r: sum(blocks_json(b, r).encode("utf-8", "replace").translate(_COST))
    empty = cost([], [])
    first_block, first_ref = None, None
    n, total, seen = 0, empty, set()
    for k, b in enumerate(blocks):
        one = cost([b], []) - empty
        if first_block is None:
            first_block = cost([b, b], []) - empty - 2 * one  # what a second item adds beyond the first, less its frame
        total += one + (first_block if k else 0)
        for i in sorted(cited(b["text"]) - seen):
            if i in known:
                more = cost([], [known[i]]) - empty
                if first_ref is None:
                    first_ref = cost([], [known[i]] * 2) - empty - 2 * more
                total += more + (first_ref if seen else 0)
                seen.add(i)
        if total // 4 > most:
            break
        n = k + 1
    kept = _cited_refs(blocks[:n], refs)
    return blocks_json(blocks[:n], kept), kept


def _cited_refs(blocks: list[dict], refs: list[dict]) -> list[dict]:
    marks = cited(" ".join(b["text"] for b in blocks))
    return [r for r in refs if r["index"] in marks]


def depth(source: str) -> int:
    """Deepest nesting by a scan of tags, without a tree."""
    d = top = 0
    for m in re.finditer(r"<!--(?:.*?-->|.*$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z0-9]+)[^>]*?(/?)>", source, re.S):
        if m[2] is None:
            continue
        if m[1]:
            d -= 1
        elif not m[3] and m[2].lower() not in _VOID:
            d += 1
            top = max(top, d)
    return top
