"""HTML to the document model: a tolerant tree, main-content choice, blocks."""

from __future__ import annotations

import re
import urllib.parse
from html.parser import HTMLParser

from docloom.plans import ir
from docloom.plans.ir import ConversionError, Document
from docloom.sources.text_formats import decode

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks; all else is walked as inline content.
BLOCK = frozenset("address article body div figcaption h1 h2 h3 h4 h5 h6 head hr html img main ol p pre section table ul".split())
INVISIBLE = frozenset("script style template noscript iframe object embed canvas button input select textarea option form".split())
BOILERPLATE = frozenset("nav aside footer".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary dialog".split())
BOILERPLATE_WORDS = frozenset("ad ads advertisement banner breadcrumb cookie footer menu nav navigation promo share sidebar".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
_BARRIER = frozenset("table ul ol dl article section main div body td th".split())
_MARK = {"b": "strong", "strong": "strong", "i": "emphasis", "em": "emphasis", "s": "strike", "del": "strike", "strike": "strike", "u": "underline", "ins": "underline", "sup": "sup", "sub": "sub", "code": "code", "kbd": "code", "samp": "code"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class _Tree(HTMLParser):
    def __init__(self, max_depth: int):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.depth, self.max_depth = 0, max_depth

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = _CLOSES.get(tag, {"p"} if tag in BLOCK else set())
        node = self.at
        while closes and node.parent is not None:
            if node.tag in closes:
                self.at = node.parent
                break
            if node.tag in _BARRIER and not (tag in ("tr", "td", "th", "tbody") and node.tag in ("td", "th")):
                break
            node = node.parent
        child = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child
            depth, n = 0, child
            while n.parent is not None:
                depth, n = depth + 1, n.parent
            if depth > self.max_depth:
                raise ConversionError("resourceLimit", limit="html_nesting_depth")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(s: str, max_depth: int = 256) -> Node:
    t = _Tree(max_depth)
    t.feed(s)
    t.close()
    return t.root


def walk(n: Node):
    yield n
    for c in n.children:
        if isinstance(c, Node):
            yield from walk(c)


def shut_out(n: Node) -> bool:
    """Hidden, not content, or boilerplate."""
    if n.tag in INVISIBLE or n.tag in BOILERPLATE or n.tag in ("svg", "math"):
        return True
    a = n.attrs
    if "hidden" in a or "inert" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    return any(w in BOILERPLATE_WORDS for k in ("id", "class") for w in re.split(r"[\s\-_:.]+", a.get(k, "").lower()))


def _score(n: Node, link: bool = False) -> tuple[int, int]:
    """Content points and link bytes of what is visible."""
    points = links = 0
    for c in n.children:
        if isinstance(c, str):
            size = len(" ".join(c.split()).encode())
            points += size
            links += size * link
        elif not shut_out(c):
            p, k = _score(c, link or c.tag == "a")
            points += p + 80 * (c.tag == "p") + 120 * (c.tag in ("h1", "h2", "h3"))
            links += k
    return points, links


def main_content(root: Node) -> tuple[Node, bool]:
    """The best of main, article, section, div and body by text, paragraphs and headings less links; whether it is a fallback."""
    best, found = None, None
    for n in walk(root):
        if n.tag in ("main", "article") or n.attrs.get("role") == "main":
            up, out = n, False
            while up is not None:
                out, up = out or shut_out(up), up.parent
            if not out:
                p, k = _score(n)
                if best is None or p - 2 * k > best:
                    best, found = p - 2 * k, n
    if found is not None:
        return found, False
    return next((n for n in walk(root) if n.tag == "body"), root), True


def safe_link(s: str) -> bool:
    return bool(s) and "&" not in s and not re.search(r"[\x00-\x20]", s) and bool(re.match(r"(?i)https?://[^/]|mailto:|#|/|\./|\.\./|[^:/?#]+(?:[/?#]|$)", s)) and not re.match(r"(?i)(?:javascript|data|vbscript|file):", s)


def external_image(s: str) -> bool:
    u = urllib.parse.urlsplit(s)
    return u.scheme in ("http", "https") and bool(u.hostname) and not (u.username or u.query or u.fragment) and not re.search(r"%(?![0-9A-Fa-f]{2})", s)


class Reader:
    def __init__(self, base: str | None = None):
        self.base = base if base and not urllib.parse.urlsplit(base).query and not urllib.parse.urlsplit(base).fragment else None
        self.diagnostics: list[tuple[str, str, str]] = []

    def inline(self, n: Node) -> list[ir.Run]:
        """The runs of an element: one space between words, none at edges and breaks."""
        out: list[ir.Run] = []
        spaced = True

        def trim() -> None:
            if out and "break" not in out[-1][1]:
                out[-1] = (out[-1][0].rstrip(" "), *out[-1][1:])
                if not out[-1][0]:
                    out.pop()

        for text, marks, link in self._inline(n):
            if "break" in marks:
                trim()
                out.append((text, marks, link))
                spaced = True
            elif text := (text.lstrip(" ") if spaced else text):
                out.append((text, marks, link))
                spaced = text.endswith(" ")
        trim()
        return out

    def _inline(self, n: Node, marks: frozenset = ir.NONE, link: str | None = None) -> list[ir.Run]:
        out: list[ir.Run] = []
        for c in n.children:
            if isinstance(c, str):
                s = re.sub(r"\s+", " ", c)
                if s:
                    out.append((s, marks, link))
            elif shut_out(c):
                continue
            elif c.tag == "br":
                out.append(ir.BREAK)
            elif c.tag == "a":
                target = c.attrs.get("href", "").strip()
                if target and self.base and not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", target):
                    target = urllib.parse.urljoin(self.base, target)
                if target and not safe_link(target):
                    self.diagnostics.append(("html.linkUriRejected", "warning", target[:200]))
                    target = ""
                out += self._inline(c, marks, target or link)
            elif c.tag in BLOCK and n.tag in BLOCK and c.tag != "img":
                continue
            elif c.tag == "img":
                if c.attrs.get("alt"):
                    out.append((c.attrs["alt"], marks, link))
            else:
                out += self._inline(c, marks | {_MARK[c.tag]} if c.tag in _MARK else marks, link)
        return out

    def blocks(self, n: Node) -> list[dict]:
        out: list[dict] = []
        run = Node("#run", {}, n)

        def flush() -> None:
            runs = self.inline(run)
            run.children.clear()
            if any("break" not in r[1] for r in runs):
                out.append(ir.paragraph(*runs))

        for c in n.children:
            if isinstance(c, str) or c.tag not in BLOCK:
                run.children.append(c)
                continue
            if shut_out(c):
                continue
            flush()
            if c.tag[0] == "h" and c.tag[1:].isdigit():
                if runs := self.inline(c):
                    out.append(ir.heading(int(c.tag[1]), *runs))
            elif c.tag == "p":
                runs = self.inline(c)
                if any("break" not in r[1] for r in runs):
                    out.append(ir.paragraph(*runs))
                out += [b for x in c.children if isinstance(x, Node) and x.tag in BLOCK for b in self.blocks(_only(x))]
            elif c.tag == "pre":
                inner = next((x for x in walk(c) if x.tag == "code"), c)
                language = next((w[9:] for w in inner.attrs.get("class", "").split() if w.startswith("language-")), None)
                out.append(ir.code("".join(_strings(c)), language))
            elif c.tag in ("ul", "ol"):
                items = [b for li in c.children if isinstance(li, Node) and li.tag == "li" and not shut_out(li) for b in [self.blocks(li)] if b]
                if items:
                    start = c.attrs.get("start", "1")
                    out.append(ir.bullet_list(items, c.tag == "ol", int(start) if start.isdigit() else 1))
            elif c.tag == "table":
                out += self.table(c)
            elif c.tag == "hr":
                out.append({"kind": "rule"})
            elif c.tag == "img":
                src, alt = c.attrs.get("src", ""), c.attrs.get("alt", "")
                if external_image(src):
                    out.append({"kind": "image", "uri": src, "alt": alt})
                else:
                    self.diagnostics.append(("html.imageUriRejected", "warning", src[:200]))
                    if alt:
                        out.append(ir.paragraph(ir.text(alt)))
            elif c.tag != "head":
                out += self.blocks(c)
        flush()
        return out

    def table(self, n: Node) -> list[dict]:
        rows, head = [], True
        trs = [t for g in n.children if isinstance(g, Node) for t in ([g] if g.tag == "tr" else [x for x in g.children if isinstance(x, Node) and x.tag == "tr"] if g.tag in ("thead", "tbody", "tfoot") else [])]
        for i, tr in enumerate(trs):
            cells = [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
            span = lambda c, k: max(1, int(c.attrs[k])) if c.attrs.get(k, "").isdigit() else 1
            row = []
            for c in cells:
                runs: list[ir.Run] = []
                for b in self.blocks(c):
                    runs += [ir.BREAK] * (2 * bool(runs)) + b.get("inlines", [ir.text(ir.render_block(b))])
                row.append((runs, min(span(c, "rowspan"), len(trs) - i), span(c, "colspan")))
            if i == 0:
                head = bool(cells) and all(c.tag == "th" for c in cells)
            if row:
                rows.append(row)
        return [ir.table(rows, header=head)] if rows else []


def _only(n: Node) -> Node:
    holder = Node("#one", {}, n.parent)
    holder.children.append(n)
    return holder


def _strings(n: Node):
    for c in n.children:
        if isinstance(c, str):
            yield c
        else:
            yield from _strings(c)


def html_blocks(s: str, base: str | None = None) -> list[dict]:
    """Blocks of a fragment."""
    return Reader(base).blocks(tree(s))


def metadata(root: Node) -> tuple[str | None, list[str], dict[str, str]]:
    title, authors, found = None, [], {}
    for n in walk(root):
        if n.tag == "title" and title is None:
            title = " ".join("".join(_strings(n)).split()) or None
        elif n.tag == "html" and n.attrs.get("lang"):
            found["lang"] = n.attrs["lang"]
        elif n.tag == "meta":
            name = (n.attrs.get("name") or n.attrs.get("property") or "").lower()
            if name == "author":
                authors.append(n.attrs.get("content", ""))
            elif name in ("description", "keywords") or name.startswith("og:"):
                found.setdefault(name, n.attrs.get("content", ""))
    return title, authors, found


def html_document(data: bytes, base: str | None = None, max_depth: int = 256, **_) -> Document:
    declared = re.search(rb"""<meta[^>]+charset=["']?([\w-]+)""", data[:1024], re.I)
    s = decode(data, declared[1].decode() if declared and declared[1].lower() not in (b"utf-8", b"utf8") else None)
    root = tree(s, max_depth)
    found = next((n.attrs["href"] for n in walk(root) if n.tag == "base" and n.attrs.get("href")), base)
    reader = Reader(found)
    content, fallback = main_content(root)
    doc = Document(blocks=reader.blocks(content), diagnostics=reader.diagnostics)
    if fallback:
        doc.diagnostics.append(("html.mainContentFallback", "info", ""))
    doc.title, doc.authors, doc.properties = metadata(root)
    return doc
