"""The document model that parsers fill, and its rendering to Markdown.

A document is a list of blocks in reading order; a block is a dict with a
`kind`.  Inline content is a list of (text, marks, link) runs, where marks is
a frozenset of names and a line break is the text "\\n" with the mark "break".
`nodes` flattens a document to the rows of the node table; `render` gives
GitHub-Flavored Markdown.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

Run = tuple[str, frozenset, "str | None"]
NONE: frozenset = frozenset()
BREAK: Run = ("\n", frozenset({"break"}), None)
MAX_DEPTH = 16


@dataclass
class Document:
    blocks: list[dict] = field(default_factory=list)
    title: str | None = None
    authors: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)
    diagnostics: list[tuple[str, str, str]] = field(default_factory=list)  # code, severity, message
    assets: list[dict] = field(default_factory=list)


class ConversionError(Exception):
    """A conversion that ends with an error code, and a limit's name if one was passed."""

    def __init__(self, code: str, message: str = "", limit: str | None = None):
        super().__init__(message or code)
        self.code, self.limit = code, limit


def text(s: str, *marks: str, link: str | None = None) -> Run:
    return (s, frozenset(marks), link)


def lines(s: str) -> list[Run]:
    """Text with its line ends as breaks."""
    out: list[Run] = []
    for i, x in enumerate(re.split(r"\r\n|\r|\n", s)):
        out += [BREAK] * (i > 0) + ([text(x)] if x else [])
    return out


def paragraph(*runs: Run) -> dict:
    return {"kind": "paragraph", "inlines": list(runs)}


def heading(level: int, *runs: Run) -> dict:
    return {"kind": "heading", "level": max(1, min(6, level)), "inlines": list(runs)}


def code(s: str, language: str | None = None) -> dict:
    return {"kind": "code", "text": s, "language": language}


def bullet_list(items: list[list[dict]], ordered: bool = False, start: int = 1, checked: list | None = None) -> dict:
    return {"kind": "list", "ordered": ordered, "start": start, "items": items, "checked": checked or [None] * len(items)}


def table(rows: list[list], header: bool = False, alignments: list | None = None) -> dict:
    """Rows of cells; a cell is a list of runs, or (runs, row span, column span)."""
    return {"kind": "table", "rows": [[c if isinstance(c, tuple) and len(c) == 3 and isinstance(c[0], list) else (c, 1, 1) for c in r] for r in rows], "header": header, "alignments": alignments}


def container(kind: str, blocks: list[dict], name: str | None = None, number: int | None = None) -> dict:
    return {"kind": kind, "blocks": blocks, "name": name, "number": number}


def plain(runs: list[Run]) -> str:
    return "".join(" " if "break" in m else t for t, m, _ in runs)


# -- escaping ----------------------------------------------------------------

_SPECIAL = re.compile(r"[\\`*\[\]<~]|(?<![^\W_])_|_(?![^\W_])")


def escape_run(s: str, cell: bool = False) -> str:
    s = _SPECIAL.sub(lambda m: "\\" + m[0], s.replace("&", "&amp;"))
    return s.replace("|", "\\|") if cell else s


def protect_paragraph(s: str) -> str:
    """Line starts that would be read as block markers are escaped."""
    out = []
    for line in s.split("\n"):
        if line.startswith("\t"):
            line = "&#9;" + line[1:]
        elif line.startswith("    "):
            line = "&#32;" + line[1:]
        m = re.match(r" {0,3}", line)
        head, rest = m[0], line[m.end() :]
        if re.match(r"(?:>|#{1,6}(?:\s|$)|[+-](?:\s|$)|=+\s*$|-+\s*$)", rest):
            rest = "\\" + rest
        elif n := re.match(r"(\d{1,9})([.)])(?=\s|$)", rest):
            rest = f"{n[1]}\\{rest[len(n[1]) :]}"
        out.append(head + rest)
    return "\n".join(out)


def code_span(s: str) -> str:
    s = s.replace("\r\n", "\n").replace("\r", "\n").replace("\n", " ")
    if not s.strip(" "):
        return f"<code>{s}</code>"
    fence = "`" * (max(map(len, re.findall(r"`+", s)), default=0) + 1)
    pad = " " if s[0] == "`" or s[-1] == "`" or (s[0] == s[-1] == " ") else ""
    return f"{fence}{pad}{s}{pad}{fence}"


def fenced(s: str, language: str | None = None) -> str:
    s = s.replace("\r\n", "\n").replace("\r", "\n")
    fence = "`" * max(3, max(map(len, re.findall(r"`+", s)), default=0) + 1)
    return f"{fence}{language or ''}\n{s}{'' if s.endswith(chr(10)) or not s else chr(10)}{fence}"


def link_target(s: str, cell: bool = False) -> str:
    out = []
    for ch in s:
        if ch == "&":
            out.append("&amp;")
        elif ch <= " " or ch in "<>\\" or ch == "\x7f" or (ch > "\x7f" and ch.isspace()) or (cell and ch == "|"):
            out.append("".join(f"%{b:02X}" for b in ch.encode()))
        else:
            out.append(ch)
    return "".join(out)


_MARKS = (("strong", "**", "strong"), ("emphasis", "*", "em"), ("strike", "~~", "del"), ("underline", None, "u"), ("sup", None, "sup"), ("sub", None, "sub"))


def render_inlines(runs: list[Run], cell: bool = False, one_line: bool = False) -> str:
    merged: list[Run] = []
    for t, m, link in runs:
        if merged and "break" not in m and "break" not in merged[-1][1] and merged[-1][1] == m and merged[-1][2] == link:
            merged[-1] = (merged[-1][0] + t, m, link)
        elif t:
            merged.append((t, m, link))
    out = []
    for i, (t, m, link) in enumerate(merged):
        if "break" in m:
            edge = i in (0, len(merged) - 1) or "break" in merged[i - 1][1] or "break" in merged[i + 1][1]
            out.append("<br>" if edge or cell or one_line else "  \n")
            continue
        if "code" in m:
            s = code_span(t)
        elif "formula" in m:
            s = f"${t}$"
        else:
            s = escape_run(t, cell)
            s = s.replace("\n", "<br>") if cell or one_line else re.sub(r" {2}\n", " &#32;\n", s)
        for name, mark, tag in _MARKS:
            if name in m and s.strip():
                lead, body, tail = re.match(r"(\s*)(.*?)(\s*)$", s, re.S).groups()
                plain_edges = mark and body[0] not in "*~<" and body[-1] not in "*~>"
                s = f"{lead}{mark}{body}{mark}{tail}" if plain_edges else f"{lead}<{tag}>{body}</{tag}>{tail}"
        if link:
            s = f"[{s}]({link_target(link, cell)})"
        out.append(s)
    return "".join(out)


def _bold(s: str) -> str:
    return "" if not s else f"<strong>{s}</strong>" if "*" in s or s[0] == "<" or s[-1] == ">" else f"**{s}**"


def _render_table(b: dict) -> str:
    grid: list[list[str | None]] = []
    for r, row in enumerate(b["rows"]):
        while len(grid) <= r:
            grid.append([])
        c = 0
        for runs, down, across in row:
            while c < len(grid[r]) and grid[r][c] is not None:
                c += 1
            s = render_inlines(runs, cell=True)
            if b["header"] and r == 0:
                s = _bold(s)
            if down > 1 or across > 1:
                s = f'<span data-rowspan="{down}" data-colspan="{across}">{s}</span>'
            for y in range(r, min(r + down, len(b["rows"]))):
                while len(grid) <= y:
                    grid.append([])
                for x in range(c, c + across):
                    grid[y] += [None] * (x + 1 - len(grid[y]))
                    grid[y][x] = s if (y, x) == (r, c) else ""
            c += across
    width = max(map(len, grid), default=0)
    if not width:
        return ""
    shown = [[x or "" for x in g] + [""] * (width - len(g)) for g in grid]
    if not b["header"]:
        shown.insert(0, [""] * width)
    bars = {"left": ":---", "center": ":---:", "right": "---:"}
    marks = [bars.get(a, "---") for a in (b["alignments"] or [None] * width)]
    row = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([row(shown[0]), row(marks), *map(row, shown[1:])])


def _render_list(b: dict) -> str:
    out = []
    for i, item in enumerate(b["items"]):
        mark = f"{b['start'] + i}." if b["ordered"] else "-"
        if b["checked"][i] is not None:
            mark += " [x]" if b["checked"][i] else " [ ]"
        body = render_blocks(item)
        indent = " " * (len(mark.split(" ")[0]) + 1)
        out.append(f"{mark} " + body.replace("\n", "\n" + indent).replace("\n" + indent + "\n", "\n\n"))
    loose = any("\n\n" in x for x in out)
    return ("\n\n" if loose else "\n").join(x.rstrip(" ") for x in out)


def clock(ms: int) -> str:
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def render_block(b: dict) -> str:
    kind = b["kind"]
    if kind == "paragraph":
        return protect_paragraph(render_inlines(b["inlines"]))
    if kind == "heading":
        s = render_inlines(b["inlines"], one_line=True)
        s = re.sub(r"(#+)$", lambda m: "\\" + m[1], s)
        return f"{'#' * b['level']} {s}" if s else ""
    if kind == "code":
        return fenced(b["text"], b.get("language"))
    if kind == "formula":
        return f"$$\n{b['text']}\n$$"
    if kind == "list":
        return _render_list(b)
    if kind == "table":
        return _render_table(b)
    if kind == "rule":
        return "---"
    if kind == "image":
        return f"![{escape_run(b.get('alt') or '')}]({link_target(b['uri'])})"
    if kind == "footnote":
        label = "fn-" + b["label"].encode().hex()
        return f"[^{label}]: " + render_blocks(b["blocks"]).replace("\n", "\n    ")
    if kind in ("page", "slide", "sheet"):
        title = {"page": f"Page {b['number']}", "slide": f"Slide {b['number']}" + (f": {b['name']}" if b["name"] else ""), "sheet": f"Sheet: {b['name']}"}[kind]
        return "\n\n".join(x for x in (f"## {escape_run(title)}", render_blocks(b["blocks"])) if x)
    if kind == "segment":
        who = f"**{escape_run(b['speaker'])}:** " if b.get("speaker") else ""
        return f"`{clock(b['start'])} – {clock(b['end'])}` {who}{render_inlines(b['inlines'])}"
    return render_blocks(b.get("blocks", []))


def render_blocks(blocks: list[dict]) -> str:
    out, last = [], None
    for b in blocks:
        s = render_block(b).strip("\n")
        if not s:
            continue
        if last and last["kind"] == b["kind"] == "list" and last["ordered"] == b["ordered"]:
            out.append("<!-- -->")
        out.append(s)
        last = b
    return "\n\n".join(out)


def render(doc: Document) -> str:
    s = render_blocks(doc.blocks)
    return s + "\n" if s else ""


# -- the node table ----------------------------------------------------------

NODE_SCHEMA = "node_id string, parent_id string, path array<int>, depth int, kind string, level int, name string, text string"


def nodes(doc: Document) -> list[tuple]:
    """Rows of the node table: node_id, parent_id, path, depth, kind, level, name, text."""
    out: list[tuple] = []

    def add(b: dict, parent: str | None, path: list[int]) -> None:
        node = "n" + ".".join(map(str, path))
        own = plain(b["inlines"]) if "inlines" in b else b.get("text")
        out.append((node, parent, path, len(path), b["kind"], b.get("level"), b.get("name"), own))
        children = b.get("blocks", [])
        if b["kind"] == "list":
            children = [{"kind": "list_item", "blocks": i} for i in b["items"]]
        elif b["kind"] == "table":
            children = [{"kind": "row", "blocks": [{"kind": "cell", "text": plain(c[0])} for c in r]} for r in b["rows"]]
        for i, child in enumerate(children):
            add(child, node, [*path, i])

    for i, b in enumerate(doc.blocks):
        add(b, None, [i])
    return out


def validate(doc: Document) -> list[str]:
    """What is wrong with a document: codes, none if it is sound."""
    wrong = []

    def look(b: dict, depth: int) -> None:
        if depth > MAX_DEPTH:
            wrong.append("depth")
            return
        if b["kind"] == "heading" and not 1 <= b["level"] <= 6:
            wrong.append("heading.level")
        if b["kind"] == "list" and (not b["items"] or b["ordered"] and b["start"] < 0):
            wrong.append("list.items")
        if b["kind"] == "table":
            widths = {sum(c[2] for c in r) for r in b["rows"]}
            if not b["rows"]:
                wrong.append("table.rows")
            elif len(widths) > 1 and all(c[1] == 1 for r in b["rows"] for c in r):
                wrong.append("table.width")
        if b["kind"] == "segment" and b["end"] < b["start"]:
            wrong.append("segment.range")
        for child in b.get("blocks", []) + [x for i in b.get("items", []) for x in i]:
            look(child, depth + 1)

    for b in doc.blocks:
        look(b, 1)
    return wrong
