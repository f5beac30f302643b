"""HTML pages to structured Markdown.

A small tree builder on the standard library's tokenizer closes p and li as HTML does; void elements and
unclosed tags are handled, misnested formatting is not rebuilt as browsers do.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose start ends an open p.
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SKIPPED = {"script", "style", "nav", "footer", "header"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.content = tag, attrs, []

    def children(self):
        return [c for c in self.content if isinstance(c, Node)]

    def walk(self):
        for c in self.children():
            yield c
            yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.content)

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {})
        self.open = [self.root]

    def _close(self, tag: str, stop: set[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close("p", {"div", "article", "section", "main", "body", "li", "td", "figure"})
        if tag == "li":
            self._close("li", {"ul", "ol"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].content.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(tag)

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.open[-1].content.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _braced(text: str, at: int) -> int:
    """Where the group that opens at ``at`` ends (after its brace), or -1."""
    depth = 0
    for m in re.finditer(r"[{}]", text[at:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return at + m.end()
    return -1


def boldsymbol(text: str) -> str:
    r"""``\bm`` and its argument (a braced group, a command or one character) become ``\boldsymbol{…}``; longer names like
    ``\bmod`` stay."""
    out, at = [], 0
    for m in re.finditer(r"\\bm(?![A-Za-z])\s*", text):
        b = m.end()
        if m.start() < at or b == len(text):
            continue
        group = _braced(text, b) if text[b] == "{" else -1
        command = re.compile(r"\\[A-Za-z]+").match(text, b)
        e = group if group > 0 else command.end() if command else b + 1
        out += [text[at : m.start()], "\\boldsymbol{", text[b + 1 : e - 1] if group > 0 else text[b:e], "}"]
        at = e
    return "".join(out) + text[at:]


def _formula(node: Node) -> str:
    tried = [node.attrs.get(k) for k in ("alttext", "aria-label", "data-tex", "data-latex")] + [node.text()]
    found = next((flat(x) for x in tried if x and flat(x)), "")
    return f"$$\n{boldsymbol(found)}\n$$" if found else ""


def _image(node: Node, base: str) -> str:
    src = node.attrs.get("src")
    return f"![{node.attrs.get('alt', '').strip() or 'Figure'}]({urljoin(base, src)})" if src else ""


def _is_math(node: Node) -> bool:
    return node.tag == "math" or node.has_class("ltx_Math") or node.has_class("katex-display")


def _lines(node: Node, base: str) -> list[str]:
    tag = node.tag
    if tag in SKIPPED:
        return []
    if re.fullmatch("h[1-6]", tag):
        found = [f"{'#' * int(tag[1])} {flat(node.text())}" if flat(node.text()) else ""]
    elif tag == "figure":
        below = list(node.walk())
        image = next((n for n in below if n.tag == "img"), None)
        math = next((n for n in below if n.tag == "math"), None) or next((n for n in below if n.has_class("ltx_Math")), None) or next((n for n in below if n.has_class("katex-display")), None)
        caption = next((n for n in below if n.tag == "figcaption"), None)
        found = [_image(image, base) if image else "", _formula(math) if math else "", flat(caption.text()) if caption else ""]
    elif tag == "img":
        found = [_image(node, base)]
    elif _is_math(node):
        found = [_formula(node)]
    elif tag == "pre":
        found = [f"```\n{node.text().strip()}\n```" if node.text().strip() else ""]
    elif tag == "li":
        found = [f"- {flat(node.text())}" if flat(node.text()) else ""]
    elif tag == "p":
        found = [flat(node.text())]
    else:
        found = [x for c in node.children() for x in _lines(c, base)]
    return [x for x in found if x]


def to_markdown(html: str, base: str, fallback: str = "Paper") -> str:
    """The title, then the main part's headings, paragraphs, lists, code, formulas and figures."""
    nodes = list(parse(html).walk())
    first = lambda test: next((n for n in nodes if test(n)), None)
    root = first(lambda n: n.tag == "main") or first(lambda n: n.tag == "article") or first(lambda n: n.attrs.get("id") == "content") or first(lambda n: n.tag == "body") or parse(html)
    h1 = first(lambda n: n.tag == "h1")
    title = flat(h1.text()) if h1 else ""
    body = re.sub(r"\n{3,}", "\n\n", "\n\n".join(_lines(root, base))).strip()
    return "\n\n".join(x for x in (f"# {title or fallback}", body) if x).strip()


def page_markdown(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) to (page_id, markdown).

    Pages go to Python a hundred at a time, and once each: what a process holds does not grow with the table."""
    made = F.udf(lambda h, u: to_markdown(h, u or ""), "string", useArrow=False).asNondeterministic()  # so filters on it are no second call
    return pages.select("page_id", made("html", "url").alias("markdown"))
