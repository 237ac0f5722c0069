"""HTML to compact markdown.

The cheap deletions before parsing and the clean-up after it are Catalyst expressions, so the parser gets less text and
the plan stays in the JVM but for one Arrow function, `distill_html`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from tidemark.functions.text import estimate_tokens, trimmed

# What is deleted before parsing, in order.
PRETRIM = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b.*?</script>", ""),
    (r"(?is)<style\b.*?</style>", ""),
    (r"(?is)<noscript\b.*?</noscript>", ""),
    (r"(?is)<svg\b.*?</svg>", ""),
    (r"(?is)<template\b.*?</template>", ""),
    (r"(?i)\ssrc=(\"|')data:[^\"']*\1", ' src=""'),
    (r"(?i)\sstyle=(\"|')[^\"']*\1", ""),
]
# Elements that are no content, and containers of content by priority.
NOISE = (
    "nav header footer aside [role=navigation] [role=banner] [role=contentinfo] [role=complementary] [role=search] [role=dialog] "
    "[role=alertdialog] .sidebar .nav .navbar .menu .breadcrumb .breadcrumbs .pagination .pager .toc .table-of-contents .skip-link "
    ".skip-to-content .cookie .cookies [class*=cookie] [id*=cookie] [class*=consent] .advertisement .ad .ads [class*=advert] [data-ad] "
    ".promo .newsletter .subscribe .signup .social .share .sharing .related .related-posts .comments #comments .disqus .edit-section "
    ".mw-editsection .mw-jump-link .noprint .modal .popup .lightbox [aria-hidden=true] [hidden]"
).split()
MAIN = (
    "main article [role=main] [itemprop=articleBody] .mw-parser-output .markdown-body .theme-doc-markdown .md-content__inner "
    ".rst-content .devsite-article-body .document .prose #content #main-content .content .post .article"
).split()
DROPPED = frozenset("script style noscript iframe form button input select textarea template svg".split())
LINK_TRACKING = re.compile(r"utm_.*|fbclid|gclid|mc_eid|mc_cid|igshid|ref", re.I)
SHELL = r"""(?i)<div[^>]+id=["'](?:root|app|__next)["']|data-reactroot|__NEXT_DATA__|window\.__NUXT__|ng-version|<div[^>]+id=["']svelte"""
MAIN_LEAST = 500

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2
    h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: An opening tag in the key's place closes these open elements first.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
SCOPES = frozenset({"ul", "ol", "dl", "table", "select", "td", "th"})


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))


class _Tree(HTMLParser):
    """Builds a tree as browsers do for the common cases of unclosed elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag in BLOCKS:
            self._close({"p"}, frozenset({"td", "th", "li", "blockquote", "div", "section", "article"}) if tag != "p" else SCOPES)
        if tag in CLOSES:
            scope = SCOPES - {"td", "th"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else SCOPES
            while self._close(CLOSES[tag], scope):
                pass
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._close({tag}, frozenset({"table"}) if tag not in ("table", "html") else frozenset())

    def _close(self, tags: set[str], scope: frozenset[str]) -> bool:
        x = self.at
        while x.parent is not None:
            if x.tag in tags:
                self.at = x.parent
                return True
            if x.tag in scope:
                return False
            x = x.parent
        return False

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _selector(text: str) -> Callable[[Node], bool]:
    """A test for a tag, .class, #id, [attr], [attr=value] or [attr*=part]."""
    if text[0] == ".":
        return lambda n: text[1:] in n.attrs.get("class", "").split()
    if text[0] == "#":
        return lambda n: n.attrs.get("id") == text[1:]
    if text[0] == "[":
        name, sign, value = re.fullmatch(r"\[([\w-]+)(?:(\*?=)(.*))?\]", text).groups()
        if sign == "*=":
            return lambda n: value in n.attrs.get(name, "")
        return (lambda n: n.attrs.get(name) == value) if sign else (lambda n: name in n.attrs)
    return lambda n: n.tag == text


_NOISE = [_selector(s) for s in NOISE]
_MAIN = [_selector(s) for s in MAIN]


def _without_noise(node: Node) -> None:
    stack = [node]
    while stack:
        x = stack.pop()
        x.children = [c for c in x.children if isinstance(c, str) or not any(test(c) for test in _NOISE)]
        stack.extend(c for c in x.children if isinstance(c, Node))


def _densest(root: Node) -> Node | None:
    """The element that holds most of the running text: paragraphs give their parents points by length and commas, links take them away."""
    points: dict[int, tuple[float, Node]] = {}
    for p in root.walk():
        if p.tag not in ("p", "pre", "td", "blockquote"):
            continue
        text = p.text().strip()
        if len(text) < 25 or p.parent is None:
            continue
        score = 1 + text.count(",") + min(len(text) // 100, 3)
        for up, share in ((p.parent, 1.0), (p.parent.parent, 0.5)):
            if up is not None:
                points[id(up)] = (points.get(id(up), (0.0, up))[0] + score * share, up)
    best = max(points.values(), key=lambda x: x[0] * (1 - _link_share(x[1])), default=None)
    return best[1] if best else None


def _link_share(node: Node) -> float:
    return sum(len(a.text()) for a in node.walk() if a.tag == "a") / max(1, len(node.text()))


def content_of(html: str) -> Node:
    """The content element: the first container by priority with enough text, else the densest element, else the whole."""
    root = parse(html)
    _without_noise(root)
    for test in _MAIN:
        found = next((n for n in root.walk() if n is not root and test(n)), None)
        if found is not None and len(found.text().strip()) > MAIN_LEAST:
            return found
    return _densest(root) or root


# What Turndown, a public converter, escapes so that text isn't taken for markup.
_ESCAPES = [
    (re.compile(r"\\"), r"\\\\"), (re.compile(r"\*"), r"\\*"), (re.compile(r"^-", re.M), r"\\-"), (re.compile(r"^\+ ", re.M), r"\\+ "), (re.compile(r"^(=+)", re.M), r"\\\1"),
    (re.compile(r"^(#{1,6}) ", re.M), r"\\\1 "), (re.compile(r"`"), r"\\`"), (re.compile(r"^~~~", re.M), r"\\~~~"), (re.compile(r"\["), r"\\["), (re.compile(r"\]"), r"\\]"),
    (re.compile(r"^>", re.M), r"\\>"), (re.compile(r"_"), r"\\_"), (re.compile(r"^(\d+)\. ", re.M), r"\1\\. "),
]
_SPECIAL = re.compile(r"[\\*\-+=#`~\[\]>_]|\d\. ")
# What stands before a language in class names of code blocks, and names of highlighters, which are no language.
LANGUAGE_PREFIXES = ["language", "lang", "highlight", "brush:"]
HIGHLIGHTERS = ["highlight", "hljs"]
_LANGUAGE = re.compile(rf"(?:{'|'.join(LANGUAGE_PREFIXES)})[-\s:]*([a-z0-9+#]+)", re.I)


def _escaped(text: str) -> str:
    if _SPECIAL.search(text):
        for pattern, by in _ESCAPES:
            text = pattern.sub(by, text)
    return text


class Markdown:
    """Emits a tree as markdown: ATX headings, fenced code, `-` lists, inline links, tables, task lists and strike-through."""

    def render(self, node: Node) -> str:
        return self._joined([self._child(c, node) for c in node.children]).strip("\n")

    def _joined(self, parts: list[str]) -> str:
        """Blocks are separated by the longer run of line ends at their border, two at most."""
        out = ""
        for part in parts:
            if not part:
                continue
            body, head = out.rstrip("\n"), part.lstrip("\n")
            gap = min(2, max(len(out) - len(body), len(part) - len(head)))
            if not gap and body[-1:].isspace() and head[:1] == " ":
                head = head[1:]
            out = body + "\n" * gap + (head.lstrip(" ") if gap and not part.startswith("    ") and not head.startswith("    ") else head)
        return out

    def _child(self, child: Node | str, parent: Node) -> str:
        if isinstance(child, str):
            return _escaped(re.sub(r"[ \t\r\n]+", " ", child)) if child.strip(" \t\r\n") else (" " if child and parent.tag not in ("table", "thead", "tbody", "tfoot", "tr", "ul", "ol") else "")
        return self._element(child)

    def _inner(self, node: Node) -> str:
        return self._joined([self._child(c, node) for c in node.children])

    def _element(self, node: Node) -> str:
        tag = node.tag
        if tag in DROPPED:
            return ""
        handler = getattr(self, f"_{tag}", None)
        if handler:
            return handler(node)
        if re.fullmatch("h[1-6]", tag):
            text = " ".join(self._inner(node).split())
            return f"\n\n{'#' * int(tag[1])} {text}\n\n" if text else ""
        inner = self._inner(node)
        if tag in BLOCKS:
            return f"\n\n{inner.strip()}\n\n" if inner.strip() else ""
        return inner

    def _marked(self, node: Node, mark: str) -> str:
        inner = self._inner(node)
        text = inner.strip()
        return f"{' ' * inner[:1].isspace()}{mark}{text}{mark}{' ' * inner[-1:].isspace()}" if text else inner

    def _b(self, node: Node) -> str:
        return self._marked(node, "**")

    def _i(self, node: Node) -> str:
        return self._marked(node, "_")

    def _del(self, node: Node) -> str:
        return self._marked(node, "~")

    _strong, _em, _s, _strike = _b, _i, _del, _del

    def _br(self, node: Node) -> str:
        return "  \n"

    def _hr(self, node: Node) -> str:
        return "\n\n---\n\n"

    def _code(self, node: Node) -> str:
        text = re.sub(r"\r?\n|\r", " ", node.text())
        if not text:
            return ""
        longest = max(map(len, re.findall("`+", text)), default=0)
        fence = "`" * (1 if not longest else longest + 1)
        pad = " " if text[0] == "`" or text[-1] == "`" or (text[0] == text[-1] == " " and text.strip()) else ""
        return f"{fence}{pad}{text}{pad}{fence}"

    def _pre(self, node: Node) -> str:
        return f"\n\n```{code_language(node)}\n{node.text().rstrip(chr(10))}\n```\n\n"

    def _blockquote(self, node: Node) -> str:
        inner = self._inner(node).strip("\n")
        return "\n\n" + re.sub("^", "> ", inner, flags=re.M) + "\n\n" if inner.strip() else ""

    def _a(self, node: Node) -> str:
        text = self._inner(node).strip()
        href = clean_href(node.attrs.get("href", ""))
        return text if not text or not href or href == text else f"[{text}]({href})"

    def _img(self, node: Node) -> str:
        src, alt = node.attrs.get("src", ""), node.attrs.get("alt", "").strip()
        return f"![{alt}]({src})" if alt and src and not src.startswith("data:") else ""

    def _ul(self, node: Node) -> str:
        first = int(node.attrs["start"]) if node.attrs.get("start", "").isdigit() else 1
        items, n = [], 0
        for child in node.children:
            if isinstance(child, str):
                continue
            if child.tag != "li":
                items.append(self._element(child).strip("\n"))
                continue
            sign = f"{first + n}.  " if node.tag == "ol" else "-   "
            n += 1
            body = re.sub(r"\n", "\n    ", self._item(child).strip("\n").strip())
            items.append(sign + body)
        text = "\n".join(x for x in items if x.strip())
        nested = node.parent is not None and node.parent.tag == "li"
        return f"\n{text}\n" if nested else f"\n\n{text}\n\n"

    _ol = _ul

    def _item(self, node: Node) -> str:
        box = next((c for c in node.children if isinstance(c, Node) and c.tag == "input" and c.attrs.get("type") == "checkbox"), None)
        return (f"[{'x' if 'checked' in box.attrs else ' '}] " if box else "") + self._inner(node).lstrip()

    def _li(self, node: Node) -> str:
        return f"\n-   {self._item(node).strip()}\n"

    def _table(self, node: Node) -> str:
        rows = [r for r in node.walk() if r.tag == "tr"]
        cells = [[c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in rows]
        if not cells or not cells[0]:
            return self._joined(["\n\n", *(f"\n\n{self._inner(c).strip()}\n\n" for r in cells for c in r)])
        texts = [[re.sub(r"\s*\n\s*", " ", self._inner(c).strip()).replace("|", "\\|") for c in r] for r in cells]
        headed = any(n.tag == "thead" for n in node.walk()) or all(c.tag == "th" for c in cells[0])
        if not headed:
            texts, cells = [[""] * len(texts[0]), *texts], [cells[0], *cells]
        rules = {"left": ":--", "right": "--:", "center": ":-:"}
        rule = [rules.get(c.attrs.get("align", "").lower(), "---") for c in cells[0]]
        return "\n\n" + "\n".join(f"| {' | '.join(r)} |" for r in [texts[0], rule, *texts[1:]]) + "\n\n"


def code_language(node: Node) -> str:
    """Language of a code block by the usual class names, of the block or else of the code in it."""
    names = [n.attrs.get("class", "") for n in (node, *(c for c in node.walk() if c.tag == "code"))][:2]
    told = next(filter(None, names), "")
    for match in _LANGUAGE.finditer(told):
        return match[1].lower() if match[1].lower() not in HIGHLIGHTERS else ""
    return ""


def clean_href(href: str) -> str:
    """The target of a link worth keeping, without tracking parameters; empty for anchors and addresses that aren't pages."""
    scheme, colon, _ = href.partition(":")
    if href[:1] in ("", "#") or (colon and scheme.lower() in ("javascript", "mailto", "tel")):
        return ""
    if scheme.lower() not in ("http", "https") or not href[len(scheme) :].startswith("://"):
        return href
    try:
        parts = urlsplit(href)
        pairs = parse_qsl(parts.query, keep_blank_values=True)
    except ValueError:
        return href
    kept = [(k, v) for k, v in pairs if not LINK_TRACKING.fullmatch(k)]
    query = parts.query if len(kept) == len(pairs) else urlencode(kept)
    host = parts.netloc if "@" in parts.netloc else parts.netloc.lower()
    return urlunsplit((parts.scheme.lower(), host, parts.path or "/", query, parts.fragment))


def to_markdown(html: str | None) -> str | None:
    """Markdown of the content, before the clean-up; null for null."""
    if html is None:
        return None
    return Markdown().render(content_of(html))


@F.pandas_udf(StringType())
def _distill(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else to_markdown(x))


def pretrim(html: Column | str) -> Column:
    """Deletes comments, scripts, styles, drawings, templates, inlined data and style attributes."""
    c = F.col(html) if isinstance(html, str) else html
    for pattern, by in PRETRIM:
        c = F.regexp_replace(c, pattern, by)
    return c


def tidied(markdown: Column) -> Column:
    """Without trailing blanks, runs of blank lines and links without text; trimmed."""
    c = F.regexp_replace(markdown, r"(?md)[ \t]+$", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return trimmed(F.regexp_replace(c, r"(?:\[\]\([^)]*\)\s*)+", ""))


def distill_html(html: Column | str) -> Column:
    """Compact markdown of a page."""
    return tidied(_distill(pretrim(html)))


def looks_unrendered(html: Column, original_tokens: Column, distilled_tokens: Column) -> Column:
    """Whether a page is likely an application shell: much HTML, next to no text."""
    thin = distilled_tokens < 150
    very_thin = (distilled_tokens / original_tokens < 0.02) & (original_tokens > 3000)
    return F.coalesce((original_tokens >= 1000) & thin & (very_thin | html.rlike(SHELL)), F.lit(False))


def with_rendered(markdown: Column, original_tokens: Column, shell: Column, rendered: Column, rendered_tokens: Column) -> Column:
    """struct<markdown, original_tokens, rendered, spa_partial>: a rendering replaces a shell's text if it has more of it; else the page is partial."""
    better = shell & F.coalesce(estimate_tokens(rendered) > estimate_tokens(markdown), F.lit(False))
    return F.struct(
        F.when(better, rendered).otherwise(markdown).alias("markdown"), F.when(better, F.greatest(original_tokens, rendered_tokens)).otherwise(original_tokens).alias("original_tokens"),
        better.alias("rendered"), (shell & ~better).alias("spa_partial"),
    )
