"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Furniture that its tag, role, class or id
names (menus, page headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts, styles, hidden parts) is cut out.  A name that only tells that
a page takes comments or has none is no such name.  Inside an article or main
element a class or id must be such a name as a whole (an advert, a notice, an
advert's box), not have it as a part of a longer name; what is otherwise named
like furniture there goes only if links make up half of its characters.  Every
remaining node has

    density = C/T * log_b(C/LC * T/LT),  b = ln(C*LC/(C-LC) + LCbody*C/Cbody + e)

with C characters, T tags, LC link characters and LT link tags below it (zero
divisors count as 1), and a density sum over its children.  The node with the
greatest sum is content; the least density on its path from the body is the
threshold: every other subtree as dense adds the node with its greatest sum.
A chosen node inside an article (or main) element stands for that element; if the
node of the greatest sum has one, only such elements stay.

Character references are decoded, white space inside a block becomes one blank,
blocks are joined by an empty line.  Nothing else is dropped or capped.

Nulls and edge cases: a null or empty page, or one without text, gives ""; a
tag or comment cut off by the end of the page is markup and goes, what was open
closes there.  Repeated rows are extracted each; an empty table gives an empty
result.  Only id, url and html are read, so extra columns cannot clash.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.llm import common

# Element names as the HTML standard sorts them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li tbody tfoot thead tr".split())
SAME_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
SCOPE = frozenset("ul ol dl table select article section div body html main nav aside".split())
# Elements, roles and words of class or id that mark page furniture.
CUT_TAGS = frozenset(
    "head nav footer aside form button select textarea input label fieldset script style noscript template iframe object embed applet "
    "svg canvas audio video map menu dialog search title noembed noframes xmp datalist option".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form tablist".split())
CUT_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Words that, in one name with such a word, only tell whether a page takes comments; words of it that an article's own parts may bear.
STATES = frozenset("has no with without open opened closed enabled disabled allow allowed allows off on".split())
OWN_PARTS = frozenset("reply respond discussion".split())
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer masthead "
    "related recommended recommendations share sharing social newsletter subscribe subscription signup login popup modal overlay toolbar "
    "pagination pager skip copyright header topbar form search".split()
)
#: Names that mean furniture inside an article too, as a whole class or id or with other words of furniture or of boxes only.
CUT_INSIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert newsletter "
    "subscribe subscription signup login popup modal overlay copyright sidebar sidebars".split()
)
BOXES = frozenset("area bar block box container holder inner panel slot unit wrap wrapper".split())
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Page:
    """Nodes in page order (a parent before its children) and the text and block breaks between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut, self.soft = ["#root"], [-1], [False], [False]
        self.events: list[tuple[int, str | None]] = []  # (node, text) or (node, None) for the edge of a block
        self._read(source)

    def _open(self, stack: list[int], name: str, attrs: str) -> int:
        cut, soft = _furniture(name, attrs, any(self.tag[i] in ("article", "main") for i in stack) if name == "header" or attrs.strip() else False)
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.cut.append(cut)
        self.soft.append(soft)
        return len(self.tag) - 1

    def _close_to(self, stack: list[int], names: tuple[str, ...], scope: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[k]]
            if name in names:
                if any(self.tag[i] in BLOCK for i in stack[k:]):
                    self.events.append((stack[k], None))
                del stack[k:]
                return
            if name in scope:
                return

    def _read(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                self.events.append((stack[-1], source[at:]))
                break
            if m.start() > at:
                self.events.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if m[0].startswith("<![CDATA["):
                continue
            if not name or not m[0].endswith(">"):
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close_to(stack, (name,), frozenset() if name in SCOPE else SCOPE)
                continue
            attrs = m[3] if m[2] else m[6]
            if name in CLOSES_P:
                self._close_to(stack, ("p",), SCOPE)
            if name in SAME_CLOSES:
                self._close_to(stack, SAME_CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select")))
            node = self._open(stack, name, attrs)
            if name in BLOCK:
                self.events.append((node, None))
            if name == "br" or name in ("td", "th"):
                self.events.append((node, " "))
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                if not self.cut[node]:
                    self.events.append((node, source[at : end.start() if end else n]))
                at = end.end() if end else n
            elif name not in VOID and not attrs.rstrip().endswith("/") or name in BLOCK - VOID:
                stack.append(node)


def _furniture(name: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """(cut whatever it holds, cut unless it holds an article or, inside one, unless links are the smaller part)."""
    if name in CUT_TAGS:
        return True, False
    named = {}
    if name == "header" and not in_article:
        return True, False
    for m in _ATTR.finditer(attrs) if attrs.strip() else ():
        named.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    if not named:
        return False, False
    if name not in ("html", "body") and ("hidden" in named or named.get("aria-hidden") == "true" or _HIDDEN.search(named.get("style", ""))):
        return True, False
    names = [{w.lower() for w in _NAME.findall(x) if not w.isdigit()} for x in f"{named.get('class', '')} {named.get('id', '')}".split()]
    if name in ("html", "body", "main"):
        return False, False
    comments = CUT_COMMENTS - OWN_PARTS if in_article else CUT_COMMENTS
    if any(x & comments and not x & STATES for x in names):
        return True, False
    if name == "article":
        return False, False
    role = named.get("role", "").lower() in CUT_ROLES
    if in_article and (role or any(x & CUT_INSIDE and x <= CUT_WORDS | BOXES for x in names)):
        return True, False
    return False, any(x & CUT_WORDS for x in names) or role


def extract(source: str | None) -> str:
    """The article text of a page; "" if there is none."""
    if not source:
        return ""
    page = _Page(source)
    n = len(page.tag)
    tag, parent = page.tag, page.parent
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i] or tag[i] in ("article", "main")
    in_link, inside = [False] * n, [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parent[i]] or tag[i] == "a"
        inside[i] = inside[parent[i]] or tag[parent[i]] in ("article", "main")
    size, linked = [0] * n, [0] * n
    for i, t in page.events:
        if t is not None:
            k = len("".join(t.split()))
            size[i] += k
            linked[i] += k if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        linked[parent[i]] += linked[i]
    gone = [False] * n
    for i in range(1, n):
        soft = page.soft[i] and (2 * linked[i] >= size[i] if inside[i] else not holds[i])
        gone[i] = gone[parent[i]] or page.cut[i] or soft
    events = [(i, None if t is None else html.unescape(t)) for i, t in page.events if not gone[i]]
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for i, t in events:
        if t is not None:
            size = len("".join(t.split()))
            chars[i] += size
            links[i] += size if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tag[i] == "a")
    body = next((i for i in range(n) if tag[i] == "body" and not gone[i]), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    density = [0.0] * n
    share = links[body] / chars[body]
    for i in range(n):
        if chars[i] and not gone[i]:
            c, t = chars[i], max(1, tags[i])
            base = math.log(c / max(1, c - links[i]) * links[i] + share * c + math.e)
            density[i] = c / t * math.log(max(1.0 + 1e-9, c / max(1, links[i]) * t / max(1, link_tags[i]))) / max(1e-9, math.log(max(base, 1.0 + 1e-9)))
            density[i] = min(density[i], 1e6 * c)
    if share == 0:  # no link at all: the base is e and the logarithm of it 1, so plain characters per tag
        density = [chars[i] / max(1, tags[i]) if not gone[i] else 0.0 for i in range(n)]
    below = [0.0] * n
    for i in range(n - 1, 0, -1):
        below[parent[i]] += density[i]
    under = [False] * n
    best_below = list(range(n))  # node of the greatest density sum in a subtree, the outermost among equals
    for i in range(n):
        under[i] = i == body or (i > 0 and under[parent[i]])
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            p = parent[i]
            if below[best_below[i]] > below[best_below[p]]:
                best_below[p] = best_below[i]
    top = best_below[body] if below[best_below[body]] > 0 else body
    threshold, i = density[top], top
    while i != body and i > 0:
        i = parent[i]
        threshold = min(threshold, density[i])
    chosen = set()
    for i in range(n):
        if under[i] and not gone[i] and density[i] >= threshold > 0 and not _inside(best_below[i], chosen, parent):
            chosen.add(_lift(best_below[i], tag, parent, body))
    if tag[_lift(top, tag, parent, body)] in ("article", "main"):
        chosen = {i for i in chosen if tag[i] in ("article", "main")}
    chosen = chosen or {body}
    keep = [False] * n
    for i in range(n):
        keep[i] = i in chosen or (i > 0 and keep[parent[i]])
    blocks, now = [], []
    for i, t in page.events:
        if t is None:
            blocks.append(now)
            now = []
        elif keep[i] and not gone[i]:
            now.append(html.unescape(t))
    blocks.append(now)
    return "\n\n".join(x for b in blocks if b and (x := " ".join("".join(b).split())))


def _inside(node: int, chosen: set[int], parent: list[int]) -> bool:
    while node >= 0:
        if node in chosen:
            return True
        node = parent[node]
    return False


def _lift(node: int, tag: list[str], parent: list[int], body: int) -> int:
    i, out = node, node
    while i > 0 and i != body:
        if tag[i] in ("article", "main"):
            out = i
            if tag[i] == "article":
                break
        i = parent[i]
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(extract, na_action=None).astype(object)

    common.bound_batches(pages.sparkSession)
    got = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
