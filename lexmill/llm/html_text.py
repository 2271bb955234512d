"""Main text of web pages by tag-path ratios.

A page becomes a list of text nodes in page order, each with its tag path from
the root. Text length and punctuation are summed over all nodes of a path and
divided by their number, so that a short paragraph counts as its siblings do.
Both ratios are smoothed over the node sequence with a Gaussian, and all four,
raw and smoothed, are fused by their geometric mean; a path's score is the mean
over its nodes, and paths above a share of the standard deviation are content.

The container is the least element that holds all nodes of content paths, or
an article or main element around it. In an article or main all blocks are
main text. In any other container it goes from the first to the last of its
parts that hold content, with the headings just before them: what lies before
and after, such as menus and footers without any mark, goes.

Marks are only used for what is never main text wherever it lies: scripts,
navigation, forms, adverts, reader comments and the like, by tag, role, class
or id. They are left out before anything is counted.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tune

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|lang)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
_NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "svg", "canvas", "audio", "video", "map", *(_RAW - {"noscript"})}
#: Words in a class or an id that mark adverts, comments, menus, notices and other furniture; the second list counts outside articles only.
_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|nav\w*|menu|breadcrumbs?|comments?|replies|reply|respond|disqus|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|share|sharing|related|footer|pagination|pager)(?:$|[\s_-])", re.I)
_OUTER_HINT = re.compile(r"(?:^|[\s_-])(?:side|notice|alert|overlay|signup|login|social|recommend\w*|masthead|topbar|toolbar|widget|skip|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
_ARTICLE = {"article", "main"}
#: A start tag on the left closes an open tag on the right.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dd", "dt"}
#: Blocks of text and parts of them, which hold no headings or lists beside their own text.
_TEXT_BLOCK = {"p", "li", "dt", "dd", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figcaption", "caption", "summary", "address", *_INLINE}
_SCOPE = {"table", "ul", "ol", "dl", "article", "section", "div", "body", "html", "main", "td", "th", "blockquote", "figure"}
_PUNCT = re.compile(r"[,.;:!?…、。，！？]")

#: Standard deviations above nothing that a path's score must reach; width of the smoothing, in nodes.
THRESHOLD = 0.5
SIGMA = 1.0
#: Punctuation marks that a node counts without any.
NO_MARKS = 0.25


class _Node:
    __slots__ = ("block", "element", "path", "text")

    def __init__(self, text: str, path: int, element: int, block: int):
        self.text, self.path, self.element, self.block = text, path, element, block


class _Tree:
    """Elements in order of their start tags: tag, parent and the last element inside; element 0 is the page."""

    def __init__(self):
        self.tag, self.parent, self.last = [""], [-1], [0]

    def shared(self, a: int, b: int) -> int:
        """The least element that holds both; a does not start after b."""
        while self.last[a] < b:
            a = self.parent[a]
        return a


def _left_out(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in _NEVER or (tag == "header" and not inside_article):
        return True
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", *_ARTICLE) and (_HINT.search(value) or not inside_article and _OUTER_HINT.search(value)):
            return True
        if name in ("class", "id") and tag in _ARTICLE and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", value, re.I):
            return True
    return False


def text_nodes(page: str) -> tuple[list[_Node], _Tree]:
    """Text nodes outside left-out elements, in page order, and the elements. Reads the page once; any bytes are accepted."""
    out: list[_Node] = []
    tree = _Tree()
    stack: list[tuple[str, int, bool, int]] = []  # tag, element, left out, path
    opened: dict[str, int] = {}
    paths: dict[tuple[int, str], int] = {}
    block = i = 0
    n = len(page)

    def emit(text: str) -> None:
        if text and not (stack and stack[-1][2]):
            out.append(_Node(text, stack[-1][3] if stack else 0, stack[-1][1] if stack else 0, block))

    def cut(k: int) -> None:
        for tag, e, _, _ in stack[k:]:
            opened[tag] -= 1
            tree.last[e] = len(tree.tag) - 1
        del stack[k:]

    def close_to(tags: set[str], stops: set[str]) -> None:
        if any(opened.get(t) for t in tags):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    return cut(k)
                if stack[k][0] in stops:
                    return

    while i < n:
        j = page.find("<", i)
        if j < 0:
            emit(page[i:])
            break
        if j > i:
            emit(page[i:j])
        nxt = page[j + 1 : j + 2]
        if page.startswith("<!--", j):
            k = page.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        if nxt in ("!", "?"):
            k = page.find(">", j)
            i = n if k < 0 else k + 1
            continue
        if page.find(">", j) < 0:  # no tag ends after this place
            emit(page[j:])
            break
        m = _TAG.match(page, j) or _LOOSE.match(page, j)
        if not m:
            emit("<")
            i = j + 1
            continue
        i = m.end()
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if tag not in _INLINE:
                block += 1
            if opened.get(tag):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        cut(k)
                        break
                    if tag in _INLINE and stack[k][0] not in _INLINE:
                        break
            continue
        if tag == "br":
            emit(" ")
            continue
        if tag not in _INLINE:
            block += 1
        if tag in _ENDS_P:
            close_to({"p"}, _SCOPE)
        if tag in _CLOSES:
            close_to(_CLOSES[tag], _SCOPE - _CLOSES[tag])
        if tag in _VOID or attrs.endswith("/") and tag not in _RAW:
            continue
        gone = bool(stack and stack[-1][2]) or _left_out(tag, attrs, any(opened.get(t) for t in _ARTICLE))
        if tag in _RAW:
            k = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, i)
            end = page.find(">", k.start()) if k else -1
            i = n if end < 0 else end + 1
            continue
        above = stack[-1] if stack else ("", 0, False, 0)
        tree.tag.append(tag)
        tree.parent.append(above[1])
        tree.last.append(n)
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, len(tree.tag) - 1, gone, paths.setdefault((above[3], tag), len(paths) + 1)))
    cut(0)
    tree.last[0] = len(tree.tag) - 1
    return out, tree


def _smooth(x: np.ndarray) -> np.ndarray:
    r = int(math.ceil(3 * SIGMA))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * SIGMA**2))
    k /= k.sum()
    return np.convolve(np.pad(x, r, mode="edge"), k, "valid")


def content_paths(nodes: list[_Node], texts: list[str]) -> set[int]:
    """The tag paths whose smoothed and fused ratios pass the threshold."""
    total: dict[int, list[int]] = {}
    for x, t in zip(nodes, texts, strict=True):
        s = total.setdefault(x.path, [0, 0, 0])
        s[0] += len(t.strip())
        s[1] += len(_PUNCT.findall(t))
        s[2] += 1
    chars = np.array([total[x.path][0] / total[x.path][2] for x in nodes])
    marks = np.array([total[x.path][1] / total[x.path][2] for x in nodes]) + NO_MARKS
    # a path's own ratios beside the smoothed ones, or a menu next to the text would pass with it
    fused = np.sqrt(np.sqrt(chars * marks) * np.sqrt(_smooth(chars) * _smooth(marks)))
    score: dict[int, float] = {}
    for x, f in zip(nodes, fused.tolist(), strict=True):
        score[x.path] = score.get(x.path, 0.0) + f / total[x.path][2]
    least = max(THRESHOLD * float(fused.std()), 1e-9)
    return {p for p, f in score.items() if f >= least} or {max(score, key=score.__getitem__)}


_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


def extract(page: str | None) -> str:
    """The main text of a page, one block a line; empty if there is none."""
    nodes, tree = text_nodes(page or "")
    full = [x for x in nodes if x.text.strip()]
    if not full:
        return ""
    passing = content_paths(full, [html.unescape(x.text) for x in full])
    content = [x.element for x in full if x.path in passing]
    holder = tree.shared(min(content), max(content))
    while holder > 0 and tree.tag[holder] in _TEXT_BLOCK:
        holder = tree.parent[holder]
    around = holder
    while around > 0 and tree.tag[around] not in _ARTICLE:
        around = tree.parent[around]
    if around > 0:
        chosen = {x.block for x in full if around <= x.element <= tree.last[around]}
    else:
        # the parts of the holder with content: from where the first starts to where the last ends
        ends = _part(tree, holder, min(content)), _part(tree, holder, max(content))
        where = [k for k, x in enumerate(full) if x.path in passing or holder not in ends and ends[0] <= x.element <= tree.last[ends[1]]]
        lo, hi = where[0], where[-1]
        while lo and any(tree.tag[e] in _HEADING for e in _line(tree, full[lo - 1].element)):
            lo -= 1
        chosen = {x.block for x in full[lo : hi + 1]}
    blocks: dict[int, list[str]] = {}
    for x in nodes:
        if x.block in chosen:
            blocks.setdefault(x.block, []).append(x.text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def _part(tree: _Tree, holder: int, e: int) -> int:
    """The child of ``holder`` that holds ``e``, or ``holder`` itself."""
    while e != holder and tree.parent[e] != holder:
        e = tree.parent[e]
    return e


def _line(tree: _Tree, e: int):
    """``e`` and its ancestors up to the first that is no part of a text block."""
    while e > 0:
        yield e
        if tree.tag[e] not in _INLINE:
            return
        e = tree.parent[e]


def declared_language(page: str | None) -> str | None:
    """The primary subtag of the root element's lang attribute."""
    m = re.search(r"<html\b([^>]*)>", page or "", re.I)
    for name, value in _ATTR.findall(m[1]) if m else []:
        if name.lower() == "lang":
            return re.split(r"[-_]", value.strip("\"' ").lower())[0] or None
    return None


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with its page_id and url and with text and n_chars (code points).

    A null or empty page gives an empty text. Every row is worked on alone and
    whole; repeated rows repeat.
    """
    tune(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col(html_col).alias("html"))

    def work(batches):
        for b in batches:
            texts = [extract(x) for x in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
