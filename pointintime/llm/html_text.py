"""Main text of HTML pages by composite text density.

Each page becomes a tree. A node's composite density is

    C/T * log_b( C/LC * T/LT ),   b = ln( C/nLC * LC + LC_body/C_body * C + e ),

C being the characters below the node, T its tags, LC and LT those within links, nLC = C - LC, with every
divisor at least 1. Densities of a node's children are summed; the subtree with the largest sum is the core of the text.
The threshold is the least density on the path from that node up to the body. All of the core's blocks are taken; of what
stands around it up to the body, blocks that reach the threshold, and those with text in paragraphs, headings, lists or tables that
isn't mostly links. Where an article or main around the core holds most of the body's text outside links, all of its blocks are
taken, and nothing around it but a first heading before it. Elements that are never article text (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments of readers), by name, role, class or id, are
cut from the tree beforehand, save for the headings, header and quotations of the article itself. A form, class or id is only a
hint: names that negate or wrap ("no-sidebar", "content-with-sidebar") say nothing, names with another meaning ("share-price",
"reply") only where they name a part of a page, and an element with the article in it, or without one elsewhere most of
the body's text outside links, stays for the densities to decide.

Text: character references decoded, white space within a block as one blank, blocks joined by an empty
line in page order. Null and empty pages, pages without text: an empty string; a page that is repeated has a text each, an empty table none. Unclosed and stray tags are
closed as browsers do for the common cases (p, li, td, tr, dt, dd, option).
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, slices, table

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW = {k: re.compile(rf"</{k}\b[^>]*>", re.I) for k in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math")}
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_NEVER = frozenset("nav aside footer button select option input textarea script style noscript template iframe svg math object embed canvas audio video dialog menu head title".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table tr tbody thead div article section body html td th blockquote".split())
_ENDS_P = _BLOCK - {"html", "body"}
_NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side-bar rail footer foot masthead topbar toolbar header site-header cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget comment comments commentlist disqus respond reply replies discussion pagination pager skip-link hidden sr-only".split())
#: Names with a meaning in articles as well: they count as a whole class or id of something other than a paragraph, or beside a part's name only.
_AMBIGUOUS_WORDS = frozenset("reply replies respond share sharing rail notice notices alert discussion related header foot promotion subscription subscribe social menu banner login signup widget popup consent recommended".split())
_PART_WORDS = frozenset("box bar list slot container wrapper wrap block button buttons link links section area unit posts articles stories items item widget message form tools icons count text label inner outer top bottom left right module panel thread body meta".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre q cite em strong".split())
_TEXTS = _PARAGRAPHS | frozenset("li dd dt td th figcaption caption summary".split())
_WRAPPER_WORDS = frozenset("no not non has have with without is under elementor".split())
_CONTENT_WORDS = frozenset("content free article main post entry title layout".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPLIT = re.compile(r"[\s_]+|(?<=[a-z])(?=[A-Z])")
_WS = re.compile(r"\s+")


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Node:
    __slots__ = ("path", "tag", "noise", "article", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None, noise: int = False, article: bool = False):
        self.tag, self.parent, self.noise, self.article, self.children, self.path = tag, parent, noise, article, [], False
        self.best = False


#: What ``Node.noise`` is where only a class or id says so.
_HINT = 2


def _noise_name(name: str, tag: str, inside: bool) -> bool:
    """Does a word of a class or id name what is never text? ``inside``: within an article or main, where a part of a name says so beside
    the name of a page's part only."""
    parts = name.split("-")
    if not _WRAPPER_WORDS.isdisjoint(parts) or parts[-1] in _CONTENT_WORDS or parts[-1] == "header" and (inside or not _CONTENT_WORDS.isdisjoint(parts)):
        return False
    if name in _AMBIGUOUS_WORDS:
        return tag not in _PARAGRAPHS
    if name in _NOISE_WORDS:
        return True
    if not _NOISE_WORDS.isdisjoint(parts) and all(x in _NOISE_WORDS or x in _PART_WORDS or x.isdigit() for x in parts):
        return True
    return not inside and any(x in _NOISE_WORDS and x not in _AMBIGUOUS_WORDS for x in (parts[0], parts[-1]))


def _within(node: Node | None) -> bool:
    """Is the node an article or main, or below one?"""
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def _attributes(text: str) -> list[tuple[str, str]]:
    """Names (lower case) and values of a tag's attributes; what stands within a value is no attribute."""
    return [(name.lower(), value.strip("\"'").strip()) for name, value in _ATTRIBUTE.findall(text)]


def _words(attributes: str) -> list[str]:
    """The words of classes and ids."""
    return [word.lower() for name, value in _attributes(attributes) if name in ("class", "id") for word in _SPLIT.split(value) if word]


def _named(tag: str, attributes: str, parent: Node) -> bool:
    words = _words(attributes)
    return bool(words) and any(_noise_name(word, tag, _within(parent)) for word in words)


def _noisy(tag: str, attributes: str, parent: Node) -> int:
    if tag == "aside" and _within(parent) and any("quote" in word for word in _words(attributes)):
        return False
    if tag in _NEVER:
        return True
    if tag == "header":
        return not _within(parent)
    for name, value in _attributes(attributes):
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in _NOISE_ROLES:
            return True
    return _HINT if tag in ("form", "fieldset") or tag not in ("html", "body", "article", "main") and _named(tag, attributes, parent) else False


def _keep_text(root: Node) -> None:
    """Takes the hints back from elements that hold the page's text."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append((node, link))
        stack += [(c, link or c.tag == "a") for c in node.children if isinstance(c, Node) and (not c.noise or c.noise == _HINT)]
    if all(node.noise != _HINT for node, _ in order):
        return
    for node, link in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node) and (not c.noise or c.noise == _HINT)]
        node.chars = sum(c.chars for c in inner) + (0 if link else sum(len("".join(c.split())) for c in node.children if isinstance(c, str)))
        node.tags = node.tag in ("article", "main") and node.article or any(c.tags for c in inner)
    body = next((x for x, _ in order if x.tag == "body"), root)
    for node, _ in order:
        if node.noise == _HINT and (node.tags or not root.tags and 2 * node.chars > body.chars):
            node.noise = False


def tree(page: str) -> Node:
    """The page as a tree of nodes and strings, without the elements that are never text."""
    root = Node("html", None)
    here, at, n = root, 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            here.children.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            up = here
            while up is not None and up.tag != tag:
                if tag not in _BLOCK and up.tag in _SCOPE:
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if tag in ("html", "body") and here.tag in ("html", "body") and (tag == "html" or here.tag == "body"):
            continue
        if tag in _RAW and not (m[3] or "").endswith("/"):
            end = _RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        if closes:
            up = here
            while up is not None and up.tag not in closes and (up.tag not in _SCOPE or up.tag in closes) :
                up = up.parent
            if up is not None and up.tag in closes and up.parent is not None:
                here = up.parent
        node = Node(tag, here, _noisy(tag, m[3] or "", here), tag in ("article", "main") and not _named(tag, m[3] or "", here))
        here.children.append(node)
        if tag not in _VOID and not (m[3] or "").endswith("/"):
            here = node
    _keep_text(root)
    return root


def _count(root: Node) -> None:
    """Characters and tags of all nodes, children before parents (deep pages need no recursion)."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        node.link_tags = node.link_chars = node.tags = node.chars = 0
        order.append((node, link))
        stack += [(c, link or c.tag == "a") for c in node.children if isinstance(c, Node) and not c.noise]
    for node, link in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                k = len("".join(c.split()))
                node.chars += k
                node.link_chars += k if link else 0
            elif not c.noise:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    body = next((x for x, _ in order if x.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node, _ in reversed(order):
        c, t = node.chars, max(1, node.tags)
        lc, lt = max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
        node.density = c / t * math.log(max(1.0, c / lc * t / lt)) / max(base, 1e-9) if c else 0.0
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.noise)


def _reads(node: Node) -> bool:
    """Has the node words outside links in an element that holds text?"""
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag in _TEXTS and x.chars > x.link_chars:
            return True
        stack += [c for c in x.children if isinstance(c, Node) and not c.noise]
    return False


def _blocks(top: Node, threshold: float) -> list[str]:
    """The text of the blocks below a node. On the way down to the densest subtree, what stands beside it under the threshold stays if
    it is text, not mostly links; nothing goes within it, or where an element names the article."""
    out, line = [], []
    named = top.tag in ("article", "main")

    def flush() -> None:
        text = _WS.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    def thin(x: Node) -> bool:
        if named or x.path or not x.parent.path or x.parent.best or x.tag not in _BLOCK or not x.chars or x.density >= threshold:
            return False
        return 2 * x.link_chars > x.chars or not _reads(x)

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.noise or thin(x):
            if x.tag in _BLOCK:
                flush()
        elif x.tag == "br":
            line.append("\n")
        else:
            block = x.tag in _BLOCK
            if block:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def _headlines(root: Node, top: Node) -> list[str]:
    """The first headings that stand before the article, where it has none of its own."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x is top:
            own = [x]
            while own:
                y = own.pop()
                if y.tag == "h1":
                    return []
                own += [c for c in y.children if isinstance(c, Node) and not c.noise]
            return [text for h in found for text in _blocks(h, 0.0)]
        if x.tag == "h1":
            found.append(x)
            continue
        stack += [c for c in reversed(x.children) if isinstance(c, Node) and not c.noise]
    return []


def main_text(page: str | None) -> str:
    """The article of a page as blocks with an empty line between them."""
    root = tree(page or "")
    _count(root)
    best, stack = None, [root]
    while stack:
        node = stack.pop()
        if best is None or node.total > best.total or node.total == best.total and node.density > best.density:
            best = node
        stack += [c for c in node.children if isinstance(c, Node) and not c.noise]
    best.best = True
    threshold, body, up = best.density, root, best
    while up is not None:
        up.path = True
        if up.tag != "html":
            threshold = min(threshold, up.density)
            body = up
        up = up.parent
    # around the densest subtree, an article or main with most of the page's text outside links names where the article ends
    top = best
    while top is not body and top is not root and not (top.tag in ("article", "main") and 2 * (top.chars - top.link_chars) >= body.chars - body.link_chars):
        top = top.parent
    if top is body and body.tag not in ("article", "main"):
        return "\n\n".join(_blocks(root, threshold))
    return "\n\n".join([*_headlines(root, top), *_blocks(top, threshold)])


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""

    def run(batches):
        for batch in (part for batch in batches for part in slices(batch)):
            found = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return mapped(pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")), "page_id long, url string, text string, n_chars long", run)


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))
