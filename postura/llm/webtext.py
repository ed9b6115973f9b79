"""Main text of web pages by composite text density.

Every node of a page's tree gets a density: its characters per tag, lowered the more of
them belong to links. The densities of a node's children add up, and the node with the
largest sum is the heart of the article, and the path from there to the body leads to its
top: the outermost article or main element on it, else the highest node beside whose branch
stand no menus, headers, footers or mostly links. What stands beside the path below the top
belongs to the article, unless it is mostly links; that, and what stands beside the path above
the top, has to reach the threshold, the least density on the path.
Parts that the markup itself names as menus, headers, footers, sidebars, notices,
adverts, forms or comments count as empty throughout. Elements say so; names (class, id,
role) do if all their words speak of such parts or of layout (social-share-bar, not
share-price), not where they tell a state (has-sidebar, comments-open); on paragraphs, headings
and the like only those for adverts and notices count.
A form, a name joined of several words or one beside a word for content doesn't count on an
element that holds most of the page's text outside of links, or an article, main part or
first heading; no name of this kind counts if nothing would be left of the page.

Pages are read whole, one at a time, without a shuffle. Defined results for odd input:
null or empty html, or a page without text, gives an empty text; unclosed and stray tags
are repaired as browsers do for paragraphs and list items; repeated rows each give their
row; further columns are ignored. A line break element ends a block.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp".split())
#: Elements that hold no article text; a form may be around the whole page.
EMPTY = set("head nav header footer aside button select option script style noscript iframe template svg canvas object audio video menu dialog textarea label fieldset title".split())
#: Of these, what a page has around its article.
FRAME = set("nav header footer aside".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Words of class, id and role that mark such parts; those of reader comments; words beside them that tell a state; words for content.
PART = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside"
    r"|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*"
    r"|respond|widget|pagination|pager|copyright|legal|search|contentinfo|complementary|toolbar"
)
#: Words of layout, which may stand beside those; words that count on texts too, which are no containers.
LAYOUT = re.compile(r"area|bar|bars|bottom|box|boxes|block|blocks|btn|button|buttons|column|col|container|content|desktop|fixed|global|icons?|inner|items?|left|links?|list|lists|main|mobile|outer|panel|primary|right|row|secondary|section|site|slot|small|sticky|top|unit|widgets?|wrap|wrapper|zone|post|posts|entry|article|page|story|form|text|message|policy|info|in|up|[a-z]?\d*")
ON_TEXT = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|newsletter|subscribe|subscription|signup|copyright|comments?|disqus|replies")
TEXTS = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split()) | INLINE
COMMENTS = re.compile("comments?|disqus|replies")
STATE = set("has no with without open closed enabled disabled on off is not".split())
CONTENT = set("article post entry content main story page body text".split())
WEAK, STRONG = 1, 2
#: An opening tag closes open ones of these.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = set("article section div main body ul ol dl table blockquote nav aside header footer form".split())


class Node:
    __slots__ = ("chars", "children", "density", "head", "link", "link_chars", "link_tags", "mark", "own", "parent", "part", "plain", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, part: bool, mark: int = 0):
        self.tag, self.parent, self.part, self.mark = tag, parent, part, mark
        self.link = tag == "a" or parent is not None and parent.link
        self.children: list[Node | str] = []
        self.own = self.plain = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.head = False
        self.density = self.total = 0.0


def marked(tag: str, attributes: str) -> int:
    """Whether an element is named as no part of the article: not at all, WEAK or STRONG."""
    if tag in ("html", "body", "main"):
        return 0
    tokens = [re.split("[-_]+", t) for a, b, c in NAMED.findall(attributes) for t in (a or b or c).lower().split()]
    content = any(w in CONTENT for parts in tokens for w in parts)
    found = WEAK if tag == "form" else 0
    for parts in tokens:
        if not STATE.isdisjoint(parts):
            continue
        if any(COMMENTS.fullmatch(w) for w in parts):
            found = STRONG
        elif tag in TEXTS and not any(ON_TEXT.fullmatch(w) for w in parts):
            continue
        elif tag != "article" and any(PART.fullmatch(w) for w in parts) and all(PART.fullmatch(w) or LAYOUT.fullmatch(w) for w in parts):
            found = max(found, WEAK if content or len(parts) > 1 else STRONG)
    return found


def parse(page: str) -> Node:
    """The page's tree; texts are children of their node."""
    root = at = Node("#root", None, False)
    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.match(page, pos)
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                at.children.append(text)
                at.own += len(" ".join(html.unescape(text).split()))
            continue
        tag = tag.lower()
        if m.group(1):
            node = at
            while node.parent is not None and node.tag != tag:
                # an inline end tag doesn't reach beyond the block it stands in
                node = root if tag in INLINE | {"p"} and node.tag in BARRIER else node.parent
            if node.parent is not None:
                at = node.parent
            continue
        attributes = m.group(3)
        if tag not in INLINE:  # blocks end an open paragraph, and list items and cells their likes
            ends = CLOSES.get(tag, {"p"})
            node = at
            while node.parent is not None and node.tag not in BARRIER | ends:
                node = node.parent
            while node.tag in ends and node.parent is not None:
                at = node = node.parent
        node = Node(tag, at, at.part or tag in EMPTY, marked(tag, attributes))
        at.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = close.end() if close else end
        elif tag not in VOID and not attributes.endswith("/"):
            at = node
    return root


def settle(order: list[Node], least: int) -> None:
    """Decides which marked nodes count as empty, from the root down; order has parents before children. Marks below least are weak."""
    body = next((x for x in order if x.tag == "body"), order[0])
    for node in order:
        if node.parent is not None and node.parent.part:
            node.part = True
        elif node.mark >= STRONG >= least or node.mark and not node.head and 2 * node.plain <= body.plain:
            node.part = True


def measure(root: Node) -> list[Node]:
    """Fills in the counts from the leaves up, then the densities; returns the nodes from the root down."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in reversed(node.children) if isinstance(x, Node)]
    for node in reversed(order):
        if not node.part:  # text outside of links, and whether an article's beginning is inside
            node.plain += node.own * (not node.link)
            node.head = node.head or node.tag in ("article", "main", "h1") and node.plain > 0 and node.mark < STRONG
            if node.parent is not None:
                node.parent.plain += node.plain
                node.parent.head = node.parent.head or node.head
    first = [node.part for node in order]
    settle(order, STRONG)
    if order[0].plain and not any(x.own and not x.part for x in order):
        for node, part in zip(order, first):
            node.part = part
        settle(order, STRONG + 1)
    for node in reversed(order):
        for x in node.children:
            if isinstance(x, Node) and not x.part:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if not node.part:
            node.chars += node.own
            node.link_chars += node.own * node.link
    whole = next((x for x in order if x.tag == "body"), root)
    share = whole.link_chars / max(whole.chars, 1)
    for node in reversed(order):
        if node.part or not node.chars:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        node.density = c / t * max(0.0, math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(max(base, 1.0001)) if base > 1 else math.log(c / max(lc, 1) * t / max(lt, 1)))
        if node.link_chars == c:
            node.density = 0.0
        node.total = sum(x.density for x in node.children if isinstance(x, Node))
        if any(isinstance(x, str) and x.strip() for x in node.children):
            node.total = max(node.total, node.density)  # its own text is a leaf
    return order


def blocks(node: Node, out: list[list[str]]) -> None:
    """Texts of the node by block, in page order."""
    todo: list[tuple[Node | str | None]] = [(node,)]
    while todo:
        (x,) = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(html.unescape(x))
        elif not x.part:
            inner = [(y,) for y in reversed(x.children)]
            todo += inner if x.tag in INLINE else [(None,), *inner, (None,)]


def linked(node: Node) -> bool:
    """Whether most of its text belongs to links."""
    return 2 * node.link_chars > node.chars


def below_top(path: list[Node]) -> set[int]:
    """The nodes of a path, from the heart up to the body, that are the article's top or lie below it."""
    named = [i for i, x in enumerate(path) if x.tag in ("article", "main")]
    top = named[-1] if named else 0
    for i in range(top + 1, len(path) if not named else 0):
        beside = [x for x in path[i].children if isinstance(x, Node) and x is not path[i - 1]]
        if any(x.tag in FRAME or x.part and (path[i].tag == "body" and x.tag not in RAW | VOID) or not x.part and x.chars and linked(x) for x in beside):
            break
        top = i
    return {id(x) for x in path[: top + 1]}


def extract(page: str | None) -> str:
    if not page:
        return ""
    order = measure(parse(page))
    body = next((x for x in order if x.tag == "body"), order[0])
    inside = [x for x in order if x.chars and not x.part and x.tag not in INLINE] or [body]
    heart = max(inside, key=lambda x: x.total)
    path, node = [], heart
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    threshold = min(x.density for x in path)
    inner = below_top(path)
    out: list[list[str]] = [[]]
    on_path = {id(x): x for x in path}
    todo: list[Node | str | None] = [path[-1]]
    while todo:  # from the body down the path; None ends a block
        x = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            if x.strip():
                out[-1].append(html.unescape(x))
        elif x is heart:
            blocks(x, out)
        elif id(x) in on_path:
            todo += [None, *reversed(x.children), None]
        elif not x.part and x.chars and (x.density >= threshold or x.tag in INLINE or id(x.parent) in inner and not linked(x)):
            blocks(x, out)
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in out) if t)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
