"""Main text of web pages by tree scoring (operator 5).

A page becomes a light tree. Each paragraph passes points for its length and
its commas to its ancestors, all of them to its parent, half to the next, and
less further up, ``LEVELS`` in all; a container's points are discounted by the share of its text
that stands in links. The best container is kept together with those of its
siblings that score near it or are long paragraphs with few links. What is
never main text (menus, headers, footers, sidebars, forms, scripts, notices,
adverts, comments of readers) is cut before scoring.

Defined cases: null and empty html give the empty text, and so does a page
without text; cut-off markup at the end of a page is dropped; very long and deeply
nested pages take time in proportion to their length; rows that repeat
give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table, text_or_empty

# Element names of HTML by what they are to this operator.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
CUT = frozenset("head script style textarea title noscript iframe xmp noembed noframes template svg math nav header footer aside form button select option menu dialog object embed canvas audio video map".split())
#: Elements of CUT that stay where a layout wraps the page's main text in them.
WRAPPERS = frozenset("form header dialog object map".split())
#: What stays beside an article in main if few of its words stand in links.
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary"}
#: An opening tag closes open ones of these names, up to the nearest element that contains such.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id or role that mark what is not main text.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|block|wrap|container)|advert\w*|adsense|breadcrumbs?|byline-share|comments?|comment(?:list|area|form|s?section)|discussion|respond|replies|disqus|consent|cookies?|copyright|dialog|footer|gdpr|masthead|topbar|login|menu|modal|nav\w*|newsletter|notification|pager|pagination|paywall|popup|promo\w*|recommend\w*|related|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|toolbar|widget|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Words that mark it if they are a whole name, or part of one that does not speak of the article.
WEAK = re.compile(r"(?:^|[_-])(?:alert|aside|banner|header|notices?|search|share|side|tags)(?:$|[_-])", re.I)
OF_ARTICLE = re.compile(r"(?:^|[_-])(?:article|blog|body|content|entry|headline|post|story|text|title|by)(?:$|[_-])", re.I)
LIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|block|wrap|container)|advert\w*|adsense|aside|banner|breadcrumbs?|byline-share|comments?|comment(?:list|area|form|s?section)|discussion|respond|replies|disqus|consent|cookies?|copyright|dialog|footer|gdpr|header|masthead|topbar|login|menu|modal|nav\w*|newsletter|notices?|notification|alert|pager|pagination|paywall|popup|promo\w*|recommend\w*|related|search|share|sharing|side|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|widget|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)""", re.S)
#: The next attribute of a tag, or its end; a quote counts only where a value starts.
_ATTR = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>)|(["'])))?)""")
#: Words that mark an article element as a reader's, an advert's or a teaser of another page.
NOT_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|ads?|advert\w*|promo\w*|sponsor\w*|related|teaser)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: Ancestors that a paragraph passes points to.
LEVELS = 6
#: What stands beside an article even where it holds article elements.
_SIDE = re.compile(r"comments?|repl(?:y|ies)|related", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "marks", "cut", "points", "chars", "linked", "holds", "size")

    def __init__(self, tag: str, parent: Node | None, marks: str = "", cut: bool = False):
        self.tag, self.parent, self.marks, self.cut = tag, parent, marks, cut
        self.children: list = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.holds, self.size = False, 0


def _attributes(html: str, at: int) -> tuple[int, str, bool, bool]:
    """Reads a tag's attributes from ``at``: its end (-1 if the page ends first), class, id and role, whether it is hidden, whether it closes itself."""
    marks, hidden = [], False
    while m := _ATTR.match(html, at):
        if m[1]:
            return m.end(), " ".join(marks), hidden, html[m.start(1) - 1] == "/"
        if m[6]:  # a quote that never ends
            return -1, "", False, False
        at = m.end()
        name = m[2].lower()
        if name == "hidden":
            hidden = True
        elif name in ("class", "id", "role", "aria-hidden", "style"):
            value = m[3] or m[4] or m[5] or ""
            if name == "aria-hidden":
                hidden |= value.lower() == "true"
            elif name == "style":
                hidden |= bool(_HIDDEN.search(value))
            else:
                marks.append(value)
    return -1, "", False, False


def parse(html: str) -> Node:
    """A tree of elements and strings. Tolerant: stray ends are ignored, open elements end with the page."""
    root = Node("#root", None)
    nodes, wrapped = [root], False
    opened: dict[str, int] = {}  # open elements by name, so that nothing is looked for in vain
    at, node, n = 0, root, len(html)

    def close(x: Node) -> Node:
        """Closes all up to ``x``; returns its parent."""
        y = node
        while y is not x.parent:
            opened[y.tag] -= 1
            y = y.parent
        return y

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            cut = html.rfind("<", at)  # what may be the start of a cut-off tag
            tail = html[at:] if cut < 0 or not re.match(r"</?[A-Za-z!]", html[cut:]) else html[at:cut]
            node.children.append(unescape(tail))
            break
        if m.start() > at:
            node.children.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        at, marks, hidden, itself = _attributes(html, at)
        if at < 0:
            break  # the page ends inside a tag
        if m[1]:
            if opened.get(tag):
                x = node
                while x.tag != tag:
                    x = x.parent
                node = close(x)
            continue
        if tag in ENDS_P and opened.get("p"):
            x = node
            while x is not root and x.tag != "p" and x.tag not in ("td", "th", "div", "article", "section", "li"):
                x = x.parent
            if x.tag == "p":
                node = close(x)
        if tag in IMPLIED and any(opened.get(t) for t in IMPLIED[tag][0]):
            closes, inside = IMPLIED[tag]
            x, last = node, None
            while x is not root and x.tag not in inside:
                if x.tag in closes:
                    last = x
                x = x.parent
            if last is not None:
                node = close(last)
        new = Node(tag, node, marks, hidden or tag in CUT)
        node.children.append(new)
        nodes.append(new)
        wrapped |= tag in WRAPPERS and not hidden
        if tag in WRAPPERS and not hidden:
            new.size = -1  # may be kept
        if tag in VOID or (itself and tag in ("svg", "math")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        node = new
        opened[tag] = opened.get(tag, 0) + 1
    _weigh(root, nodes, wrapped)
    return root


def _weigh(root: Node, nodes: list[Node], wrapped: bool) -> None:
    """Which elements hold the article, and what wraps it, or, on a page without one, more text than stands outside: that stays.

    ``nodes`` are in page order, so that their reverse has children before parents.
    """
    for x in reversed(nodes):
        x.holds = any(isinstance(c, Node) and not c.cut and (c.holds or c.tag == "main" or c.tag == "article" and not NOT_ARTICLE.search(c.marks)) for c in x.children)
        if x.size < 0 and x.holds and not _SIDE.search(x.marks):
            x.cut = False
    if not wrapped or root.holds:
        return
    wrappers = [x for x in nodes if x.size < 0]

    def weigh(x: Node) -> int:
        return sum(len(c.strip()) if isinstance(c, str) else 0 if c.cut else c.size for c in x.children)

    for x in reversed(nodes):
        x.size = weigh(x)
    outside = root.size
    at = set(map(id, wrappers))
    for x in reversed(nodes):
        x.size = weigh(x)  # wrappers inside may be kept by now
        if id(x) in at and x.cut and x.size > outside:
            x.cut = False
            y = x
            while y is not root and not y.cut:
                y = y.parent
            outside += x.size if y is root else 0  # inside another that is cut, it counts with that one


def _spaced(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _unlikely(marks: str) -> bool:
    return bool(UNLIKELY.search(marks)) or any(WEAK.search(name) and not OF_ARTICLE.search(name) for name in marks.split())


def _score(root: Node, cut_unlikely: bool) -> list[Node]:
    """Fills in points and text lengths from the leaves up; returns the containers that have points."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        if cut_unlikely and x.marks and not x.cut and x.tag not in ("html", "body", "main", "#root"):
            # an element of an unlikely name may wrap the article itself, as a layout with a sidebar does
            x.cut = bool(NOT_ARTICLE.search(x.marks)) if x.tag == "article" else _unlikely(x.marks) and not (x.holds and not _SIDE.search(x.marks))
        if not x.cut:
            stack += [c for c in x.children if isinstance(c, Node)]
    own: dict[int, tuple[int, int]] = {}
    scored: dict[int, Node] = {}
    for x in reversed(order):
        if x.cut:
            continue
        inline = commas = 0
        for c in x.children:
            if isinstance(c, str):
                size = len(c.strip())
                inline += size
                commas += c.count(",") + c.count("，") + c.count("、")
                x.chars += size
            elif not c.cut:
                x.chars += c.chars
                x.linked += c.chars if c.tag == "a" else c.linked
                if c.tag not in BLOCK:  # inline: its text is this element's
                    size, more = own.get(id(c), (0, 0))
                    inline += size
                    commas += more
        if x.tag not in BLOCK:
            own[id(x)] = (inline, commas)
            continue
        if inline and x.tag not in ("html", "body"):
            points = (1 + commas + min(inline / 100, 3)) * (1 - min(1.0, x.linked / max(1, x.chars)))
            p, level = x.parent, 0
            while p is not None and level < LEVELS and (p.tag in BLOCK or p.tag == "#root"):
                p.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                scored[id(p)] = p
                p, level = p.parent, level + 1
    for x in scored.values():
        if x.tag in ("article", "main") or LIKELY.search(x.marks):
            x.points += 5
        x.points *= 1 - min(1.0, x.linked / max(1, x.chars))
    return list(scored.values())


def _blocks(nodes: list, out: list[str]) -> None:
    """Blocks of text under ``nodes`` in page order."""
    run: list[str] = []

    def flush():
        if text := _spaced(run):
            out.append(text)
        run.clear()

    # an explicit stack, as pages nest deeper than Python recurses: (node or string) to open, None to end a block
    stack = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.cut:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in BLOCK:
            flush()
            stack.append(None)
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    flush()


def _with_rest_of_main(article: Node, near: list) -> list:
    """``near``, siblings of an article, with the headings, paragraphs and texts beside it up to the main element, in page order."""
    x = article.parent
    while x is not None and x.tag != "main":
        x = x.parent
    if x is None:
        return near
    main, x, level = x, article, max(10.0, 0.2 * article.points)
    while x is not main:
        beside, kept = [], set(map(id, near))
        for c in x.parent.children:
            if c is x and x is not article:
                beside += near
            elif isinstance(c, str) or id(c) in kept:
                beside.append(c)
            elif not c.cut and c.tag != "article":
                density = c.linked / max(1, c.chars)
                if c.points >= level or c.tag in BESIDE and density < 0.25 or c.tag == "p" and (density < 0.25 or not c.linked) or c.tag not in BLOCK and c.tag != "a":
                    beside.append(c)
        near, x = beside, x.parent
    return near


def main_text(html: str) -> str:
    """The main text: blocks of the best container and its kept siblings, joined by newlines."""
    if not html:
        return ""
    for cut_unlikely in (True, False):  # where nothing is left, names may have misled
        root = parse(html)
        scored = _score(root, cut_unlikely)
        if scored:
            break
    else:
        return _kept([root])
    best = max(scored, key=lambda x: x.points)
    x = best
    while x is not None and x.tag not in ("article", "main"):
        x = x.parent
    if x is not None:
        best = x
    if best.parent is None or best.tag in ("body", "html", "article", "main"):
        near = [best]
        if best.tag == "article":  # a page of several articles
            near = [c for c in best.parent.children if c is best or isinstance(c, Node) and c.tag == "article" and not c.cut and c.points >= 0.2 * best.points]
            near = _with_rest_of_main(best, near)
        return _kept(near)
    level = max(10.0, 0.2 * best.points)
    near = []
    for c in best.parent.children:
        if isinstance(c, str) or c.cut:
            continue
        density = c.linked / max(1, c.chars)
        if c is best or c.points >= level or c.tag in ("h1", "h2", "h3") and density < 0.25 or c.tag == "p" and (c.chars > 80 and density < 0.25 or 0 < c.chars <= 80 and not c.linked):
            near.append(c)
    return _kept(near)


def _kept(nodes: list) -> str:
    out: list[str] = []
    _blocks(nodes, out)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of ``pages(page_id, url, html)``."""

    def run(batches):
        for batch in slices(batches):
            text = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_tree_scored_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
