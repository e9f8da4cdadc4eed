"""Main text of web pages by tree scoring.

The page becomes a tree, with end tags implied where HTML implies them. Menus,
forms and other elements that are never article text are cut, and so are parts
whose class, id or role says that they stand beside the article: containers by
any word of a name, paragraphs and headings only by a whole name, as their ids
are slugs of what they say. Words that may also name a topic cut a container
only if it does not read like prose, and nothing that holds the article is cut.

Every paragraph then passes points for its length and its commas to its
ancestors: all to the parent, half of that to the grandparent, a quarter to the
next and so on, less what is link text. The best container, or the article
around it, is kept with those siblings that score well or read like prose. Of
several articles on a page it is the one with the best container.

Trees are built and scored in time linear in the page, however deep it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame

from orderlens.llm.common import map_rows

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
PROSE = frozenset("p pre blockquote td dd li".split())
NEVER = frozenset(
    "head script style template noscript nav header footer aside form fieldset button select option textarea input "
    "iframe object embed svg canvas audio video dialog menu search map".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("body caption head html legend tbody td tfoot th thead title tr".split())
# A start tag that ends an open element, and the elements beyond which it does not reach.
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
PARAGRAPH_SCOPE = frozenset("table td th caption button object html template".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that mark parts beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs comment "
    "comments complementary contentinfo cookie cookies consent copyright dialog disclaimer discussion disqus footer "
    "gdpr header infobar leaderboard legal lightbox login masthead menu modal nav navbar navigation newsletter notice "
    "notices outbrain overlay pager pagination paywall popular popup promo promoted recommended related replies respond "
    "search share sharing sidebar sidenav signin signup skip social sponsor sponsored subscribe subscription taboola "
    "toolbar topbar trending widget".split()
)
# Those of them that, in a name of several words, may also say what an article is about.
TOPICS = frozenset("copyright legal navigation popular recommended related search share social trending".split())
# Elements whose names of several words are slugs of what they say.
SLUGGED = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
# Words before such a word that say what a part has, not what it is.
HAS = frozenset("has with without no show hide is".split())
TOP = frozenset("html body article main".split())

SIBLING_SHARE = 0.2
# A part with so many characters of paragraphs, and no more than this share of links, reads like prose.
PROSE_CHARS = 80
PROSE_LINKS = 0.25

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*'|["'])*+)>|<[!?][^>]*>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MARKS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_RAW_END = {name: re.compile(rf"</{name}\s*/?>", re.IGNORECASE) for name in RAW}


KEPT, DOUBTFUL, BESIDE_IT, NEVER_TEXT = range(4)


@dataclass(eq=False, slots=True)
class Node:
    name: str
    parent: Node | None
    mark: int = KEPT
    depth: int = 0
    cut: bool = False
    parts: list = field(default_factory=list)  # texts and nodes in page order
    points: float = 0.0
    size: int = 0
    linked: int = 0
    prose: int = 0
    holds_article: bool = False

    @property
    def nodes(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]


def _named(value: str, whole: bool) -> int:
    """What the names in a class, id or role say of a part; with ``whole``, names of several words say nothing."""
    mark = KEPT
    for name in unescape(value).split():
        words = [w.lower() for w in _MARKS.findall(name)]
        if whole and len(words) > 1:
            continue
        for before, w in zip(["", *words], words):
            if w in BESIDE and before not in HAS:
                mark = max(mark, DOUBTFUL if w in TOPICS and len(words) > 1 else BESIDE_IT)
    return mark


def _marked(name: str, rest: str) -> int:
    """What an element's name and attributes say: article text, in doubt, beside the article, or never text."""
    if name in NEVER:
        return NEVER_TEXT
    if name in TOP or "=" not in rest and "hidden" not in rest.lower():
        return KEPT
    mark = KEPT
    for found in _ATTRIBUTE.finditer(rest):
        key = found[1].lower()
        value = found[2] or found[3] or found[4] or ""
        if key in ("class", "role") or key == "id" and name not in HEADING:
            mark = max(mark, _named(value, name in SLUGGED))
        value = value.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return NEVER_TEXT
    return mark


class Open:
    """The open elements, with the depth of the last one of every name."""

    def __init__(self) -> None:
        self.root = self.node = Node("html", None)
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, names: frozenset) -> int:
        """The depth of the deepest open element with one of the names, 0 if there is none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def push(self, child: Node) -> None:
        self.node = child
        self.depths.setdefault(child.name, []).append(child.depth)
        if child.name in BLOCK:
            self.blocks.append(child.depth)

    def close_to(self, depth: int) -> None:
        """Close everything down from ``depth``; every element is closed once."""
        while self.node.depth >= depth:
            self.depths[self.node.name].pop()
            if self.node.name in BLOCK:
                self.blocks.pop()
            self.node = self.node.parent

    def close(self, names: frozenset, bound: int) -> bool:
        """Close the deepest element of the names, unless it lies above ``bound``."""
        depth = self.last(names)
        if depth <= bound:
            return False
        self.close_to(depth)
        return True


def parse(html: str) -> Node:
    """The page's tree; tags that are never closed end with the page."""
    stack, at = Open(), 0
    while at < len(html):
        tag = _TAG.search(html, at)
        if tag is None:
            stack.node.parts.append(html[at:])
            break
        if tag.start() > at:
            stack.node.parts.append(html[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name or name == "html":
            continue
        if tag["end"]:
            # An inline end tag does not reach beyond the block it stands in.
            bound = 0 if name in BLOCK or not stack.blocks else stack.blocks[-1]
            stack.close(frozenset([name]), bound)
            continue
        if name in ENDS_PARAGRAPH:
            stack.close(frozenset(["p"]), stack.last(PARAGRAPH_SCOPE))
        if name in IMPLIED_END:
            ended, bounds = IMPLIED_END[name]
            while stack.close(ended, stack.last(bounds)):
                pass
        child = Node(name, stack.node, _marked(name, tag["rest"]), stack.node.depth + 1)
        stack.node.parts.append(child)
        if name in RAW:
            stop = _RAW_END[name].search(html, at)
            child.parts.append(html[at : stop.start() if stop else len(html)])
            child.mark = NEVER_TEXT
            at = stop.end() if stop else len(html)
        elif name not in VOID:
            stack.push(child)
    _cut(stack.root)
    return stack.root


def _cut(root: Node) -> None:
    """Decide which marked parts go: those never text, those beside an article, and doubtful ones that are no prose."""
    order = []
    todo = [(root, False)]
    while todo:
        node, linked = todo.pop()
        node.cut = node.mark == NEVER_TEXT
        if not node.cut:
            order.append((node, linked))
            todo.extend((child, linked or child.name == "a") for child in node.nodes)
    for node, linked in reversed(order):
        own = sum(len(part.strip()) for part in node.parts if isinstance(part, str))
        kept = [child for child in node.nodes if not child.cut]
        node.size = own + sum(child.size for child in kept)
        node.linked = (own if linked else 0) + sum(child.linked for child in kept)
        node.prose = node.size if node.name in PROSE else sum(child.prose for child in kept)
        node.holds_article = node.name in ("article", "main") or any(child.holds_article for child in kept)
        if node.mark in (DOUBTFUL, BESIDE_IT) and not node.holds_article:
            reads = node.prose >= PROSE_CHARS and node.linked <= PROSE_LINKS * node.size
            node.cut = node.mark == BESIDE_IT or not reads


def _link_density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _own_text(node: Node) -> str:
    """A paragraph's text: all of it up to the blocks within it."""
    out, todo = [], [node]
    while todo:
        here = todo.pop()
        if isinstance(here, str):
            out.append(here)
        elif here is node or not (here.cut or here.name in BLOCK):
            todo.extend(reversed(here.parts))
    return unescape("".join(out)).strip()


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        here = todo.pop()
        if not here.cut:
            yield here
            todo.extend(reversed(here.nodes))


def best_container(root: Node) -> Node | None:
    """The node with the most points; none without any text."""
    order = list(_walk(root))
    for node in order:
        if node.name not in BLOCK and node is not root:
            continue
        text = _own_text(node)
        if text:
            points = (1.0 + text.count(",") + min(len(text) / 100, 3.0)) * (1.0 - _link_density(node))
            # Prose elements speak for the container around them, other blocks for themselves.
            (node.parent if node.name in PROSE or node.name in HEADING else node).points += points
    # Children come after their parents, so their points are complete when they are passed on.
    for node in reversed(order):
        if node.parent is not None:
            node.parent.points += node.points / 2
    scored = [node for node in order if node.points > 0]
    if not scored:
        return root if root.size else None
    best = max(scored, key=lambda n: n.points * (1.0 - _link_density(n)))
    around = best
    while around is not None:
        if around.name in ("article", "main"):
            return around
        around = around.parent
    return best


def kept_nodes(best: Node) -> list[Node]:
    """The best container and its siblings that belong to it, in page order."""
    if best.parent is None or best.name in TOP:
        return [best]
    least = SIBLING_SHARE * best.points
    kept = []
    for node in best.parent.nodes:
        if node is best:
            kept.append(node)
        elif not node.cut and node.name in BLOCK:
            size, density = node.size, _link_density(node)
            prose = node.name in PROSE and (size > PROSE_CHARS and density < PROSE_LINKS or 0 < size <= PROSE_CHARS and density == 0)
            heading = node.name in HEADING and density == 0
            if node.points >= least > 0 or prose or heading:
                kept.append(node)
    return kept


def _blocks(nodes: list[Node]) -> Iterator[str]:
    """The texts of the blocks below the nodes; blocks and line feeds between them split texts."""
    held: list[str] = []
    todo: list = [x for node in reversed(nodes) for x in (None, node, None)]
    while todo:
        here = todo.pop()
        if here is None:
            yield "".join(held)
            held = []
        elif isinstance(here, str):
            held.append(here)
        elif here.name == "br":
            held.append("\n")
        elif not here.cut:
            edge = [None] if here.name in BLOCK else []
            todo.extend([*edge, *reversed(here.parts), *edge])
    yield "".join(held)


def main_text(html: str | None) -> str:
    """The page's main text: blocks in page order, joined by an empty line; '' if there is none."""
    best = best_container(parse(html or ""))
    if best is None:
        return ""
    texts = (" ".join(unescape(block).split()) for block in _blocks(kept_nodes(best)))
    return "\n\n".join(text for text in texts if text)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    A null or empty html, or one without main text, gives '' with 0
    characters. Markup may be broken or without any tag (then all is text), and
    pages may be long and deep; one at a time is held.
    Repeated rows give repeated rows, nulls in page_id and url stay, an empty
    table gives an empty result, and other columns are ignored.
    """

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            text = main_text(row["html"])
            yield {"page_id": row["page_id"], "url": row["url"], "text": text, "n_chars": len(text)}

    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    return map_rows(pages.select("page_id", "url", "html"), work, schema)
