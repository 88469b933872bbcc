"""Main text of web pages by composite text density.

Every DOM node gets its characters, link characters, tags and link tags. Its composite density is the characters per
tag, weighed down by the share of linked text. The density sum of a block adds the densities of what it is made of: the
blocks right below it, and the runs of text and inline tags between them. The block of maximum density sum is content;
the least density on the path from it up to the body is the threshold. Any other block that reaches the threshold, and
isn't mostly links, gives its own subtree of maximum density sum as further content. Headings right before content belong
to it; lists of links inside it that stay below the threshold don't. All is read in page order.

Menus, headers, footers, asides, forms, scripts, styles, hidden nodes, and nodes whose class, id or role says advert,
notice, comment, sidebar and the like are left out of the tree before densities are computed, as are head and title.
A class or id alone doesn't drop what holds the page's text (``drop_flagged``); if nothing else is left, it drops nothing.

Defined results: null, empty or textless html gives the empty text; repeated pages stay repeated; unclosed, stray and
misnested tags are repaired (an open paragraph, list item, row, cell or option is closed by the next); ties in density
sum go to the node that comes first. Whole pages are read in time linear in their length; nothing is cut. No shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head title script style noscript template iframe object svg canvas nav footer aside form button select textarea menu dialog xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
# an opening tag of the key closes an open tag of the value, up to the nearest container
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "tbody", "tfoot"}, "tbody": {"tr", "td", "th", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
CLUTTER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"comments?|respond|disqus|replies|reply|sidebar|side-bar|aside|widget|related|recommended|recommendations|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toolbar|social|share|sharing|footer|masthead|site-header|"
    r"page-header|topbar|skip-link|disclaimer|tag-list|outbrain|taboola)s?(?:$|[\s_-])", re.I
)
# "has-sidebar" or "ad-free" says what is around a node, not what it is
NEGATED = re.compile(r"\b(?:has|with|without|no|non|is)[_-][a-z]+(?:[_-][a-z]+)*|\b[a-z]+[_-]free\b", re.I)
CLUTTER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: links in a block from which on it can be a list of links
RAIL_LINKS = 3
_OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)(?:([^<>\"']*)>)?|!--|[!?])")
_TAG_STEP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("block", "chars", "children", "density", "flagged", "in_link", "link_chars", "link_tags", "parent", "score", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, flagged: bool = False) -> None:
        self.tag, self.parent, self.flagged = tag, parent, flagged
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.score = 0.0
        self.block = tag in BLOCK
        self.in_link = tag == "a" or (parent is not None and parent.in_link)


class OpenTags:
    """The stack of open tags, which finds the last one of a name without walking."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Node, bool]] = []  # tag, the node it is in, whether it is inside clutter
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, parent: Node, clutter: bool) -> None:
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, parent, clutter))

    def pop(self) -> tuple[Node, bool]:
        tag, parent, clutter = self.stack.pop()
        self.places[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
        return parent, clutter

    def last(self, *tags: str) -> int:
        """Place of the last open one of the tags; -1 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def ended_by_end(self, tag: str) -> int:
        """Place down to which an end tag closes; an inline tag's end doesn't close blocks around it."""
        at = self.last(tag)
        return -1 if tag not in BLOCK and self.blocks and self.blocks[-1] > at else at

    def ended_by_start(self, wanted: set[str], scope: set[str]) -> int:
        """Place down to which an opening tag closes tags of ``wanted`` inside the nearest of ``scope``."""
        at = self.last(*wanted)
        if at <= self.last(*scope):
            return -1
        # the outermost of a run (a cell inside the row that ends)
        while at and self.stack[at - 1][0] in wanted:
            at -= 1
        return at


class Tokens:
    """(start, end, is an end tag, name, attributes) of each tag, comment or declaration; the name is empty for the latter two.

    Each place is looked at once: what has no end further on is remembered.
    """

    def __init__(self, page: str) -> None:
        self.page, self.unclosed = page, set()

    def find(self, what: str, pos: int) -> int:
        if what in self.unclosed:
            return -1
        at = self.page.find(what, pos)
        if at < 0:
            self.unclosed.add(what)
        return at

    def next(self, pos: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while m := _OPENING.search(page, pos):
            pos = m.end()
            if m[3] is not None:
                return m.start(), pos, m[1] == "/", m[2].lower(), m[3]
            if m[2] is None:
                if m[0] == "<!--":
                    end = self.find("-->", pos)
                    return m.start(), len(page) if end < 0 else end + 3, False, "", ""
                if (end := self.find(">", pos)) >= 0:
                    return m.start(), end + 1, False, "", ""
                continue
            at = pos
            while ">" not in self.unclosed:
                step = _TAG_STEP.search(page, at)
                if step is None:
                    self.unclosed.add(">")
                elif step[1] is None:
                    return m.start(), step.end(), bool(m[1]), m[2].lower(), page[pos : step.start()]
                else:
                    # a quote without an end is a letter
                    end = self.find(step[1], step.end())
                    at = step.end() if end < 0 else end + 1
        return None


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def is_clutter(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether a subtree can't be main text by its tag or attributes, and whether its class or id says that it isn't."""
    if tag in DROPPED:
        return True, False
    if not raw or raw.isspace() or tag in ("body", "html", "main", "article"):
        return False, False
    a = attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "") or a.get("role", "").lower() in CLUTTER_ROLES:
        return True, False
    return False, any(CLUTTER.search(NEGATED.sub(" ", a[k])) for k in ("class", "id") if a.get(k))


def drop_flagged(root: Node) -> None:
    """Takes nodes with a clutter class or id from the tree, but not those that wrap the page's text.

    Such a node stays if it holds a main; if it holds an article and the text outside all flagged nodes isn't most of the
    page's; or if it holds most of the page's text and no article or main outside flagged nodes has a quarter of it. Text
    is counted in characters outside links.
    """
    nodes = in_order(root)
    if not any(n.flagged for n in nodes):
        return
    # characters outside links, those of them outside flagged nodes too, and the tags article and main, at or below a node
    plain, bare, held = {}, {}, {}
    for node in reversed(nodes):
        below = [c for c in node.children if isinstance(c, Node)]
        own = sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        plain[node] = 0 if node.tag == "a" else own + sum(plain[c] for c in below)
        bare[node] = 0 if node.tag == "a" or node.flagged else own + sum(bare[c] for c in below)
        held[node] = ({node.tag} & {"article", "main"}).union(*(held[c] for c in below))
    total, known, stack = plain[root], 0, [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            known += bare[node]
        elif not node.flagged:
            stack += [c for c in node.children if isinstance(c, Node)]

    def stays(node: Node) -> bool:
        return "main" in held[node] or ("article" in held[node] and bare[root] * 2 <= total) or (plain[node] * 2 > total and known * 4 < total)

    gone = {n for n in nodes if n.flagged and not stays(n)}
    for parent in {n.parent for n in gone}:
        parent.children = [c for c in parent.children if c not in gone]


def parse(page: str, by_name: bool = True) -> Node:
    """The tree of a page without clutter (``by_name``: by class and id too). Text nodes are strings with references decoded."""
    root = Node("html", None)
    at, here = 0, root
    tags, tokens = OpenTags(), Tokens(page)
    hidden = 0

    def text(a: int, b: int) -> None:
        if a < b and not hidden:
            here.children.append(html.unescape(page[a:b]))

    def close(down_to: int) -> None:
        nonlocal here, hidden
        while 0 <= down_to < len(tags.stack):
            here, clutter = tags.pop()
            hidden -= clutter

    while token := tokens.next(at):
        start, end, closing, tag, raw = token
        text(at, start)
        at = end
        if not tag:
            continue
        if closing:
            close(tags.ended_by_end(tag))
            continue
        if tag in ("html", "body") and tags.last(tag) >= 0:
            continue
        if tag in BLOCK:
            close(tags.ended_by_start({"p"}, {"table", "td", "th", "button", "object"}))
        if tag in CLOSES:
            close(tags.ended_by_start(CLOSES[tag], SCOPE.get(tag, {"table"})))
        if tag == "header" and tags.last("article", "main", "section") < 0:
            clutter, flagged = True, False
        else:
            clutter, flagged = is_clutter(tag, raw)
        if tag in VOID:
            if not hidden and tag in ("br", "hr", "wbr"):
                here.children.append(Node(tag, here))
            continue
        if raw.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            if not hidden and not clutter:
                here.children.append(html.unescape(page[at : ended.start()]))
            at = ended.end()
            continue
        parent = here
        tags.push(tag, parent, clutter)
        hidden += clutter
        if not hidden:
            here = Node(tag, parent, flagged)
            parent.children.append(here)
    text(at, len(page))
    if by_name:
        drop_flagged(root)
    return root


def in_order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def composite(chars: int, tags: int, link_chars: int, link_tags: int, linked: float) -> float:
    """Characters per tag, weighed down by links; ``linked`` is the share of linked text in the page."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + linked * chars + math.e)
    weight = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * max(0.0, math.log(max(1.0, weight)) / math.log(max(math.e, base)))


def densities(root: Node) -> list[Node]:
    """Fills counts, composite densities and density sums; returns the nodes, parents first.

    All text and all tags below a link are linked, whatever blocks the link holds.
    """
    nodes = in_order(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACE.sub(" ", c).strip())
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + c.in_link
                node.block |= c.block
        if node.in_link:
            node.link_chars = node.chars
    linked = root.link_chars / root.chars if root.chars else 0.0
    for node in nodes:
        # a node inside a link is a link itself, with or without tags below it
        node.density = 0.0 if node.in_link else composite(node.chars, node.tags, node.link_chars, node.link_tags, linked)
    for node in nodes:
        if not node.block:
            continue
        run = [0, 0, 0, 0]  # of text and inline tags since the last block
        for c in [*node.children, None]:
            if c is None or (isinstance(c, Node) and c.block):
                node.score += c.density if c else 0.0
                if run[0] and not node.in_link:
                    node.score += composite(*run, linked)
                    run = [0, 0, 0, 0]
            elif isinstance(c, str):
                run[0] += len(_SPACE.sub(" ", c).strip())
            else:
                run = [a + b for a, b in zip(run, (c.chars, c.tags + 1, c.link_chars, c.link_tags + c.in_link), strict=True)]
    return nodes


def content(root: Node) -> tuple[list[Node], float]:
    """The subtrees that hold the main text, in page order, and the threshold."""
    nodes = densities(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    if not body.chars:
        return [], 0.0
    # the first node of maximum density sum at or below each block
    best: dict[Node, Node] = {}
    for node in reversed(nodes):
        if node.block:
            below = best.get(node, node)
            best[node] = node if node.score >= below.score else below
            others = best.get(node.parent)
            if others is None or best[node].score >= others.score:
                best[node.parent] = best[node]
    path = [best[body]]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    on_path, found, stack = set(path), [], [body]
    while stack:
        node = stack.pop()
        if node is path[0] or (node not in on_path and node.density >= threshold and node.link_chars * 2 <= node.chars):
            found.append(best[node])
        else:
            stack += [c for c in reversed(node.children) if isinstance(c, Node) and c.block and c.chars]
    out = []
    for node in found:
        out += [*headings_before(node), node]
    return list(dict.fromkeys(out)), threshold


def headings_before(node: Node) -> list[Node]:
    """Headings that stand right before a block, or before a block that it begins."""
    out: list[Node] = []
    while node.parent is not None and node.tag != "body":
        for c in reversed(node.parent.children[: node.parent.children.index(node)]):
            if isinstance(c, str) and not c.strip():
                continue
            if isinstance(c, str) or c.tag not in HEADINGS:
                return out[::-1]
            out.append(c)
        node = node.parent
    return out[::-1]


def is_rail(node: Node, threshold: float) -> bool:
    return node.block and node.link_tags >= RAIL_LINKS and node.link_chars * 2 > node.chars and node.density < threshold


def linked_cards(node: Node) -> set[Node]:
    """Children that are blocks of nothing but links, where at least as many as make a list of links follow each other."""
    found: set[Node] = set()
    run: list[Node] = []
    for c in [*node.children, None]:
        if isinstance(c, str) and not c.strip():
            continue
        if isinstance(c, Node) and c.block and c.chars and c.link_chars == c.chars and c.tag not in HEADINGS:
            run.append(c)
            continue
        if len(run) >= RAIL_LINKS:
            found.update(run)
        run = []
    return found


def blocks(node: Node, out: list[str], threshold: float = 0.0) -> None:
    """Texts of the blocks below a node without lists of links, white space folded."""
    pieces: list[str] = []

    def flush() -> None:
        if text := _SPACE.sub(" ", "".join(pieces)).strip():
            out.append(text)
        pieces.clear()

    stack: list[object] = [node]
    while stack:
        item = stack.pop()
        if item is flush:
            flush()
        elif isinstance(item, str):
            pieces.append(item)
        elif item.tag in ("br", "wbr"):
            pieces.append(" " if item.tag == "br" else "")
        elif item is node or not is_rail(item, threshold):
            if item.block:
                flush()
                stack.append(flush)
            cards = linked_cards(item) if threshold else ()
            stack += [c for c in reversed(item.children) if c not in cards]
    flush()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    out: list[str] = []
    for by_name in (True, False):
        chosen, threshold = content(parse(page, by_name))
        # a page of nothing but lists of links keeps them
        for least in (threshold, 0.0):
            for node in chosen:
                blocks(node, out, least)
            if out:
                return "\n".join(out)
    return ""


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) in place of the html column; a column of those names is replaced."""
    kept = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars")])
    others = [c for c in kept.columns if c != html_column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(p) for p in batch[html_column]]
            yield batch[others].assign(text=text, n_chars=[len(t) for t in text])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != html_column), "text string", "n_chars long"])
    return kept.select(*others, F.col(html_column)).mapInPandas(run, schema)
