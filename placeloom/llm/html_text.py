"""Main text of web pages by composite text density.

Every block element of a page is a node. Its density is its characters per tag,
scaled down the more of its characters are in links, relative to the page (composite
text density). A node's score is the sum of its children's densities, and the node
with the largest score is the root of the article. The least text density (characters
per tag) on the path from the body to it is the threshold for parts beside it; those
that are mostly links stay out. Marked-up text (article, main) bounds the choice; its
innermost article stays whole.

Parts marked as something beside the article (navigation, asides, comments, forms, ...)
are cut off before, but only after they are measured: one that holds an <article> or
<main>, or most of the page's text, is a wrapper and stays, and if cutting would leave no
text at all nothing is cut.

The parser is a tolerant tokenizer with the implied end tags that matter for blocks. It
passes over a page once; what is open is found by its tag, never by walking up.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)            # comment
      | <[!?][^>]*(?:>|\Z)          # declaration
      | <(/?)([a-zA-Z][^\s/>]*)     # tag: end mark, name
        ((?:[^>"']|"[^"]*"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))""",
    re.S | re.X,
)
# Every name is passed over once, whether a value follows or not.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++)))?""")

# Their content is not markup; it ends at their end tag.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
# Elements that start and end a block of text.
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
    "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# Elements without text of the article, and those that mark a part beside it: most
# surely, or so that they may wrap the whole page.
_CUT = {
    "applet", "audio", "button", "canvas", "datalist", "head", "iframe", "input", "label", "legend", "link", "math",
    "meta", "noembed", "noframes", "noscript", "object", "optgroup", "option", "script", "select", "style", "svg",
    "template", "textarea", "title", "video", "xmp",
}
_ASIDE = {"aside", "dialog", "footer", "menu", "nav", "search"}
_WRAPPER = {"form", "header"}
# Words of a class, id or role that mark a part beside the article.
_SIDE = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|complementary|contentinfo|cookies?|consent|"
    r"disclaimer|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|"
    r"pagination|pager|popup|promo|promoted|recommended|related|replies|reply|respond|search|share|sharing|sidebar|side|"
    r"signup|social|sponsor\w*|subscribe|toolbar|topbar|widget)\Z"
)
# Beside such a word these say that a page has or lacks the part, not that this is it.
_SAYS_OF = {
    "by", "disabled", "enabled", "has", "hidden", "hide", "image", "is", "layout", "no", "not", "results", "show",
    "toggle", "with", "without",
}
# Beside such a word these change nothing.
_PLAIN = {
    "area", "article", "block", "body", "bottom", "box", "buttons", "container", "inner", "item", "items", "links", "list",
    "main", "page", "post", "posts", "primary", "secondary", "section", "site", "top", "wrap", "wrapper",
}
_NOT, _MAYBE, _SURELY = 0, 1, 2
# A start tag ends an open element of these, up to the nearest of the bounds.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_P_BOUNDS = {"td", "th", "table", "caption", "button", "object", "html"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# A marked part with a larger share of the page's characters wraps the page; the second
# where the mark is sure and no article is marked within.
_MOST, _ALMOST_ALL = 0.5, 0.9
# A part with a larger share of its characters in links is no article text.
_LINK_SHARE = 0.5


class _Node:
    __slots__ = ("tag", "parent", "children", "chars", "links", "tags", "link_tags", "density", "score", "mark", "articles")

    def __init__(self, tag: str, parent: _Node | None, mark: int = _NOT, article: bool = False):
        self.tag, self.parent, self.children, self.mark = tag, parent, [], mark
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.score = 0.0
        self.articles = int(article)


class _Open:
    """The open elements, with the places of each tag on the stack."""

    def __init__(self, root: _Node):
        # Of each: tag, its node (that of its nearest block), cut off or not, in a link or not.
        self.stack: list[tuple[str, _Node, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.push("html", root, False, False)

    def push(self, tag: str, node: _Node, cut: bool, link: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node, cut, link))

    def nearest(self, tags: set[str]) -> int:
        """The highest place of any of the tags, 0 if none is open."""
        return max([self.places[t][-1] for t in tags if self.places.get(t)], default=0)

    def pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in _BLOCKS:
                self.blocks.pop()


def _parse(page: str) -> tuple[_Node, list[tuple[_Node, str]]]:
    """The tree of block elements and the blocks of text in page order."""
    root = _Node("html", None)
    blocks: list[tuple[_Node, str]] = []
    opened = _Open(root)
    stack = opened.stack
    pending: list[str] = []

    def flush() -> None:
        text = " ".join("".join(pending).split())
        if text:
            blocks.append((stack[-1][1], text))
        pending.clear()

    def pop(index: int) -> None:
        if opened.blocks[-1] >= index:
            flush()
        opened.pop_to(index)

    def close(names: set[str], bounds: set[str]) -> None:
        lowest = opened.nearest(names)
        if not lowest or opened.nearest(bounds) > lowest:
            return
        while lowest > 1 and stack[lowest - 1][0] in names:
            lowest -= 1
        pop(lowest)

    def add(raw: str) -> None:
        _, node, cut, link = stack[-1]
        if cut or not raw:
            return
        text = html.unescape(raw)
        pending.append(text)
        size = len("".join(text.split()))
        node.chars += size
        if link:
            node.links += size

    at = 0
    while at < len(page):
        found = _MARKUP.search(page, at)
        if not found:
            tail = page[at:]
            # A page cut off within a tag ends at it.
            broken = re.search(r"</?[a-zA-Z!?][^<]*\Z|</?\Z", tail)
            add(tail[: broken.start()] if broken else tail)
            break
        add(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            index = opened.nearest({name})
            # An end tag of an inline element does not reach beyond its block.
            if index and (name in _BLOCKS or index > opened.blocks[-1]):
                pop(index)
            continue
        if name in _BLOCKS:
            close({"p"}, _P_BOUNDS)
            flush()
        if name in _CLOSES:
            close(*_CLOSES[name])
        if name in _HEADINGS and stack[-1][0] in _HEADINGS:
            pop(len(stack) - 1)
        _, node, cut, link = stack[-1]
        if name == "html" or (name == "body" and opened.places.get("body")):
            continue
        mark = _NOT
        if not cut:
            cut = name in _CUT
            if not cut and name not in ("body", "article", "main"):
                mark = max(_SURELY if name in _ASIDE else _MAYBE if name in _WRAPPER else _NOT, _beside(found[3]))
                # An inline part is cut at once, if it is marked surely.
                cut = name not in _BLOCKS and mark == _SURELY
        if name in _VOID:
            if name in ("br", "hr", "img"):
                pending.append(" ")
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if not end:
                break
            close_mark = page.find(">", end.start())
            at = len(page) if close_mark < 0 else close_mark + 1
            continue
        if name in _BLOCKS and not cut:
            # The articles of comments and the like are not the page's.
            child = _Node(name, node, mark, name in ("article", "main") and not _beside(found[3]))
            node.children.append(child)
            node = child
        elif not cut and name == "a":
            node.link_tags += 1
        opened.push(name, node, cut, link or name == "a")
    flush()
    return root, blocks


def _beside(attributes: str) -> int:
    """How surely class, id or role say that an element is a part beside the article."""
    best = _NOT
    if "=" not in attributes:
        return best
    for key, one, two, three in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role"):
            for token in (one or two or three).lower().split():
                best = max(best, _side_word(token))
    return best


def _side_word(token: str) -> int:
    """``sidebar`` and ``comment-list`` mark surely, ``header-fixed`` perhaps, ``has-sidebar`` does not."""
    words = set(re.split("[_-]+", token))
    rest = {w for w in words if not _SIDE.match(w)}
    if len(rest) == len(words) or rest & _SAYS_OF or "by" in words:
        return _NOT
    return _SURELY if rest <= _PLAIN else _MAYBE


def _in_order(root: _Node) -> list[_Node]:
    """All nodes, parents before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.children)
    return order


def _wraps(node: _Node, share: float) -> bool:
    """Whether a marked part that has ``share`` of the page's text is a wrapper of it all."""
    return share > (_ALMOST_ALL if node.mark == _SURELY and not node.articles else _MOST)


def _cut_parts(root: _Node, blocks: list[tuple[_Node, str]]) -> list[tuple[_Node, str]]:
    """Take marked parts off the tree, unless they wrap what the page is about; the blocks left."""
    order = _in_order(root)
    whole = {id(node): node.chars for node in order}
    for node in reversed(order):
        if node.parent is not None:
            whole[id(node.parent)] += whole[id(node)]
            node.parent.articles += node.articles
    gone: set[int] = set()
    for node in order:
        if node.parent is not None and id(node.parent) in gone:
            gone.add(id(node))
        elif node.mark and node.articles < root.articles:
            gone.add(id(node))  # what is marked as the article lies elsewhere
        elif node.mark and not _wraps(node, whole[id(node)] / max(whole[id(root)], 1)):
            gone.add(id(node))
    left = [block for block in blocks if id(block[0]) not in gone]
    if not left:
        return blocks
    for node in order:
        if id(node) not in gone:
            node.children = [child for child in node.children if id(child) not in gone]
    return left


def _measure(root: _Node) -> list[_Node]:
    """Subtree sums, densities and scores; nodes with children before parents."""
    order = _in_order(root)[::-1]
    for node in order:
        for child in node.children:
            node.chars += child.chars
            node.links += child.links
            node.link_tags += child.link_tags
            node.tags += child.tags + 1
    share = root.links / max(root.chars, 1)
    for node in order:
        chars, links = node.chars, node.links
        tags, link_tags = max(node.tags, 1), max(node.link_tags, 1)
        if not chars:
            continue
        # The factor is 1 without links and falls as links take more of the characters.
        factor = 1.0
        if links:
            base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
            linked = math.log(max(chars / links * tags / link_tags, 1.0)) / math.log(base)
            factor = min(linked / max(math.log(chars * tags), 1.0), 1.0)
        node.density = chars / tags * factor
    for node in order:
        node.score = sum(child.density for child in node.children)
    return order


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, white space joined, one per line.

    A null, empty or textless page has an empty text. Of equally good subtrees the
    one nearer the body is taken. Nothing is dropped for its length.
    """
    if not page:
        return ""
    root, blocks = _parse(page)
    blocks = _cut_parts(root, blocks)
    if not blocks:
        return ""
    order = _measure(root)
    best = root
    for node in reversed(order):  # parents first
        if node.score > best.score:
            best = node
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    # Marked-up text bounds the choice, and its innermost article is taken whole.
    marked = [node for node in path if node.tag in ("article", "main")]
    whole, first = best, None
    if marked:
        whole = next((node for node in marked if node.tag == "article"), marked[0])
        inside, article = _below(order, {id(marked[-1])}), _below(order, {id(whole)})
        blocks = [block for block in blocks if id(block[0]) in inside]
        first = next((k for k, (node, _) in enumerate(blocks) if id(node) in article), 0)
    # Links count by their share alone: as a factor they would press the threshold below any text.
    top = marked[-1] if marked else path[-1]
    threshold = min(_thickness(node) for node in path[: path.index(top) + 1])
    above = {id(node) for node in path[path.index(whole) + 1 :]}
    chosen = {
        id(node)
        for node in order
        if node is whole
        or (id(node) not in above and node.links <= _LINK_SHARE * node.chars and _thickness(node) >= threshold)
    }
    # Loose text between the parts on the path is held against the same threshold.
    loose = {id(node) for node in path if id(node) in above and _own_links(node) <= _LINK_SHARE}
    under = _below(order, chosen)
    kept = [id(node) in under or (id(node) in loose and len(text) >= threshold) for node, text in blocks]
    # Titles above the article are its own.
    for k in range(first or 0):
        kept[k] = kept[k] or blocks[k][0].tag in _HEADINGS
    # A heading belongs to the text that follows it.
    for k in range(len(blocks) - 2, -1, -1):
        if not kept[k] and blocks[k][0].tag in _HEADINGS and kept[k + 1]:
            kept[k] = True
    return "\n".join(text for (_, text), keep in zip(blocks, kept) if keep)


def _thickness(node: _Node) -> float:
    return node.chars / max(node.tags, 1)


def _own_links(node: _Node) -> float:
    chars = node.chars - sum(child.chars for child in node.children)
    return (node.links - sum(child.links for child in node.children)) / max(chars, 1)


def _below(order: list[_Node], tops: set[int]) -> set[int]:
    """The given nodes and all below them; ``order`` has children before parents."""
    found: set[int] = set()
    for node in reversed(order):
        if id(node) in tops or (node.parent is not None and id(node.parent) in found):
            found.add(id(node))
    return found


@F.pandas_udf(StringType())
def _extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text)


def extract(page: Column) -> Column:
    """The main text of a page as a column; empty for null pages."""
    return _extract(page.cast("string"))


def extract_text(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the markup, with the main text in ``out``.

    One row per row of ``pages``; repeated rows give equal texts, an empty table an
    empty one. A column that bears the name of ``out`` is replaced.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (page, out)]
    return pages.select(*kept, extract(F.col(f"`{page}`")).alias(out))
