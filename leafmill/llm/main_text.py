"""Main text of web pages by tree scoring (operator 4).

Every paragraph earns points for its length and its commas, less the share of
it that is link text.  The points go to its ancestors, the further up the fewer.
The container with most points, discounted by its own link density, holds the
article; siblings that score nearly as well, and headings and sentences beside
it, are kept too.  Menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are left out by their element, or by the words of their class,
id and role; a name leaves nothing out that holds nearly all of the page's
points, and a name that only might say so nothing that reads like an article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import map_batches, strings, table

#: A quote that is never closed ends with its tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+[^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg object canvas audio video select datalist".split())
LEFT_OUT = frozenset("nav footer aside form menu dialog fieldset head".split())
#: Text of these counts as link text; a block of nothing else is no part of the article.
CONTROLS = frozenset("button label option".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote li td th dd dt figcaption h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What only the article has.
TITLES = frozenset("h1 article main".split())
#: What an opening element ends, and what keeps it from looking further up.
ENDS = {
    **dict.fromkeys("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), ({"p"}, {"table", "td", "th", "button", "article", "section", "div", "li", "blockquote", "body"})),
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, set()),
}
#: Words of a class, id or role that mark what isn't the article.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist contentinfo cookie cookies consent copyright "
    "disclaimer discussion disqus feedback footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification paywall pager pagination popup privacy "
    "promo promotion recommended related replies reply respond rss search share sharing shoutbox sidebar sidebars signup skip skyscraper social sponsor sponsored subscribe subscription "
    "tags teaser toc toolbar tooltip topbar widget widgets outbrain taboola complementary alert alertdialog dialog".split()
)
LIKELY = frozenset("article body content entry main post story text".split())
#: A name that begins so tells how the page is laid out around an element, not what the element is.
LAYOUT = frozenset("has no with without is layout hide show js page single".split())
#: Words that add nothing to the others of a name.
NEUTRAL = LIKELY | frozenset("site top bottom left right box area wrapper wrap container section list block inner outer item row col column bar header footer inline page group panel primary secondary user global".split())
#: A doubtful element with less link text and longer blocks than that is kept; sure ones go together unless they hold more than such a share of all points.
DENSITY, LENGTH, ALL = 0.25, 40, 0.9
#: What an ancestor gets of the points of the one below.
FADE = 0.5


class Node:
    """An element. out: left out for sure; doubt: 2 named so that it is left out, 1 perhaps; block: the nearest block element."""

    __slots__ = ("tag", "parent", "out", "doubt", "link", "control", "likely", "inside", "block", "points", "score", "size", "linked", "blocks", "held", "count", "titled", "order")

    def __init__(self, tag: str, parent: Node | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.out = parent is not None and parent.out
        self.doubt, self.likely = 0, False
        self.control = tag in CONTROLS or (parent is not None and parent.control)
        self.link = tag == "a" or self.control or (parent is not None and parent.link)
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.points, self.score, self.size, self.linked, self.blocks, self.held = 0.0, 0.0, 0, 0, 0, 0.0


def doubt(names: str) -> tuple[int, bool]:
    """(2, 1 or 0: surely, perhaps or not a menu, notice, advert and the like; likely the article) by class, id and role."""
    found, likely = 0, False
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or (len(words) > 1 and words[0] in LAYOUT):
            continue
        likely = likely or not LIKELY.isdisjoint(words)
        if not UNLIKELY.isdisjoint(words):
            found = max(found, 2 if all(w in UNLIKELY or w in NEUTRAL for w in words) else 1)
    return found, likely


def _tree(page: str) -> tuple[list[Node], list[tuple[Node, str] | None]]:
    """All elements, and the page's texts in order; None stands where a block begins or ends."""
    at = Node("", None, 0)
    nodes, texts, open_ = [at], [], Counter()
    place, n = 0, len(page)

    def close(to: Node) -> Node:
        """Close up to and with ``to``."""
        up = at
        while up is not to:
            open_[up.tag] -= 1
            up = up.parent
        open_[to.tag] -= 1
        return to.parent

    while place < n:
        m = _TOKEN.search(page, place)
        if m is None:
            texts.append((at, page[place:]))
            break
        if m.start() > place:
            texts.append((at, page[place : m.start()]))
        place = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag] > 0:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = close(up)
            if tag in BLOCKS:
                texts.append(None)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, place)
                place = end.end() if end else n
            texts.append((at, " "))
            continue
        if tag in ENDS:
            ended, stop = ENDS[tag]
            if any(open_[x] > 0 for x in ended):
                up = at if tag in ("option", "body") else at.block
                while up.parent is not None and up.tag not in stop:
                    if up.tag in ended:
                        at = close(up)
                        break
                    up = up.parent.block
        if tag in BLOCKS:
            texts.append(None)
        elif tag in ("br", "wbr", "img"):
            if tag == "br":
                texts.append((at, " "))
            continue
        if tag in VOID or (m[3].endswith("/") and tag not in BLOCKS):
            continue
        at = Node(tag, at, len(nodes))
        nodes.append(at)
        open_[tag] += 1
        if not at.out:
            at.out = tag in LEFT_OUT or (tag == "header" and not at.parent.inside) or bool(m[3] and _HIDDEN.search(m[3]))
            if m[3] and tag not in ("html", "body"):
                at.doubt, at.likely = doubt(" ".join("".join(x) for x in _NAMES.findall(m[3])))
                if tag in ("article", "main"):
                    at.doubt = 0
    return nodes, texts


def _blocks(texts: list) -> Iterator[list[tuple[Node, str]]]:
    block = []
    for x in texts:
        if x is not None:
            block.append(x)
        elif block:
            yield block
            block = []
    if block:
        yield block


def _read(texts: list) -> Iterator[tuple[Node, str, float]]:
    """(block element, text, share of link text) of the blocks that aren't left out."""
    for block in _blocks(texts):
        block = [x for x in block if not x[0].out]
        text = "".join(t for _, t in block)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if not text or all(n.control for n, t in block if t.strip()):
            continue
        linked = sum(len(t.strip()) for n, t in block if n.link)
        yield next(n for n, t in block if t.strip()).block, text, linked / max(len(text), linked)


def points(text: str, density: float) -> float:
    """What a paragraph earns: for being there, for commas, and for its length, less its share of link text."""
    return (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - density)


def gather(nodes: list[Node], found: list[tuple[Node, str, float]]) -> None:
    """Points of blocks go to their containers and on to all ancestors, the further up the fewer; one pass, from the last element to the first.

    size, linked and blocks are sums over all that an element holds; held are
    all points below it, undiminished; count is its number of elements; titled, whether a title is among them.
    """
    for x in nodes:
        x.points = x.score = x.held = 0.0
        x.size = x.linked = x.blocks = 0
        x.count, x.titled = 1, x.tag in TITLES
    for owner, text, density in found:
        owner.size += len(text)
        owner.linked += len(text) * density
        owner.blocks += 1
        if owner.tag not in HEADINGS:
            earned = points(text, density)
            owner.held += earned
            (owner.parent if owner.tag in PARAGRAPHS and owner.parent is not None else owner).points += earned
    for x in reversed(nodes):
        x.score += x.points
        if (up := x.parent) is not None:
            up.score += FADE * x.score
            up.size += x.size
            up.linked += x.linked
            up.blocks += x.blocks
            up.held += x.held
            up.count += x.count
            up.titled = up.titled or x.titled


def _topmost(nodes: list[Node], root: Node, sure: int) -> list[Node]:
    """The elements below root that are named so, without those below one of them."""
    out, i = [], root.order + 1
    while i < root.order + root.count:
        x = nodes[i]
        if x.out or x.doubt == sure:
            if not x.out:
                out.append(x)
            i += x.count
        else:
            i += 1
    return out


def _discard(nodes: list[Node]) -> bool:
    """Leave out what is named as no article; whether there was any.

    If hardly any of the page's points are left without what is surely none, the
    heaviest of these with a title in it stays, and what lies below it is looked
    at in the same way.  What is perhaps none goes if it neither reads like an article nor
    holds most of the points that are left.
    """
    any_out, root = False, nodes[0]
    left = root.held
    while root is not None and (found := _topmost(nodes, root, 2)):
        gone = sum(x.held for x in found)
        root = max((x for x in found if x.titled), key=lambda x: x.held, default=None) if gone > ALL * left else None
        for x in found:
            if x is not root:
                x.out = any_out = True
        left = left - gone if root is None else root.held
    for x in nodes[1:]:
        if x.parent.out:
            x.out = True
        elif x.doubt == 1 and not x.out and x.held <= left / 2 and not (x.blocks and x.linked < DENSITY * x.size and x.size >= LENGTH * x.blocks):
            x.out = any_out = True
    return any_out


def main_text(page: str) -> str:
    """The article of an HTML page, one line for each block; empty if there is none."""
    nodes, texts = _tree(page)
    found = list(_read(texts))
    gather(nodes, found)
    if _discard(nodes):
        found = list(_read(texts))
        gather(nodes, found)
    if not found:
        return ""

    def worth(x: Node) -> float:
        if not x.size or x.out:
            return -1.0
        return x.score * (1.25 if x.likely or x.tag in ("article", "main") else 1.0) * (1 - x.linked / x.size)

    best = max(nodes, key=lambda x: (worth(x), -x.order))
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    if best.parent is None:
        return "\n".join(t for _, t, _ in found)
    # The element beside the best one (or the best itself) under which each element stands.
    branch: list[Node | None] = [None] * len(nodes)
    for x in nodes[1:]:
        branch[x.order] = x if x.parent is best.parent else branch[x.parent.order]
    beside: dict[Node, list[tuple[str, float]]] = {}
    for owner, text, density in found:
        if (x := branch[owner.order]) is not None and x is not best:
            beside.setdefault(x, []).append((text, density))
    kept, enough = {best}, max(1.5, 0.2 * worth(best))
    for x, blocks in beside.items():
        if best.tag in ("article", "main"):
            keep = x.tag == best.tag
        elif x.tag in HEADINGS:
            keep = True
        elif x.tag in ("p", "pre", "blockquote"):
            keep = all(d < 0.25 and (len(t) > 80 or re.search(r"[.!?。！？…\"”’)]\s*$", t)) for t, d in blocks)
        else:
            keep = worth(x) >= enough
        if keep:
            kept.add(x)
    return "\n".join(t for o, t, _ in found if branch[o.order] in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """Operator 4's contract: page_id, url, text, n_chars.

    A null html is an empty page with an empty text; bytes that are not valid
    UTF-8 read as U+FFFD; page_id and url may be null or repeat; an empty table
    has no rows.
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [main_text(x) for x in strings(batch.column("html"))]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(read, "page_id long,url string,text string,n_chars long", make)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
