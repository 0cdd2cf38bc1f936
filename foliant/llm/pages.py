"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, fewer the farther away; a
container's points are discounted by the share of its text that stands in links. The best container is
kept, as an article around it, or else with all that stands beside it, up to the ancestor of nearly all the
text, but for furniture and blocks of links.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPH = frozenset("p pre blockquote td dd li h2 h3 h4 figcaption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("script style template nav footer aside button select textarea input iframe object embed svg canvas head dialog menu audio video map".split())
SPARE = frozenset("noscript header".split())  # they hold an article only if nothing else does
HELD = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Names of furniture: the last word of a name tells what it is (post-comments), but for words of size and place.
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb "
    "breadcrumbs footer header masthead comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations widget toolbar pagination pager "
    "login signin signup register hidden skip tags".split()
)
PLACES = frozenset("left right top bottom inner outer box wrapper wrap container block section area region panel list item items bar row column col group slot unit main wide small large form link links button buttons".split())
LEADING = frozenset("ad ads advert advertisement sponsored promo sidebar comment comments cookie cookies gdpr newsletter share sharing related recommended breadcrumb".split())
ARTICLE = frozenset("article content body text story post page entry main".split())
NOT = frozenset("has no not with without js".split())
NOTICES = frozenset("cookie cookies consent gdpr notice notices alert popup".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: An open tag ends these when it begins: (new tags) -> what they end, up to the given borders.
ENDS = [
    (frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), frozenset(["p"]), frozenset("button td th li dd dt div section article body".split())),
    (frozenset(["li"]), frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    (frozenset(["dd", "dt"]), frozenset(["dd", "dt"]), frozenset(["dl"])),
    (frozenset(["td", "th"]), frozenset(["td", "th"]), frozenset(["tr", "table"])),
    (frozenset(["tr"]), frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    (frozenset(["option"]), frozenset(["option"]), frozenset(["select"])),
]
LEVELS = 5
LOOSE = frozenset("html body main article section div form td".split())  # containers whose own text is a paragraph


#: Marks of subtrees: furniture by its name or role only, which may be wrong; furniture unless the page has nothing else; furniture.
TOLD, LAST, SURE = 1, 2, 3
SAYS = re.compile(r"[^\W\d_]{4}")  # outside links, a word that makes a paragraph more than a list of them


class Node:
    __slots__ = ("children", "commas", "flow", "in_article", "links", "mark", "parent", "plain", "points", "says", "size", "tag", "unwanted")

    def __init__(self, tag: str, parent: Node | None, mark: int):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.children: list[Node | str] = []
        self.unwanted, self.points, self.size, self.links = mark > 0, 0.0, 0, 0
        #: of the text up to the next blocks below: its characters, commas and pieces outside links that say something; says: a paragraph below has such pieces
        self.flow = self.commas = self.plain = 0
        self.says = False
        self.in_article = tag == "article" or (parent is not None and parent.in_article)


def _mark(tag: str, attrs: dict[str, str | None]) -> int:
    if tag in DROPPED:
        return SURE
    names = [re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", x).lower()) for x in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()]
    if tag in HELD:
        return LAST if tag == "article" and any({"comment", "reply"} & set(n) for n in names) else 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or ""):
        return SURE
    if tag in SPARE or re.search(r"visibility\s*:\s*hidden", attrs.get("style") or ""):
        return LAST
    told = TOLD if tag == "form" or (attrs.get("role") or "").lower() in ROLES else 0
    for name in names:
        if not name or name[0] in NOT:
            continue
        end = len(name)
        while end > 1 and name[end - 1] in PLACES:
            end -= 1
        head = name[end - 1]
        if head in FURNITURE or (name[0] in LEADING and head not in ARTICLE):
            told = max(told, SURE if NOTICES & {head, name[0]} else LAST if COMMENTS & {head, name[0]} else TOLD)
    return told


class Tree(HTMLParser):
    """A forgiving tree of a page; unwanted subtrees are marked as they open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, 0)
        self.nodes: list[Node] = []
        self.open: Counter[str] = Counter()  # tags from the root to here

    def _up_to(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        for begins, ended, borders in ENDS:
            if tag in begins and any(self.open[t] for t in ended):
                up = self.at
                while up.parent is not None and up.tag not in ended and up.tag not in borders:
                    up = up.parent
                if up.tag in ended and up.parent is not None:
                    self._up_to(up.parent)
        if tag == "html":
            return
        node = Node(tag, self.at, _mark(tag, dict(attrs)))
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.parent is not None and tag in ("svg", "iframe"):
            self._up_to(self.at.parent)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        up = self.at
        while up.tag != tag:
            up = up.parent
        self._up_to(up.parent)

    def handle_data(self, data):
        self.at.children.append(data)

    def unknown_decl(self, data):
        pass


def _parsed(html: str) -> Tree:
    tree = Tree()
    try:
        tree.feed(html)
        tree.close()
    except AssertionError:  # a malformed marked section
        tree = Tree()
        tree.feed(re.sub(r"<!\[[^>]*>?", "", html))  # to browsers a comment
        tree.close()
    return tree


def _text(nodes: list[Node | str]) -> str:
    """The wanted text below the nodes, in page order; block borders part words, inline tags don't."""
    out: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.unwanted:
            if x.tag == "header" and x.in_article:  # its headings and paragraphs are the article's own
                todo.extend(reversed(_headed(x)))
            out.append(" ")
        elif x.tag in INLINE:
            todo.extend(reversed(x.children))
        else:
            todo.append(" ")
            todo.extend(reversed(x.children))
            out.append(" ")
    return " ".join("".join(out).split())


def _headed(header: Node) -> list[Node]:
    """Headings and paragraphs of a header, in page order."""
    out, todo = [], [c for c in reversed(header.children)]
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.unwanted:
            if x.tag in HEADING or x.tag == "p":
                out.append(x)
            elif x.tag not in INLINE:
                todo.extend(reversed(x.children))
    return out


def _measure(tree: Tree) -> None:
    """Sizes of text, of link text and of the text up to the next blocks, of every wanted node; children before parents."""
    for node in [tree.root, *tree.nodes]:
        node.size = node.links = node.flow = node.commas = node.plain = 0
        node.says = False
    for node in [*reversed(tree.nodes), tree.root]:
        if node.unwanted:
            node.size = node.links = node.flow = node.commas = node.plain = 0
            node.says = False
            continue
        for c in node.children:
            if isinstance(c, str) and (words := c.split()):
                node.size += len(c.strip())
                node.flow += sum(map(len, words)) + len(words)
                node.commas += c.count(",")
                node.plain += SAYS.search(c) is not None
        if node.tag == "a":
            node.links, node.plain = node.size, 0
        node.says = node.says or (node.tag == "p" and node.plain > 0)
        up = node.parent
        if up is not None:
            up.size += node.size
            up.links += node.links
            up.says = up.says or node.says
            if node.tag in INLINE:
                up.flow, up.commas, up.plain = up.flow + node.flow, up.commas + node.commas, up.plain + node.plain


def _score(tree: Tree) -> Node | None:
    """The container of most points."""
    dropped: set[int] = set()
    scored: dict[int, Node] = {}
    for node in [tree.root, *tree.nodes]:
        node.points = 0.0
    for node in [tree.root, *tree.nodes]:
        if node.unwanted or (node.parent is not None and id(node.parent) in dropped):
            dropped.add(id(node))
            continue
        loose = node.tag in LOOSE and any(c.strip() if isinstance(c, str) else c.tag in INLINE and c.size for c in node.children)
        if not (node.tag in PARAGRAPH or loose) or not node.size or not node.flow:
            continue
        points = (1 + node.commas + min((node.flow - 1) / 100, 3)) * (1 - min(1.0, node.links / node.size))
        up = node if loose else node.parent
        for level in range(LEVELS):
            if up is None:
                break
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[id(up)] = up
            up = up.parent
    for node in scored.values():
        node.points *= 1 - min(1.0, node.links / max(1, node.size))
    return max(scored.values(), key=lambda n: n.points, default=None)


def _best(tree: Tree) -> Node | None:
    """The best container; of what is furniture in doubt if nothing else scores."""
    best = _likely(tree)
    if best is not None and best.points > 0:
        return best
    for node in tree.nodes:
        if node.mark in (TOLD, LAST):
            node.unwanted = False
    _measure(tree)
    return _score(tree)


def _likely(tree: Tree) -> Node | None:
    """The best container without furniture. Marks by name alone that cost most of the page's text are lifted if what is left scores little."""
    _measure(tree)
    best, size = _score(tree), tree.root.size
    told = [n for n in tree.nodes if n.mark == TOLD]
    if not told:
        return best
    for node in told:
        node.unwanted = False
    _measure(tree)
    half = 0.5 * (tree.root.size - tree.root.links)
    large = [n for n in told if n.size - n.links >= half] if tree.root.size > 2 * size else []
    for node in told:
        node.unwanted = node not in large
    points = best.points if best else 0.0
    _measure(tree)
    if large:
        lifted = _score(tree)
        if lifted is not None and points < 0.2 * lifted.points:
            return lifted
        for node in large:
            node.unwanted = True
        _measure(tree)
        best = _score(tree)
    return best


def main_text(html: str) -> str:
    """The article of one page; empty if it has none."""
    tree = _parsed(html)
    best = _best(tree)
    if best is None or best.points <= 0:  # nothing scores: an article all the same, or what text there is, unless it is links
        articles = [n for n in tree.nodes if n.tag in ("article", "main") and n.size and not n.unwanted]
        if articles:
            return _text([max(articles, key=lambda n: n.size)])
        return _text([tree.root]) if 2 * tree.root.links < tree.root.size else ""
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best = up
    if best.parent is None or best.tag in ("body", "article", "main"):
        return _text([best])
    # up to the ancestor that holds nearly all text that is not links; what stands beside the path stays but for links
    before: list[list[Node | str]] = []
    after: list[Node | str] = []
    at, enough = best, 0.9 * (tree.root.size - tree.root.links)
    while at.parent is not None and at.tag not in HELD:
        if at is not best and at.size - at.links >= enough:
            break
        beside = at.parent.children
        place = next(i for i, x in enumerate(beside) if x is at)
        before.append([x for x in beside[:place] if _beside(x)])
        after += [x for x in beside[place + 1 :] if _beside(x)]
        at = at.parent
    return _text([*(x for part in reversed(before) for x in part), best, *after])


def _beside(x: Node | str) -> bool:
    """Whether a block beside the best one belongs to it: few links, or a paragraph that says something besides them."""
    if isinstance(x, str) or x.tag == "h1":
        return True
    share = x.links / x.size if x.size and not x.unwanted else 1.0
    return share < 0.25 or (share < 0.75 and x.says)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py() or "") for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row: the article's blocks in page order, white space as single spaces.

    Null, empty or text-free html: an empty text. Rows stand alone, so repeats are kept as they are; of
    containers with equal points the first counts; very long and deep pages, with any number of unclosed or
    unmatched tags, are walked without recursion in time linear in their tags;
    other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")
