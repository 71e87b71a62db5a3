"""Main-text extraction from web pages by tree scoring.

The page is parsed leniently into a tree (unclosed and stray tags are legal) in
one pass: a tag is read by a scanner that gives up at the next ``<`` outside a
quoted value, and what it gives up is text. Every paragraph passes points to its
ancestors: one, one more per comma, one more per 100 characters up to three; the
parent gets them whole, the grandparent half, the ``LEVELS`` nearest ancestors
above a third and less by depth. A container's points are discounted by its link
density. The best container is kept, with those siblings that score at least a
fifth of it or are long paragraphs with few links, and with the text that stands
directly beside it. An article element (or else main) that scores a quarter of
the best container or more is preferred to it, whatever stands beside it, and of
several the best one and its sibling articles are kept. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are cut
out by tag, role, class and id before scoring.

A class or id alone is weak evidence ("discussion" names a chapter as well as a
forum). It never cuts a heading, and never what holds the page's text: where
less than a fifth of the paragraph text is left beside an element that its name
(or a form around the page) cut, that element is put back. Inside an article or
main element a name cuts nothing of running text, tables' cells or paragraphs; a
section or list item only if most of its text is linked, and any other element
if that is so or its text is short; reader comments are cut by name alone. An
article's own header keeps its headings and paragraphs; labels and buttons in
running text are words of it. Lists of links stay inside the chosen container,
unless that is the whole page.

Defined results: null html counts as empty and gives an empty text; a page
without any paragraph-like block gives the text of its largest remaining
container; character references are decoded once; white space inside a block
becomes one space; blocks are joined by one newline; nothing is shortened.
Rows may repeat, null ids and urls stay null, other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot
th thead tr ul""".split())
DROPPED = frozenset("""script style noscript template iframe nav header footer aside form button select textarea input svg canvas
object embed audio video menu dialog head title noframes fieldset label""".split())
KEEPERS = frozenset("html body article main".split())
ENDS_P = BLOCK - {"html", "body", "head", "option"}
UNWANTED = re.compile(r"""(?ix)(?:^|[\s_-])(?:ad|ads|advert\w*|adv|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|
newsletter|subscribe|subscription|signup|login|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|side-?bar|aside|widget\w*|related|recommend\w*|
footer\w*|header\w*|masthead|share|sharing|social\w*|comment\w*|disqus|respon[ds]e?s?|reply|replies|discussion|remark\w*|feedback|toolbar|
pagination|pager|copyright|legal|disclaimer|form|search\w*|hidden|skip\w*)(?:$|[\s_-])""")
# "has-sidebar" says something of the page, not that the element is a sidebar
MODIFIER = re.compile(r"(?i)(?:has|with|without|no|is|js|layout)[-_]")
COMMENTS = re.compile(r"(?i)(?:^|[\s_-])(?:comment\w*|disqus|respond|reply|replies)(?:$|[\s_-])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = frozenset("p pre blockquote figcaption caption table thead tbody tfoot tr td th dt dd".split()) | HEADINGS
SHORT, LINKED = 80, 0.5  # characters, and share of them in links, of an element that its name calls unwanted
WANTED = re.compile(r"(?i)(?:article|post|entry|story|main|content|page|text|body)(?:[-_]|$)")
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?>[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
INLINE = frozenset("label button".split())  # words of the text where they stand in running text
LEVELS = 32  # ancestors that a paragraph passes points to
LEFT = 0.2  # share of the paragraph text that must be left beside an element for its name to cut it
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table select".split())


NO, BY_NAME, COMMENT, YES = range(4)


class Node:
    __slots__ = ("tag", "parent", "kids", "bad", "doubted", "inside", "depth", "named", "chars", "linked", "mark")

    def __init__(self, tag: str, parent: "Node | None", bad: bool) -> None:
        self.tag, self.parent, self.bad, self.doubted = tag, parent, bad, False
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.kids: list = []  # nodes and strings in page order
        self.depth = parent.depth + 1 if parent else 0
        self.named = NO  # why it may be put back
        self.chars = self.linked = 0
        self.mark = False


def running(at: Node) -> bool:
    """Whether text here is part of a paragraph, item or cell."""
    while at.tag not in BLOCK:
        at = at.parent
    return at.tag in RUNNING or at.tag == "li"


def unwanted(tag: str, attrs: str) -> int:
    """Whether an element is cut: not, by its class or id, as reader comments,
    or by its tag, role or style."""
    if tag in DROPPED:
        return YES
    if not attrs or tag in KEEPERS:
        return NO
    found = NO
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names = [v for v in value.split() if not MODIFIER.match(v)]
            bad = [v for v in names if UNWANTED.search(v)]
            if bad and not any(WANTED.match(v) for v in names if v not in bad):
                found = max(found, COMMENT if any(COMMENTS.search(v) for v in bad) else BY_NAME)
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return YES
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return YES
    return found


def opened(tag: str, attrs: str, at: Node) -> Node:
    """The element's node, cut where its name is enough, doubted where its
    contents decide (see :func:`settle`)."""
    node, why = Node(tag, at, False), unwanted(tag, attrs)
    if why == YES:
        node.bad = not (tag in INLINE and running(at)) and not (tag == "header" and node.inside)
        node.named = BY_NAME if tag == "form" else NO
    elif why and tag not in HEADINGS:
        if not node.inside:
            node.bad, node.named = True, why
        elif tag not in RUNNING and (tag in BLOCK or not running(at)):
            node.bad, node.doubted = why == COMMENT, why == BY_NAME
    return node


def put_back(root: Node) -> None:
    """Undo cuts by name until enough of the page's paragraph text is left: the
    cut element with the most of it (reader comments last), outermost first; a
    deep nest of cut elements is put back as one."""
    for turn in count(1):
        left, cut = 0, []
        stack: list = [(root, None)]
        while stack:
            at, under = stack.pop()
            for kid in at.kids:
                if isinstance(kid, str):
                    n = len(kid) - kid.count(" ") if kid and not kid.isspace() and not in_link(at) else 0
                    if under is None:
                        left += n
                    else:
                        cut[under][0] += n
                elif not kid.bad:
                    stack.append((kid, under))
                elif kid.named and under is None:
                    cut.append([0, kid.named != COMMENT, kid])
                    stack.append((kid, len(cut) - 1))
                elif kid.named:
                    stack.append((kid, under))
        most = max(cut, key=lambda c: (c[1] and left < LEFT * c[0], c[0]), default=None)
        if most is None or not most[0] or left >= LEFT * most[0] or not most[1] and left:
            return
        most[2].bad = False
        if turn % 16 == 0:
            stack = [most[2]]
            while stack:
                at = stack.pop()
                nodes = [k for k in at.kids if not isinstance(k, str)]
                for k in nodes:
                    k.bad = k.bad and k.named != BY_NAME
                stack += [k for k in nodes if not k.bad]


def in_link(at: Node) -> bool:
    while at is not None and at.tag not in BLOCK:
        if at.tag == "a":
            return True
        at = at.parent
    return False


def settle(root: Node) -> None:
    """Cut the doubted elements that look like boilerplate, inner ones first."""
    stack: list = [(root, iter(root.kids), False, [0, 0])]
    while stack:
        at, kids, link, total = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                n = len(SPACE.sub(" ", unescape(kid)).strip())
                total[0] += n
                total[1] += n if link else 0
            elif not kid.bad:
                stack.append((kid, iter(kid.kids), link or kid.tag == "a", [0, 0]))
                break
        else:
            stack.pop()
            n, linked = total
            if at.doubted:
                at.bad = linked > LINKED * n or n < SHORT and at.tag not in ("section", "li")
            if stack and not at.bad:
                stack[-1][3][0] += n
                stack[-1][3][1] += linked


def parse(html: str) -> Node:
    """Lenient tree: a block start closes an open paragraph, an end tag closes
    back to its nearest opener within the same block, stray ends are ignored."""
    root = Node("html", None, False)
    at, pos, n, doubts, named, declared = root, 0, len(html), False, False, True
    open_: Counter = Counter(["html"])

    def close(up: Node) -> Node:
        """Leave ``up``, counting what is left open no more."""
        node = at
        while node is not up.parent:
            open_[node.tag] -= 1
            node = node.parent
        return node

    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            at.kids.append(html[pos:])
            break
        m = TAG.match(html, lt)
        if m is None:
            end = -1
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                end = n if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), lt) and declared:
                end = html.find("]]>", lt) + 3 if html.startswith("<![CDATA[", lt) else 0
                end = end if end > 2 else html.find(">", lt) + 1
                declared = end > 0  # no ">" follows any more: the rest has no declaration
                end = end or -1
            if end < 0:  # a stray "<" is text
                at.kids.append(html[pos:lt + 1])
                pos = lt + 1
                continue
            if lt > pos:
                at.kids.append(html[pos:lt])
            pos = end
            continue
        if lt > pos:
            at.kids.append(html[pos:lt])
        pos = m.end()
        tag = m[2].lower()
        if m[1]:
            up = at if open_[tag] > 0 else None
            while up is not None and up.tag != tag:
                if tag not in BLOCK and up.tag in BLOCK and up.tag != "p":
                    up = None  # an inline end does not reach out of its block
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                at = close(up)
            continue
        if tag == "html" or tag == "body" and at.tag == "body":
            continue
        if tag in ENDS_P and open_["p"] > 0:
            up = at  # a block ends the open paragraph, and inline tags left open in it
            while up is not None and (up.tag not in BLOCK):
                up = up.parent
            if up is not None and up.tag == "p" and up.parent is not None:
                at = close(up)
        if same := SAME.get(tag):
            up = at if any(open_[t] > 0 for t in same) else None
            while up is not None and up.tag not in same and up.tag not in LISTS:
                up = up.parent
            if up is not None and up.tag in same and up.parent is not None:
                at = close(up)
        if tag in VOID:
            at.kids.append(Node(tag, at, False))
            continue
        node = opened(tag, m[3], at)
        doubts |= node.doubted
        named |= bool(node.named)
        at.kids.append(node)
        if m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
            if not node.bad:
                node.kids.append(html[pos:end.start() if end else n])
            pos = end.end() if end else n
            continue
        at = node
        open_[tag] += 1
    if named:
        put_back(root)
    if doubts:
        settle(root)
    return root


def blocks_of(node: Node) -> list[tuple[str, Node, int]]:
    """(text, block, linked characters) of the wanted blocks in page order."""
    out: list[tuple[str, Node, int]] = []
    run: list[tuple[str, bool]] = []

    def flush(owner: Node) -> None:
        text = SPACE.sub(" ", unescape("".join(t for t, _ in run))).strip()
        if text and (owner.tag in HEADINGS or owner.tag == "p" or not in_header(owner)):
            linked = len(SPACE.sub(" ", "".join(t for t, a in run if a)).strip())
            out.append((text, owner, min(linked, len(text))))
        run.clear()

    stack: list = [(node, iter(node.kids), False, node)]
    while stack:
        at, kids, link, owner = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                run.append((kid, link))
            elif kid.bad:
                if kid.tag in BLOCK:
                    flush(owner)
            elif kid.tag == "br":
                run.append((" ", link))
            elif kid.tag in BLOCK:
                flush(owner)
                stack.append((kid, iter(kid.kids), link, kid))
                break
            else:
                stack.append((kid, iter(kid.kids), link or kid.tag == "a", owner))
                break
        else:
            stack.pop()
            if at.tag in BLOCK:
                flush(owner)
    flush(node)
    return out


def in_header(at: Node) -> bool:
    """Within an article's own header."""
    while at is not None and at.inside:
        if at.tag == "header":
            return True
        at = at.parent
    return False


PARAGRAPHS = frozenset("p pre blockquote td li dd div article section main".split())


def weight(level: int) -> float:
    return 1 if level == 0 else 1 / 2 if level == 1 else 1 / (3 * level)


def main_text(html: str | None) -> str:
    """The article's blocks joined by newlines."""
    root = parse(html or "")
    blocks = blocks_of(root)
    if not blocks:
        return ""
    order, stack = [], [root]  # parents before their children
    while stack:
        at = stack.pop()
        order.append(at)
        stack += [k for k in at.kids if not isinstance(k, str) and not k.bad]
    scored: dict[Node, float] = {}

    def pass_points(up: Node | None, points: float) -> None:
        for level in range(LEVELS):
            if up is None:
                break
            scored[up] = scored.get(up, 0.0) + points * weight(level)
            up = up.parent

    for text, owner, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
        if owner.tag in PARAGRAPHS and len(text) >= 25 and linked <= len(text) // 2:
            points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) // 100, 3)
            pass_points(owner.parent if owner.tag in ("p", "pre", "td", "li", "dd") and owner.parent else owner, points)
    if not scored:
        for text, owner, linked in blocks:  # short pages: points by characters alone
            pass_points(owner.parent or owner, (len(text) - linked) / 100)
    for at in reversed(order):
        if at.parent is not None:
            at.parent.chars += at.chars
            at.parent.linked += at.linked
    final = {n: s * (1 - n.linked / max(1, n.chars)) for n, s in scored.items()}
    best = max(final, key=lambda n: (final[n], -n.depth))
    for tag in ("article", "main"):  # an element that says it is the article is, unless next to nothing is in it
        own = [n for n in final if n.tag == tag and final[n] >= 0.25 * final[best]]
        if own:
            best = max(own, key=lambda n: (final[n], n.depth))
            break
        up = best
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None:
            best = up
            break
    keep, beside = {best}, None
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        beside = best.parent if best.parent.tag not in ("html", "body") else None
        for kid in best.parent.kids:
            if isinstance(kid, Node) and not kid.bad and kid.chars:
                n = kid.chars
                density = kid.linked / n
                long_text = kid.tag in ("p", "pre", "blockquote") and (n > 80 and density < 0.25 or n <= 80 and density == 0)
                if long_text or kid.tag in HEADINGS and density == 0 or final.get(kid, 0.0) >= max(3.0, 0.2 * final[best]):
                    keep.add(kid)
    elif best.tag == "article" and best.parent is not None:  # a page of several articles keeps them all
        keep |= {k for k in best.parent.kids if isinstance(k, Node) and k.tag == "article" and not k.bad
                 and final.get(k, 0.0) >= 0.2 * final.get(best, 0.0)}
    inner: set[Node] = set()  # within the best container
    for at in order:
        at.mark = at in keep or at.parent is not None and at.parent.mark
        if at is best or at.parent in inner:
            inner.add(at)
    whole = best.tag in ("html", "body")
    kept = []
    for text, owner, linked in blocks:
        listed = owner.tag in ("li", "ul", "ol", "div") and linked > 0.8 * len(text)
        if owner.mark and (owner in inner and not whole or not listed) or owner is beside and not linked:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, col="html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    base = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    return base.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
