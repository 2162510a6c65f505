"""Main text of web pages by tree scoring.

A page becomes a tree of elements; what cannot be article (menus, page headers, footers, asides, forms, scripts, and
elements whose class, id or role names an advert, notice, comment and the like) is left out of it. A name counts as a whole
or by its first or last part, and beside a word for content only where the last part says what the thing is; it never
counts for article and main, nor for an element that holds most of the page, comments apart. Every paragraph earns
points for its length and its commas and passes them on: in full to the element around it, half to the next, then a
third of that for each step. An element's points count as far as its text is not links. The best element is kept, and
of its siblings those with a fair share of its points and paragraphs that stand alone; their blocks are the text.

Character references are decoded once, white space inside a block becomes one blank, blocks are joined by one blank.
Nothing is capped: a page of any size is one tree.

Nulls and empties: a null page counts as empty; a page without text gives the empty text. Markup that is never closed or
never opened is read as browsers do in the plain cases: a block ends an open paragraph, an end tag without a start is
skipped; a slash closes what is no block, frames and scripts too. Ties go to the element that comes first. Rows that repeat
are extracted each for itself. An empty table gives an empty result.
"""

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import beside_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe xmp".split())
LEFT_OUT = RAW | frozenset("nav aside footer form button select menu dialog head audio video map svg math object canvas template".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul br""".split())
#: A start tag ends these open elements, up to the nearest of the elements in the second set.
ENDS = {tag: ({"p"}, {"table", "td", "th", "button"}) for tag in BLOCKS - {"br", "html", "body", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}}
ENDS |= {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
         "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}),
         "th": ({"td", "th", "p"}, {"tr", "table"})}
PARAGRAPHS = frozenset("p pre td blockquote h2 h3 h4 li dd figcaption".split())
BEGINS = {"article": 25.0, "main": 15.0, "section": 2.0, "div": 2.0, "ul": -3.0, "ol": -3.0, "table": -2.0}
NAMES_OUT = frozenset("""ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
    disqus dialog footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification notifications overlay pager
    pagination popup promo promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored
    subscribe subscription toolbar widget widgets alert complementary contentinfo search""".split())
QUALIFIERS = frozenset("with has no without is not js".split())
NAMES_IN = frozenset("article content main post entry story text".split())
#: Last parts that say what a thing is, whatever content word comes before.
NAMES_OF = frozenset("""ad ads advert comment comments commentlist footer menu nav navigation newsletter pagination promo related respond
    share sharing signup subscribe""".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: First parts of names that file a page under a subject.
FILING = frozenset("category tag format type status postid".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    """left: "" if it may be article, "name" if only its name speaks against it, else "out"."""

    __slots__ = ("tag", "parent", "children", "points", "named", "inside", "left")

    def __init__(self, tag, parent, named, inside, left=""):
        self.tag, self.parent, self.children, self.points, self.named, self.inside, self.left = tag, parent, [], 0.0, named, inside, left


def judged(attributes: str, inside: bool) -> tuple[str, bool]:
    """(left out, named like content) by class, id, role and visibility; left out is "", "name" or "out"."""
    left, good = "", False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            left = "out"
        elif key in ("class", "id", "role"):
            for name in value.split():
                parts = [p.lower() for p in NAME_PART.findall(name)]
                if not parts or parts[0] in QUALIFIERS or parts[0] in FILING and len(parts) > 1:
                    continue
                content = any(p in NAMES_IN for p in parts)
                good |= content
                if parts[-1] in NAMES_OF or not content and (parts[0] in NAMES_OUT or parts[-1] in NAMES_OUT) or parts == ["header"] and not inside:
                    left = left or "name"
                    if not COMMENTS.isdisjoint(parts):
                        left = "out"
    return left, good


def parse(page: str) -> Element:
    """The tree of what may be article; texts are decoded strings among the children."""
    root = Element("#root", None, False, False)
    here, at, end = root, 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            here.children.append(html.unescape(page[at:stop]))
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            node = here
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                here = node.parent
            continue
        if tag in VOID:
            if tag in BLOCKS:
                here.children.append("\n")
            continue
        if tag in ENDS:
            closed, fence = ENDS[tag]
            node, last = here, None
            while node.parent is not None and node.tag not in fence:
                if node.tag in closed:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        attributes = found[3]
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if close or tag in ("script", "style"):
                at = close.end() if close else end
            continue
        inside = here.inside or tag in ("article", "main")
        left, good = judged(attributes, inside) if "=" in attributes or "hidden" in attributes else ("", False)
        if tag in ("html", "body", "article", "main"):
            left = ""
        if tag in LEFT_OUT or tag == "header" and not inside:
            left = "out"
        node = Element(tag, here, good, inside, left)
        here.children.append(node)
        here = node
    prune(root)
    return root


def prune(root: Element) -> None:
    """Take out what is left out; but an element with most of the page's running text is not, where only its name speaks against it."""
    order, stack = [], [(root, False)]
    running = {}
    while stack:
        node, counts = stack.pop()
        order.append(node)
        counts = node.tag != "a" and (counts or node.tag in ("p", "pre", "blockquote"))
        node.children = [c for c in node.children if c.__class__ is str or c.left != "out"]
        running[id(node)] = sum(len(c.strip()) for c in node.children if c.__class__ is str) if counts else 0
        stack.extend([(c, counts) for c in reversed(node.children) if c.__class__ is Element])
    for node in reversed(order):
        if node.parent is not None:
            running[id(node.parent)] += running[id(node)]
    for node in order:
        node.children = [c for c in node.children if c.__class__ is str or not c.left or 2 * running[id(c)] > running[id(root)]]


def walk(root: Element):
    """Elements in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend([c for c in reversed(node.children) if c.__class__ is Element])


def text_of(node: Element) -> str:
    """Blocks in page order, with one blank between them and for all white space."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.__class__ is str:
            out.append(x)
            continue
        if x.tag in BLOCKS:
            out.append("\n")
            stack.append("\n")
        stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    root = parse(page or "")
    order = list(walk(root))
    # letters, and letters in links, from the leaves up
    letters, links, own = {}, {}, {}
    for node in reversed(order):
        n = link = alone = commas = 0
        for c in node.children:
            if c.__class__ is str:
                k = len(c.strip())
                n, alone, commas = n + k, alone + k, commas + c.count(",") + c.count("،") + c.count("，")
            else:
                n, link = n + letters[id(c)], link + links[id(c)]
                if c.tag not in BLOCKS:
                    alone, commas = alone + own[id(c)][0], commas + own[id(c)][1]
        letters[id(node)], links[id(node)], own[id(node)] = n, n if node.tag == "a" else link, (alone, commas)
    scored = []
    for node in order:
        node.points += BEGINS.get(node.tag, 0.0) + (10.0 if node.named else 0.0) if node.tag in BLOCKS else 0.0
        n, commas = own[id(node)]
        if n and (node.tag in PARAGRAPHS or node.tag in BLOCKS and n >= 25):
            density = links[id(node)] / max(letters[id(node)], 1)
            worth = (1.0 + commas + min(n / 100.0, 3.0)) * (1.0 - density)
            # a block that has text of its own beside paragraphs is a container too
            up, share = node.parent if node.tag in PARAGRAPHS else node, 1.0
            while up is not None and up.tag != "#root":
                up.points += worth * share
                share = share / 2 if share == 1.0 else share / 3
                up = up.parent
        if node.tag in BLOCKS and node.tag not in PARAGRAPHS:
            scored.append(node)
    final = {id(x): x.points * (1.0 - links[id(x)] / max(letters[id(x)], 1)) for x in order}
    best = max(scored, key=lambda x: final[id(x)], default=None)
    if best is None or not letters[id(best)]:
        return text_of(root)
    if best.parent is None or best.tag in ("body", "html"):
        return text_of(best)
    bar, kept = max(10.0, 0.2 * final[id(best)]), []
    for x in best.parent.children:
        if x is best:
            kept.append(x)
        elif x.__class__ is Element and letters[id(x)]:
            density = links[id(x)] / letters[id(x)]
            if x.tag in PARAGRAPHS:
                if density < 0.25 and (own[id(x)][0] > 80 or best.parent.tag == "article"):
                    kept.append(x)
            elif x.tag in BLOCKS and (final[id(x)] >= bar and density < 0.5 or best.parent.tag == "article" and x.tag in ("h1", "header", "section")):
                kept.append(x)
    return " ".join(filter(None, [text_of(x) for x in kept]))


def extract(pages: DataFrame) -> DataFrame:
    """Every row of `pages` as `row`, with text, the main text of its html."""
    def run(column):
        for at in range(0, len(column), 256):
            part = column.slice(at, 256)
            yield len(part), [pa.array([main_text(x) for x in part.to_pylist()], pa.string())]

    return beside_rows(pages, "html", lambda: run, "text string")
