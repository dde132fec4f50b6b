"""Main text of web pages by composite text density.

A page becomes a tree of elements. Elements that are never article text (scripts, menus, forms, parts named as
adverts, notices, comments, ...) are left out. For every other element the density is its characters per tag,
adjusted by its links; an element's sum adds the densities of its children and of its own text. The subtree with
the largest sum is the content; the smallest density on its path to the body is the threshold above which other
parts belong to it too. A page with an article element is searched inside its articles, and the one found is
taken whole, as a short article may have less text than what stands around it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pages turned into one Arrow batch.
ROWS = 512

# Elements of the HTML standard by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NEVER_TEXT = frozenset(
    "script style noscript template textarea title head nav aside footer form button select option input dialog menu iframe object "
    "svg canvas audio video map noembed noframes datalist".split()
)
#: Elements that a start tag closes if they stand open right around it.
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead"), "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th", "tbody"),
}
#: An open one of these keeps a start tag inside from closing what is outside.
FENCES = frozenset("table ul ol dl div article section main body html td th select".split())
ARTICLES = frozenset(("article", "main"))
#: Words that name parts beside the article in class, id, role or aria-label.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login paywall sidebar sidebars widget widgets nav navbar navigation menu menus "
    "breadcrumb breadcrumbs pagination pager toolbar masthead footer related recommended recommendations teaser teasers share sharing "
    "social comment comments commentlist disqus respond replies reply alert contentinfo complementary search searchbox skip".split()
)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)")
_NAMED = ("class", "id", "role", "aria-label", "itemprop")


@dataclass
class Tree:
    """Elements in page order: a child comes after its parent.

    named: whether attributes name the element as beside the article. left_out: whether it isn't article text.
    pieces: (element, text) in page order.
    """

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    named: list[bool] = field(default_factory=list)
    left_out: list[bool] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)


def names_aside(tag: str, attributes: str) -> bool:
    """Whether attributes name the element as something beside the article."""
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in _NAMED and not ASIDE_NAMES.isdisjoint(_NAME.findall("".join(values).lower())):
            return True
    return _HIDDEN.search(attributes) is not None


def parse(page: str) -> Tree:
    """Elements and texts of a page as browsers would see them; what is left open ends with the page."""
    tree = Tree(["html"], [-1], [False])
    tags, parents, pieces = tree.tags, tree.parents, tree.pieces
    stack, open_tags = [0], {"html": 1}
    pattern = _TAG

    def close(count: int) -> None:
        for _ in range(count):
            open_tags[tags[stack.pop()]] -= 1

    def place_of(names: tuple[str, ...], fenced: bool) -> int:
        """How many elements to close so that the innermost one of these names is closed; 0 if there is none."""
        for depth in range(len(stack) - 1, 0, -1):
            tag = tags[stack[depth]]
            if tag in names:
                return len(stack) - depth
            if fenced and tag in FENCES:
                break
        return 0

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            pieces.append((stack[-1], page[at:mark]))
        if mark == size:
            break
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 2)
            at = size if end < 0 else end + 3
            continue
        following = page[mark + 1 : mark + 2]
        if following in ("!", "?") or following == "/" and not page[mark + 2 : mark + 3].isalpha():
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        found = pattern.match(page, mark)
        if found is None and following.isascii() and (following.isalpha() or following == "/") and pattern is _TAG:
            pattern = _PLAIN_TAG  # a quote that nothing closes: from here on quotes mean nothing
            found = pattern.match(page, mark)
        if found is None:
            pieces.append((stack[-1], "<"))
            at = mark + 1
            continue
        at = found.end()
        ending, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
        if ending:
            if open_tags.get(tag):
                if tag in BLOCKS:
                    close(place_of((tag,), tag != "body" and tag not in FENCES))
                else:
                    # Signs inside a line end inside their block.
                    for depth in range(len(stack) - 1, 0, -1):
                        if tags[stack[depth]] == tag:
                            close(len(stack) - depth)
                            break
                        if tags[stack[depth]] in BLOCKS:
                            break
            elif tag == "br":
                pieces.append((stack[-1], " "))
            continue
        if tag == "html" or tag == "body" and open_tags.get("body"):
            continue
        if tag == "body" and open_tags.get("head"):
            close(place_of(("head",), False))
        if tag in BLOCKS and open_tags.get("p"):
            close(place_of(("p",), True))
        if tag in CLOSED_BY:
            names = CLOSED_BY[tag]
            for _ in names:
                depth = len(stack) - 1
                if tags[stack[depth]] in names:
                    close(1)
                else:
                    inside = [k for k in names if open_tags.get(k)]
                    count = place_of(tuple(inside), True) if inside else 0
                    if not count:
                        break
                    close(count)
        node = len(tags)
        tags.append(tag)
        parents.append(stack[-1])
        tree.named.append(names_aside(tag, attributes))
        if tag == "br" or tag == "hr":
            pieces.append((node, " "))
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            stop = size if end is None else end.start()
            pieces.append((node, page[at:stop]))
            closing = page.find(">", stop)
            at = size if closing < 0 else closing + 1
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    leave_out(tree)
    return tree


def leave_out(tree: Tree) -> None:
    """Mark what can't be article text: by element, or by name unless the part holds an article or all there is."""
    n, tags, parents = len(tree.tags), tree.tags, tree.parents
    article = [tags[i] in ARTICLES and not tree.named[i] for i in range(n)]
    holds, inside = article[:], article[:]
    for i in range(n - 1, 0, -1):
        holds[parents[i]] |= holds[i]
    for i in range(1, n):
        inside[i] |= inside[parents[i]]
    by_tag = [tags[i] in NEVER_TEXT or tags[i] == "header" and not inside[i] for i in range(n)]
    by_name = [tree.named[i] and not holds[i] for i in range(n)]
    for named in (by_name, [False] * n):
        tree.left_out = [a or b for a, b in zip(by_tag, named)]
        for i in range(1, n):
            tree.left_out[i] |= tree.left_out[parents[i]]
        if any(not tree.left_out[node] and text.strip() for node, text in tree.pieces):
            break


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """Of every element its link-adjusted characters per tag, and the sum over its children and its own text."""
    n = len(tree.tags)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(n):
        linked[i] = tree.tags[i] == "a" or i > 0 and linked[tree.parents[i]]
    own = [0] * n
    for node, text in tree.pieces:
        if not tree.left_out[node]:
            own[node] += len(text.strip())
    for i in range(n - 1, -1, -1):
        chars[i] += own[i]
        if linked[i]:
            links[i] = chars[i]
        if i and not tree.left_out[i]:
            up = tree.parents[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (tree.tags[i] == "a")
    share = links[0] / max(chars[0], 1)

    def density(c: int, lc: int, t: int, lt: int) -> float:
        if not c:
            return 0.0
        plain = c / max(t, 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        # Without links in the page there is nothing to adjust.
        return plain if base <= 1 else plain * max(0.0, math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / math.log(base))

    found = [density(*x) for x in zip(chars, links, tags, link_tags)]
    sums = [density(c, c if a else 0, 1, 1 if a else 0) for c, a in zip(own, linked)]
    for i in range(1, n):
        if not tree.left_out[i]:
            sums[tree.parents[i]] += found[i]
    return found, sums


def content(tree: Tree) -> list[bool]:
    """Which elements' text is the content: marked subtrees, without what is left out."""
    n, parents, out = len(tree.tags), tree.parents, tree.left_out
    density, sums = densities(tree)
    in_article = [False] * n
    for i in range(n):
        in_article[i] = tree.tags[i] in ARTICLES or i > 0 and in_article[parents[i]]
    written = {node for node, text in tree.pieces if not out[node] and text.strip()}
    searched = [not out[i] for i in range(n)]
    if any(in_article[i] for i in written):
        searched = [a and b for a, b in zip(searched, in_article)]
    best = [i if searched[i] else -1 for i in range(n)]
    # Of equal sums the outer element, which comes first.
    for i in range(n - 1, 0, -1):
        up = parents[i]
        if best[i] >= 0 and not out[up] and (best[up] < 0 or sums[best[i]] > sums[best[up]]):
            best[up] = best[i]
    marked = [False] * n
    top = best[0]
    if top >= 0:
        path = [top]
        while parents[path[-1]] >= 0:
            path.append(parents[path[-1]])
        article = next((i for i in reversed(path) if tree.tags[i] in ARTICLES), None)
        if article is not None:
            marked[article] = True
        else:
            least = min((density[i] for i in path if tree.tags[i] != "html"), default=0.0)
            marked[top] = True
            for i in range(n):
                if searched[i] and best[i] >= 0 and density[i] >= least and density[i] > 0:
                    marked[best[i]] = True
            if sums[top] <= 0:
                marked[0] = True
    for i in range(1, n):
        marked[i] = marked[i] or marked[parents[i]]
    return [m and not o for m, o in zip(marked, out)]


def main_text(page: str | None) -> str:
    """The article of a page: references decoded, white space one space, blocks joined by one space."""
    if not page:
        return ""
    tree = parse(page)
    chosen = content(tree)
    parts: list[str] = []
    last = -1
    block = _blocks(tree)
    for node, text in tree.pieces:
        if chosen[node]:
            if block[node] != last:
                parts.append(" ")
                last = block[node]
            parts.append(unescape(text))
        elif tree.tags[node] in BLOCKS:
            last = -1
    return " ".join("".join(parts).split())


def _blocks(tree: Tree) -> list[int]:
    """The block that each element's text belongs to."""
    block = [0] * len(tree.tags)
    for i in range(1, len(block)):
        block[i] = i if tree.tags[i] in BLOCKS else block[tree.parents[i]]
    return block


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    A null or empty page, and one without an article, has the empty text. White space is what Unicode calls so.
    A page is worked on whole, whatever its length; rows are independent, so repeated rows give equal rows, null ids
    and urls stay null, an empty table gives none, and other columns are left out.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                texts = [main_text(page.as_py()) for page in rows.column(2)]
                columns = [rows.column(0).cast(pa.int64()), rows.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
