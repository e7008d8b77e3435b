"""Main text of web pages by tag-path ratios: paths of text nodes are scored, smoothed, fused and cut at a threshold."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sayplace.llm.common import bound_batches

#: A quote begins a value only after "=", and ends it only before what may follow a value; else it is a character.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"""
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')(?=[\s/>])|=)*)(?:>|\Z)""", re.DOTALL)
#: Each attribute in turn, so that neither a longer name nor a value is taken for one.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"(?=[\s/]|\Z)|'[^']*'(?=[\s/]|\Z)|[^\s>]+))?""")

#: Fixed values of HTML: elements without content, with raw content, within a line, and those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select", "menu")

#: Elements and roles that by the standard hold something other than an article's text: menus, site headers and
#: footers, asides, forms, what isn't shown as text.
OUTSIDE = frozenset("head nav footer aside form script style noscript template iframe svg canvas object button select textarea input dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements that gather paths. What a named one holds belongs together, at whatever depth.
CONTAINERS = frozenset("html body div section article main center details fieldset header hgroup td".split())
NAMED = ("article", "main")
#: Classes and ids that hint at something else than article text: a weak feature, HINT below.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer comment comments reply replies disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended widget pagination pager toolbar skip".split())
#: What may stand before a hint in a class or id.
BEFORE = frozenset(["site", "global"])

#: What linked text counts to other text; the share of a part's score that reaches the text around it; the share
#: of the best score that a path must reach.
LINKED, SMOOTHING, THRESHOLD = 0.1, 0.5, 0.4
#: The weak features: what a hint makes of a score, what a named article does, and what a list of links alone does.
HINT, NAME, MENU = 1 / 8, 2.0, 1 / 4
_PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，、；：！？]")


@dataclass
class Paths:
    """The tree of a page's tag paths, each path once; a path's number is greater than its parent's. Number 0 is the page."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    hinted: list[bool] = field(default_factory=lambda: [False])
    known: dict = field(default_factory=dict)

    def child(self, parent: int, tag: str, label: str, hinted: bool) -> int:
        key = (parent, tag, label, hinted)
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.tag)
            self.parent.append(parent)
            self.tag.append(tag)
            self.hinted.append(hinted)
        return at


#: A text node: its path, its text and whether it lies in a link.
Node = tuple[int, str, bool]


def _hint(word: str, within_named: bool) -> bool:
    """Whether a class or id is a hint, or begins with one; has-sidebar and entry-header aren't."""
    if word not in HINTS:
        first, *rest = re.split(r"[-_]+", word)
        word = rest[0] if first in BEFORE and rest else first
    return word in HINTS and not (within_named and word in ("header", "masthead"))


def _features(tag: str, attributes: str, within_named: bool) -> tuple[bool, bool, str]:
    """Whether an element lies outside by the standard, whether it is hinted at, and its classes."""
    if tag in OUTSIDE or tag == "header" and not within_named:
        return True, False, ""
    hinted, classes = False, ""
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id"):
                value = value.strip("\"'").lower()
                if name == "class":
                    classes = value
                if tag not in ("html", "body", *NAMED):
                    hinted = hinted or any(_hint(w, within_named) for w in value.split())
                elif tag in NAMED:
                    hinted = hinted or any(w in HINTS for w in value.split())
            elif name == "hidden" or name == "role" and value.strip("\"'").lower() in ROLES or name == "aria-hidden" and value.strip("\"'").lower() == "true":
                return True, False, ""
            elif name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                return True, False, ""
    return False, hinted, classes


class _Stack:
    """Open elements, and for each tag the places of those open, so that nothing is searched for."""

    def __init__(self) -> None:
        self.paths = Paths()
        self.tags: list[str] = []
        self.nodes: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.outside = self.links = self.named = 0
        self.is_outside: list[bool] = []

    def push(self, tag: str, attributes: str) -> None:
        outside, hinted, classes = _features(tag, attributes, self.named > 0)
        at = len(self.tags)
        above = self.nodes[-1] if self.nodes else 0
        # Elements within a line have a path of their own only where something tells their text from the rest.
        inline = tag in INLINE
        if outside or inline and not hinted:
            node = above
        else:
            node = self.paths.child(above, tag, classes if tag in CONTAINERS else "", hinted)
        self.tags.append(tag)
        self.nodes.append(node)
        self.is_outside.append(outside)
        self.places.setdefault(tag, []).append(at)
        if not inline:
            self.blocks.append(at)
        self.outside += outside
        self.links += tag == "a"
        self.named += tag in NAMED

    def cut(self, size: int) -> None:
        """Close all but so many."""
        while len(self.tags) > size:
            tag = self.tags.pop()
            self.nodes.pop()
            self.places[tag].pop()
            self.outside -= self.is_outside.pop()
            self.links -= tag == "a"
            self.named -= tag in NAMED
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        """The place of the last one open of these, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1


_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}


def text_nodes(page: str) -> tuple[Paths, list[list[Node]]]:
    """The page's paths and blocks in order, a block being its text nodes with character references decoded.

    Text outside by the standard is left out. Each element is pushed and popped once, and nothing looks
    through the open ones, so time is in proportion to the page at any depth.
    """
    stack = _Stack()
    out: list[list[Node]] = []
    block: list[Node] = []
    at = 0

    def text(begin: int, end: int) -> None:
        if end > begin and not stack.outside:
            block.append((stack.nodes[-1] if stack.nodes else 0, html.unescape(page[begin:end]), stack.links > 0))

    def end_block() -> None:
        nonlocal block
        if block:
            out.append(block)
            block = []

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            text(at, len(page))
            break
        text(at, m.start())
        at = m.end()
        closing, tag, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                if not stack.outside:
                    block.append((stack.nodes[-1] if stack.nodes else 0, " ", stack.links > 0))
            elif closing:
                k = stack.last(tag)
                if k > stack.last_block():
                    stack.cut(k)
            elif tag not in VOID:
                stack.push(tag, attributes)
            continue
        end_block()
        if closing:
            k = stack.last(tag)
            if k >= 0:
                stack.cut(k)
            continue
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in CLOSES_P:
            # A paragraph ends here, and line elements left open don't reach into the next block.
            k = stack.last_block()
            stack.cut(k if k >= 0 and stack.tags[k] == "p" else k + 1)
        elif tag in CLOSES_SAME:
            k = stack.last(*CLOSES_SAME[tag])
            if k > stack.last(*LISTS):
                stack.cut(k)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.push(tag, attributes)
    end_block()
    return stack.paths, out


def ratios(paths: Paths, found: list[list[Node]]) -> dict[int, tuple[float, float, int, float]]:
    """Of each path with text: text length and punctuation marks, each to its number of text nodes; these; and the share of its text in links."""
    sums: dict[int, list[float]] = {}
    for block in found:
        for path, text, linked in block:
            n = len(text.strip())
            if not n:
                continue
            s = sums.setdefault(path, [0, 0, 0, 0])
            s[0] += 1
            if linked:
                s[3] += n
            else:
                s[1] += n
                s[2] += len(_PUNCTUATION.findall(text))
    return {p: ((free + LINKED * linked) / n, marks / n, n, linked / (free + linked)) for p, (n, free, marks, linked) in sums.items()}


def scores(paths: Paths, measured: dict[int, tuple[float, float, int, float]]) -> dict[int, tuple[float, bool]]:
    """Of each path with text its score, and whether nothing hints against it.

    Fused: length times one more than punctuation, for each of a path's text nodes. Smoothed over the tree
    of paths: upwards, the paths of one container stand together, and a container's own text gets a share
    of what the containers in it have; downwards, a container has at least what the text around it has,
    and in a named article at least what the whole article has. A hint divides the score of a container
    and of what is in it, and within a named article it is a part of the article's at most. In a list,
    a path of links alone has a part of its container's.
    """
    size = len(paths.tag)
    parent, tag, hinted = paths.parent, paths.tag, paths.hinted
    container, in_list = [0] * size, [False] * size
    for p in range(1, size):
        container[p] = p if tag[p] in CONTAINERS or hinted[p] else container[parent[p]]
        in_list[p] = container[p] != p and (in_list[parent[p]] or tag[p] in ("ul", "ol"))
    mass = [0.0] * size
    for p, (length, marks, n, _) in measured.items():
        mass[container[p]] += length * (1 + marks) * n
    # Upwards: own text, and what of the containers below reaches it; and all of it together, but for what is hinted at.
    up, whole, holds = mass[:], mass[:], [False] * size
    for c in range(size - 1, 0, -1):
        if container[c] == c:
            above = container[parent[c]]
            holds[above] = holds[above] or holds[c] or tag[c] == "article"
            if not hinted[c]:
                whole[above] += whole[c]
                if tag[above] not in ("", "html", "body"):
                    up[above] += up[c] * (SMOOTHING if mass[above] else 1.0)
    # Downwards.
    floor, article, weight, clear = mass[:], [-1.0] * size, [1.0] * size, [True] * size
    for c in range(1, size):
        if container[c] != c:
            continue
        above = container[parent[c]]
        weight[c], article[c], clear[c] = weight[above], article[above], clear[above] and not hinted[c]
        floor[c] = max(mass[c], floor[above])
        if tag[c] == "article" or tag[c] == "main" and not holds[c]:
            if not hinted[c] and article[above] < 0:
                weight[c] *= NAME
                article[c] = whole[c]
                floor[c] = max(whole[c], floor[c])
                clear[c] = True
        if hinted[c]:
            weight[c] *= HINT
            if article[above] >= 0:
                up[c] = min(up[c], article[above])
                floor[c] = min(floor[c], article[above])
            else:
                floor[c] = mass[c]
    out = {}
    for p, (_, _, _, links) in measured.items():
        c = container[p]
        out[p] = weight[c] * max(up[c], floor[c]) * (MENU if in_list[p] and links == 1 else 1.0), clear[c]
    return out


def extract(page: str | None, threshold: float = THRESHOLD) -> str:
    """The text of the page's content paths, one block to a line; empty for null, empty and pages without text.

    A path is content where its score reaches a share of the best. The best is among the paths that
    nothing hints against, if there are such.
    """
    if not page:
        return ""
    paths, found = text_nodes(page)
    judged = scores(paths, ratios(paths, found))
    if not judged:
        return ""
    best = max((s for s, clear in judged.values() if clear), default=0.0) or max(s for s, _ in judged.values())
    content = {p for p, (s, _) in judged.items() if s >= threshold * best}
    lines = []
    for block in found:
        line = " ".join("".join([text for path, text, _ in block if path in content or text.isspace()]).split())
        if line:
            lines.append(line)
    return "\n".join(lines)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([extract(h) for h in batch.column(2).to_pylist()], pa.string())], names=["id", "url", "text"])


def extract_text(df: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """Rows (id, url, text), one for every row of df; each page is judged by itself, so there is no shuffle.

    A null or empty page, and one without content, has an empty text. Broken markup is read as far as it
    goes, a page of any depth in time in proportion to its length. Repeated rows give repeated rows;
    other columns are left out.
    """
    bound_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(page).alias("page")).mapInArrow(_extract, f"id {kind}, url string, text string")
