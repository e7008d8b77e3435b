import html
import random
import re
import time

import pytest

from sayplace.llm import html_extract
from sayplace.llm.html_extract import HINT, LINKED, MENU, NAME, SMOOTHING, THRESHOLD, extract, extract_text, ratios, text_nodes

MENU_BAR = '<nav><ul><li><a href="/a">Menu one, two.</a></li></ul></nav>'
CASES = [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just text, no tags", "just text, no tags"), ("a < b", "a < b"), ("<p>open <b>bold<br><p>next", "open bold\nnext"),
    (f"{MENU_BAR}<div class=\"ad\">Buy now, please.</div><article><h1>T &amp; t</h1><p> One\n  two. </p><p><b>Broken<br><p>Three &eacute;&#233;.</article><footer>&copy; me, all rights.</footer>", "T & t\nOne two.\nBroken\nThree éé."),
    ('<article><p>x<script>var t="</p>";</script>y</p><style>p{}</style><form><p>name</p></form><aside>no, no.</aside><section class="comments"><p>hey, you.</p></section><article class="comment"><p>c</p></article></article>', "x\ny"),
    ("<main><p>In, a text of some length, with marks.</p></main><div><p>Out, as long as what is inside.</p></div>", "In, a text of some length, with marks."),
    ('<div id="top" class="site-header"><p>Name, of the site.</p></div><div class="content"><h1>Title</h1><p>One, two; three. Long text of the page, with more.</p><p>And one more, as long as the first; yes.</p></div>'
     '<div class="sidebar"><p>x, y, z.</p></div><div class="cookie-notice"><p>We use cookies, fine.</p></div>', "Title\nOne, two; three. Long text of the page, with more.\nAnd one more, as long as the first; yes."),
    ("<article><p>a&nbsp;&nbsp;b</p><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "a b\none\ntwo\nc\nd"), ("<article><p>x</p><!-- ad --><p>y", "x\ny"), ("<!-- never closed <p>x</p>", ""),
    # No name tells here which is which: length and punctuation do.
    ('<div><div class="one"><h1>The title</h1><div class="two"><p>A long text, of the page; with more of it. And more.</p></div></div><div class="three">Another thing</div></div>', "The title\nA long text, of the page; with more of it. And more."),
    ('<div class="a"><p>A long text, of the page; with more of it. And more.</p><ul><li><a href="/1">one</a></li><li><a href="/2">two</a></li></ul></div>', "A long text, of the page; with more of it. And more."),
    # Markup.
    ('<div class="content has-sidebar"><p>Text, here.</p></div>', "Text, here."), ('<div class="has-comments no-menu"><p>Text.</p></div>', "Text."), ("<p title=it's>Hello world, it's fine.</p>", "Hello world, it's fine."),
    ('<p title="oops>Hello world</p>', "Hello world"), ('<p>a <span class="ad">x<span>y</span>z</span> b</p>', "a b"), ('<p title="x>y" lang = "en">Text</p>', "Text"), ("a</div></p></b> b", "a\nb"),
    ('<main><div class="related-work"><p>Prior work, is part of this text.</p></div><p>Text.</p></main>', "Text."),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages(page, text):
    assert extract(page) == text


def test_blocks_have_paths():
    paths, [block] = text_nodes("<div><section><p>a <i>b</i> c</p></section></div>")
    assert [text for _, text, _ in block] == ["a ", "b", " c"] and len({p for p, _, _ in block}) == 1
    p, names = block[0][0], []
    while p:
        names.append(paths.tag[p])
        p = paths.parent[p]
    assert names == ["p", "section", "div"]


def test_long_page():
    assert len(extract("<article>" + "<p>word, word.</p>" * 20_000 + "</article>").split("\n")) == 20_000


@pytest.mark.parametrize("part, close", [
    ("<div>", "</div>"), ("<div class=a>x", ""), ("<span class=ad>", ""), ("<span class=ad>x", ""), ("<td></td>", ""), ("<p a=\"x>", ""), ("<b><p>x", ""), ("</div>", ""), ("<!-", ""), ("<script>", ""), ("<a b='", "")])
def test_time_follows_length(part, close):
    begin = time.perf_counter()
    extract("<div>" * 1000 + part * 100_000 + "text" + close * 100_000)
    assert time.perf_counter() - begin < 10


# A page as a tree, and the same method written out for trees: every sum over again from its definition.

WORDS = "a word, and; another. text of it: more".split()


def grow(rng, depth=0):
    """(tag, classes, children), children texts or trees."""
    if depth >= 4 or rng.random() < 0.35:
        return rng.choice(["p", "h2", "blockquote"]), "", [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 30])))]
    if rng.random() < 0.15:
        return "ul", "", [("li", "", [("a", "", [rng.choice(WORDS)])]) for _ in range(3)]
    tag = rng.choice(["div", "div", "section", "article", "main"] if depth else ["div"])
    return tag, rng.choice(["", "", "x", "y", "ad", "related box"]) if tag in ("div", "section") else "", [grow(rng, depth + 1) for _ in range(rng.randrange(1, 5))]


def render(tree):
    tag, classes, children = tree
    return f'<{tag}{f" class=\"{classes}\"" if classes else ""}>' + "".join(html.escape(c) if isinstance(c, str) else render(c) for c in children) + f"</{tag}>"


def leaves(tree, path=(), linked=False):
    tag, classes, children = tree
    if tag == "a":
        linked = True
    else:
        path = (*path, (tag, classes if tag in ("div", "section", "article", "main") else "", bool(set(classes.split()) & {"ad", "related"})))
    for c in children:
        if isinstance(c, str):
            yield path, c, linked
        else:
            yield from leaves(c, path, linked)


def brute(tree):
    nodes = list(leaves(tree))
    text_paths = list(dict.fromkeys(p for p, _, _ in nodes))
    container = lambda p: next((p[:k] for k in range(len(p), 0, -1) if p[k - 1][0] in ("div", "section", "article", "main") or p[k - 1][2]), ())
    fused = {}
    for p in text_paths:
        own = [(t, linked) for q, t, linked in nodes if q == p]
        length = sum(len(t) * (LINKED if linked else 1) for t, linked in own) / len(own)
        marks = sum(len(re.findall("[.,;:!?]", t)) for t, linked in own if not linked) / len(own)
        fused[p] = len(own) * length * (1 + marks)
    boxes = list(dict.fromkeys(p[:k] for p in text_paths for k in range(len(p) + 1) if container(p[:k]) == p[:k]))
    mass = {c: sum(f for p, f in fused.items() if container(p) == c) for c in boxes}
    below = {c: [d for d in boxes if d and container(d[:-1]) == c] for c in boxes}

    def up(c):
        return mass[c] + (sum(up(d) for d in below[c] if not d[-1][2]) * (SMOOTHING if mass[c] else 1) if c else 0)

    def whole(c):
        return mass[c] + sum(whole(d) for d in below[c] if not d[-1][2])

    def article(c):
        """The outermost named article that holds c."""
        for k in range(1, len(c) + 1):
            tag, _, hinted = c[k - 1]
            inner = any(d[: k] == c[:k] and len(d) > k and any(e[0] == "article" for e in d[k:]) for d in boxes)
            if c[:k] in boxes and not hinted and (tag == "article" or tag == "main" and not inner):
                return c[:k]
        return None

    def floor(c):
        if not c:
            return mass[c]
        above, a = floor(container(c[:-1])), article(c)
        if c[-1][2]:
            return min(max(mass[c], above), whole(a)) if a else mass[c]
        return max(mass[c], above, whole(c) if a == c else 0)

    def score(p):
        c = container(p)
        a = article(c)
        own = up(c)
        if c and c[-1][2] and a:
            own = min(own, whole(a))
        weight = HINT ** sum(h for _, _, h in c) * (NAME if a else 1)
        clear = not any(h for _, _, h in (c[len(a) :] if a else c))
        listed = any(t == "ul" for t, _, _ in p[len(c) :]) and all(linked for q, _, linked in nodes if q == p)
        return weight * max(own, floor(c)) * (MENU if listed else 1), clear

    judged = {p: score(p) for p in text_paths}
    best = max([s for s, clear in judged.values() if clear] or [s for s, _ in judged.values()])
    return "\n".join(t for p, t, _ in nodes if judged[p][0] >= THRESHOLD * best)


def test_against_definitions():
    rng, cut = random.Random(5), 0
    for _ in range(400):
        tree = grow(rng)
        got = extract(render(tree))
        assert got == brute(tree), render(tree)
        cut += got != "\n".join(t for _, t, _ in leaves(tree))
    assert cut > 100


def test_ratios():
    paths, found = text_nodes("<div><p>One, two.</p><p>Three</p><p><a>link</a> x</p></div>")
    [(length, marks, n, links)] = ratios(paths, found).values()
    assert n == 4 and length == pytest.approx((9 + 5 + 1 + 4 * LINKED) / 4) and marks == 0.5 and links == pytest.approx(4 / 19)


def test_scores_decide_on_the_tables(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    text = [extract(p) for p in pages]
    assert all(a != b for a, b in zip(text, [extract(p, threshold=0) for p in pages]))
    monkeypatch.setattr(html_extract, "HINT", 1.0)
    monkeypatch.setattr(html_extract, "NAME", 1.0)
    assert sum(a == b for a, b in zip(text, map(extract, pages))) >= 0.95 * len(pages)


def test_frame(spark):
    rows = [(k, f"u{k}", page, "t", 5) for k, (page, _) in enumerate(CASES)] + [(0, None, None, "t", 5), (None, "u", "<article>x</article>", "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, id int").repartition(3)
    got = sorted(map(tuple, extract_text(df, "page_id", "url", "html").collect()), key=str)
    expected = [(k, f"u{k}", text) for k, (_, text) in enumerate(CASES)] + [(0, None, ""), (None, "u", "x")]
    assert got == sorted(expected, key=str)
    assert extract_text(df.limit(0), "page_id", "url", "html").count() == 0
