import pytest

from sayplace.llm.html_extract import extract

ARTICLE = "<article><h1>Title</h1><p>One, two; three.</p></article>"
TEXT = "Title\nOne, two; three."
CASES = [
    *((f'<div class="{c}">{ARTICLE}</div>', TEXT) for c in ("layout has-sidebar", "no-sidebar", "sidebar-left", "menu", "x")),
    *((f"<div {a}>{ARTICLE}</div>", TEXT) for a in ('data-id="menu"', 'data-hidden="false"', 'title="a hidden class=ad"')),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>One, two; three.</p></article>', TEXT),
    (f'{ARTICLE}<div class="related-posts"><article><p>A card, with text.</p></article></div>', TEXT),
    ('<div class="related"><article><p>Card.</p></article></div><div><p>The text itself, longer than cards; all of it.</p></div>', "The text itself, longer than cards; all of it."),
    (f'{ARTICLE}<div class="site-footer"><p>No, no.</p></div><p hidden>No.</p><div id=ad-slot>Buy, now.</div>', TEXT),
    (f"<nav>{ARTICLE}</nav>", ""), (f"<div hidden>{ARTICLE}</div>", ""), (f'<div role="navigation">{ARTICLE}</div>', ""), (f'<div style="display: none">{ARTICLE}</div>', ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_names(page, text):
    assert extract(page) == text
