"""Main text against a plain recursion over the tree, and with tags and marks that should not decide."""

import math
import re

import duckdb
import pytest
from reasonset.llm import html_text

PAGES = "/root/testdata/sf0.1/pages.parquet"


@pytest.fixture(scope="module")
def pages():
    return [r[0] for r in duckdb.sql(f"select html from '{PAGES}' where html is not null order by page_id").fetchall()]


def plain_text(page):
    """Densities, threshold and choice by recursion over children."""
    tree = html_text.Tree(page)
    children = {i: [] for i in range(len(tree.tags))}
    for i, up in enumerate(tree.parent):
        if up >= 0 and not tree.gone[i]:
            children[up].append(i)

    def tags(i):
        return sum(1 + tags(c) for c in children[i])

    def links(i):
        return sum((tree.tags[c] == "a") + links(c) for c in children[i])

    c_body, lc_body = tree.chars[0], tree.links[0]

    def density(i):
        c, lc, t, lt = tree.chars[i], max(1, tree.links[i]), max(1, tags(i)), max(1, links(i))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - tree.links[i]) * tree.links[i] + lc_body / max(1, c_body) * c + math.e)
        value = math.log(max(1.0, c / lc * t / lt))
        return c / t * (value / math.log(max(base, 1 + 1e-9)) if base > 1 else value)

    dense = {i: density(i) for i in children}
    sums = {i: sum(dense[c] for c in children[i]) for i in children}
    best = max(children, key=lambda i: (round(sums[i], 9), round(dense[i], 9), -i))
    if best == 0:
        return tree.text(0)
    way, at = [], best
    while at:
        way.append(dense[at])
        at = tree.parent[at]

    def texts(i):
        inside = not tree.in_article[best] or tree.in_article[i] or sums[i] >= min(way)
        if i and (i == best or dense[i] >= min(way) > 0 and inside):
            return [tree.text(i)]
        return [t for c in children[i] for t in texts(c)]

    return " ".join(t for t in texts(0) if t)


def renamed(page):
    return re.sub(r"(</?)(article|main)\b", r"\1div", page, flags=re.IGNORECASE)


def test_choice_agrees_with_a_plain_recursion(pages):
    for page in pages[:500]:
        assert html_text.main_text(page) == plain_text(page)
        assert html_text.main_text(renamed(page)) == plain_text(renamed(page))


def test_densities_and_not_the_tag_find_the_text(pages):
    for page in pages:
        whole = html_text.main_text(page)
        assert whole and html_text.main_text(renamed(page)) == whole


def paragraphs(name, n=6):
    return "".join(f"<p>{name} paragraph {i} with a good number of words in it, so that it is dense enough.</p>" for i in range(n))


def counts(page):
    text = html_text.main_text(page)
    assert text == plain_text(page)
    return [text.count(f"{k} paragraph") for k in "abc"]


def test_several_articles_and_blocks_beside_one():
    a, b, c = map(paragraphs, "abc")
    assert counts(f"<body><article>{a}</article><article>{b}</article></body>") == [6, 6, 0]
    assert counts(f"<body><article>{a}</article><div>{b}</div><section>{c}</section></body>") == [6, 6, 6]
    assert counts(f"<body><main><article>{a}</article><div>{b}</div></main><div>buy our things, cheap and good and wanted by all of us</div></body>") == [6, 6, 0]
    assert "buy" not in html_text.main_text(f"<body><article>{a}</article><div>buy our things, cheap and good and wanted by all of us</div></body>")


def test_marks_need_a_second_sign_inside_an_article():
    a, b, c = map(paragraphs, "abc")
    assert counts(f"<body><article>{a}<div class='social-science'>{b}</div>{c}</article></body>") == [6, 6, 6]
    linked = "<div class='related'><a href=x>more of this</a> and <a href=y>that as well</a></div>"
    asked = "<div class='alert'>Tell us your name, please. <form><input name=n></form></div>"
    text = html_text.main_text(f"<body><article>{a}{linked}{asked}{b}</article></body>")
    assert "more of this" not in text and "your name" not in text and text.count("paragraph") == 12
    assert counts(f"<body><article>{a}<div id='reader-comments'>{b}</div></article></body>") == [6, 0, 0]
    assert "home" not in html_text.main_text(f"<body><div id=siteNav>home about contact and more</div><div>{a}</div></body>")


def test_very_long_page():
    page = f"<body><nav>{'<a href=x>menu</a>' * 20_000}</nav><article>{paragraphs('a', 20_000)}</article></body>"
    assert html_text.main_text(page).count("a paragraph") == 20_000
