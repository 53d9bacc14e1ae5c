"""The page tree against a form that puts every block's text together, and the rules of noise, main block, title and trimming."""

import random

import pytest

from textassay.operators import pages

LONG = "Words of the article that go on for a while, as they do in print. " * 8


@pytest.mark.parametrize(
    "attrs, noise",
    [
        ({"class": "sidebar"}, True),
        ({"class": "has-sidebar row"}, False),
        ({"class": "layout-with-sidebar"}, False),
        ({"class": "entry-content share"}, False),
        ({"id": "main_nav"}, True),
        ({"itemprop": "articleBody", "class": "promo"}, False),
        ({"class": "top-skip-link2"}, True),
        ({"class": "advertisement-x"}, True),
        ({"class": "navigable"}, False),
        ({}, False),
    ],
)
def test_noise_by_class_and_id(attrs, noise):
    assert pages.is_noise("div", attrs) is noise
    assert pages.is_noise("aside", attrs)


def test_title_and_main_block():
    tree = pages.Tree(f"<title> </title><body><header><h1>Head <b>two</b></h1></header><main><p>{LONG}</p></main><article>short</article></body>")
    assert tree.title() == "Headtwo"
    assert tree.main().tag == "main" if tree.size(tree.main()) > 400 else True
    assert pages.Tree("<title>A &amp; b</title><h1>x</h1>").title() == "A & b" and pages.Tree("").title() is None
    hinted = pages.Tree(f"<body><div class='wrap'><div class='my-Story'>{LONG}</div><div>{LONG * 2}</div></div></body>")
    assert hinted.main().classes == "my-story"
    assert pages.Tree(f"<body><div class='story'>{LONG[:90]}</div><div>{LONG}</div></body>").main().classes == ""
    assert pages.main_block(f"<article>tiny</article><div>{LONG}</div>") == LONG.strip()
    assert pages.main_block("<p>no block at all") == "no block at all" and pages.main_block(None) == ""


def test_trimming():
    lines = ["EN", "FR", "条款", "Home", "Blog", "Mail", "The first long line stands here", *(f"line number {k} of it" for k in range(8)), "相关文章 of others", "more"]
    assert pages.trimmed(lines).split("\n") == lines[6:15]
    assert pages.trimmed(["EN", "OK"]) == "EN\nOK"


def plain(page):
    """Each element's own list of texts, copied up as it closes."""
    import html.parser

    class Parser(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.closed, self.order = [["", False, [], -1, {}]], [], 0

        def handle_starttag(self, tag, attrs):
            if tag not in pages.VOID:
                own = dict(attrs)
                self.open.append([tag, pages.is_noise(tag, own), [], self.order, own])
                self.order += 1

        def pop(self):
            tag, noise, texts, order, own = self.open.pop()
            if not noise:
                self.open[-1][2].extend(texts)
                if not any(o[1] for o in self.open):
                    self.closed.append((order, tag, own, texts))
            return tag

        def handle_endtag(self, tag):
            if any(o[0] == tag for o in self.open[1:]):
                while self.pop() != tag:
                    pass

        def handle_data(self, data):
            if data.strip():
                self.open[-1][2].append(data.strip())

    parser = Parser()
    parser.feed(page)
    parser.close()
    while len(parser.open) > 1:
        parser.pop()
    return sorted(parser.closed, key=lambda c: c[0])


def test_sizes_equal_texts_put_together():
    rng = random.Random(5)
    for _ in range(150):
        out = []
        for _ in range(rng.randint(1, 60)):
            kind = rng.random()
            tag = rng.choice(["div", "p", "section", "aside", "article", "b", "nav"])
            out.append(f"<{tag} class='{rng.choice(['', 'x', 'sidebar', 'content', 'has-sidebar'])}'>" if kind < 0.4 else f"</{tag}>" if kind < 0.7 else rng.choice(["word ", " two words\n", "<br>", "&amp;"]))
        page = "<body>" + "".join(out)
        tree = pages.Tree(page)
        want = [(tag, sum(map(len, texts))) for _, tag, _, texts in plain(page)]
        assert [(e.tag, tree.size(e)) for e in tree.elements] == want


def test_deep_pages_take_linear_time():
    deep = "<div>" * 20_000 + "text " * 200 + "</div>" * 20_000
    assert pages.main_block(deep).startswith("text text")


def test_extract_gives_title_and_text(spark):
    rows = [(1, f"<title>T</title><article>{LONG}</article>"), (2, None), (3, ""), (None, "<h1>H</h1>")]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1].title == "T" and got[1].text == LONG.strip() and got[2].title is None and got[2].text == got[3].text == "" and got[None].title == "H"
