"""Pages laid out in ways that the given ones don't show: one model, fitted on pages of one template."""

import pytest

from trialmill.llm import htmlmain
from trialmill.llm.dom import Page

FIRST = "The old bridge over the river was closed on Monday, after engineers had found cracks in two of its pillars. Repairs will take at least until autumn, the city says."
SECOND = "Traffic is led over the northern bridge meanwhile, where buses have a lane of their own. Residents had asked for one for years, and many hope that it will stay."
P, Q = f"<p>{FIRST}</p>", f"<p>{SECOND}</p>"
BOTH = f"{FIRST}\n{SECOND}"
PAGES = {
    "form around the page": (f'<body><form id="aspnetForm"><div class="content"><h1>Bridge closed</h1>{P}{Q}</div></form></body>', f"Bridge closed\n{BOTH}"),
    "misleading class": (f'<body><div class="meta article">{P}{Q}</div></body>', BOTH),
    "misleading words": (f'<body><div class="social-science article-tags">{P}{Q}</div></body>', BOTH),
    "aside in the article": (f"<body><article>{P}<aside>Read also: what the mayor said</aside>{Q}</article></body>", BOTH),
    "footer in the article": (f"<body><article>{P}{Q}<footer>Filed under news</footer></article></body>", BOTH),
    "menu in main": (f"<body><main><nav>Menu One</nav>{P}{Q}</main></body>", BOTH),
    "notice": (f"<body><noscript>Please enable JavaScript to use this site.</noscript><article>{P}{Q}</article></body>", BOTH),
    "headline in a header": (f"<body><header><a href=/>Home</a></header><article><header><h1>Bridge closed for repairs</h1></header>{P}{Q}</article></body>", f"Bridge closed for repairs\n{BOTH}"),
    "plain article": (f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><h1>Bridge closed</h1>{P}{Q}</article><footer>© The Paper</footer></body>", f"Bridge closed\n{BOTH}"),
}


@pytest.fixture(scope="module")
def model(spark):
    return htmlmain.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_parts_are_told_apart(model, name):
    html, want = PAGES[name]
    assert htmlmain.main_text(html, model) == want


def test_new_layouts_lose_and_keep_little(spark, model):
    """Held-out layouts of the given pages' own text: characters lost or kept wrongly, against all of the articles'."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    wrong = sum(htmlmain.wrong_characters(h, 7000 + i, model) for i, h in enumerate(pages))
    whole = sum(len(t) for h in pages for n, t, _ in Page(h).runs)
    assert wrong < 0.02 * whole, wrong / whole


def test_a_page_of_prose_is_never_empty():
    page = Page(f"<body><div class='meta ad sidebar'>{P}</div><nav><p>{SECOND}</p></nav></body>")
    assert htmlmain.prose(page) == [FIRST] and htmlmain.prose(Page("<body><div>Menu</div></body>")) == []
