"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Training rows come from a bounded sample of the pages themselves. A page whose
own elements tell its article from other parts labels its nodes, by element
alone; besides, its article and the
rest of its text are laid out anew in other mark-up, where each part's label is
known because it was put there, so that the trees learn
from densities, places and attribute words rather than from one template.
Decoding gives each subtree one choice: keep all of it, drop all of it, or let
its children choose, at a small cost. An ancestor that is dropped or
kept thus never contradicts a descendant.
"""

from __future__ import annotations

import html as escapes
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, sampled, save
from .dom import ASIDE, BAD_WORDS, FEATURES, MAIN, MARKS, Page, features

# Usual names of a page's parts, for the layouts made for training.
NAMES = {
    "content": "content article post entry story main post-content article-body entry-content page-content text",
    "top": "header masthead top-bar site-header banner head",
    "menu": "nav menu navbar navigation breadcrumbs main-menu links",
    "side": "sidebar widget related right-rail side-bar recommended aside",
    "ad": "ad ads advert advertisement sponsored promo ad-box banner-ad",
    "notice": "cookie-notice consent notice alert newsletter popup gdpr-banner subscribe disclaimer",
    "comments": "comments comment-list discussion replies reader-comments reviews",
    "form": "form search login signup contact-form feedback",
    "foot": "footer site-footer bottom copyright legal page-footer",
}
#: Of the words that speak against a node, those that article containers carry at times.
MISLEADING = "meta social tags share top bottom promo head header body-header hidden related-article teaser alert legal search rail widget".split()
SEMANTIC = {"content": ("article", "main"), "top": ("header",), "menu": ("nav",), "side": ("aside",), "ad": ("aside",), "notice": ("aside", "dialog"), "comments": ("section",), "form": ("form",), "foot": ("footer",)}


def labels_of(page: Page, given: bool = False) -> np.ndarray:
    """1 within an article, 0 within other parts, -1 where the mark-up doesn't say or a subtree holds both.

    Elements alone tell: attribute words are features, so within an article
    they leave a node without a label. given: by data-part alone, as in the layouts made here.
    """
    n = len(page.nodes)
    own = np.full(n, -1)
    for i, node in enumerate(page.nodes):
        if not i:
            continue
        above = own[node.parent]
        if given:
            own[i] = above if node.given is None else int(node.given)
        else:
            unsure = bool(node.words & BAD_WORDS) or above == -2
            unsure = unsure or (node.tag == "header" and above == 1)  # it may hold the headline
            own[i] = -2 if unsure and above == 1 else 0 if node.tag in ASIDE or above == 0 else -2 if unsure else 1 if node.tag in MAIN or above == 1 else -1
    kinds: list[set[int]] = [set() for _ in range(n)]
    for node, _, _ in page.runs:
        kinds[node].add(int(own[node]))
    for i in range(n - 1, 0, -1):
        kinds[page.nodes[i].parent] |= kinds[i]
    return np.array([max(next(iter(k)), -1) if len(k) == 1 else -1 for k in kinds])


def laid_out(main: list[str], other: list[str], rng: random.Random) -> str:
    """A page with the given main blocks among other parts."""
    esc, words = escapes.escape, " ".join(other + main).split() or ["x"]
    pick = lambda n: esc(" ".join(rng.choices(words, k=n)))
    say = lambda: esc(rng.choice(main)[: rng.randint(40, 400)]) if main and rng.random() < 0.7 else pick(rng.randint(3, 40))

    def part(kind: str, inside: str) -> str:
        tag = rng.choice(SEMANTIC[kind]) if rng.random() < 0.4 else rng.choice(("div", "div", "section"))
        words = [rng.choice(NAMES[kind].split())]
        if kind == "content" and rng.random() < 0.2:  # words that mislead
            words = words * (rng.random() < 0.6) + rng.choices(MISLEADING, k=rng.randint(1, 2))
            rng.shuffle(words)
        name = "" if tag in MAIN | ASIDE and rng.random() < 0.5 else f' {rng.choice(("class", "id"))}="{" ".join(words)}"'
        return f'<{tag}{name} data-part="{int(kind == "content")}">{inside}</{tag}>'

    items = lambda: "<ul>" + "".join(f'<li><a href="/x">{pick(rng.randint(1, 4))}</a></li>' for _ in range(rng.randint(3, 9))) + "</ul>"
    talk = lambda: "".join(f"<{t}>{say()}</{t}>" for t in rng.choices(("p", "div"), k=rng.randint(1, 4)))
    makers = {"top": lambda: f"<div>{pick(3)}</div>" + items() * (rng.random() < 0.5), "menu": items, "side": lambda: rng.choice((items, talk))(), "ad": lambda: rng.choice((say, talk))(), "notice": talk, "comments": lambda: f"<h3>{pick(2)}</h3>" + talk() * rng.randint(1, 3), "form": lambda: f"<p>{say()}</p><label>{pick(2)}</label><input>", "foot": lambda: rng.choice((say, items))()}
    make = lambda kind: part(kind, makers[kind]())
    brief = lambda: rng.choice((lambda: f"{pick(rng.randint(2, 6))}", lambda: f"<p>{pick(rng.randint(2, 12))}</p>", lambda: f'{pick(2)}: <a href="/x">{pick(rng.randint(1, 6))}</a>'))()
    inner = lambda tag: f'<{tag} data-part="0">{brief()}</{tag}>'
    blocks = []
    for i, text in enumerate(main):
        tag = rng.choice(("h1", "h2", "p")) if not i else rng.choice(("p",) * 12 + ("div", "li", "blockquote", "h2"))
        blocks.append(f'<{tag} data-part="1">{esc(text)}</{tag}>')
        if rng.random() < 0.1:
            blocks.append(make(rng.choice(("ad", "side", "notice", "menu"))) if rng.random() < 0.6 else inner(rng.choice(("aside", "nav"))))
    if blocks and rng.random() < 0.2:  # the headline in a header of its own
        blocks[0] = f'<header data-part="1">{blocks[0]}</header>'
    if rng.random() < 0.15:
        blocks.insert(0, inner("nav"))
    if rng.random() < 0.25:
        blocks.append(inner(rng.choice(("footer", "aside"))))
    before = [make(k) for k in ("notice", "top", "menu", "ad") if rng.random() < 0.55]
    after = [make(k) for k in ("side", "comments", "form", "ad", "notice") if rng.random() < 0.5]
    rng.shuffle(after)
    inside = "".join(blocks)
    plain = rng.choice((inside, f"<section>{inside}</section>", f"<div>{inside}</div>", f"<table><tr><td>{inside}</td></tr></table>"))
    body = "".join(before) + (plain if rng.random() < 0.35 else part("content", inside)) + "".join(after) + (make("foot") if rng.random() < 0.85 else "")
    if rng.random() < 0.2:
        body = f'<noscript data-part="0">{rng.choice((pick(rng.randint(3, 12)), talk()))}</noscript>' + body
    for _ in range(rng.randint(0, 2)):
        body = f"<div>{body}</div>"
    if rng.random() < 0.12:  # a form around everything
        body = f'<form{rng.choice(("", " id=page-form", " class=form"))}>{body}</form>'
    return f"<html><head><title>{pick(4)}</title></head><body>{body}</body></html>"


def training_rows(html: str, seed: int, layouts: int) -> Iterator[tuple[list[float], float]]:
    """Features and labels of a page's nodes, as it is and laid out anew."""
    page = Page(html)
    given = labels_of(page)
    if (given == 1).any():  # else nothing says which parts are asides of an article
        for x, y in zip(features(page), given, strict=True):
            if y >= 0 and x[1] > 0:
                yield x.tolist(), float(y)
    rng = random.Random(seed)
    for _ in range(layouts):
        new = Page(relaid(page, rng) or "")
        keep = labels_of(new, given=True)
        for x, y in zip(features(new), keep, strict=True):
            if y >= 0 and x[1] > 0:
                yield x.tolist(), float(y)


#: What a split costs. On layouts that the trees haven't seen, costs from 0.05 to 1 get as many characters wrong within a few hundredths of a percent; low ones part short asides from articles.
SPLIT_COST = 0.1


@dataclass
class Trees:
    """Boosted trees as arrays: feature (-1 at a leaf), threshold, left, right and value of each node."""

    weights: list[float]
    trees: list[tuple[np.ndarray, ...]]
    split_cost: float = SPLIT_COST

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for w, (feature, threshold, left, right, value) in zip(self.weights, self.trees, strict=True):
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                k = at[rows]
                at[rows] = np.where(x[rows, feature[k]] <= threshold[k], left[k], right[k])
            total += w * value[at]
        return 2 * total


SPLIT, LEAF = re.compile(r"^( *)If \(feature (\d+) <= ([-\d.Ee]+)\)"), re.compile(r"^( *)Predict: ([-\d.Ee]+)")


def exported(model) -> Trees:
    """The trees of a fitted GBTClassificationModel, from their printed form."""
    out = []
    for tree in model.trees:
        rows: list[list[float]] = []
        lines = tree.toDebugString.split("\n")
        at = 1

        def build() -> int:
            nonlocal at
            line, me = lines[at], len(rows)
            at += 1
            if m := SPLIT.match(line):
                rows.append([int(m[2]), float(m[3]), 0, 0, 0.0])
                left = build()
                at += 1  # Else
                rows[me][2:4] = left, build()
            else:
                rows.append([-1, 0.0, 0, 0, float(LEAF.match(line)[2])])
            return me

        build()
        f, t, a, b, v = zip(*rows, strict=True)
        out.append((np.array(f, int), np.array(t), np.array(a, int), np.array(b, int), np.array(v)))
    return Trees(list(model.treeWeights), out)


def fit(pages: DataFrame, sample_pages: int = 300, layouts: int = 3, trees: int = 20, depth: int = 5, seed: int = 42) -> Trees:
    """Fits on about sample_pages pages, chosen by a hash of page_id, each with `layouts` layouts of its own text.

    Pages of no use (null, empty, without text) are passed over; without any,
    every node is kept unless its tag or attribute words speak against it.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for i, t in zip(b.seed, b.html, strict=True) for r in training_rows(t, int(i), layouts)]
            yield pd.DataFrame(found, columns=["x", "label"])

    some = sampled(pages.where(F.length("html") > 0), "page_id", sample_pages, seed)
    data = save(some.select(F.xxhash64("page_id").alias("seed"), "html").repartition(8).mapInPandas(rows, "x array<double>, label double"), "nodes")
    if data.select("label").distinct().count() < 2:
        return Trees([], [])
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="v", labelCol="label", stepSize=0.3, maxBins=64)
    return exported(gbt.fit(data.select(array_to_vector("x").alias("v"), "label").coalesce(4)))


#: Log-odds that the trees' are added to: what HTML and the commonest names say, however rare it is in the sample.
START = {"part_above": -2.0, "part_words_above": -2.0}


def wrong_characters(html: str, seed: int, model: Trees) -> int:
    """Of a new layout of a page's own text: characters of blocks that are lost or kept wrongly."""
    new = Page(relaid(Page(html), random.Random(seed)) or "")
    keep = labels_of(new, given=True)
    want = Counter(text for node, text, _ in new.runs if keep[node] == 1)
    got = Counter(decode(new, log_odds(features(new), model), model.split_cost))
    return sum(len(t) * n for t, n in ((want - got) + (got - want)).items())


def relaid(page: Page, rng: random.Random) -> str | None:
    """A page's article, or its longest blocks, laid out anew among its other text; None without any."""
    given = labels_of(page)
    main = [text for node, text, _ in page.runs if given[node] == 1] or sorted((t for _, t, _ in page.runs), key=len)[-3:]
    other = [text for node, text, _ in page.runs if given[node] == 0]
    return laid_out(main[: rng.randint(1, 40)], other, rng) if main else None


def prose(page: Page) -> list[str]:
    """Long blocks with few links that no element puts aside: what is left of a page of which nothing was kept, as where words in its attributes mislead."""
    aside = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        aside[i] = node.tag in ASIDE - {"form"} or (i > 0 and aside[node.parent])
    return [text for node, text, linked in page.runs if not aside[node] and len(text) >= 80 and linked < 0.3 * len(text) and MARKS.search(text)]


def decode(page: Page, odds: np.ndarray, split_cost: float = 1.0) -> list[str]:
    """The kept runs of the likeliest choices, found bottom up.

    A node is kept, dropped or split. Below a kept or dropped one all are the
    same; a split one costs split_cost and leaves the choice to each child, and
    to its own runs, if it has any. Each choice of a node, and of a split one's
    own runs, adds its log-probability. Nodes without text have no part in it.
    """
    n = len(page.nodes)
    keep_log, drop_log = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    keep, drop, best = [0.0] * n, [0.0] * n, [0.0] * n
    filled = [False] * n
    for i in range(n - 1, -1, -1):
        node = page.nodes[i]
        filled[i] = bool(node.runs) or any(filled[c] for c in node.children)
        if not filled[i]:
            continue
        keep[i] = keep_log[i] + sum(keep[c] for c in node.children)
        drop[i] = drop_log[i] + sum(drop[c] for c in node.children)
        own = max(keep_log[i], drop_log[i]) if node.runs else 0.0
        best[i] = max(keep[i], drop[i], own + sum(best[c] for c in node.children) - split_cost if node.children else -np.inf)
    kept = [False] * n
    fate = [0] * n  # 1 and -1: settled by an ancestor
    for i in range(n):
        node = page.nodes[i]
        fate[i] = fate[node.parent] if i else 0
        if not fate[i] and filled[i]:
            fate[i] = 1 if best[i] == keep[i] else -1 if best[i] == drop[i] else 0
        kept[i] = fate[i] == 1 or (fate[i] == 0 and odds[i] > 0)
    return [text for node, text, _ in page.runs if kept[node]]


def log_odds(x: np.ndarray, model: Trees) -> np.ndarray:
    if model.trees:
        start = sum(w * x[:, FEATURES.index(f)] for f, w in START.items())
        return np.clip(model.log_odds(x) + start, -6, 6)
    against = sum(x[:, FEATURES.index(f)] for f in ("aside_tag", "aside_above", "bad_words", "bad_above"))
    return np.where(against > 0, -3.0, 3.0)


def main_texts(htmls: list[str | None], model: Trees, at_once: int = 256) -> list[str]:
    """The main text of each page; the trees go over the nodes of some hundred pages together."""
    out: list[str] = []
    for i in range(0, len(htmls), at_once):
        pages = [Page(h or "") for h in htmls[i : i + at_once]]
        rows = [features(p) for p in pages]
        odds = np.split(log_odds(np.concatenate(rows), model), np.cumsum([len(r) for r in rows])[:-1])
        out += ["\n".join(decode(p, o, model.split_cost) or prose(p)) for p, o in zip(pages, odds, strict=True)]
    return out


def main_text(html: str | None, model: Trees) -> str:
    return main_texts([html], model)[0]


def extract(pages: DataFrame, model: Trees) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of pages(page_id, url, html).

    Null and empty html have the empty text. Character references are decoded,
    white space inside a block becomes one space, blocks are trimmed and joined
    in page order by one line feed; blocks that are equal all stay. Malformed,
    very deep and very long pages are pages like others, see dom.Page.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred tree nodes

    def run(texts: list[str | None]) -> list[list]:
        found = main_texts(texts, shared.value)
        return [found, [len(t) for t in found]]

    return map_text(pages, ["page_id", "url"], run, "text string, n_chars long", column="html")
