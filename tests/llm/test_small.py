"""Operators of the pipeline against brute force in plain Python, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import json
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trialmill.llm import bpe, cotrain, htmlmain, langid, lm, mixing, quality_rules, simhash, topk, warc
from trialmill.llm.common import sampled_by
from trialmill.llm.dom import Page
from trialmill.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stems="the of river stone bridge under walk light paper green".split()):
    return " ".join(rng.choice(stems) + rng.choice(["", "s", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Prose, junk, copies, edge cases; a null in each column, a repeated row."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(160):
        text = prose(rng, int(rng.integers(12, 60))) + ".\n" + prose(rng, 12)
        rows.append([i, text, "en" if i % 3 else "fr", f"s{i % 2}", len(text)])
    for i in range(160, 172):
        rows.append([i, " ".join(w + "&&&%%%***" for w in prose(rng, 40).split()), "en", "s0", 300])
    rows += [[200, rows[5][1], "en", "s0", 9], [201, rows[5][1] + " tail", "fr", None, 9], [202, None, "en", "s1", None], [203, "", None, "s1", 0], [204, " \n\t ", "en", "s0", 4], [205, "a b", "en", "s0", 3], [206, "x " * 30_000, "en", "s1", 60_000]]
    rows += [[None, "no id at all but some words in it", "en", "s0", 5], rows[3], [207, rows[7][1].upper(), "en", "s0", 5]]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("size_", F.lit(1)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def stats_by_loop(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated)]


def test_quality_rules(docs, empty):
    got = quality_rules.judge(docs).collect()
    assert len(got) == docs.count() and quality_rules.judge(empty).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        want = stats_by_loop(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & set(range(160, 172)) and len(kept & set(range(160))) >= 157
    for text in ("a b c d e a b c d e", "q\nq\n\n \nq", "a a a a a a a", "one two"):
        assert list(quality_rules.text_stats(text)[:5]) == stats_by_loop(text)


def test_mcd_holds_against_outliers():
    rng = np.random.default_rng(5)
    d = len(quality_rules.FEATURES)
    x = rng.permutation(np.vstack([rng.normal(0, 1, (300, d)), rng.normal(9, 0.1, (60, d))]))
    products = lambda r: [1.0, *r, *[r[i] * r[j] for i in range(d) for j in range(i, d)]]
    far = np.linalg.norm(x - np.median(x, axis=0), axis=1)
    mean, cov, logdet = quality_rules._estimate(np.array([products(r) for r in x[np.argsort(far)]]), 270)
    near = x[np.argsort(far)[:270]]
    want = np.cov(near.T, bias=True) + np.diag(np.square(quality_rules.FLOORS))
    assert np.allclose(mean, near.mean(axis=0)) and np.allclose(cov, want) and np.isclose(logdet, np.linalg.slogdet(want)[1])
    assert np.abs(mean).max() < 0.3
    half, _, _ = quality_rules._estimate(np.array([[2.0, *[3.0] * d, *[5.0] * (d * (d + 1) // 2)], [2.0, *[9.0] * d, *[50.0] * (d * (d + 1) // 2)]]), 3)
    assert np.allclose(half, (3 + 4.5) / 3)  # half of the second cell counts


def mcd_by_loop(x, share):
    """C-steps by sorting, from many starts, until nothing changes: the least determinant."""
    rng = np.random.default_rng(0)
    floors, h, best = np.diag(np.square(quality_rules.FLOORS)), share * len(x), None
    for start in range(12):
        some = x if start == 0 else x[rng.choice(len(x), min(len(x), 16), replace=False)]
        mean, cov = some.mean(axis=0), np.cov(some.T, bias=True) + floors
        for _ in range(30):
            far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            order = np.argsort(far)
            w = np.zeros(len(x))
            w[order] = np.clip(h - np.arange(len(x)), 0, 1)
            mean = w @ x / w.sum()
            cov = (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean) + floors
        if best is None or np.linalg.slogdet(cov)[1] < best[2]:
            best = mean, cov, np.linalg.slogdet(cov)[1]
    return best[:2]


def test_small_groups_are_judged_by_their_own_estimate(spark):
    """Verdicts of groups of 8 to 150 rows, against sorting in plain numpy and the same shrinkage."""
    rng = np.random.default_rng(17)
    rows, i = [], 0
    for lang, source, n in (("en", "a", 150), ("en", "b", 12), ("fr", "a", 40), ("fr", None, 8), (None, "a", 25)):
        for k in range(n):
            words = [str(rng.choice("of river stone bridge walk light".split())) + str(rng.choice(["", "s", "ing", "er"])) for _ in range(int(rng.integers(15, 80)))]
            if k % 9 == 0:
                words = [w + str(rng.choice(["", "#", "%%&", "$$$$"])) for w in words]
            rows.append((i, " ".join(words).title() if source == "b" else " ".join(words), lang, source, 1))
            i += 1
    docs = spark.createDataFrame(rows, DOCS)
    stats = quality_rules.statistics(docs).select("doc_id", "lang", "source", *quality_rules.transformed()).toPandas()
    x, d = stats[quality_rules.FEATURES].to_numpy(), len(quality_rules.FEATURES)
    key = lambda v: "-" if v is None or v != v else v
    lang, source = stats.lang.map(key), stats.source.map(key)
    limit = 1.6**2 * quality_rules.chi2_quantile(1 - 1e-4, d) * 0.75 / quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.75, d), d + 2)
    want = {}
    for pair in set(zip(lang, source)):
        masks = [np.ones(len(x), bool), (lang == pair[0]).to_numpy(), ((lang == pair[0]) & (source == pair[1])).to_numpy()]
        now = None
        for m in masks:
            mine = mcd_by_loop(x[m], 0.75)
            now = mine if now is None else quality_rules._shrunk(m.sum(), mine, now, 50)
        gap = x[masks[2]] - now[0]
        want |= dict(zip(stats.doc_id[masks[2]], np.sqrt(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(now[1]), gap)), strict=True))
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    differ = [i for i, r in got.items() if not r.base_failed and r.kept != (want[i] <= math.sqrt(limit))]
    assert len(differ) <= 2 and np.median([abs(got[i].distance / want[i] - 1) for i in got]) < 0.1
    params = quality_rules.mcd(quality_rules.statistics(docs)).collect()
    assert sorted(r.rows for r in params) == [8, 12, 25, 40, 150]


def test_kinds_of_letters_beyond_the_first_plane():
    assert quality_rules.kind_counts("aB1!\U00010400\U00020000\U0001F600") == (2, 2, 1)


PARAGRAPHS = ["The council met on Tuesday to discuss the new bridge, which will open next year.", "Members agreed that the costs, though high, were justified by the traffic &amp; the trade.", "A second meeting will follow in spring, and the public may attend it, too."]
STORY = "".join(f"<p>{p}</p>\n" for p in PARAGRAPHS)
WANT = "\n".join(p.replace("&amp;", "&") for p in PARAGRAPHS)
LAYOUTS = {
    "classes": f'<body><div class="header"><p>Site of the town</p><ul><li><a href=x>Home</a></ul></div><div class="content">{STORY}</div><div class="sidebar"><p>Read also this long story about the other bridge, and more of it.</p></div><div class="footer">Copyright</div>',
    "comments": f'<body><nav><a href=x>Home</a></nav><main><article>{STORY}</article><section class="comments"><h2>Comments</h2><div><p>I think this is great, thank you for the article.</p></div></section></main><form><label>Name</label><p>Send us your message now.</p></form>',
    "notice": f'<body><div id="cookie-banner"><p>We use cookies to improve your experience, please accept.</p></div><script>var a = "<p>no</p>";</script><style>p {{}}</style><article>{STORY}</article><footer>&copy; all</footer>',
    "bare": f"<body>{STORY}</body>",
}


def test_html_text(spark):
    pages = spark.createDataFrame([(i, f"<html><body><nav><ul><li>Home</li><li>News</li></ul></nav><div class='ad'>Buy {i}</div><article><h1>Title {i}</h1>{STORY}</article><footer>end</footer></body></html>") for i in range(40)], "page_id long, html string")
    model = htmlmain.fit(pages, sample_pages=40, layouts=6)
    for name, html in LAYOUTS.items():
        assert htmlmain.main_text(html, model) == WANT, name
    odd = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (2, "u", "<p>", 1), (3, "u", "<article><p>a\n b<p>&eacute;&#33; <b>c</b>d", 1)], "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in htmlmain.extract(odd, model).collect())
    assert got == [(1, "", 0), (2, "", 0), (2, "", 0), (3, "a b\né! cd", 9)]
    none = htmlmain.fit(pages.where("page_id < 0"))
    assert none.trees == [] and htmlmain.main_text(LAYOUTS["comments"], none) == WANT
    assert htmlmain.extract(pages.where("page_id < 0").withColumn("url", F.lit("u")), none).count() == 0


def texts_of(html):
    return [text for _, text, _ in Page(html).runs]


@pytest.mark.parametrize("head", ["<head><title>T</title><meta charset=x>", "<head><title>T<body>", "<head><noscript><link rel=x></noscript><script>a</script>", "<head><noscript><img src=x><body>", "<head><style>p {}</style></head>"])
@pytest.mark.parametrize("body", ["<body><p>one</p><p>two</p></body></html>", "<p>one<p>two", "<div><p>one</p>two</div>"])
def test_an_open_head_takes_no_text(head, body):
    assert texts_of(f"<html>{head}{body}") == ["one", "two"]


@pytest.mark.parametrize("tag", ["button", "select", "iframe", "svg", "template", "textarea"])
def test_an_open_silent_element_takes_no_block(tag):
    assert texts_of(f"<body><p>one</p><{tag}>lost<p>two</p><div>three</div></body>") == ["one", "two", "three"]
    assert texts_of(f"<body><div>one<{tag}>lost</div>two") == ["one", "two"]
    assert texts_of(f"<body><{tag}>lost<p>one</p><{tag}>gone<p>gone</p></{tag}><p>two</p>") == ["one", "two"]
    assert texts_of(f"<body><p>one</p><{tag}>gone<p>gone</p><div>gone</div></{tag}><p>two</p>") == ["one", "two"]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>area <math><mi>x</mi><mo>=</mo><mn>2</mn></math> done", ["area x=2 done"]),
        ("<p>a <noscript>plain <b>text</b></noscript> c</p>", ["a plain text c"]),
        ("<div><noscript>one</noscript><p>two</div>", ["one", "two"]),
        ("<p>see <object data=x>the <i>map</i></object> or <video src=y>the film</video> <audio>the song</audio>.", ["see the map or the film the song."]),
        ("<p>a<![foo[bar]]>b<![if IE]>c<![endif]>d<![CDATA[x > y]]>e", ["abcde"]),
        ("<p>a<!-- open <p>lost", ["a"]),
        ("<p>a<!>b<!x>c<?php echo ?>d</>e", ["abcde"]),
        ("<p>a < b &lt; c & d &copy e", ["a < b < c & d © e"]),
        ("<p>a<b class='x", ["a"]),
        ("</div></p></nothing>a</b>", ["a"]),
        ("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e<dt>f</dl><ul><li>g<ul><li>h</ul><li>i</ul>", list("abcdefghi")),
    ],
)
def test_odd_markup(html, want):
    assert texts_of(html) == want


@pytest.mark.parametrize(
    "html",
    ["<b>" * 60_000 + "<p>x" * 60_000, "<div>" * 60_000 + "</section>" * 60_000 + "x", "<svg>" * 100_000 + "x", "<li>x" * 100_000, "<a" * 200_000, "<!--" * 100_000, "<p x='" * 60_000, "<math>" * 80_000 + "x", "<ul><li>x" * 40_000],
    ids=["inline", "stray", "svg", "flat", "tags", "comments", "quotes", "math", "deep"],
)
def test_time_is_linear_in_the_page(html):
    start = time.process_time()
    page = Page(html)
    features = htmlmain.features(page)
    htmlmain.decode(page, np.ones(len(page.nodes)))
    assert time.process_time() - start < 15 and len(features) == len(page.nodes)


def test_decoding_contradicts_no_ancestor():
    """The runs kept are those of the likeliest labelling, found by trying all of them."""

    def ways(page, odds, i):
        """(log-probability, runs kept) of every choice for the subtree of node i."""
        yes, no = -math.log1p(math.exp(-odds[i])), -math.log1p(math.exp(odds[i]))
        node = page.nodes[i]
        below = [c for c in node.children if has_text(page, c)]

        def whole(k, kept):
            total, runs = (-math.log1p(math.exp(-odds[k] if kept else odds[k]))), list(page.nodes[k].runs)
            for c in page.nodes[k].children:
                if has_text(page, c):
                    t, r = whole(c, kept)
                    total, runs = total + t, runs + r
            return total, runs if kept else []

        out = [whole(i, True), whole(i, False)]
        if node.children:
            for own in ((yes, node.runs), (no, [])) if node.runs else ((0.0, []),):
                combos = [(own[0] - 1.0, list(own[1]))]
                for c in below:
                    combos = [(a + p, r + q) for a, r in combos for p, q in ways(page, odds, c)]
                out += combos
        return out

    def has_text(page, i):
        return bool(page.nodes[i].runs) or any(has_text(page, c) for c in page.nodes[i].children)

    for html in ("<body><div><p>one</p><p>two</p></div><div>three<p>four</p></div></body>", "<main>a<section>b<p>c</p></section><nav></nav></main>", "x<div><div>y</div></div>z"):
        page = Page(html)
        for seed in range(40):
            odds = np.random.default_rng(seed).normal(0, 2, len(page.nodes))
            best = max(ways(page, odds, 0), key=lambda w: w[0])
            assert htmlmain.decode(page, odds) == [page.runs[r][1] for r in sorted(best[1])]
    assert htmlmain.decode(page, np.full(len(page.nodes), 5.0)) == ["x", "y", "z"]
    assert htmlmain.decode(page, np.full(len(page.nodes), -5.0)) == []


def test_labels_come_from_elements_alone():
    page = Page("<body><nav>a</nav><main><p>b</p><div class='comments'>c</div></main><div class='footer'>d</div></body>")
    given = htmlmain.labels_of(page)
    assert {page.runs[r][1]: int(given[i]) for i, n in enumerate(page.nodes) for r in n.runs} == {"a": 0, "b": 1, "c": -1, "d": -1}


@pytest.mark.parametrize("wide", [False, True])
def test_top_k(spark, wide):
    rng = np.random.default_rng(3)
    rows = [(i, ((1e5 if wide else 1) * rng.normal(size=8)).tolist(), "extra") for i in range(400)]
    rows += [(400, [1.0] * 8, "x"), (401, [1.0] * 8, "tie"), (450, [1.0] * 8, "tie"), (500, None, "x"), (501, [float("nan")] + [0.0] * 7, "x"), (502, [None] + [0.0] * 7, "x"), (550, [float("inf")] * 8, "x"), (600, [1.0, 2.0], "short"), (601, [3.0, 4.0], "short"), (650, [], "none"), (651, [], "none")]
    rows += [(401, [9.0] * 8, "again"), (401, [9.0] * 8, "again"), (7, [-9.0] * 8, "again")]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, block_rows=90, query_rows=4)
    v = [(i, [math.floor(256 * x) for x in e]) for i, e, _ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, x in v:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in v if c != q and len(y) == len(x))[:5]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(vectors.where("vec_id < 0"), vectors.where("vec_id < 0")).count() == 0


def test_equal_vectors_that_cannot_rank_are_left_out():
    v = np.array([[1, 2]] * 6 + [[3, 4]] * 2 + [[1, 2]] * 2)
    ids = np.array([9, 5, 5, 5, 7, 8, 1, 1, 2, 5])
    assert sorted(topk.distinct_enough(ids, v, 2).tolist()) == [1, 2, 4, 6, 7, 8]
    assert sorted(topk.distinct_enough(ids, v[:, :0], 1).tolist()) == [6, 8]


def test_a_hot_vector(spark):
    """A third of all rows, and queries among them, hold one vector: few candidates, the same ranks."""
    rng = np.random.default_rng(6)
    rows = [(i, [3.0, -2.0, 1.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(900)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got, read = topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, block_rows=300)
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    want = []
    for q in range(0, 900, 50):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and read.count() < 18 * 60


def test_few_exact_vectors_are_read(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    _, read = topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, block_rows=500)
    assert 60 * 5 <= read.count() < 60 * 60  # of 60 queries by 3000 rows


def fingerprint_by_loop(text, n=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    rows = [(r.doc_id, fingerprint_by_loop(r.text)) for r in docs.collect()]
    assert set(got) == {(i, f"{f:016x}") for i, f in rows}
    for i, f in rows:
        reach, todo = set(), {f}
        while todo:
            x = todo.pop()
            reach.add(x)
            todo |= {g for _, g in rows if g not in reach and (x ^ g).bit_count() <= 4}
        assert got[i, f"{f:016x}"] == min(j for j, g in rows if g in reach and j is not None) if any(g in reach and j is not None for j, g in rows) else True
    assert got[200, f"{fingerprint_by_loop(docs.where('doc_id = 5').first().text):016x}"] == 5
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 200 not in ids and ids.count(3) == 1 and None in ids


def test_deduplicate_keeps_unlike_texts_of_one_id(spark):
    a, b = "one two three four five six seven", "a wholly unlike text about other things than those"
    rows = [(1, a, "p", "x"), (1, b, "q", "x"), (1, b, "q", "x"), (2, a, "r", "x"), (3, b, "s", "x"), (None, a, "t", "x"), (None, None, "u", "x"), (4, None, "v", None), (5, "", "w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _th string, fp string")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], rows[1], rows[5], rows[6], rows[7]]))


def test_an_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=3)
    assert simhash.bits_for(1) == 12 and simhash.bits_for(10**9) > 20
    fps = np.array([0, 0b1111, 0b11111, 0b11111 << 30], "u8")
    assert {tuple(map(int, x)) for x in simhash.meet(np.zeros(4, np.int64), fps, 12, 2)} == {(0, 0b1111), (0, 0b11111)}


def test_ball_hashing_finds_every_link(spark):
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, 60).tolist()
    for f in fps[:30]:
        for d in range(1, 8):
            fps.append(f ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    signed = np.array(fps, "u8").view("i8").tolist()
    table = spark.createDataFrame([(x,) for x in set(signed)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(table, key_bits=6)).collect()}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if (fps[i] ^ fps[signed.index(b)]).bit_count() <= 4:
                assert roots.get(a, a) == roots.get(b, b)
    seen = {}
    for x in set(signed):
        seen.setdefault(roots.get(x, x), []).append(x)
    for group in seen.values():  # every member of a class is within the radius of another
        for x in group:
            assert len(group) == 1 or any((x ^ y) & (2**64 - 1) and ((x ^ y) & (2**64 - 1)).bit_count() <= 4 for y in group)


def test_lm_scores(spark, docs, empty):
    got = {(r.doc_id, r.n_tokens): r for r in lm.score(docs, block_tokens=500, range_tokens=300).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r.doc_id, [*WORD.findall((r.text or "").translate(low)), " "]) for r in docs.collect()]
    rest = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    c = Counter(t for i, ts in rows if rest(i) != 1 for t in ts)
    n, v = sum(c.values()), len(c)
    assert len(rows) == lm.score(docs).count() and lm.score(empty).count() == 0
    for i, ts in rows:
        r = got[i, len(ts)]
        assert r.held_out == (rest(i) == 1) and r.train_tokens == n and r.n_known == sum(c[t] > 0 for t in ts)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    whole = {(r.doc_id, r.n_tokens): r.score for r in lm.score(docs.repartition(3)).collect()}
    assert all(math.isclose(whole[k], r.score, rel_tol=1e-6) for k, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_scores_are_those_of_a_loop(spark):
    """The model with dictionaries of strings: counts, buckets, expectation-maximisation to the end."""
    rng = np.random.default_rng(23)
    rows = [(i, prose(rng, int(rng.integers(3, 40))) if i % 7 else "the river walks under the bridge", "en", "s", 1) for i in range(300)] + [(1000, None, "en", "s", 0)]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {i: [*WORD.findall((t or "").translate(low)), None] for i, t, *_ in rows}
    rest = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    grams = lambda ts: [(None if k == 0 else (["^", *ts][k - 1], ts[k - 1]), ["^", *ts][k], w) for k, w in enumerate(ts)]

    def counts(ids):
        c = Counter()
        for i in ids:
            c["^",] += 1
            for two, a, b in grams(texts[i]):
                c.update([(b,), (a, b), *([(*two, b)] if two else [])])
        return c, sum(n for g, n in c.items() if len(g) == 1 and g != ("^",))

    def estimates(c, n, two, a, b):
        return (c[a, b] / max(c[a,], 1), c[b,] / n, 1 / (v + 1)), c[(*two, b)] / max(c[two], 1) if two else 0.0

    def learned(cells, start):
        out = {}
        for k, p in cells.items():
            p, w = np.array(p), np.array([0.0, *start[1:]]) if k == 0 else np.array(start)
            for _ in range(3000):
                part = p * w
                w = lm.mixed((part / part.sum(axis=1, keepdims=True)).sum(axis=0), len(p), k)
            out[k] = w
        return lambda k: out[max(j for j in out if j <= k)]

    v = len({w for i in texts if rest[i] != 1 for w in texts[i]})
    bucket = lambda c: 0 if c == 0 else int(math.log2(c)) + 1
    c, n = counts([i for i in texts if rest[i] > 1])
    left_out = [g for i in texts if rest[i] == 0 for g in grams(texts[i])]
    cells, more = {}, {}
    for two, a, b in left_out:
        cells.setdefault(bucket(c[a,]), []).append(estimates(c, n, two, a, b)[0])
    mix = learned(cells, [0.4, 0.4, 0.2])
    for two, a, b in left_out:
        if two:
            low3, high = estimates(c, n, two, a, b)
            more.setdefault(bucket(c[two]), []).append((high, float(np.dot(mix(bucket(c[a,])), low3))))
    lift = learned(more, [0.5, 1.0])
    c, n = counts([i for i in texts if rest[i] != 1])
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, DOCS), block_tokens=400, range_tokens=300, close=2e-4).collect()}
    for i, ts in texts.items():
        want = 0.0
        for two, a, b in grams(ts):
            low3, high = estimates(c, n, two, a, b)
            p = float(np.dot(mix(bucket(c[a,])), low3))
            w = lift(bucket(c[two]))[0] if two else 0.0
            want += math.log10(w * high + (1 - w) * p)
        assert math.isclose(got[i], want, rel_tol=1e-2), i


def test_lm_is_a_distribution():
    """Over the known words and one more, probabilities after a context add up to one."""
    mix = lm.weights(__import__("pandas").DataFrame({"bucket": [0, 1, 2], "two": [-999, 8, 9], "one": [4, 4, -999], "n": [5, 6, 7]}))
    assert np.allclose(mix.sum(axis=1), 1) and mix[0, 0] < 1e-9
    counts = {"a": 3, "b": 2, "c": 1}
    after = {"a": 1, "b": 2}
    n, v = sum(counts.values()), len(counts)
    w = mix[2]
    assert math.isclose(sum(w[0] * after.get(x, 0) / 3 + w[1] * counts.get(x, 0) / n + w[2] / (v + 1) for x in "abc?"), 1)


WORDS_OF = {"en": "the and thing over river with light", "de": "und der schön über fluss mit licht", "fr": "les et chose sur rivière avec été", "es": "los y cosa sobre río con señal"}


def test_language_id(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(WORDS_OF[c].split(), 12)), c, "x", 1) for i, c in enumerate(list(WORDS_OF) * 60)]
    rows += [(900, None, "en", "x", 1), (901, "123 456 !! ² ½ ① Ⅷ", "en", "x", 1), (902, "", None, None, None), (903, "und der fluss über licht", None, "x", 1), (None, "les et chose sur", "fr", "x", 1)]
    table = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = langid.predict_held_out(table).collect()
    assert len(got) == len(rows)
    truth = {i: c for i, _, c, _, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and by[900].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    nothing = langid.predict_held_out(table.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and langid.predict_held_out(table.where("false")).count() == 0


def test_language_id_learns_rare_languages(spark):
    rng = np.random.default_rng(19)
    many = [(i, " ".join(rng.choice(WORDS_OF[c].split(), 12)), c, "x", 1) for i, c in enumerate(["en", "de", "fr"] * 1500)]
    many += [(5000 + i, " ".join(rng.choice(WORDS_OF["es"].split(), 12)), "es", "x", 1) for i in range(4)]
    many += [(6000 + i, "1 2 3", "es", "x", 1) for i in range(2000)]  # without a letter: they take no part of the sample
    table = spark.createDataFrame(many, DOCS)
    model = langid.fit(table, sample_rows=60)
    assert sorted(c for codes in model.families.values() for c in codes) == ["de", "en", "es", "fr"]
    told = {r.doc_id: r.lang_pred for r in langid.identify(table.where("doc_id < 6000"), model, ["doc_id"]).collect()}
    for code in WORDS_OF:
        mine = [told[i] == c for i, _, c, _, _ in many if i < 6000 and c == code]
        assert sum(mine) / len(mine) > 0.95, code


def test_any_number_of_languages_is_learned(spark):
    """1200 languages of a few rows each, two families of several among them."""
    rng = np.random.default_rng(21)
    codes = [*"de nl fr es".split(), *[f"x{i}" for i in range(1196)]]
    stems = {c: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(3)] for c in codes}
    rows = [(n, " ".join(rng.choice(stems[c], 8)), c) for n, c in enumerate(c for c in codes for _ in range(3))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table, dims=256, sample_rows=2000)
    assert sum(map(len, model.families.values())) == 1200 and model.families["germanic"] == ["de", "nl"] and ("de", "nl") in model.pair_weights
    some = rows[::40]
    assert np.mean([model.predict([t])[0][0] == c for _, t, c in some]) > 0.8
    few = sampled_by(table, "doc_id", "lang", 1000, 100, 1500).groupBy("lang").count().collect()
    assert len(few) == 1200 and {r["count"] for r in few} == {1}


def test_paths_of_archives(spark, tmp_path):
    assert warc.opened("/a/b")[1] == warc.opened("file:/a/b")[1] == warc.opened("file:///a/b")[1] == "/a/b"
    assert warc.qualified(spark, "/a/b") == "file:/a/b" and warc.qualified(spark, "s3://x/y") == "s3://x/y"
    with pytest.raises(ValueError, match="dbfs"):
        warc.opened("dbfs:/a/b")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.default.link./shared", f"file://{tmp_path}")
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs:///")
        assert warc.qualified(spark, "/shared/x").startswith("viewfs:/")
    finally:
        conf.set("fs.defaultFS", before)


def test_mixing(spark, empty):
    rng = np.random.default_rng(10)
    rows = [(i, prose(rng, int(rng.integers(1, 30))), "en", f"s{i % 5}" if i % 3 else "s0", 1) for i in range(1500)]
    rows += [(2000, None, "en", "nothing", 1), (2001, "a b c", "en", None, 1), (None, "a b", "en", "s1", 1), rows[3], rows[3]]
    table = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash")).withColumn("copies", F.lit(9))
    got = mixing.mix(table)
    out = got.collect()
    assert len(out) == len(rows) and mixing.mix(empty).count() == 0
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, budget = {}, set(order), 1.5 * sum(size.values())
    while True:  # share by weight, stop who has enough, share the rest anew
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= over
    target |= {s: level * weight[s] for s in left}
    taken = Counter()
    for r in out:
        assert r.size == len(WORD.findall(r.text or "")) and math.isclose(r.target, target[r.source], abs_tol=1e-6) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.source or "", r.copies) for r in out) == sorted((str(r.doc_id), r.source or "", r.copies) for r in again)
    odd = table.withColumns({"_size": F.lit("a"), "_key": F.lit("b"), "_n": F.lit("c"), "_copy": F.lit("d"), "size": F.lit(-1)})
    emitted = mixing.mixed_rows(odd)
    assert emitted.columns == odd.columns and emitted.count() == sum(r.copies for r in out)
    assert [tuple(r) for r in emitted.select("target", "copies", "_size", "_key", "_n", "_copy", "size").distinct().collect()] == [("clash", 9, "a", "b", "c", "d", -1)]
    times, want = Counter(), Counter()
    for r in emitted.collect():
        times[r.doc_id, r.source, len(WORD.findall(r.text or ""))] += 1
    for r in out:
        want[r.doc_id, r.source, r.size] += r.copies
    assert times == +want


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(spark, docs, empty):
    t = library()
    odd = ["Don't STOP  it's é é ﬁ ß İ  x y", "<|endoftext|>a<|startoftext|> b", "日本語テキスト 😀😀 a1b22", "\x1c\x1f z ​", "x" * 9000 + " tail", "ab" * 5000 + "!?" * 4000 + "é" * 3000, "a" * 7000 + "<|endoftext|>" + "q" * 100]
    rng = np.random.default_rng(12)
    odd += ["".join(rng.choice(list("abcdethrowins"), 6000)) for _ in range(3)]
    rows = [(5000 + i, x) for i, x in enumerate(odd)] + [(90, None), (91, ""), (91, ""), (None, "some words")] + [(r.doc_id, r.text) for r in docs.collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    digest = Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        digest[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(table, tokenizer_path()).collect())) == digest
    first = {r.doc_id: r for r in bpe.encode(table, tokenizer_path()).collect()}
    assert list(first[5000].ids) == t.encode(odd[0], add_special_tokens=False).ids
    assert bpe.digests(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("leaf", [3, 17, 64])
def test_tree_concatenation(leaf):
    t, tree = library(), bpe.Bpe(tokenizer_path(), leaf)
    rng = np.random.default_rng(leaf)
    for alphabet in ("ab", "theringsou", "é日ß"):
        for n in (1, leaf, leaf + 1, 500, 1201):
            word = "".join(rng.choice(list(alphabet), n))
            assert tree.long_piece(word) == t.encode(word, add_special_tokens=False).ids


def test_every_text_is_joined_from_halves(docs):
    texts = [r.text for r in docs.collect() if r.text and len(r.text) > 1]
    t, tree = library(), bpe.Bpe(tokenizer_path())
    assert tree.grown(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert tree.joins >= len(texts)
    before = tree.joins
    long = "word and another " * 40_000 + "x" * 30_000 + " end"
    assert tree.grown([long])[0] == t.encode(long, add_special_tokens=False).ids
    assert tree.joins - before > len(long) / bpe.LEAF / 2


def test_cuts_may_fall_anywhere():
    """Contractions, special tokens, marks that join the letter before, and white space of all kinds, under every cut."""
    t, tree = library(), bpe.Bpe(tokenizer_path())
    rng = np.random.default_rng(31)
    symbols = ["a", "b", "th", "ing", "'s", "'", "'ll", "1", "2", " ", "  ", "\n", "\t", "é", "e\u0301", "\u0301", "\u0316\u0300", "日", "😀", "!", "<|endoftext|>", "Σ", "İ", "ß", "\x1c", "\u200b", "가", "\u1100", "\u1161", "\u11a8", "DON", "x" * 9]
    for _ in range(200):
        tree.leaf = int(rng.choice([1, 2, 3, 9, 17, 40]))
        some = rng.choice(symbols, int(rng.integers(2, 12)), replace=False)
        texts = ["".join(rng.choice(some, int(rng.integers(1, 60)))) for _ in range(6)]
        assert tree.grown(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


class Counted:
    """A tokenizer, and the characters that it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.given += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_the_library_gets_words_once(docs):
    texts = [r.text for r in docs.collect() if r.text] * 5
    t, tree = library(), bpe.Bpe(tokenizer_path())
    counted = [x for x in ("whole", "words") if hasattr(tree, x)]
    for x in counted:
        setattr(tree, x, Counted(getattr(tree, x)))
    assert tree.grown(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(getattr(tree, x).given for x in counted) < sum(map(len, texts)) / 4
    before = tree.whole.given
    assert tree.grown(["Yes, "])[0] == t.encode("Yes, ", add_special_tokens=False).ids and tree.whole.given == before


@pytest.mark.parametrize("rules", ["as they are", "cased", "no special tokens"])
def test_remembered_words(monkeypatch, tmp_path, rules):
    """Letters and marks of all kinds, pieces that hold the mark or parts of it, and a memo that is full all the time."""
    from tokenizers import Tokenizer

    path = tokenizer_path()
    if rules != "as they are":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if rules == "cased":
            spec["normalizer"]["normalizers"].pop()
        else:
            spec["added_tokens"] = []
        path = str(tmp_path / "tokenizer.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec, f)
    t = Tokenizer.from_file(path)
    tree, rng = bpe.Bpe(path), np.random.default_rng(8)
    assert tree.ruled == (rules != "cased") and bool(tree.mark) == (rules != "no special tokens")
    chars = [chr(c) for c in range(33, 384)] + list("œŒſΣσςİıﬁ日가\u0301\u1161\u00ad\u0085\u00a0\u2028\r\t\f")
    texts = [c for c in chars] + [f"{a}{c}{b} {c}{c}, {c}." for c in chars for a, b in (("a", ""), ("", "Z!?"), ("É", "ß"))]
    pieces = ["<", "<|", "<|endoftext|", "|>", "endoftext|>", "<|endoftext|>", "<|startoftext|>", "</w>", "a</w>", "Don't", "it's,", "A" * 48, "b" * 49, "Éa" * 40 + ".", "." * 9, "!?" * 50, "x" * 3000, ""]
    for memo in (1, 40, 1 << 17):
        monkeypatch.setattr(bpe, "MEMO", memo)
        monkeypatch.setattr(bpe, "CALL", int(rng.integers(1, 70)))
        for _ in range(6):
            some = texts + [" ".join(rng.choice(pieces + chars, int(rng.integers(1, 30)))) for _ in range(60)]
            some = [some[i] for i in rng.permutation(len(some))]
            for i in range(0, len(some), 199):
                assert tree.grown(some[i : i + 199]) == [t.encode(x, add_special_tokens=False).ids for x in some[i : i + 199]]
        assert all(len(p) <= bpe.KEPT for p in tree.memo)


def test_cotraining(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i < 160)) for i in [*range(0, 160, 2), *range(160, 172)]] + [(0, None), (1000, 1)], "doc_id long, quality int")
    model = cotrain.fit(docs, labels)
    got = cotrain.score(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(1, 160, 2)) and not any(by[i].kept for i in range(160, 172))
    assert all(0 <= r.quality_score <= 1 for r in got)
    assert cotrain.score(empty, model).count() == 0
    blank = cotrain.fit(docs, labels.where("false"))
    assert {round(r.quality_score, 6) for r in cotrain.score(docs, blank).collect()} == {0.5}
    one_sided = cotrain.fit(docs, labels.where("quality = 1"))
    assert all(r.kept for r in cotrain.score(docs, one_sided).collect())
    assert cotrain.score(empty, cotrain.fit(empty, labels)).count() == 0


def test_views_label_for_each_other_in_every_round(spark):
    """Two informative views: both hand rows over in each round, never one twice, and accuracy on unseen labels doesn't fall."""
    rng = np.random.default_rng(13)
    rows, labels = [], []
    for i in range(1200):
        good = rng.random() < 0.8
        text = prose(rng, int(rng.integers(5, 30)))
        if not good:
            text = " ".join(w if rng.random() < 0.7 else w + "&&%" for w in text.split())
        rows.append((i, text, "en", ("news" if rng.random() < 0.8 else "dump") if good else ("dump" if rng.random() < 0.8 else "news"), int(rng.integers(1, 500))))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, DOCS).withColumn("text_odds", F.lit("clash"))
    some = spark.createDataFrame(labels[:160], "doc_id long, quality int")
    right = []
    for rounds in (0, 3):
        model = cotrain.fit(docs, some, rounds=rounds, per_round=60)
        said = {r.doc_id: r.quality_score > 0.5 for r in cotrain.score(docs, model).collect()}
        right.append(sum(said[i] == bool(y) for i, y in labels[160:]))
    assert right[1] >= right[0] and right[1] > 0.9 * len(labels[160:])
    for r in range(3):
        for view in ("text", "meta"):
            assert sum(n for at, v, _, n, w in model.handed if (at, v) == (r, view) and w > 0) >= 30


def test_the_surest_rows_are_those_of_a_sort(spark, docs):
    kinds = (("source", False), ("n_chars", True))
    rng = np.random.default_rng(2)
    pool = cotrain.viewed(docs, kinds).cache()
    rows = pool.toPandas().drop_duplicates("_t")
    x = cotrain.arrays(rows, kinds)
    model = cotrain.Model(kinds, [rng.normal(size=a.shape[1] + 1) for a in x], [(1.0, 0.0)] * 2, 0.0)
    given = [set(rows._t[:40]), set()]
    got = cotrain.surest(pool, model, given, (7, 11))
    for v in (0, 1):
        free = rows.assign(odds=model.odds(v, x[v]))
        free = free[~free._t.isin(given[v])]
        for label, n in ((0, 7), (1, 11)):
            want = free.iloc[np.lexsort((free._t, -free.odds if label else free.odds))[:n]]
            assert set(got[(got["view"] == v) & (got["label"] == label)]._t) == set(want._t)


def test_metadata_may_be_missing(spark, docs):
    labels = spark.createDataFrame([(i, int(i < 160)) for i in [*range(0, 160, 2), *range(160, 172)]], "doc_id long, quality int")
    bare = docs.drop("n_chars", "source")
    scores = cotrain.score(bare, cotrain.fit(bare, labels))
    assert scores.count() == docs.count() and scores.where("quality_score IS NULL").count() == 0
    assert cotrain.score(bare, cotrain.fit(docs, labels)).where("quality_score IS NULL").count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc(spark, tmp_path, compression):
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (5, "u", None), (6, "u\r\nX: y", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", big), (3, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = str(tmp_path / compression)
    warc.archive(warc.page_records(pages), path, compression)
    back = warc.read(spark, path)
    got = back.collect()
    assert len(got) == len(rows)
    ids = lambda df: sorted((str(r[0]), r[1], str(r[2])) for r in df.select(warc.page_id_of("record_id"), "record_type", warc.page_id_of("refers_to")).collect())
    kinds = ids(back)
    assert kinds.count(("1", "revisit", "3")) == 1 and kinds.count(("3", "response", "None")) == 2 and kinds.count(("None", "response", "None")) == 1
    assert len({r.record_id for r in got}) == len(rows) - 1  # one page_id is there twice
    for r in got:
        page = r.record_id[len("<urn:page:") : -1] if r.record_id.startswith("<urn:page:") else ""
        html = next(h for i, _, h in rows if str("" if i is None else i) == page) or ""
        assert (r.http_head or "").startswith("HTTP/1.1 200 OK\r\n") == (r.record_type == "response")
        assert r.payload_digest == "sha1:" + hashlib.sha1(html.encode()).hexdigest() and r.payload_length == len(html.encode())
        assert bytes(r.payload) == (b"" if r.record_type == "revisit" else html.encode())
    few = warc.read(spark, path, payload=False).where("record_type = 'revisit' AND target_uri IN ('http://a/', 'none')")
    assert [r.payload for r in few.collect()] == [None] and ids(few) == [("1", "revisit", "3")]
    told = warc.resolved(back).collect()
    assert sorted((r.record_type, r.payload_bytes, r.payload_digest) for r in told) == sorted((r.record_type, r.payload_length, r.payload_digest[5:]) for r in got)
    assert warc.page_records(pages.where("false")).count() == 0
    warc.archive(warc.page_records(pages.where("false")), str(tmp_path / "none"))


def test_digests_are_of_the_payloads_read(spark, tmp_path):
    """A writer that spoils a payload is found out, also where a revisit refers to it."""
    pages = spark.createDataFrame([(i, "u", "x" * 2000) for i in range(3)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.archive(warc.page_records(pages), path)
    assert {r.payload_digest for r in warc.resolved(warc.read(spark, path)).collect()} == {hashlib.sha1(b"x" * 2000).hexdigest()}
    for file in (tmp_path / "w").glob("*.warc"):
        file.write_bytes(file.read_bytes().replace(b"x" * 2000, b"x" * 1999 + b"y"))
    spoilt = warc.resolved(warc.read(spark, path)).collect()
    assert {r.payload_digest for r in spoilt} == {hashlib.sha1(b"x" * 1999 + b"y").hexdigest()} and len(spoilt) == 3
    lone = warc.resolved(warc.read(spark, path).where("record_type = 'revisit'")).collect()
    assert [r.payload_digest for r in lone] == [None, None]


@pytest.mark.parametrize("payload", [True, False])
def test_malformed_records(payload):
    import io

    good = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n b\r\nContent-length: 3\r\n\r\nabc\r\n\r\n"
    read = lambda data: list(warc.parse(io.BytesIO(data), {}, payload))
    assert [(r["target_uri"], r["content_length"]) for r in read(good * 2)] == [("http://a/ b", 3)] * 2
    for bad in (b"junk\r\n", good[:-6], b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"WARC/1.0\r\nContent-Length: -1\r\n\r\n", b"WARC/1.0\r\nContent-Length: x\r\n\r\n", b"WARC/1.0\r\nContent-Le"):
        with pytest.raises(ValueError):
            read(good + bad)
    assert read(b"") == [] and read(b"\r\n\r\n") == []


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_files_cut_short(spark, tmp_path, name):
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5000\r\n\r\n" + b"z" * 5000 + b"\r\n\r\n"
    data = gzip.compress(record) + gzip.compress(record)[:40] if name.endswith("gz") else record + record[:100]
    (tmp_path / name).write_bytes(data)
    assert warc.read(spark, str(tmp_path), on_error="stop").count() == 1
    with pytest.raises(Exception, match="cut short|end-of-stream|end of stream"):
        warc.read(spark, str(tmp_path)).select("payload").collect()


def test_warc_filters_are_taken():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull
    from pyspark.sql.types import StructField, StructType, StringType

    reader = warc.WarcReader(StructType([StructField("record_type", StringType())]), {"path": "/x"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), IsNotNull(("refers_to",)), GreaterThan(("content_length",), 5)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"revisit"}, "refers_to": None}
