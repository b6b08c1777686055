"""Block nodes of an HTML page, their text runs and their features."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np

# Elements by their part in HTML.
INLINE = set("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark math nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't the page's: not shown, or part of a form or of a drawing. What math, noscript, object, audio, video and canvas hold stays.
SILENT = set("button datalist head iframe script select style svg template textarea title".split())
#: Silent elements that can hold their own kind; the start of another one ends any other.
NESTS = {"svg", "template"}
#: What an open head can hold; any other start ends it.
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: The start of one of these ends a silent element that the page never closes.
BLOCKS = CLOSES_P - {"hr"} | set("body caption dd dt li tbody td tfoot th thead tr".split())
#: The start of the key closes open elements of these kinds, down to the nearest wall.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "tbody": ("tr", "td", "th"), "tfoot": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
WALLS = set("ul ol dl table menu div section article body".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXTUAL = {"p", "pre", "blockquote", "td", "dd", "figcaption"} | HEADINGS
MAIN = {"article", "main"}
ASIDE = set("nav aside footer header form menu dialog noscript".split())
#: Of those, what holds none of an article: a header may have the headline, and a form the whole page.
PARTS = ASIDE - {"header", "form"}
# Words in class, id and role that tell of a node's part.
GOOD_WORDS = set("article articlebody body content entry main maincontent news page paragraph post prose story text".split())
BAD_WORDS = set(
    "ad ads adv advert advertisement alert aside banner bar bottom breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright dialog disclaimer discussion disqus feedback foot footer form gdpr head header "
    "hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination popup privacy promo promoted promotion recommended related replies reply respond reviews rail search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription tags teaser toolbar top topbar widget widgets".split()
)
#: Of those, the ones that hardly ever stand on an article's containers.
PART_WORDS = set("ads adv advert advertisement breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu nav navbar navigation newsletter pagination popup recommended replies reply respond reviews sidebar signup sponsored subscribe subscription".split())
TOKENS = re.compile(r"[a-z]+")
MARKS = re.compile(r"[.,;:!?]")

FEATURES = (
    "depth log_chars log_own_chars link_share density marks_per_word words_per_run page_share starts_at ends_at children siblings place same_tag before after parent_density "
    "textual heading list_item main_tag aside_tag nearest_part aside_above bad_words good_words bad_above good_above digits links main_above header_above form_above part_above part_words_above"
).split()


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: set[str]
    given: str | None = None  # a label in data-part, in pages made for training; no feature
    place: int = 0  # among its siblings
    children: list[int] = field(default_factory=list)
    runs: list[int] = field(default_factory=list)
    links: int = 0


class Page(HTMLParser):
    """nodes: block elements in page order; runs: (node, text) of the inline text between block borders.

    Any text is a page: an unclosed comment or tag takes the rest, a declaration
    ends at the next `>`, an end tag without its start does nothing. Time is
    linear in the text, whatever is left open: where an open element of a kind
    stands is looked up, not searched for.

    A silent element without an end would take the rest of the page: which ones
    have none is known at the end only, and such a page is read a second time.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.endless: set[int] = set()  # silent elements, by place among all of them, that the page never closes
        self.last_end = html.rfind(">")
        self.read(html)
        if self.endless:
            self.read(html)

    def read(self, html: str) -> None:
        self.reset()
        self.nodes = [Node("#page", -1, 0, set())]
        self.runs: list[tuple[int, str, int]] = []
        self.open: list[tuple[str, int, bool]] = [("#page", 0, False)]  # tag, node, inline
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # places in open, of each tag
        self.blocks = [0]  # places in open of what isn't inline
        self.silent: list[tuple[str, int]] = []
        self.silent_at: defaultdict[str, list[int]] = defaultdict(list)
        self.n_silent = 0
        self.text: list[str] = []
        self.linked = 0
        self.feed(html)
        self.close()
        self.flush()
        self.unsilence(0)

    # What the parser leaves open at the end of the text, or doesn't know.

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = self.rawdata.find("-->", i + 2)
        return len(self.rawdata) if end < 0 else end + 3

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        mark = "]]>" if self.rawdata[i + 3 : i + 9].lower() == "cdata[" and self.rawdata.find("]]>", i) >= 0 else ">"
        end = self.rawdata.find(mark, i)
        return len(self.rawdata) if end < 0 else end + len(mark)

    def parse_starttag(self, i: int) -> int:
        return len(self.rawdata) if i > self.last_end else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        return len(self.rawdata) if i > self.last_end else super().parse_endtag(i)

    @property
    def here(self) -> int:
        return self.open[-1][1]

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.nodes[self.here].runs.append(len(self.runs))
            self.runs.append((self.here, text, min(self.linked, len(text))))
        self.text, self.linked = [], 0

    def push(self, tag: str, node: int, inline: bool) -> None:
        self.at[tag].append(len(self.open))
        if not inline:
            self.blocks.append(len(self.open))
        self.open.append((tag, node, inline))

    def pop_to(self, at: int) -> None:
        if self.blocks[-1] >= at:
            self.flush()
        while len(self.open) > at:
            tag, _, inline = self.open.pop()
            self.at[tag].pop()
            if not inline:
                self.blocks.pop()

    def hush(self, tag: str) -> None:
        self.silent_at[tag].append(len(self.silent))
        self.silent.append((tag, self.n_silent))
        self.n_silent += 1

    def speak(self, at: int) -> None:
        """Silent elements from `at` on end."""
        while len(self.silent) > at:
            self.silent_at[self.silent.pop()[0]].pop()

    def unsilence(self, at: int) -> None:
        """Silent elements from `at` on end, without an end tag of their own."""
        self.endless.update(k for tag, k in self.silent[at:] if tag != "head")
        self.speak(at)

    def end_endless(self) -> None:
        while self.silent and self.silent[-1][1] in self.endless:
            self.speak(len(self.silent) - 1)

    def is_inline(self, tag: str) -> bool:
        if tag == "noscript":  # as inline as what is around it
            return self.open[-1][2] or self.open[self.blocks[-1]][0] in TEXTUAL or any(map(str.strip, self.text))
        return tag in INLINE or bool(self.at["math"])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_endless()
        if self.silent_at[tag] and tag not in NESTS:
            self.unsilence(self.silent_at[tag][0])
        if self.silent and self.silent[-1][0] == "head" and tag not in IN_HEAD:
            self.speak(len(self.silent) - 1)
        if self.silent:
            if tag in SILENT:
                self.hush(tag)
            return
        if tag in SILENT:
            self.hush(tag)
            if tag not in {"script", "style"}:
                self.text.append(" ")
            return
        if tag == "br":
            self.text.append(" ")
        if self.is_inline(tag):
            if tag not in VOID:
                self.push(tag, self.here, True)
                self.nodes[self.here].links += tag == "a"
            return
        if tag in CLOSES_P and self.open[self.blocks[-1]][0] == "p":
            self.pop_to(self.blocks[-1])
        if tag in CLOSES:
            wall = max((self.at[w][-1] for w in WALLS if self.at[w]), default=0)
            inside = [self.at[name][k] for name in CLOSES[tag] if (k := bisect_right(self.at[name], wall)) < len(self.at[name])]
            if inside:
                self.pop_to(min(inside))
        self.flush()
        if tag in VOID:
            return
        words = {w for k, v in attrs if k in ("class", "id", "role") and v for w in TOKENS.findall(v.lower())}
        above = self.nodes[self.here]
        self.nodes.append(Node(tag, self.here, above.depth + 1, words, dict(attrs).get("data-part"), len(above.children)))
        above.children.append(len(self.nodes) - 1)
        self.push(tag, len(self.nodes) - 1, False)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and self.at[tag]:
            self.end_endless()
        if self.silent:
            if self.silent_at[tag]:
                self.speak(self.silent_at[tag][-1])
            elif tag in {"head", "body", "html"}:
                self.unsilence(0)
            return
        if self.at[tag] and (self.at[tag][-1] > self.blocks[-1] or not self.open[self.at[tag][-1]][2]):
            self.pop_to(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.silent and self.silent[-1][0] == "head" and data.strip():  # text ends an open head, too
            self.speak(len(self.silent) - 1)
        if not self.silent:
            self.text.append(data)
            if self.at["a"]:
                self.linked += len(data)


def features(page: Page) -> np.ndarray:
    """A row of FEATURES for each node: sums over its subtree, its attributes, its place among siblings and below ancestors."""
    nodes, n, log = page.nodes, len(page.nodes), math.log1p
    own, linked, words, marks, digits, runs = ([0] * n for _ in range(6))
    start, end, at = [-1] * n, [0] * n, 0
    for node, text, in_link in page.runs:
        own[node] += len(text)
        linked[node] += in_link
        words[node] += text.count(" ") + 1
        marks[node] += len(MARKS.findall(text))
        digits[node] += sum(map(str.isdigit, text))
        runs[node] += 1
        start[node] = at if start[node] < 0 else start[node]
        at += len(text)
        end[node] = at
    total = max(at, 1)
    chars, size, links = own[:], [1] * n, [node.links for node in nodes]
    for i in range(n - 1, 0, -1):  # children stand behind their parents
        p = nodes[i].parent
        for x in (chars, linked, words, marks, digits, runs, size, links):
            x[p] += x[i]
        if start[i] >= 0:
            start[p] = start[i] if start[p] < 0 else min(start[p], start[i])
            end[p] = max(end[p], end[i])
    density = [c / k for c, k in zip(chars, size, strict=True)]
    tags = [Counter([nodes[c].tag for c in node.children]) for node in nodes]
    bad, good = [len(node.words & BAD_WORDS) for node in nodes], [len(node.words & GOOD_WORDS) for node in nodes]
    out = []
    above = [(0,) * 9] * n  # nearest part, aside above, bad words above, good words above; an article, a header, a form, another part, words of one above
    for i, node in enumerate(nodes):
        p, tag = node.parent, node.tag
        peers, place, same = [i], 0, 1.0
        if p >= 0:
            peers, place, name = nodes[p].children, node.place, nodes[p].tag
            same = tags[p][tag] / len(peers)
            part, aside, n_bad, n_good, main, header, form, other, named = above[p]
            above[i] = (1 if name in MAIN else -1 if name in ASIDE else part, aside or name in ASIDE, n_bad + bad[p], n_good + good[p], main or name in MAIN, header or name == "header", form or name == "form", other or name in PARTS, named or bool(node.words & PART_WORDS))
        some = max(chars[i], 1)
        out.append((
            node.depth, log(chars[i]), log(own[i]), linked[i] / some, density[i], marks[i] / max(words[i], 1), words[i] / max(runs[i], 1), chars[i] / total, (start[i] if start[i] >= 0 else total) / total, end[i] / total,
            len(node.children), len(peers), place / len(peers), same, log(chars[peers[place - 1]]) if place else 0, log(chars[peers[place + 1]]) if place + 1 < len(peers) else 0, density[p] if p >= 0 else 0,
            tag in TEXTUAL, tag in HEADINGS, tag == "li", tag in MAIN, tag in ASIDE, *above[i][:2], bad[i], good[i], *above[i][2:4], digits[i] / some, links[i], *above[i][4:],
        ))
    return np.array(out, dtype=float)
