"""BPE encoding and decoding of whole texts with a public tokenizer file.

Every text goes by tree concatenation. It is halved, wherever its middle falls,
until a part holds `leaf` characters at most, at least once; the parts are
encoded as they are, unsplit and side by side, and neighbours are joined level
by level. A join encodes a window around the cut again, from a word before it
to a word behind it, and beside that the window's two sides alone. The window
takes the place of the sides' tokens once it starts as the left side does and
ends as the right side does; until then it grows. It reaches from white space
to white space, which no token of such a tokenizer spans, so nothing outside
it can change.

Leaves and windows repeat words, and most of the library's time goes into them.
So these are parted at spaces and line feeds, a piece that was encoded lately is
remembered, and only the others are encoded: many in one call, with a special
token between them, at which the library parts a text before all else. Where the
tokenizer's rules are RULES, a piece of Latin letters with marks behind them has
the tokens of the letters in lower case and those of the marks: such words need
the model alone.

A cut that would fall into a piece of more than `leaf` characters without white
space goes around it. Such a piece has a tree of its own, over its symbols and
without the word end: a window is right once its first token is the one that
the left side had there and its last the one that the right side had. A token
sequence is the encoding exactly if each neighbouring pair of tokens is, and
every pair then comes from an encoding.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text

#: Leaves of the trees hold so many characters at most.
LEAF = 2048
#: Characters to either side of a cut that a window holds at least, at first.
REACH = 16
#: Texts whose trees grow side by side: their leaves, and then their windows, are encoded together.
TOGETHER = 256
#: Leaves or windows whose new pieces are encoded together.
RUN = 512
#: Pieces of a text that the library gets.
CALL = 64
#: Pieces that a worker remembers; as many older ones stay until they are met again or give way. Longer ones than KEPT characters aren't remembered.
MEMO, KEPT = 1 << 17, 64
#: Rules (normalizer, pre-tokenizer) that lower-case letters one by one and part them from marks. They change nothing else in the pieces that WORD finds, which are shorter than KEPT.
RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
WORD = re.compile(f"^(([{LETTERS}]{{1,48}})([{MARKS}]{{0,8}}))$", re.MULTILINE)


class Bpe:
    """The tokenizer of one file, in one task."""

    def __init__(self, path: str, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.path, self.suffix = path, self.whole.model.end_of_word_suffix
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.names = [self.whole.id_to_token(i) or "" for i in range(size)]
        added = self.whole.get_added_tokens_decoder()
        special = [t.content for t in added.values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # a mark goes between pieces that don't hold its first character: no special token can then reach over an end of it
        self.mark, self.mark_id = next(((t.content, i) for i, t in added.items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word or any(t.content[0] in x[1:] for x in special))), (None, -1))
        self.symbol = {ord(c): self.whole.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(256)) if re.match(f"[{LETTERS}{MARKS}]", c)} if (self.spec["normalizer"], self.spec["pre_tokenizer"]) == RULES else {}
        # without a word end or a token for each symbol, tokens don't tell where a word ends
        self.ruled = bool(self.symbol and self.suffix) and all(self.whole.token_to_id(x + end) is not None for x in "".join(self.symbol.values()) for end in ("", self.suffix))
        self.ends = np.array([bool(self.suffix) and x.endswith(self.suffix) for x in self.names])
        self.leaf, self.joins = leaf, 0
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def bare(self, suffix: str | None, parts: dict | None = None):
        """The model alone: symbols in, tokens out, the last with the word end if a suffix is given."""
        from tokenizers import Tokenizer

        model = self.spec["model"] | {"end_of_word_suffix": suffix}
        return Tokenizer.from_str(json.dumps(self.spec | {"model": model, "normalizer": None, "pre_tokenizer": parts, "added_tokens": [], "truncation": None, "padding": None}))

    @cached_property
    def inner(self):
        return self.bare(None)

    @cached_property
    def last(self):
        return self.bare(self.suffix) if self.suffix else self.inner

    @cached_property
    def words(self):
        return self.bare(self.suffix, {"type": "WhitespaceSplit"})

    def symbols(self, ids: list[int]) -> str:
        """The symbols that the tokens stand for, without a word end."""
        text = "".join(self.names[i] for i in ids)
        return text[: -len(self.suffix)] if self.suffix and ids and self.names[ids[-1]].endswith(self.suffix) else text

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        model, k = (self.last if ends else self.inner), 4
        while True:
            a, b = left[-k:], right[:k]
            to_end = len(b) == len(right)
            inside = (model if to_end else self.inner).encode(self.symbols(a) + self.symbols(b), add_special_tokens=False).ids
            if (len(a) == len(left) or inside[0] == a[0]) and (to_end or inside[-1] == b[-1]):
                return left[: len(left) - len(a)] + inside + right[len(b) :]
            k *= 2

    def tree(self, symbols: str) -> list[int]:
        """The tokens of one pre-token, by halves."""
        cuts = list(range(0, len(symbols), self.leaf))
        leaves = [symbols[i : i + self.leaf] for i in cuts]
        level = [e.ids for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)] + [self.last.encode(leaves[-1], add_special_tokens=False).ids]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1], i + 2 >= len(level)) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def long_piece(self, piece: str) -> list[int]:
        ids: list[int] = []
        for part in self.special.split(piece) if self.special else [piece]:
            if self.special and self.special.fullmatch(part):
                ids.append(self.whole.token_to_id(part))
            elif part:
                text = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(text):
                    ids += self.tree(word) if len(word) > self.leaf else self.last.encode(word, add_special_tokens=False).ids
        return ids

    def parts(self, text: str) -> list[tuple[int, int, bool]]:
        """(start, end, long) of the leaves of a text; long ones are pieces without white space."""
        leaf, out, todo = max(1, min(self.leaf, (len(text) + 1) // 2)), [], [(0, len(text))]
        while todo:
            start, end = todo.pop()
            if end - start <= leaf:
                out.append((start, end, False))
                continue
            cut = (start + end) // 2
            if cut - start > self.leaf and end - cut > self.leaf:
                a, b = space_before(text, start, cut), space_after(text, cut, end)
                if b - a > self.leaf:
                    out.append((a, b, True))
                    todo += [x for x in ((b, end), (start, a)) if x[0] < x[1]]
                    continue
            todo += [(cut, end), (start, cut)]
        return sorted(out)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The tokens of each text, as little-endian 32-bit integers."""
        out: list[bytes] = []
        for i in range(0, len(texts), RUN):
            pieces = [t.replace("\n", " ").split(" ") for t in texts[i : i + RUN]]
            long = self.learn(set().union(*pieces))
            out += [b"".join(map(self.memo.__getitem__, x)) for x in pieces]
            for piece in long:
                del self.memo[piece]
        return out

    def learn(self, pieces: set[str]) -> list[str]:
        """Sees that the memo holds all these pieces; returns those that are too long to stay."""
        if len(self.memo) > MEMO:
            self.memo, self.older = {"": b""}, self.memo
        new = self.unmet(pieces)
        apart = [(p, w.lower(), marks) for p, w, marks in WORD.findall("\n".join(new))] if self.ruled else []
        words = self.unmet({w for _, w, _ in apart} | {marks for _, _, marks in apart})
        others = new.difference([p for p, _, _ in apart])
        marked = [p for p in others if self.mark and self.mark[0] not in p]
        calls = [marked[i : i + CALL] for i in range(0, len(marked), CALL)] + [[p] for p in others.difference(marked)]
        found = self.whole.encode_batch_fast([(self.mark or "").join(x) for x in calls], add_special_tokens=False)
        for call, e in zip(calls, found, strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(ids == self.mark_id) if len(call) > 1 else ids[:0]
            self.remember(call, ids, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)])
        calls = list(words)
        calls = [calls[i : i + CALL] for i in range(0, len(calls), CALL)]
        found = self.words.encode_batch_fast([" ".join(x).translate(self.symbol) for x in calls], add_special_tokens=False) if calls else []
        for call, e in zip(calls, found, strict=True):
            ids = np.array(e.ids, "<u4")
            at = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            self.remember(call, ids, [0, *at[:-1]], at)
        memo = self.memo
        for p, w, marks in apart:
            if p != w:
                memo[p] = memo[w] + memo[marks]
        return [p for p in others if len(p) > KEPT]

    def remember(self, pieces: list[str], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        held = ids.tobytes()
        self.memo.update(zip(pieces, [held[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], strict=True))

    def unmet(self, pieces: set[str]) -> set[str]:
        """The pieces that aren't remembered; those from before the memo was last full are taken over."""
        new = pieces.difference(self.memo)
        met = [p for p in new if p in self.older]
        self.memo.update((p, self.older[p]) for p in met)
        new.difference_update(met)
        return new

    def window(self, text: str, start: int, cut: int, end: int, reach: int) -> tuple[int, int]:
        """From white space to white space around a cut, `reach` characters to either side at least if the pieces there aren't long."""
        a, b = space_before(text, start, max(start, cut - reach)), space_after(text, min(end, cut + reach), end)
        a = a if cut - a <= reach + self.leaf else space_before(text, start, cut)
        b = b if b - cut <= reach + self.leaf else space_after(text, cut, end)
        return a, b

    def joined(self, jobs: list[tuple[str, int, int, int, bytes, bytes]]) -> list[bytes]:
        """The tokens of text[start:end] for each (text, start, cut, end, left tokens, right tokens)."""
        out = [b""] * len(jobs)
        self.joins += len(jobs)
        todo, reach = list(range(len(jobs))), REACH
        while todo:
            spans = [self.window(*jobs[i][:4], reach) for i in todo]
            asked = [x for i, (a, b) in zip(todo, spans, strict=True) for x in (jobs[i][0][a:b], jobs[i][0][a : jobs[i][2]], jobs[i][0][jobs[i][2] : b])]
            found, grow = self.ids(asked), []
            for n, (i, (a, b)) in enumerate(zip(todo, spans, strict=True)):
                _, start, _, end, left, right = jobs[i]
                inside, before, after = found[3 * n : 3 * n + 3]
                agree = (a == start or inside[:4] == before[:4]) and (b == end or inside[-4:] == after[-4:])
                if agree or reach > end - start:
                    out[i] = left[: len(left) - len(before)] + inside + right[len(after) :]
                else:
                    grow.append(i)
            todo, reach = grow, reach * 2
        return out

    def grown(self, texts: list[str]) -> list[list[int]]:
        """The tokens of each text, by halves."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.grown_bytes(texts)]

    def grown_bytes(self, texts: list[str]) -> list[bytes]:
        levels = [self.parts(t) for t in texts]
        short = self.ids([t[a:b] for t, parts in zip(texts, levels, strict=True) for a, b, long in parts if not long])
        at = iter(short)
        trees = [[(a, b, np.array(self.long_piece(t[a:b]), "<u4").tobytes() if long else next(at)) for a, b, long in parts] for t, parts in zip(texts, levels, strict=True)]
        while any(len(x) > 1 for x in trees):
            jobs = [(t, x[i][0], x[i][1], x[i + 1][1], x[i][2], x[i + 1][2]) for t, x in zip(texts, trees, strict=True) for i in range(0, len(x) - 1, 2)]
            done = iter(self.joined(jobs))
            trees = [[(x[i][0], x[i + 1][1], next(done)) if i + 1 < len(x) else x[i] for i in range(0, len(x), 2)] for x in trees]
        return [x[0][2] if x else b"" for x in trees]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Of each text, the ids as little-endian 32-bit integers and the decoded text."""
        for i in range(0, len(texts), TOGETHER):
            for ids in self.grown_bytes([t or "" for t in texts[i : i + TOGETHER]]):
                yield ids, " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def space_before(text: str, start: int, at: int) -> int:
    """The place behind the last space or line feed of text[start:at]; start, if there is none."""
    return max(text.rfind(" ", start, at), text.rfind("\n", start, at), start - 1) + 1


def space_after(text: str, at: int, end: int) -> int:
    """The place of the first space or line feed of text[at:end]; end, if there is none."""
    a, b = text.find(" ", at, end), text.find("\n", at, end)
    return min(a if a >= 0 else end, b if b >= 0 else end)


@lru_cache(maxsize=2)
def tokenizer(path: str, leaf: int = LEAF) -> Bpe:
    """One for each worker process and file."""
    return Bpe(path, leaf)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, ids array<int> and decoded string: a row for each row of docs.

    Null and empty texts have no ids and decode to the empty string. Repeated
    rows and null ids stay; other columns are ignored.
    """

    def run(texts: list[str | None]) -> list[list]:
        found = list(tokenizer(path).encode(texts))
        return [[np.frombuffer(ids, "<i4") for ids, _ in found], [text for _, text in found]]

    return map_text(docs, keep, run, "ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256 and decoded_sha256 of what encode() gives, without moving the ids."""

    def run(texts: list[str | None]) -> list[list]:
        out: list[list] = [[], [], []]
        for ids, text in tokenizer(path).encode(texts):
            for column, x in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), strict=True):
                column.append(x)
        return out

    return map_text(docs, keep, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
