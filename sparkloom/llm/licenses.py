"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser reads licence expressions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# Phrases of the base labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases and their labels
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "eclipse public license": "epl",
    "creative commons": "cc",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
}
# Beginnings of licence identifiers and their labels, longest first
IDENTIFIERS = {
    "apache": "apache", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "mit": "mit", "bsd": "bsd", "mpl": "mpl", "isc": "isc", "bsl": "bsl",
    "epl": "epl", "cc0": "cc0", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "unlicense": "unlicense", "zlib": "zlib",
}
TAG = "spdx-license-identifier:"
#: How sure one find of each kind makes us that the text is under a licence.
WEIGHTS = {"base": 0.9, "notice": 0.7, "tag": 0.95, "broken": 0.4}
# What is no word turns into a blank, byte by byte in UTF-8; A-Z into a-z
_BYTES = bytes((b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))
_LEXEME = re.compile(r"[^\S\n]*(\(|\)|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?)")
_RANK = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str | None:
    low = identifier.lower()
    return next((IDENTIFIERS[k] for k in sorted(IDENTIFIERS, key=len, reverse=True) if low.startswith(k)), None)


def _lexemes(text: str, at: int) -> list[str]:
    """The lexemes of the longest well-formed beginning of a line, from `at`. What follows it is prose, and the beginning may be empty.

    It is well formed wherever an operand has ended and all brackets are closed;
    `with` stands between a licence and an exception, both bare.
    """
    out: list[str] = []
    whole = depth = 0
    wants, bare, excepted = True, False, False  # an operand or bracket; was the last operand an identifier; is it an exception
    while m := _LEXEME.match(text, at):
        x, at = m[1], m.end()
        low = x.lower()
        if x == "(" and wants and out[-1:] != ["with"]:
            depth += 1
        elif x == ")" and not wants and depth:
            depth, bare = depth - 1, False
        elif low in _RANK and not wants and (low != "with" or (bare and not excepted)):
            x, wants = low, True
        elif wants and x not in "()" and low not in _RANK:
            wants, bare, excepted = False, True, out[-1:] == ["with"]
        else:
            break
        out.append(x)
        if not wants and not depth:
            whole = len(out)
    return out[:whole]


def read_expression(text: str, at: int = 0) -> list[str]:
    """The longest well-formed licence expression that the text has at `at`, in postfix order; empty if there is none.

    Shunting yard: operators wait on a stack; `with` binds tighter than `and`,
    `and` than `or`. Nothing is multiplied out, so any expression is read whole.
    """
    out: list[str] = []
    pending: list[str] = []
    for x in _lexemes(text, at):
        if x == "(":
            pending.append(x)
        elif x == ")":
            while pending[-1] != "(":
                out.append(pending.pop())
            pending.pop()
        elif x in _RANK:
            while pending and pending[-1] != "(" and _RANK[pending[-1]] >= _RANK[x]:
                out.append(pending.pop())
            pending.append(x)
        else:
            out.append(x)
    return out + pending[::-1]


def rendered(postfix: list[str]) -> str:
    """The expression with the brackets it needs."""
    done: list[tuple[list[str], int]] = []
    for x in postfix:
        if x not in _RANK:
            done.append(([x], 4))
            continue
        (right, r), (left, k) = done.pop(), done.pop()
        sides = [["(", *side, ")"] if rank < _RANK[x] else side for side, rank in ((left, k), (right, r))]
        sides[0] += [f" {x} ", *sides[1]]
        done.append((sides[0], _RANK[x]))
    return "".join(done[0][0]) if done else ""


def satisfied(postfix: list[str], accepted: Callable[[str], bool]) -> bool:
    """Whether accepted licences alone meet the expression. A licence with an exception is accepted if the licence is."""
    done: list[bool] = []
    for x in postfix:
        if x not in _RANK:
            done.append(accepted(x))
        else:
            right, left = done.pop(), done.pop()
            done.append(left if x == "with" else left and right if x == "and" else left or right)
    return bool(done) and done[0]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for phrase, label in (NOTICES | BASE).items():
            self.machine.add_word(f" {phrase} ", (phrase in BASE, label, len(phrase)))
        self.machine.make_automaton()
        self.tags = ahocorasick.Automaton()
        self.tags.add_word(TAG, len(TAG))
        self.tags.make_automaton()

    def run(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base labels, labels, score, expressions)."""
        raw = (text or "").encode()
        words = b" ".join(raw.translate(_BYTES).split()).decode()
        line = f" {words} "
        finds = list(self.machine.iter(line))
        starts, base, labels, kinds = [], set(), set(), []
        if finds:
            blanks = [i for i, c in enumerate(line) if c == " "]  # the k-th word begins after the k-th blank
            for end, (is_base, label, size) in finds:
                labels.add(label)
                kinds.append("base" if is_base else "notice")
                if is_base:
                    base.add(label)
                    starts.append(bisect_left(blanks, end - size - 1))
        expressions = []
        low = raw.lower().decode()  # A-Z only, so places stay the same
        for end, _ in self.tags.iter(low):
            postfix = read_expression(text or "", end + 1)
            expressions.append(rendered(postfix))
            kinds.append("tag" if postfix else "broken")
            labels |= {x for i in postfix if i not in _RANK and (x := label_of(i))}
        doubt = 1.0
        for k in kinds[:1000]:  # beyond that, doubt is nil in floating point
            doubt *= 1 - WEIGHTS[k]
        n = words.count(" ") + 1 if words else 0
        return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, expressions


_SCANNER: list[Scanner] = []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions (array, one for each identifier tag).

    Null and empty texts have no words, no labels, null places and score 0. A tag
    gives the longest expression that is well formed from its colon on, on its
    line; prose may follow, and an empty one means that there was none. Rows stay one for one.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for b in batches:
            rows = [_SCANNER[0].run(t) for t in b.column(1).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions array<string>")
