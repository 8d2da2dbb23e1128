"""Licence scans: an Aho-Corasick automaton over words, and a shunting-yard parser for licence expressions.

The automaton's alphabet are words, so phrases stand at word borders by construction and a match is known by its
word's ordinal.  Identifier tags are phrases as well; what follows one is read from the text as an expression.  Licences that
a notice names one after the other, with `and`, `or` or `with` between them, are an expression, too.  The value of an
expression is how much it asks for: `and` takes the most of its sides, `or` the least, `with` an exception one step less.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostloom.llm import words as W

#: Bytes of text that are scanned before results are handed on.
SLICE = 2 << 20
#: Phrases whose places are counted.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further phrases, as words in lower case, and their labels.
NOTICES = {
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "apache software license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl-1.0",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "classpath exception": "classpath-exception",
    "llvm exceptions": "llvm-exception",
}
#: What follows one of these is an expression.
TAGS = {"spdx license identifier", "license expression"}
#: How much licences ask for, by the start of their label: the longest start that fits counts.
ASKS = {
    "public-domain": 0, "cc0": 0, "unlicense": 0, "0bsd": 0,
    "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "bsl": 1, "cc-by": 1,
    "lgpl": 2, "mpl": 2, "epl": 2, "eupl": 2,
    "gpl": 3, "agpl": 3, "cc-by-sa": 3, "gfdl": 3,
    "cc-by-nc": 4, "cc-by-nd": 4, "reserved": 4, "proprietary": 4,
}
#: The names of what is asked for; an unknown licence asks for the most.
LEVELS = ["nothing", "notice", "files", "share-alike", "restricted"]
_KNOWN = sorted(ASKS, key=len, reverse=True)
#: Words that may stand between licences of one expression.
_FILL = {b"the", b"a", b"an", b"either", b"its", b"under", b"version", b"license", b"licence", b"2", b"3", b"0", b"1"}
_SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Binding of operators: a larger number binds first.
BINDS = {"or": 1, "and": 2, "with": 3}
#: The share of doubt that evidence of each kind leaves.
DOUBT = {"tag": 0.05, "long": 0.2, "short": 0.5}


class Phrases:
    """Aho-Corasick over words: goto and failure links of a trie whose edges are words."""

    def __init__(self, phrases: list[list[bytes]]):
        self.goto: list[dict[bytes, int]] = [{}]
        self.out: list[list[int]] = [[]]
        for k, phrase in enumerate(phrases):
            state = 0
            for word in phrase:
                if word not in self.goto[state]:
                    self.goto[state][word] = len(self.goto)
                    self.goto.append({})
                    self.out.append([])
                state = self.goto[state][word]
            self.out[state].append(k)
        self.fail = [0] * len(self.goto)
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for word, after in self.goto[state].items():
                self.fail[after] = self._step(self.fail[state], word)
                self.out[after] = self.out[after] + self.out[self.fail[after]]
                queue.append(after)
        self.words = {w for phrase in phrases for w in phrase}

    def _step(self, state: int, word: bytes) -> int:
        while state and word not in self.goto[state]:
            state = self.fail[state]
        return self.goto[state].get(word, 0)

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(ordinal of the last word, phrase) of every match, in the words' order."""
        found, state, before, known = [], 0, -1, self.words
        for i in [i for i, w in enumerate(words) if w in known]:
            state = self._step(state if i == before + 1 else 0, words[i])
            before = i
            for k in self.out[state]:
                found.append((i, k))
        return found


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: the longest start of the tokens that is an expression, operands before operators.

    Operators are and, or and with (in any case; with binds first, then and), parentheses group.  Tokens that don't
    fit end the expression; without an operand there is none.
    """
    out: list[str] = []
    stack: list[str] = []
    best: list[str] = []
    wanted = True  # an operand
    for token in tokens:
        low = token.lower()
        if wanted and low == "(":
            stack.append(low)
        elif wanted and low not in BINDS and low != ")":
            out.append(low)
            wanted = False
        elif not wanted and low in BINDS:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            wanted = True
        elif not wanted and low == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            break
        if not wanted and "(" not in stack:
            best = out + stack[::-1]
    return best


def asks(label: str) -> int:
    return next((ASKS[k] for k in _KNOWN if label.startswith(k)), 4)


def value(expression: list[str]) -> int:
    """How much an expression in postfix asks for."""
    stack: list[int] = []
    for token in expression:
        if token == "with":
            stack.pop()
            stack[-1] = max(min(stack[-1], 1), stack[-1] - 1)
        elif token in BINDS:
            right = stack.pop()
            stack[-1] = (max if token == "and" else min)(stack[-1], right)
        else:
            stack.append(asks(token))
    return stack[-1]


def operands(expression: list[str]) -> list[str]:
    """The licences and exceptions of an expression."""
    return [t for t in expression if t not in BINDS]


class Scanner:
    """All phrases in one automaton."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: set[str] = TAGS):
        phrases = [*base, *[p for p in notices if p not in base], *tags]
        self.length = [len(p.split()) for p in phrases]
        self.label = [base.get(p) or notices.get(p) for p in phrases]
        self.n_base = len(base)
        self.automaton = Phrases([p.encode().split() for p in phrases])

    def scan(self, text: str) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, asks) of one text."""
        raw = text.encode()
        words = raw.lower().translate(_SEPARATORS).split()
        found = self.automaton.find(words)
        places = [i - self.length[k] + 1 for i, k in found if k < self.n_base]
        base = {self.label[k] for _, k in found if k < self.n_base}
        if not found:
            return len(words), 0, None, None, "", "", 0.0, [], None
        spans = self._longest(found)
        labels, kept, doubt = set(base), [], {}
        read = set()  # words that tags' expressions have taken
        for last, _, k in spans:
            expression = self._tagged(raw, last) if self.label[k] is None else []
            if expression:
                kept.append(expression)
                labels.update(operands(expression))
                doubt["tag"] = DOUBT["tag"]
                read.update(range(last + 1, last + 1 + sum(len(_WORD.findall(t.encode())) for t in expression)))
        named = [s for s in spans if self.label[s[2]] is not None and s[1] not in read]
        for _, _, k in named:
            labels.add(self.label[k])
            kind = "long" if self.length[k] > 3 else "short"
            doubt[kind] = DOUBT[kind]
        kept += self._named(words, named)
        for label in base - {t for e in kept for t in e}:
            kept.append([label])
            doubt.setdefault("short", DOUBT["short"])
        left = 1.0
        for d in doubt.values():
            left *= d
        asked = max((value(e) for e in kept), default=None)
        return (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 - left if labels else 0.0, sorted({" ".join(e) for e in kept}), None if asked is None else LEVELS[asked],
        )

    def _longest(self, found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(last, first, phrase) of matches that lie inside no other, by their places."""
        spans = sorted((i - self.length[k] + 1, -i, k) for i, k in found)
        out: list[tuple[int, int, int]] = []
        reach = -1
        for first, minus, k in spans:
            if -minus > reach:
                out.append((-minus, first, k))
                reach = -minus
        return out

    @staticmethod
    def _tagged(raw: bytes, last: int) -> list[str]:
        """The expression after word number `last`, up to the end of its line."""
        for n, m in enumerate(_WORD.finditer(raw.lower())):
            if n == last:
                line = re.split(rb"[\r\n]", raw[m.end() :], maxsplit=1)[0]
                return postfix(_TOKEN.findall(line.lstrip(b" \t:\"'=").decode()))
        return []

    def _named(self, words: list[bytes], named: list[tuple[int, int, int]]) -> list[list[str]]:
        """Expressions of licences with an operator and fillers, or nothing, between neighbours."""
        out, tokens, end = [], [], None
        for last, first, k in named:
            between = words[end + 1 : first] if end is not None and first - end <= 6 else None
            signs = [w for w in between if w.decode(errors="ignore") in BINDS] if between is not None else []
            if len(signs) == 1 and all(w in _FILL or w in signs for w in between):
                tokens += [signs[0].decode(), self.label[k]]
            else:
                if tokens:
                    out.append(postfix(tokens))
                tokens = [self.label[k]]
            end = last
        return [*out, postfix(tokens)] if tokens else out


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, asks string"
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.string()]
_NAMES = [f.strip().split()[0] for f in _SCHEMA.split(",")]


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each row of `docs`: words, places of base phrases, labels, score, expressions, and what they ask for.

    Words are runs of digits, letters a-z (A-Z in lower case) and characters outside ASCII.  n_base counts all places of
    base phrases, first_word and last_word are their smallest and largest start (null without any).  base_labels and labels
    (base ones, licences that a tag's expression names, and notices that lie inside no longer one) are distinct, sorted and joined by
    commas; empty if there are none.  score is 1 less the doubt that the kinds of evidence leave: 0 without labels.  expressions
    are in postfix; asks is the most that one of them asks for (null if there are none).  Null texts count as empty,
    repeated rows give equal rows, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for rows, _, _ in W.slices(batch, "text", SLICE):
                found = [scanner.scan(t or "") for t in rows.column(1).to_pylist()]
                columns = [rows.column(0), *[pa.array([x[i] for x in found], _TYPES[i + 1]) for i in range(9)]]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, _SCHEMA)
