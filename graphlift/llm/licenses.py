"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates the tags' expressions.

Words are runs of bytes outside 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F after A-Z are lower-cased. The
automaton runs over the words joined by single blanks, so a phrase is found whatever stands
between its words. Where the words of an identifier tag are found, the expression after the tag
is parsed from the text itself, in one pass; a word counts as an operand only if it is an identifier, so prose after a tag gives no labels.

Null texts count as empty: no words, no labels, null places, score 0. Repeated rows stay; other columns
are ignored, whatever their names. Texts are taken whole, in time in proportion to their length. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames

#: Fixed by the contract of the query: phrase, label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice phrases of the licences' own public texts: phrase, label.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "bsd license": "bsd",
    "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: First letters of an identifier to the label of its family; the longest that fits counts.
FAMILIES = {"gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc0": "cc0"}

_SEPARATORS = bytes(0x20 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_TAG = re.compile(rb"spdx[-\s]license[-\s]identifier\s*:?", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_NEXT = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Identifiers without a number or a family, in lower case.
PLAIN = {"zlib", "unlicense", "wtfpl", "0bsd", "postgresql", "x11", "ncsa", "curl", "ruby", "vim", "beerware", "libpng", "openssl", "json", "ntp", "ijg", "hpnd", "sleepycat", "noassertion", "none"}
#: A name and a version after a hyphen, an exception's name, or a reference to a text of one's own.
_FORM = re.compile(r"[a-z][a-z0-9.]*(-[a-z0-9.]+)*-v?\d[a-z0-9.]*(-[a-z0-9.]+)*\+?|[a-z0-9.+-]*-exception[a-z0-9.+-]*|(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")


class ExpressionError(ValueError):
    """An expression that doesn't follow the grammar."""


def parse(expression: str) -> list[str]:
    """Shunting-yard: the expression in reverse Polish order. WITH binds closest, then AND, then OR; all from the left."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if token == "(":
            if not operand:
                raise ExpressionError(expression)
            stack.append(token)
        elif token == ")":
            if operand:
                raise ExpressionError(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError(expression)
            stack.pop()
        elif word in _RANK:
            if operand:
                raise ExpressionError(expression)
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            if not operand:
                raise ExpressionError(expression)
            out.append(token)
            operand = False
    if operand or "(" in stack:
        raise ExpressionError(expression)
    return out + stack[::-1]


def identifies(word: str) -> bool:
    """Whether a word is a licence's or an exception's identifier: one of a family, a plain one, or one by its form."""
    name = word.lower()
    return name in PLAIN or bool(_fits(name)) or bool(_FORM.fullmatch(name))


def leading(text: bytes | str, at: int = 0) -> str:
    """The longest expression that the line begins with at `at`, as text may follow it; empty if there is none.

    One pass of the parser's two states, operand or operator, that remembers the last place where the
    expression was complete. It stops at the first word that isn't an identifier, a full stop, a line's end or any other sign.
    """
    if isinstance(text, str):
        text = text.encode()
    operand, depth, start, complete = True, 0, None, None
    while m := _NEXT.match(text, at):
        token, at = m[1].decode("ascii"), m.end()
        start = m.start(1) if start is None else start
        word, stopped = token, False
        if token == "(":
            if not operand:
                break
            depth += 1
            continue
        if token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif token.lower() in _RANK:
            if operand:
                break
            operand = True
            continue
        else:
            word = token.rstrip(".:")
            stopped = word != token
            if not operand or not identifies(word):
                break
            operand = False
        if not depth:
            complete = at - (len(token) - len(word))
        if stopped:
            break
    return "" if complete is None else text[start:complete].decode("ascii")


@dataclass(frozen=True)
class Expression:
    """Licence identifiers of an expression, in order, and its value under a policy."""

    postfix: tuple[str, ...]

    @classmethod
    def of(cls, text: str) -> Expression:
        return cls(tuple(parse(text)))

    def licences(self) -> list[str]:
        """Identifiers of licences, without those of exceptions."""
        names: list[str] = []
        first: list[int] = []  # of each part of the expression, its first name's place
        for t in self.postfix:
            if t not in _RANK:
                first.append(len(names))
                names.append(t)
            else:
                at = first.pop()
                if t == "with":
                    del names[at:]
        return list(dict.fromkeys(names))

    def allowed(self, policy) -> bool:
        """policy(licence, exception or None) -> bool; OR needs one side, AND both."""
        stack: list = []
        for t in self.postfix:
            if t not in _RANK:
                stack.append(t)
                continue
            b, a = stack.pop(), stack.pop()
            if t == "with":
                stack.append((a, b))
            else:
                known = [x if isinstance(x, bool) else policy(*x) if isinstance(x, tuple) else policy(x, None) for x in (a, b)]
                stack.append(known[0] or known[1] if t == "or" else known[0] and known[1])
        top = stack[0]
        return top if isinstance(top, bool) else policy(*top) if isinstance(top, tuple) else policy(top, None)


def _fits(name: str) -> list[str]:
    """Families of an identifier in lower case."""
    return [f for f in FAMILIES if name == f or name.startswith(f + "-") or name == f + "+"]


def family(identifier: str) -> str:
    """The label of a licence identifier: its family's where one fits, else its own in lower case."""
    name = identifier.lower().rpartition(":")[2].removeprefix("licenseref-")
    fits = _fits(name)
    return FAMILIES[max(fits, key=len)] if fits else re.sub(r"[^a-z0-9.+-]", "-", name)


def permissive(licence: str, exception: str | None) -> bool:
    """The default policy: no copyleft, no limits of use; a GPL with an exception counts as allowed."""
    return exception is not None or family(licence) in {"mit", "apache", "bsd", "isc", "cc0", "cc-by", "public-domain"}


def _automaton(base: dict[str, str], notices: dict[str, str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, label in {**notices, **base, TAG: ""}.items():
        raw = f" {phrase} ".encode().decode("latin-1")
        automaton.add_word(raw, (phrase, label, phrase in base, len(raw)))
    automaton.make_automaton()
    return automaton


@dataclass
class Scan:
    n_words: int
    matches: list[tuple[int, int, str, bool]]  # first word, words, label, of the base
    expressions: list[str]
    labels: list[str]
    allowed: bool | None

    @property
    def base(self) -> list[tuple[int, int, str, bool]]:
        return [m for m in self.matches if m[3]]

    @property
    def score(self) -> float:
        """How sure it is that the text carries a licence: each place of evidence halves the doubt, a tag's expression quarters it."""
        return 1 - 0.5 ** (len(self.matches) + 2 * len(self.expressions))


def scan(text: bytes, automaton, policy=permissive) -> Scan:
    words = text.translate(_SEPARATORS).split()
    # A blank before and after; each phrase has its own blanks, and matches that share one are both found.
    joined = " " + b" ".join(words).decode("latin-1") + " "
    matches, labels, tagged, at, seen = [], set(), False, 0, 0
    for end, (phrase, label, base, size) in automaton.iter(joined):
        start = end - size + 1
        # ends ascend, starts need not: count on from the last one or back from it
        seen += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
        at = start
        if label:
            matches.append((seen, phrase.count(" ") + 1, label, base))
            labels.add(label)
        else:
            tagged = True
    expressions, allowed = [], None
    if tagged:
        for m in _TAG.finditer(text):
            found = leading(text, m.end())
            if found:
                expressions.append(found)
                parsed = Expression.of(found)
                labels.update(map(family, parsed.licences()))
                allowed = parsed.allowed(policy) and allowed is not False
    return Scan(len(words), matches, expressions, sorted(labels), allowed)


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, n_matches, expressions (array), allowed."""
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_matches bigint, expressions array<string>, allowed boolean"
    schema = frames.arrow_schema(ddl)

    def find(batches):
        automaton = _automaton(base, notices)
        for batch in batches:
            rows: dict[str, list] = {f: [] for f in schema.names}
            for k, t in zip(batch.column(0).to_pylist(), frames.strings(batch.column(1)), strict=True):
                s = scan(t, automaton)
                own = s.base
                values = (k, s.n_words, len(own), min((m[0] for m in own), default=None), max((m[0] for m in own), default=None), ",".join(sorted({m[2] for m in own})), ",".join(s.labels), s.score, len(s.matches), s.expressions, s.allowed)
                for f, v in zip(schema.names, values, strict=True):
                    rows[f].append(v)
            yield from frames.as_table(rows, schema).to_batches()

    return frames.map_arrow(docs.select(key, text), find, ddl)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licences(frames.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_matches")
