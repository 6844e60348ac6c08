"""SCL-16 on texts of any length: does a text hold a copy block whose slots are filled?

The pattern of `text.personalization_pattern` has a node for each word, and Java's matcher a stack frame for
each node, so a block of some thousand words overflows the stack. Here the places that a match can have
reached are a set, moved on line by line; a line without slots is compared at once."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkproof.functions.text import PERSONAL_SLOT, SLOT_MARK, has_slot, let, norm_text

SLOT_LENGTH = 60
# The white space of ECMAScript, as in text.WS.
BLANKS = re.compile("[ \t\n\x0b\x0c\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]*")


class _Fold(dict):
    """Characters that differ by case only, as one of them."""

    def __missing__(self, code: int) -> str:
        upper = chr(code).upper()
        lower = (upper if len(upper) == 1 else chr(code)).lower()
        self[code] = lower if len(lower) == 1 else chr(code)
        return self[code]


FOLD = _Fold()


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(FOLD)


def slot_lines(raw: Column) -> Column:
    """Lines of a block as lists of alternatives in which SLOT_MARK stands for a slot; NULL without slots."""

    def marked(part: Column) -> Column:
        return norm_text(F.regexp_replace(part, PERSONAL_SLOT, SLOT_MARK))

    def options(line: Column) -> Column:
        both = has_slot(line) & F.contains(line, F.lit(" / "))
        found = F.when(both, F.transform(F.split(line, " / "), marked)).otherwise(F.array(marked(line)))
        return F.filter(found, lambda p: p != "")

    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: F.trim(x) != "")
    parts = F.filter(F.transform(lines, options), lambda p: F.size(p) > 0)
    return F.when(has_slot(raw), let(parts, lambda p: F.when(F.size(p) > 0, p)))


def _over_blanks(text: str, at: Iterable[int], least: int) -> set[int]:
    return {q for p in at for q in range(p + least, BLANKS.match(text, p).end() + 1)}


def _over_words(text: str, at: set[int], piece: str) -> set[int]:
    """Places behind a piece without slots; each of its blanks takes any white space."""
    core = piece.strip(" ")
    if piece.startswith(" "):
        at = _over_blanks(text, at, 1)
    if core:
        out = set()
        for p in at:
            if text.startswith(core, p):
                out.add(p + len(core))
                continue
            for i, word in enumerate(core.split(" ")):
                q = BLANKS.match(text, p).end() if i else p
                if (i and q == p) or not text.startswith(word, q):
                    break
                p = q + len(word)
            else:
                out.add(p)
        at = out
    return _over_blanks(text, at, 1) if piece.endswith(" ") and core else at


def _over_slot(text: str, at: set[int]) -> set[int]:
    out: set[int] = set()
    for p in at:
        newline = text.find("\n", p, p + SLOT_LENGTH)
        out.update(range(p, (min(p + SLOT_LENGTH, len(text)) if newline < 0 else newline) + 1))
    return out


def _starts(text: str, options: list[str]) -> set[int]:
    """Places where a match can begin."""
    out: set[int] = set()
    for option in options:
        first = re.split(f"[ {SLOT_MARK}]", option, maxsplit=1)[0]
        if not first:
            return set(range(len(text) + 1))
        p = text.find(first)
        while p >= 0:
            out.add(p)
            p = text.find(first, p + 1)
    return out


def holds(text: str, lines: list[list[str]]) -> bool:
    text = folded(text)
    lines = [[folded(o) for o in options] for options in lines]
    at = _starts(text, lines[0])
    for k, options in enumerate(lines):
        at = _over_blanks(text, at, 0) if k else at
        reached: set[int] = set()
        for option in options:
            now = at
            for i, piece in enumerate(option.split(SLOT_MARK)):
                now = _over_words(text, _over_slot(text, now) if i else now, piece)
            reached |= now
        at = reached
        if not at:
            return False
    return True


def personalization_match(text: Column, raw: Column) -> Column:
    """Whether a normalised text holds the block, NULL when the block has no slot."""

    def match(texts: pa.Array, blocks: pa.Array) -> pa.Array:
        # One row at a time is held as Python objects.
        pairs = ((t.as_py(), b.as_py()) for t, b in zip(texts, blocks, strict=True))
        return pa.array([None if t is None or b is None else holds(t, b) for t, b in pairs], type=pa.bool_())

    return F.arrow_udf(match, returnType=T.BooleanType())(text, slot_lines(raw))
