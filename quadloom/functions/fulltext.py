"""Full text over a column: words, phrases, prefixes, wildcards, and/or/not, score and excerpt.

A word stands between characters that are neither letters, digits nor underscores, whatever its case; no look-around, so
the patterns mean the same in other regular-expression engines."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEFT, RIGHT, WORD = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]"
#: A wildcard may use the word's beginning only after so many characters.
PREFIX = 4


@dataclass(frozen=True)
class Part:
    pattern: str
    negated: bool = False
    words: str = ""


def _pattern(token: str) -> str:
    at = min([i for i in (token.find("*"), token.find("?")) if i >= 0], default=-1)
    if at < 0:
        return f"(?iu){LEFT}{re.escape(token)}{RIGHT}"
    if at >= PREFIX and at == len(token) - 1 and token[at] == "*":
        return f"(?iu){LEFT}{re.escape(token[:at])}{WORD}*"
    return "(?iu)" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in token)


def parts_of(text: str) -> tuple[list[Part], bool]:
    """The parts of a search text, and whether any of them is enough. The last and/or counts for the whole text."""
    found, either, negate = [], False, False
    for m in re.finditer(r"'([^']*)'|\"([^\"]*)\"|(\S+)", text):
        phrase, word = m[1] if m[1] is not None else m[2], m[3]
        if word and word.lower() in ("and", "or", "not"):
            negate = word.lower() == "not"
            either = either if negate else word.lower() == "or"
            continue
        if token := (phrase if phrase is not None else word):
            found.append(Part(_pattern(token), negate, token))
            negate = False
    return found, either


def contains(column: Column, text: str) -> Column:
    parts, either = parts_of(text)
    if not parts:
        return F.lit(False)
    tests = [~column.rlike(p.pattern) if p.negated else column.rlike(p.pattern) for p in parts]
    return reduce((lambda a, b: a | b) if either else (lambda a, b: a & b), tests)


def score(column: Column, text: str, depth: int = 0) -> Column:
    """Hits a hundred characters, damped by the depth of the path that led to the text."""
    hits = [F.regexp_count(column, F.lit(p.pattern)) for p in parts_of(text)[0] if not p.negated]
    total = reduce(lambda a, b: a + b, hits, F.lit(0))
    return total * 100.0 / F.greatest(F.length(column), F.lit(1)) / (depth + 1 if depth else 1)


def excerpt(column: Column, text: str, around: int = 40) -> Column:
    """What stands around the first hit of each part. The hit is found first, in one pass: tried at each place of the
    text, the pattern with what stands before would look for the hit from `around` places at each."""
    pieces = []
    for p in parts_of(text)[0]:
        if not p.negated:
            pattern = p.pattern.removeprefix("(?iu)")
            before = F.split(column, f"(?iu)(?s){pattern}", 2)[0]
            near = F.substring(column, F.greatest(F.length(before) - around, F.lit(0)) + 1, F.length(column))
            found = F.regexp_extract(near, f"(?iu)(?s).{{0,{around}}}{pattern}.{{0,{around}}}", 0)
            pieces.append(F.when(column.rlike(f"(?iu)(?s){pattern}"), F.nullif(found, F.lit(""))))
    return F.concat_ws(" … ", *pieces) if pieces else F.lit("")
