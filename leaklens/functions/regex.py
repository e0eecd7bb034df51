"""Full-match regular expressions with the meaning of SQL ``SIMILAR TO``.

The reports filter with ``SIMILAR TO`` (an RE2 full match).  Spark's
``rlike`` is a Java ``find``.  Wrapping the pattern as ``(?d)\\A(?:p)\\z``
gives the same answers: ``\\A``/``\\z`` anchor the whole text (``$`` would
also match before a final newline) and ``(?d)`` makes ``.`` stop only at
``\\n``, as RE2 does, instead of also at ``\\r``, U+0085, U+2028, U+2029.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_full(pattern: str) -> str:
    return "(?d)\\A(?:" + pattern + ")\\z"


def required_literals(pattern: str) -> tuple[list[str], bool]:
    """Literal runs every match of ``pattern`` must contain,
    and whether they compare case-insensitively.

    Only for patterns without alternation; a word cut by a quantifier loses
    its last character.  Used as a cheap ``contains`` prefilter so the
    backtracking regex runs only on rows that can match - same answers.
    """
    if "|" in pattern or re.search(r"\)[?*{]", pattern):
        return [], False   # alternation / optional groups: no safe literals
    ci = "(?i)" in pattern or "(?si)" in pattern or "(?is)" in pattern
    body = re.sub(r"\(\?[a-z]+\)", " ", pattern)    # inline flag groups
    body = re.sub(r"\[[^\]]*\]", " ", body)          # character classes
    body = re.sub(r"\\[A-Za-z]", " ", body)          # class escapes (\s, \d, ...)
    words = []
    # a run of literal characters: escaped specials or anything not special
    for m in re.finditer(r"(?:\\[^A-Za-z0-9]|[^\\^$.|?*+()\[\]{}\s])+", body):
        w = re.sub(r"\\(.)", r"\1", m.group(0))
        nxt = body[m.end():m.end() + 1]
        if nxt in ("?", "*", "{"):
            w = w[:-1]
        # short literals ('$', '=') filter little and cost a scan each
        if len(w) >= 3:
            words.append(w.lower() if ci else w)
    return words, ci


def _prefilter(c: Column, words: list[str], ci: bool) -> Column | None:
    if not words:
        return None
    src = F.lower(c) if ci else c
    return reduce(lambda a, b: a & b, [src.contains(w) for w in words])


def full_match(col: Column | str, pattern: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    words, ci = required_literals(pattern)
    rx = c.rlike(java_full(pattern))
    pre = _prefilter(c, words, ci)
    return rx if pre is None else (pre & rx)


def any_full_match(col: Column | str, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [full_match(col, p) for p in patterns])


def _like(c: Column, p: str) -> Column:
    # the literal pieces between wildcards must all occur: cheap prefilter
    words = [w for w in re.split(r"[%_]", p) if len(w) >= 3]
    pre = _prefilter(c, words, False)
    return c.like(p) if pre is None else (pre & c.like(p))


def like_any(col: Column | str, patterns: list[str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return reduce(lambda a, b: a | b, [_like(c, p) for p in patterns])


def like_none(col: Column | str, patterns: list[str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return reduce(lambda a, b: a & b, [~c.like(p) for p in patterns])


# ---- SQL text for the DuckDB oracle built from the same pattern lists ----

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_similar_any(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"{expr} SIMILAR TO {sql_str(p)}" for p in patterns) + ")"


def sql_like_any(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"{expr} LIKE {sql_str(p)}" for p in patterns) + ")"


def sql_like_none(expr: str, patterns: list[str]) -> str:
    return "(" + " AND ".join(f"{expr} NOT LIKE {sql_str(p)}" for p in patterns) + ")"
