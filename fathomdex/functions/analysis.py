"""The text analyzer: lower case, split at everything but a-z and 0-9.

Tests on tokens are written as regular expressions over the lowered text, which finds the same tokens as an array of them would and
stays inside generated code; arrays are built only where a test needs each token (fuzzy, suggestions).
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = "[^a-z0-9]+"
#: What tokens of lowered text are made of, for code that reads its bytes.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LEFT, _RIGHT = "(?<![a-z0-9])", "(?![a-z0-9])"


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SPLIT), lambda x: x != "")


def tokenize(s: str) -> list[str]:
    return [t for t in re.split(SPLIT, str(s).lower()) if t]


def token_count(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit("[a-z0-9]+"))


#: Tokens up to which a plain search for each comes before the regular expression, which most texts are then spared.
PLAIN = 8


def _holds_any(c: Column, found: list[str]) -> Column:
    return functools.reduce(operator.or_, (F.lower(c).contains(t) for t in found))


def frequency(c: Column, token: str) -> Column:
    return F.when(~F.lower(c).contains(token), 0).otherwise(F.regexp_count(F.lower(c), F.lit(f"{_LEFT}{token}{_RIGHT}")))


def any_token(c: Column, found: list[str]) -> Column:
    if not found:
        return F.lit(False)
    test = F.lower(c).rlike(f"{_LEFT}(?:{'|'.join(found)}){_RIGHT}")
    return _holds_any(c, found) & test if len(found) <= PLAIN else test


def all_tokens(c: Column, found: list[str]) -> Column:
    out = F.lit(bool(found))
    for t in dict.fromkeys(found):
        out = out & any_token(c, [t])
    return out


def phrase(c: Column, found: list[str], prefix: bool = False) -> Column:
    """The tokens one after another; with prefix, the last one need only begin so."""
    if not found:
        return F.lit(False)
    return F.lower(c).contains(max(found, key=len)) & F.lower(c).rlike(_LEFT + SPLIT.join(found) + ("" if prefix else _RIGHT))


def token_prefix(c: Column, start: str) -> Column:
    return F.lower(c).rlike(_LEFT + re.escape(start.lower()))


def canonical(c: Column, kind: str) -> Column:
    """A value as the string that names its bucket: whole numbers without a fraction."""
    if kind in ("double", "float") or kind.startswith("decimal"):
        return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def wildcard_regex(pattern: str) -> str:
    return "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
