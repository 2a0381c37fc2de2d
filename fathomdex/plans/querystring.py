"""Query strings: +must, -not, "phrases", field:value and OR, to syntax tree.

Clauses side by side must all hold; clauses joined by OR form one alternative; a minus negates its own clause.
"""

from __future__ import annotations

import re

from . import ast as A

_CLAUSE = re.compile(r'\s*([+-]?)(?:([A-Za-z_][\w.]*):)?(?:"((?:[^"\\]|\\.)*)"|("(?:[^"\\]|\\.)*$)|(\S+))')
_STRIPPED = str.maketrans(dict.fromkeys('|<>(){}[]^~*?\\/', " "))


def parse(q: A.QueryString, all_fields: tuple) -> A.Node:
    if not q.simple:
        return _parse(q.text, q.fields, all_fields)
    try:
        return _parse(q.text.translate(_STRIPPED), q.fields, all_fields)
    except A.ParsingError:
        return A.MatchNone()


def _parse(text: str, fields: tuple, all_fields: tuple) -> A.Node:
    groups: list[list[A.Node]] = []
    at, joined = 0, False
    while text[at:].strip():
        m = _CLAUSE.match(text, at)
        if not m or m[4] is not None:
            raise A.ParsingError("parsing_exception: unterminated phrase")
        at = m.end()
        sign, field, phrase, word = m[1], m[2], m[3], m[5]
        if word == "OR" and not sign and not field:
            joined = bool(groups)
            continue
        if word == "AND" and not sign and not field:
            continue
        on = (field,) if field else fields
        on = tuple(all_fields) if on == ("_all",) else on
        leaf = [A.Phrase((f,), phrase) if phrase is not None else A.Match(f, word) for f in on]
        node: A.Node = leaf[0] if len(leaf) == 1 else A.Bool(should=tuple(leaf), minimum=1) if leaf else A.MatchNone()
        if sign == "-":
            node = A.Bool(must_not=(node,))
        if joined:
            groups[-1].append(node)
        else:
            groups.append([node])
        joined = False
    if not groups:
        return A.MatchNone()
    parts = tuple(g[0] if len(g) == 1 else A.Bool(should=tuple(g), minimum=1) for g in groups)
    return parts[0] if len(parts) == 1 else A.Bool(must=parts)
