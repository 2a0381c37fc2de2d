"""The SQL subset: SELECT columns | * | COUNT(*) [AS name] FROM index [WHERE ...] [ORDER BY ...] [LIMIT n] [OFFSET n], to request bodies and back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dsl
from . import search as S
from .ast import ParsingError
from .compile import Fields, compile

_LEX = re.compile(r"""\s*(?:(?P<str>'(?:[^']|'')*')|"(?P<quoted>[^"]+)"|(?P<num>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w\-]*(?:\.[A-Za-z_]\w*)*)|(?P<op><=|>=|!=|<>|[=<>(),*;]))""")
_WORDS = {"SELECT", "FROM", "WHERE", "AND", "OR", "ORDER", "BY", "ASC", "DESC", "LIMIT", "OFFSET", "IN", "LIKE", "AS", "COUNT", "NULL", "TRUE", "FALSE"}


@dataclass
class Statement:
    """A parsed statement: index, body of the request, and the name of its COUNT(*), if it is one."""

    index: str
    body: dict
    count_as: str | None = None


def _lex(sql: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while sql[at:].strip():
        m = _LEX.match(sql, at)
        if not m:
            raise ParsingError(f"parsing_exception: bad SQL near {sql[at:at + 20]!r}")
        at = m.end()
        if m["str"] is not None:
            out.append(("value", m["str"][1:-1].replace("''", "'")))
        elif m["quoted"] is not None:
            out.append(("name", m["quoted"]))
        elif m["num"] is not None:
            out.append(("value", float(m["num"]) if "." in m["num"] else int(m["num"])))
        elif m["name"] is not None:
            w = m["name"].upper()
            out.append(("word", w) if w in _WORDS else ("name", m["name"]))
        else:
            out.append(("op", "!=" if m["op"] == "<>" else m["op"]))
    return out


class _Parser:
    def __init__(self, sql: str):
        self.tokens, self.at = _lex(sql), 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *wanted):
        t = self.peek()
        if t in wanted:
            self.at += 1
            return t
        return None

    def need(self, *wanted):
        t = self.take(*wanted)
        if t is None:
            raise ParsingError(f"parsing_exception: expected {' or '.join(str(w[1]) for w in wanted)}, found {self.peek()[1]}")
        return t

    def kind(self, *kinds):
        t = self.peek()
        if t[0] not in kinds:
            raise ParsingError(f"parsing_exception: expected {' or '.join(kinds)}, found {t[1]}")
        self.at += 1
        return t[1]

    def statement(self) -> Statement:
        self.need(("word", "SELECT"))
        body, count_as = {}, None
        if self.take(("word", "COUNT")):
            for p in "(*)":
                self.need(("op", p))
            count_as = self.kind("name") if self.take(("word", "AS")) else "count"
            body["size"] = 0
        elif not self.take(("op", "*")):
            columns = [self.kind("name")]
            while self.take(("op", ",")):
                columns.append(self.kind("name"))
            body["_source"] = columns
        self.need(("word", "FROM"))
        index = self.kind("name")
        body["query"] = self.either() if self.take(("word", "WHERE")) else {"match_all": {}}
        if self.take(("word", "ORDER")):
            self.need(("word", "BY"))
            body["sort"] = []
            while True:
                name = self.kind("name")
                way = self.take(("word", "DESC"), ("word", "ASC"))
                body["sort"].append({name: "desc" if way == ("word", "DESC") else "asc"})
                if not self.take(("op", ",")):
                    break
        while True:
            w = self.take(("word", "LIMIT"), ("word", "OFFSET"))
            if not w:
                break
            n = self.kind("value")
            key = "size" if w[1] == "LIMIT" else "from"
            if not isinstance(n, int) or n < 0 or key in body and count_as is None:
                raise ParsingError(f"parsing_exception: bad {w[1]}")
            if count_as is None:
                body[key] = n
        self.take(("op", ";"))
        if self.peek()[0] is not None:
            raise ParsingError(f"parsing_exception: unexpected {self.peek()[1]}")
        return Statement(index, body, count_as)

    def either(self) -> dict:
        parts = [self.both()]
        while self.take(("word", "OR")):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else {"bool": {"should": parts, "minimum_should_match": 1}}

    def both(self) -> dict:
        parts = [self.test()]
        while self.take(("word", "AND")):
            parts.append(self.test())
        return parts[0] if len(parts) == 1 else {"bool": {"filter": parts}}

    def test(self) -> dict:
        if self.take(("op", "(")):
            inner = self.either()
            self.need(("op", ")"))
            return inner
        name = self.kind("name")
        if self.take(("word", "IN")):
            self.need(("op", "("))
            values = [self.value()]
            while self.take(("op", ",")):
                values.append(self.value())
            self.need(("op", ")"))
            return {"terms": {name: values}}
        if self.take(("word", "LIKE")):
            return _like(name, str(self.value()))
        op = self.need(*(("op", o) for o in ("=", "!=", "<", "<=", ">", ">=")))[1]
        v = self.value()
        if op == "=":
            return {"term": {name: v}}
        if op == "!=":
            return {"bool": {"must_not": [{"term": {name: v}}]}}
        return {"range": {name: {{"<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}[op]: v}}}

    def value(self):
        w = self.take(("word", "TRUE"), ("word", "FALSE"), ("word", "NULL"))
        return {"TRUE": True, "FALSE": False, "NULL": None}[w[1]] if w else self.kind("value")


def _like(name: str, pattern: str) -> dict:
    if pattern.endswith("%") and not re.search(r"[%_]", pattern[:-1]):
        return {"match_phrase_prefix": {name: pattern[:-1]}}
    return {"wildcard": {name: pattern.replace("%", "*").replace("_", "?")}}


def parse(sql: str) -> Statement:
    return _Parser(sql).statement()


def to_dsl(sql: str) -> tuple[str, dict]:
    """(index, request body)."""
    s = parse(sql)
    return s.index, s.body


def run(sql: str, tables, mapping: dict[str, str] | None = None) -> DataFrame:
    """The statement's rows.  tables(index) gives the index's DataFrame.  Strings compare whole unless mapping calls their field text."""
    s = parse(sql)
    df = tables(s.index)
    mapping = {f: "keyword" for f in df.columns} | (mapping or {})
    fields = Fields(df, mapping)
    found = df.where(compile(dsl.parse(s.body["query"]), fields))
    if s.count_as is not None:
        return found.agg(F.count("*").alias(s.count_as))
    for c in s.body.get("_source", ()):
        if fields.type(c) is None:
            raise ParsingError(f"parsing_exception: unknown column [{c}]")
    keys = [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in S.sort_columns(s.body["sort"], fields)] if s.body.get("sort") else []
    if keys:
        found = found.orderBy(*keys, *([F.col("_id")] if "_id" in df.columns else []))
    if s.body.get("from"):
        found = found.offset(s.body["from"])
    if "size" in s.body:
        found = found.limit(s.body["size"])
    return found.select(*(fields.column(c).alias(c) for c in s.body["_source"])) if "_source" in s.body else found


def _literal(v) -> str:
    if v is None or isinstance(v, bool):
        return {None: "NULL", True: "TRUE", False: "FALSE"}[v]
    return repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _name(n: str) -> str:
    return n if re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*", n) and n.upper() not in _WORDS else f'"{n}"'


def _where(q: dict) -> str:
    (kind, body), = q.items()
    if kind == "bool":
        every = [_where(x) for k in ("must", "filter") for x in _items(body.get(k))]
        for x in _items(body.get("must_not")):
            (k, v), = x.items()
            (f, value), = v.items() if k == "term" else ((None, None),)
            if k != "term":
                raise ParsingError("parsing_exception: only a term can be negated in SQL")
            every.append(f"{_name(f)} != {_literal(value['value'] if isinstance(value, dict) else value)}")
        should = [_where(x) for x in _items(body.get("should"))]
        if should:
            every.append("(" + " OR ".join(should) + ")" if len(should) > 1 else should[0])
        return every[0] if len(every) == 1 else "(" + " AND ".join(every) + ")"
    (f, v), = body.items()
    if kind in ("term", "match"):
        v = v.get("value", v.get("query")) if isinstance(v, dict) else v
        return f"{_name(f)} = {_literal(v)}"
    if kind == "terms":
        return f"{_name(f)} IN ({', '.join(map(_literal, v))})"
    if kind == "range":
        parts = [f"{_name(f)} {o} {_literal(v[k])}" for k, o in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")) if k in v]
        return parts[0] if len(parts) == 1 else "(" + " AND ".join(parts) + ")"
    if kind == "match_phrase_prefix":
        return f"{_name(f)} LIKE {_literal(str(v) + '%')}"
    raise ParsingError(f"parsing_exception: [{kind}] has no SQL")


def _items(x) -> list:
    return [] if not x else x if isinstance(x, list) else [x]


def to_sql(index: str, body: dict) -> str:
    """A request body as a statement that parse() reads back to the same rows."""
    source = body.get("_source")
    out = f"SELECT {', '.join(map(_name, [source] if isinstance(source, str) else source)) if isinstance(source, (str, list)) and source else '*'} FROM {_name(index)}"
    q = body.get("query")
    if q and "match_all" not in q:
        w = _where(q)
        out += " WHERE " + (w[1:-1] if w.startswith("(") and _closes(w) else w)
    keys = [(k, v if isinstance(v, str) else v.get("order", "asc")) for part in _items(body.get("sort")) for k, v in part.items()]
    if keys:
        out += " ORDER BY " + ", ".join(f"{_name(k)} {w.upper()}" for k, w in keys)
    for k, w in (("size", "LIMIT"), ("from", "OFFSET")):
        if body.get(k) is not None:
            out += f" {w} {int(body[k])}"
    return out


def _closes(w: str) -> bool:
    """Whether the first bracket is closed by the last character."""
    depth, quoted = 0, False
    for k, c in enumerate(w):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if depth == 0:
                return k == len(w) - 1
    return False
