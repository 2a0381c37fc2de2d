"""Syntax tree to one boolean Column.

A missing field does not match, so must_not keeps documents without the field.  In a filter null is as good as false, so compile() leaves leaves as
they are and typed comparisons on bare columns reach the Parquet reader as pushed filters; only what is negated or counted is made true or
false first.  holds() is never null, for use as a value.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analysis, geo
from . import ast as A
from . import querystring


class Fields:
    """What is known of an index's columns: Spark types, and which strings are analysed text (all that no mapping calls otherwise)."""

    def __init__(self, df: DataFrame, mapping: dict[str, str] | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.mapping = mapping or {}

    def type(self, name: str) -> T.DataType | None:
        head, *rest = name.split(".")
        t = self.types.get(name) or self.types.get(head)
        if name in self.types:
            return t
        for part in rest:
            t = next((f.dataType for f in t.fields if f.name == part), None) if isinstance(t, T.StructType) else None
        return t

    def element(self, name: str) -> T.DataType | None:
        t = self.type(name)
        return t.elementType if isinstance(t, T.ArrayType) else t

    def is_array(self, name: str) -> bool:
        return isinstance(self.type(name), T.ArrayType)

    def is_text(self, name: str) -> bool:
        return isinstance(self.element(name), T.StringType) and self.mapping.get(name, "text") == "text"

    def is_number(self, name: str) -> bool:
        return isinstance(self.element(name), T.NumericType)

    def text_fields(self) -> tuple:
        return tuple(n for n in self.types if self.is_text(n) and not n.startswith("_"))

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.types else F.col(".".join(f"`{p}`" for p in name.split(".")))


def compile(node: A.Node, fields: Fields) -> Column:  # noqa: A001
    return _COMPILERS[type(node)](node, fields)


def holds(node: A.Node, fields: Fields) -> Column:
    return F.coalesce(compile(node, fields), F.lit(False))


def _on(fields: Fields, name: str, test) -> Column:
    """test(value) for the field, or for any element of an array; false where the field is unknown, null or false where it is null."""
    if fields.type(name) is None:
        return F.lit(False)
    c = fields.column(name)
    return F.exists(c, test) if fields.is_array(name) else test(c)


def _string(fields: Fields, name: str):
    t = fields.element(name)
    kind = t.simpleString() if t is not None else "string"
    return (lambda c: c) if kind == "string" else (lambda c: analysis.canonical(c, kind))


def _match(n: A.Match, fields: Fields) -> Column:
    if fields.type(n.field) is not None and not fields.is_text(n.field):
        return _term(A.Term(n.field, n.text), fields)
    found = analysis.tokenize(n.text)
    return _on(fields, n.field, lambda c: (analysis.all_tokens if n.operator == "and" else analysis.any_token)(c, found))


def _phrase(n: A.Phrase, fields: Fields) -> Column:
    found = analysis.tokenize(n.text)
    return _any(_on(fields, f, lambda c, f=f: analysis.phrase(_string(fields, f)(c), found)) for f in n.fields)


def _phrase_prefix(n: A.PhrasePrefix, fields: Fields) -> Column:
    if not fields.is_text(n.field):
        return _on(fields, n.field, lambda c: c.cast("string").startswith(n.text))
    found = analysis.tokenize(n.text)
    return _on(fields, n.field, lambda c: analysis.phrase(c, found, prefix=True))


def _multi(n: A.MultiMatch, fields: Fields) -> Column:
    found = analysis.tokenize(n.text)
    if n.type == "phrase":
        return _phrase(A.Phrase(n.fields, n.text), fields)
    if n.type == "phrase_prefix":
        if not found:
            return F.lit(False)

        def test(c: Column) -> Column:
            out = analysis.token_prefix(c, found[-1]) & (analysis.token_count(c) >= len(found))
            return out & analysis.all_tokens(c, found[:-1]) if found[:-1] else out

        return _any(_on(fields, f, test) for f in n.fields)
    return _any(_match(A.Match(f, n.text), fields) for f in n.fields)


def _literal(value, t: T.DataType | None) -> Column:
    if isinstance(t, T.BooleanType) and isinstance(value, str):
        return F.lit({"true": True, "false": False}.get(value.lower()))
    if isinstance(t, T.NumericType):
        if isinstance(value, bool):
            return F.lit(float(value))
        try:
            x = float(value)
        except (TypeError, ValueError):
            return F.lit(None).cast("double")
        return F.lit(int(x)) if x == int(x) and abs(x) < 2**53 and isinstance(t, T.IntegralType) else F.lit(x)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(value, (int, float)):
            value = value if abs(value) >= 1e12 else value * 1000
            return F.timestamp_millis(F.lit(int(value))).cast(t)
        return F.lit(str(value)).cast(t)
    return F.lit(str(value).lower() if isinstance(value, bool) else str(value))


def _term(n: A.Term, fields: Fields) -> Column:
    if n.value is None:
        return F.lit(False)
    if fields.is_text(n.field):
        # exact token membership: a value that is no single token of the analyzer is in no document
        v = str(n.value)
        return _on(fields, n.field, lambda c: analysis.any_token(c, [v])) if analysis.tokenize(v) == [v] else F.lit(False)
    return _on(fields, n.field, lambda c: c == _literal(n.value, fields.element(n.field)))


def _terms(n: A.Terms, fields: Fields) -> Column:
    values = [v for v in n.values if v is not None]
    if not values:
        return F.lit(False)
    if fields.is_text(n.field):
        single = [str(v) for v in values if analysis.tokenize(str(v)) == [str(v)]]
        return _on(fields, n.field, lambda c: analysis.any_token(c, single))
    t = fields.element(n.field)
    return _on(fields, n.field, lambda c: c.isin([_literal(v, t) for v in values]))


_COMPARE = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def _range(n: A.Range, fields: Fields) -> Column:
    if not n.bounds:
        return F.lit(False)
    t = fields.element(n.field)
    return _on(fields, n.field, lambda c: functools.reduce(operator.and_, (_COMPARE[k](c, _literal(v, t)) for k, v in n.bounds)))


def _exists(n: A.Exists, fields: Fields) -> Column:
    return fields.column(n.field).isNotNull() if fields.type(n.field) is not None else F.lit(False)


def _prefix(n: A.Prefix, fields: Fields) -> Column:
    if fields.is_text(n.field):
        return _on(fields, n.field, lambda c: analysis.token_prefix(c, n.value))
    return _on(fields, n.field, lambda c: c.cast("string").startswith(n.value))


def _pattern(regex: str, name: str, fields: Fields) -> Column:
    if fields.is_text(name):
        return _on(fields, name, lambda c: F.exists(analysis.tokens(c), lambda t: t.rlike(f"^(?:{regex})$")))
    return _on(fields, name, lambda c: c.cast("string").rlike(f"^(?:{regex})$"))


def edits(fuzziness, value: str) -> int:
    if str(fuzziness).upper().startswith("AUTO"):
        return 0 if len(value) <= 2 else 1 if len(value) <= 5 else 2
    k = int(fuzziness)
    if not 0 <= k <= 2:
        raise A.ParsingError("parsing_exception: fuzziness is AUTO, 0, 1 or 2")
    return k


def _fuzzy(n: A.Fuzzy, fields: Fields) -> Column:
    v, k = n.value.lower(), edits(n.fuzziness, n.value)
    near = lambda t: F.levenshtein(t, F.lit(v), k) >= 0
    if fields.is_text(n.field):
        return _on(fields, n.field, lambda c: F.exists(analysis.tokens(c), near))
    return _on(fields, n.field, lambda c: near(F.lower(c.cast("string"))))


def _terms_set(n: A.TermsSet, fields: Fields) -> Column:
    hits = [F.coalesce(_term(A.Term(n.field, v), fields), F.lit(False)).cast("int") for v in dict.fromkeys(n.values)]
    return functools.reduce(operator.add, hits, F.lit(0)) >= n.minimum


def geo_columns(name: str, fields: Fields) -> tuple[Column, Column]:
    t = fields.type(name)
    c = fields.column(name)
    if isinstance(t, T.StructType):
        return c["lat"], c["lon"]
    parts = F.split(c, ",")
    return F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")


def _geo_distance(n: A.GeoDistance, fields: Fields) -> Column:
    if fields.type(n.field) is None:
        return F.lit(False)
    return geo.haversine(*geo_columns(n.field, fields), n.lat, n.lon) <= n.metres


def _geo_box(n: A.GeoBox, fields: Fields) -> Column:
    if fields.type(n.field) is None:
        return F.lit(False)
    lat, lon = geo_columns(n.field, fields)
    east = (lon >= n.left) & (lon <= n.right) if n.left <= n.right else (lon >= n.left) | (lon <= n.right)
    return (lat <= n.top) & (lat >= n.bottom) & east


def _any(columns) -> Column:
    columns = list(columns)
    return functools.reduce(operator.or_, columns) if columns else F.lit(False)


def _cost(node: A.Node, fields: Fields) -> int:
    """Typed tests first, text tests last: a conjunction stops at its first false part."""
    return max((1 if getattr(x, "field", None) and not fields.is_text(x.field) else 2) if not isinstance(x, A.Bool) else 0 for x in A.walk(node))


def _bool(n: A.Bool, fields: Fields) -> Column:
    every = sorted([(_cost(x, fields), k, x, False) for k, x in enumerate(n.must + n.filter)] + [(_cost(x, fields), k, x, True) for k, x in enumerate(n.must_not)], key=lambda e: (e[0], e[3], e[1]))
    out = None
    for _, _, x, negated in every:
        c = ~holds(x, fields) if negated else compile(x, fields)
        out = c if out is None else out & c
    # optional beside must or filter, unless a minimum is given
    least = n.minimum if n.minimum is not None else 0 if n.must or n.filter else 1
    if n.should and least > 0:
        some = _any(compile(x, fields) for x in n.should) if least == 1 else functools.reduce(operator.add, (holds(x, fields).cast("int") for x in n.should)) >= least
        out = some if out is None else out & some
    return F.lit(True) if out is None else out


_COMPILERS = {
    A.MatchAll: lambda n, f: F.lit(True),
    A.MatchNone: lambda n, f: F.lit(False),
    A.Match: _match,
    A.Phrase: _phrase,
    A.PhrasePrefix: _phrase_prefix,
    A.MultiMatch: _multi,
    A.QueryString: lambda n, f: compile(querystring.parse(n, f.text_fields()), f),
    A.Term: _term,
    A.Terms: _terms,
    A.Range: _range,
    A.Exists: _exists,
    A.Prefix: _prefix,
    A.Wildcard: lambda n, f: _pattern(analysis.wildcard_regex(n.value), n.field, f),
    A.Regexp: lambda n, f: _pattern(n.value, n.field, f),
    A.Fuzzy: _fuzzy,
    A.TermsSet: _terms_set,
    A.GeoDistance: _geo_distance,
    A.GeoBox: _geo_box,
    A.Bool: _bool,
}
