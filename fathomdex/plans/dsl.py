"""JSON query DSL to syntax tree.  An unknown query type raises; it never becomes match_all."""

from __future__ import annotations

from ..functions.geo import metres
from . import ast as A


def _one(body: dict, what: str):
    if not isinstance(body, dict) or len(body) != 1:
        raise A.ParsingError(f"parsing_exception: {what} takes one field")
    return next(iter(body.items()))


def _list(x) -> tuple:
    return tuple(x) if isinstance(x, (list, tuple)) else (x,)


def point(p) -> tuple[float, float]:
    if isinstance(p, dict):
        return float(p["lat"]), float(p["lon"])
    if isinstance(p, str):
        lat, lon = p.split(",")
        return float(lat), float(lon)
    return float(p[1]), float(p[0])


def parse(q: dict | None) -> A.Node:
    """The query's tree; None or {} matches all."""
    if not q:
        return A.MatchAll()
    kind, body = _one(q, "a query")
    f = _PARSERS.get(kind)
    if f is None:
        raise A.ParsingError(f"parsing_exception: unknown query [{kind}]")
    return f(body)


def _match(body):
    f, v = _one(body, "match")
    if isinstance(v, dict):
        return A.Match(f, str(v.get("query", v.get("value", ""))), str(v.get("operator", "or")).lower())
    return A.Match(f, str(v))


def _phrase(body):
    if not body:
        raise A.ParsingError("parsing_exception: match_phrase takes a field")
    value = lambda v: str(v.get("query", "")) if isinstance(v, dict) else str(v)
    parts = tuple(A.Phrase((f,), value(v)) for f, v in body.items())
    return parts[0] if len(parts) == 1 else A.Bool(should=parts, minimum=1)


def _phrase_prefix(body):
    f, v = _one(body, "match_phrase_prefix")
    return A.PhrasePrefix(f, str(v.get("query", "")) if isinstance(v, dict) else str(v))


TYPES = ("best_fields", "most_fields", "cross_fields", "phrase", "phrase_prefix")


def _multi(body):
    kind = body.get("type") or "best_fields"
    if kind not in TYPES:
        raise A.ParsingError(f"parsing_exception: multi_match type [{kind}]")
    if not body.get("fields"):
        raise A.ParsingError("parsing_exception: multi_match needs fields")
    return A.MultiMatch(_list(body["fields"]), str(body.get("query", "")), kind)


def _query_string(simple):
    def f(body):
        fields = body.get("fields") or body.get("default_field") or "_all"
        return A.QueryString(str(body.get("query", "")), _list(fields), simple)

    return f


def _term(body):
    f, v = _one(body, "term")
    return A.Term(f, v.get("value") if isinstance(v, dict) else v)


def _terms(body):
    f, v = _one({k: x for k, x in body.items() if k != "boost"}, "terms")
    if not isinstance(v, (list, tuple)):
        raise A.ParsingError("parsing_exception: terms takes a list")
    return A.Terms(f, tuple(v))


def _range(body):
    f, v = _one(body, "range")
    return A.Range(f, tuple((k, v[k]) for k in ("gt", "gte", "lt", "lte") if v.get(k) is not None))


def _valued(make):
    def f(body):
        field, v = _one(body, "the query")
        return make(field, str(v.get("value", v.get("query"))) if isinstance(v, dict) else str(v))

    return f


def _fuzzy(body):
    f, v = _one(body, "fuzzy")
    return A.Fuzzy(f, str(v.get("value", "")), v.get("fuzziness", "AUTO")) if isinstance(v, dict) else A.Fuzzy(f, str(v))


def _terms_set(body):
    f, v = _one(body, "terms_set")
    return A.TermsSet(f, tuple(v.get("terms", ())), int(v.get("minimum_should_match", 1)))


def _geo_distance(body):
    rest = {k: v for k, v in body.items() if k not in ("distance", "distance_type", "validation_method")}
    f, p = _one(rest, "geo_distance")
    lat, lon = point(p)
    return A.GeoDistance(f, lat, lon, metres(body["distance"]))


def _geo_box(body):
    f, v = _one(body, "geo_bounding_box")
    (top, left), (bottom, right) = point(v["top_left"]), point(v["bottom_right"])
    return A.GeoBox(f, top, left, bottom, right)


def _bool(body):
    part = lambda k: tuple(parse(x) for x in _list(body[k])) if body.get(k) else ()
    least = body.get("minimum_should_match")
    should = part("should")
    if isinstance(least, str):
        least = int(len(should) * int(least[:-1]) / 100) if least.endswith("%") else int(least)
    return A.Bool(part("must"), part("filter"), should, part("must_not"), least)


_PARSERS = {
    "match_all": lambda b: A.MatchAll(),
    "match_none": lambda b: A.MatchNone(),
    "match": _match,
    "match_phrase": _phrase,
    "match_phrase_prefix": _phrase_prefix,
    "multi_match": _multi,
    "query_string": _query_string(False),
    "simple_query_string": _query_string(True),
    "term": _term,
    "terms": _terms,
    "range": _range,
    "exists": lambda b: A.Exists(b["field"]),
    "prefix": _valued(A.Prefix),
    "wildcard": _valued(A.Wildcard),
    "regexp": _valued(A.Regexp),
    "fuzzy": _fuzzy,
    "terms_set": _terms_set,
    "geo_distance": _geo_distance,
    "geo_bounding_box": _geo_box,
    "bool": _bool,
}
