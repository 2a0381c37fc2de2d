"""Fluent request builder, free query helpers and aggregation builders; all of them make the JSON that dsl.py and aggs.py read."""

from __future__ import annotations

from . import search as S


def match_all() -> dict:
    return {"match_all": {}}


def match(field: str, query: str, operator: str | None = None) -> dict:
    return {"match": {field: {"query": query, "operator": operator} if operator else query}}


def match_phrase(field: str, query: str) -> dict:
    return {"match_phrase": {field: query}}


def match_phrase_prefix(field: str, query: str) -> dict:
    return {"match_phrase_prefix": {field: query}}


def multi_match(query: str, fields: list[str], kind: str | None = None) -> dict:
    return {"multi_match": {"query": query, "fields": list(fields), **({"type": kind} if kind else {})}}


def query_string(query: str, fields: list[str] | None = None) -> dict:
    return {"query_string": {"query": query, **({"fields": list(fields)} if fields else {})}}


def simple_query_string(query: str, fields: list[str] | None = None) -> dict:
    return {"simple_query_string": {"query": query, **({"fields": list(fields)} if fields else {})}}


def term(field: str, value) -> dict:
    return {"term": {field: value}}


def terms(field: str, values: list) -> dict:
    return {"terms": {field: list(values)}}


def range_(field: str, gte=None, lte=None, gt=None, lt=None) -> dict:
    return {"range": {field: {k: v for k, v in (("gt", gt), ("gte", gte), ("lt", lt), ("lte", lte)) if v is not None}}}


def exists(field: str) -> dict:
    return {"exists": {"field": field}}


def prefix(field: str, value: str) -> dict:
    return {"prefix": {field: value}}


def wildcard(field: str, pattern: str) -> dict:
    return {"wildcard": {field: pattern}}


def regexp(field: str, pattern: str) -> dict:
    return {"regexp": {field: pattern}}


def fuzzy(field: str, value: str, fuzziness="AUTO") -> dict:
    return {"fuzzy": {field: {"value": value, "fuzziness": fuzziness}}}


def terms_set(field: str, values: list, minimum: int) -> dict:
    return {"terms_set": {field: {"terms": list(values), "minimum_should_match": minimum}}}


def geo_distance(field: str, lat: float, lon: float, distance: str) -> dict:
    return {"geo_distance": {"distance": distance, field: {"lat": lat, "lon": lon}}}


def geo_bounding_box(field: str, top: float, left: float, bottom: float, right: float) -> dict:
    return {"geo_bounding_box": {field: {"top_left": {"lat": top, "lon": left}, "bottom_right": {"lat": bottom, "lon": right}}}}


def bool_(must=(), filter=(), should=(), must_not=(), minimum_should_match=None) -> dict:  # noqa: A002
    parts = {"must": list(must), "filter": list(filter), "should": list(should), "must_not": list(must_not)}
    body = {k: v for k, v in parts.items() if v}
    return {"bool": body | ({"minimum_should_match": minimum_should_match} if minimum_should_match is not None else {})}


class Agg:
    """One named aggregation.  sub() nests others under it."""

    def __init__(self, name: str, kind: str, **body):
        self.name, self.kind, self.body, self.subs = name, kind, {k: v for k, v in body.items() if v is not None}, []

    def sub(self, *more: "Agg") -> "Agg":
        self.subs += more
        return self

    def build(self) -> dict:
        return {self.kind: dict(self.body), **({"aggs": {a.name: a.build() for a in self.subs}} if self.subs else {})}

    def size(self, n: int) -> "Agg":
        self.body["size"] = n
        return self

    def order(self, by: str, way: str = "desc") -> "Agg":
        self.body["order"] = {by: way}
        return self

    def min_doc_count(self, n: int) -> "Agg":
        self.body["min_doc_count"] = n
        return self

    def add_range(self, start=None, stop=None, key: str | None = None) -> "Agg":
        self.body.setdefault("ranges", []).append({k: v for k, v in (("from", start), ("to", stop), ("key", key)) if v is not None})
        return self


def _metric(kind: str):
    return lambda name, field: Agg(name, kind, field=field)


avg_agg, sum_agg, min_agg, max_agg, stats_agg, cardinality_agg, value_count_agg = map(_metric, ("avg", "sum", "min", "max", "stats", "cardinality", "value_count"))


def terms_agg(name: str, field: str, size: int | None = None) -> Agg:
    return Agg(name, "terms", field=field, size=size)


def histogram_agg(name: str, field: str, interval: float) -> Agg:
    return Agg(name, "histogram", field=field, interval=interval)


def date_histogram_agg(name: str, field: str, calendar_interval: str | None = None, fixed_interval: str | None = None) -> Agg:
    return Agg(name, "date_histogram", field=field, calendar_interval=calendar_interval, fixed_interval=fixed_interval)


def range_agg(name: str, field: str) -> Agg:
    return Agg(name, "range", field=field, ranges=[])


def terms_result(response: dict, name: str) -> list[tuple]:
    """(key, doc_count) of a terms result."""
    return [(b["key"], b["doc_count"]) for b in response["aggregations"][name]["buckets"]]


def stats_result(response: dict, name: str) -> dict:
    return response["aggregations"][name]


class Search:
    """Search().match("title", "fox").page(0, 5).sort("views", "desc").run(df)"""

    def __init__(self):
        self.body: dict = {}

    def query(self, q: dict) -> "Search":
        self.body["query"] = q
        return self

    def page(self, start: int, size: int) -> "Search":
        self.body |= {"from": start, "size": size}
        return self

    def _sort(self, part: dict) -> "Search":
        self.body.setdefault("sort", []).append(part)
        return self

    def sort(self, field: str, order: str = "asc", mode: str | None = None) -> "Search":
        return self._sort({field: {"order": order, **({"mode": mode} if mode else {})}})

    def sort_geo_distance(self, field: str, lat: float, lon: float, order: str = "asc") -> "Search":
        return self._sort({"_geo_distance": {field: {"lat": lat, "lon": lon}, "order": order}})

    def sort_script(self, source: str, order: str = "asc") -> "Search":
        return self._sort({"_script": {"type": "number", "script": {"source": source}, "order": order}})

    def agg(self, *more: Agg) -> "Search":
        self.body.setdefault("aggs", {}).update({a.name: a.build() for a in more})
        return self

    def source(self, includes=(), excludes=()) -> "Search":
        self.body["_source"] = {k: list(v) for k, v in (("includes", includes), ("excludes", excludes)) if v}
        return self

    def highlight(self, *fields: str, pre: str = "<em>", post: str = "</em>") -> "Search":
        self.body["highlight"] = {"fields": {f: {} for f in fields}, "pre_tags": [pre], "post_tags": [post]}
        return self

    def track_total_hits(self, how) -> "Search":
        self.body["track_total_hits"] = how
        return self

    def suggest(self, name: str, kind: str, field: str, text: str, **options) -> "Search":
        self.body.setdefault("suggest", {})[name] = {"text": text, kind: {"field": field, **options}}
        return self

    def build(self) -> dict:
        return dict(self.body)

    def plan(self, df, mapping=None) -> S.SearchPlan:
        return S.plan(df, self.body, mapping)

    def run(self, df, mapping=None) -> dict:
        return S.search(df, self.body, mapping)

    def count(self, df, mapping=None) -> int:
        return S.count(df, self.body.get("query"), mapping)


def _chained(make):
    return lambda self, *a, **k: self.query(make(*a, **k))


for _name, _make in {"match": match, "match_phrase": match_phrase, "match_phrase_prefix": match_phrase_prefix, "multi_match": multi_match, "query_string": query_string, "simple_query_string": simple_query_string, "exists": exists, "prefix": prefix, "wildcard": wildcard, "fuzzy": fuzzy, "regexp": regexp, "match_all": match_all, "geo_distance": geo_distance, "geo_bounding_box": geo_bounding_box, "terms_set": terms_set, "term": term, "terms": terms, "range": range_, "bool": bool_}.items():
    setattr(Search, _name, _chained(_make))
