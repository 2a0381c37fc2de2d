"""A search request as one plan: matching, scoring, sorting, paging, highlighting and source filtering stay one DataFrame until its page is taken."""

from __future__ import annotations

import fnmatch
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..operators import aggs, highlight, scoring, suggest
from . import ast as A
from . import compile as C
from . import dsl

#: Total hits are counted up to this number unless a request asks for more.
TRACKED = 10_000
META = ("_index", "_id", "_score", "_seq_no", "_primary_term", "_version")


def identified(df: DataFrame, key: str | None = None, index: str | None = None) -> DataFrame:
    """df with _id, the key column as a string, and _index, where it lacks them."""
    if "_id" not in df.columns:
        if key is None:
            raise ValueError("an index needs an _id column or a key")
        df = df.withColumn("_id", F.col(f"`{key}`").cast("string"))
    return df if "_index" in df.columns or index is None else df.withColumn("_index", F.lit(index))


def source_columns(df: DataFrame, spec) -> list[str]:
    """Columns of _source: all, none, or those that patterns include and do not exclude."""
    own = [c for c in df.columns if c not in META]
    if spec is None or spec is True:
        return own
    if spec is False:
        return []
    if isinstance(spec, dict):
        inc, exc = (spec.get(k) or spec.get(k[:-1]) or [] for k in ("includes", "excludes"))
    else:
        inc, exc = spec, []
    inc, exc = ([x] if isinstance(x, str) else list(x) for x in (inc, exc))
    hit = lambda c, patterns: any(fnmatch.fnmatchcase(c, p) for p in patterns)
    return [c for c in own if (not inc or hit(c, inc)) and not hit(c, exc)]


_SCRIPT = re.compile(r"doc\[['\"](\w+)['\"]\]\.value|(\d+(?:\.\d+)?)|([-+*/%()])|\s+")


def script_column(source: str, fields: C.Fields) -> Column:
    """Arithmetic over doc['field'].value; anything else raises."""
    at, out = 0, []
    while at < len(source):
        m = _SCRIPT.match(source, at)
        if not m or m[1] and fields.type(m[1]) is None:
            raise A.ParsingError(f"parsing_exception: unsupported script {source!r}")
        out.append(f"`{m[1]}`" if m[1] else f"{m[2]}D" if m[2] else m[3] or " ")
        at = m.end()
    return F.expr("".join(out))


def _of_array(c: Column, mode: str) -> Column:
    ordered, n = F.array_sort(F.filter(c, lambda x: x.isNotNull())), F.size(F.filter(c, lambda x: x.isNotNull()))
    total = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x)
    pick = {
        "min": lambda: F.array_min(c),
        "max": lambda: F.array_max(c),
        "sum": lambda: F.when(n > 0, total),
        "avg": lambda: F.when(n > 0, total / n),
        "median": lambda: F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2),
    }
    if mode not in pick:
        raise A.ParsingError(f"parsing_exception: sort mode [{mode}]")
    return pick[mode]()


def sort_columns(spec, fields: C.Fields) -> list[tuple[Column, bool]]:
    """(column, descending) of each key, the first one foremost."""
    out = []
    for part in spec if isinstance(spec, (list, tuple)) else [spec]:
        for name, how in ({part: {}} if isinstance(part, str) else part).items():
            how = {"order": how} if isinstance(how, str) else dict(how)
            down = str(how.pop("order", "desc" if name == "_score" else "asc")).lower() == "desc"
            if name == "_geo_distance":
                how = {k: v for k, v in how.items() if k not in ("unit", "mode", "distance_type", "ignore_unmapped")}
                f, p = next(iter(how.items()))
                c = geo.haversine(*C.geo_columns(f, fields), *dsl.point(p))
            elif name == "_script":
                s = how["script"]
                c = script_column(s["source"] if isinstance(s, dict) else s, fields)
            elif name in ("_score", "_id", "_index", "_doc"):
                c = F.col("_id" if name == "_doc" else name)
            elif fields.type(name) is None:
                continue
            else:
                c = fields.column(name)
                if fields.is_array(name):
                    c = _of_array(c, how.get("mode") or ("max" if down else "min"))
            out.append((c, down))
    return out


@dataclass
class SearchPlan:
    """The parts of a request, none of them run."""

    matched: DataFrame
    hits: DataFrame
    fields: C.Fields
    node: A.Node
    size: int
    body: dict = field(default_factory=dict)
    base: DataFrame | None = None

    def total(self) -> tuple[int, str]:
        """(value, relation) under track_total_hits: true or a number below 1 counts all, a number N or the default up to that many."""
        t = self.body.get("track_total_hits")
        if t is True or isinstance(t, int) and not isinstance(t, bool) and t <= 0:
            return self.matched.count(), "eq"
        most = t if isinstance(t, int) and not isinstance(t, bool) else TRACKED
        n = self.matched.limit(most + 1).count()
        return (most, "gte") if n > most else (n, "eq")


def plan(df: DataFrame, body: dict | None = None, mapping: dict[str, str] | None = None, postings=None) -> SearchPlan:
    """df: an index with _id, or the union of several with _index too; postings: its inverted index, if it has one, which is used where it can answer.

    Aggregations and suggestions are over all matching documents and all documents; only hits are paged.  Without a sort, hits come by score if the
    query scores, then by _index and _id; these also break ties of a sort, and missing values come last.
    """
    body = dict(body or {})
    unknown = set(body) - {"query", "from", "size", "sort", "_source", "aggs", "aggregations", "highlight", "track_total_hits", "suggest", "timeout", "track_scores"}
    if unknown:
        raise A.ParsingError(f"parsing_exception: unknown key {sorted(unknown)}")
    start, size = int(body.get("from") or 0), int(10 if body.get("size") is None else body["size"])
    if start < 0 or size < 0:
        raise A.ParsingError("parsing_exception: from and size must not be negative")
    fields = C.Fields(df, mapping)
    node = dsl.parse(body.get("query"))
    matched = df.where(C.compile(node, fields))
    if postings is not None and postings.answers(node, fields):
        scored = postings.matching_scored(df, node, fields)
        matched = scored.drop("_score")
    else:
        scored = scoring.matching_scored(df, node, fields) if scoring.is_text_query(node) else matched.withColumn("_score", F.lit(1.0))
    keys = sort_columns(body["sort"], fields) if body.get("sort") else [(F.col("_score"), True)] if scoring.is_text_query(node) else []
    ties = [F.col(c) for c in ("_index", "_id") if c in df.columns]
    hits = scored.orderBy(*(c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in keys), *ties)
    if start:
        hits = hits.offset(start)
    hits = hits.limit(size)
    shown = [c for c in ("_index", "_id", "_score") if c in hits.columns] + [F.col(f"`{c}`") for c in source_columns(df, body.get("_source"))]
    if body.get("highlight"):
        shown.append(highlight.highlight_map(node, body["highlight"], fields).alias("highlight"))
    return SearchPlan(matched, hits.select(*shown), fields, node, size, body, df)


def _json(v):
    if isinstance(v, T.Row):
        return {k: _json(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [_json(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else v


def search(df: DataFrame, body: dict | None = None, mapping: dict[str, str] | None = None, postings=None) -> dict:
    """The response: took, hits, and aggregations and suggestions if asked for.  At most a page of rows and the buckets come to the driver."""
    began, p = time.monotonic(), plan(df, body, mapping, postings)
    value, relation = p.total()
    found = []
    for r in p.hits.collect() if p.size else ():
        row = r.asDict()
        h = {k: row.pop(k) for k in ("_index", "_id", "_score") if k in row}
        marks = row.pop("highlight", None) if p.body.get("highlight") else None
        h["_source"] = {k: _json(v) for k, v in row.items()}
        if p.body.get("_source") is False:
            del h["_source"]
        found.append(h | ({"highlight": marks} if marks else {}))
    best = max((h["_score"] for h in found), default=None)
    out = {"took": 0, "timed_out": False, "_shards": {"total": 1, "successful": 1, "skipped": 0, "failed": 0}, "hits": {"total": {"value": value, "relation": relation}, "max_score": best, "hits": found}}
    specs = p.body.get("aggs") or p.body.get("aggregations")
    if specs:
        out["aggregations"] = aggs.evaluate(p.matched, specs, p.fields)
    if p.body.get("suggest"):
        out["suggest"] = {n: [{"text": p.body["suggest"].get(n, {}).get("text", p.body["suggest"].get("text", "")), "options": [x.asDict() for x in s.collect()]}] for n, s in suggest.suggest(_dictionary_of(df, postings, p.body["suggest"]), p.body["suggest"]).items()}
    out["took"] = int((time.monotonic() - began) * 1000)
    return out


def _dictionary_of(df: DataFrame, postings, body: dict):
    named = {o["field"] for s in body.values() if isinstance(s, dict) for o in s.values() if isinstance(o, dict) and "field" in o}
    return postings if postings is not None and named <= set(postings.fields) else df


def count(df: DataFrame, query: dict | None = None, mapping: dict[str, str] | None = None) -> int:
    return df.where(C.compile(dsl.parse(query), C.Fields(df, mapping))).count()


def scroll(df: DataFrame, body: dict | None = None, mapping: dict[str, str] | None = None, size: int = 1000):
    """All hits in _id order, page by page.  They are sorted once, into the shared folder, as they are at the start; a page is then read from there."""
    from ..sources import storage

    body = {k: v for k, v in (body or {}).items() if k not in ("from", "size", "sort")}
    p = plan(df, body | {"size": 0}, mapping)
    rows = storage.settled(p.matched.select("_id", *(F.col(f"`{c}`") for c in source_columns(df, body.get("_source")) if c != "_id")).orderBy("_id"))
    page = []
    for r in rows.toLocalIterator():  # one partition at a time
        page.append(r)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


class ResultCache:
    """Responses by request, the least recently used dropped first; a write to an index drops its entries."""

    def __init__(self, capacity: int = 1000, max_bytes: int = 64 << 10):
        self.capacity, self.max_bytes, self.entries = capacity, max_bytes, {}

    @staticmethod
    def key(indices, body) -> str:
        import hashlib
        import json

        return hashlib.sha1(json.dumps([sorted(indices), body], sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str):
        if key in self.entries:
            self.entries[key] = self.entries.pop(key)
            return self.entries[key][1]
        return None

    def put(self, key: str, indices, response: dict) -> None:
        import json

        if len(json.dumps(response, default=str)) <= self.max_bytes:
            self.entries.pop(key, None)
            self.entries[key] = (frozenset(indices), response)
            while len(self.entries) > self.capacity:
                self.entries.pop(next(iter(self.entries)))

    def invalidate(self, index: str) -> None:
        self.entries = {k: v for k, v in self.entries.items() if index not in v[0]}


__all__ = ["SearchPlan", "ResultCache", "count", "identified", "plan", "scroll", "search"]
