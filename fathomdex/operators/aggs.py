"""Aggregations.  Every level of a request is one groupBy over the keys above it, whatever the number of buckets; all metrics of a level share it."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ast import ParsingError
from ..plans.compile import Fields

METRICS = ("avg", "sum", "min", "max", "value_count", "cardinality", "stats")
BUCKETS = ("terms", "histogram", "date_histogram", "range")
CALENDAR = {"minute": "minute", "1m": "minute", "hour": "hour", "1h": "hour", "day": "day", "1d": "day", "week": "week", "1w": "week", "month": "month", "1M": "month", "quarter": "quarter", "1q": "quarter", "year": "year", "1y": "year"}
_FIXED = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def split(spec: dict) -> tuple[str, dict, dict]:
    """(type, body, sub-aggregations) of one aggregation; sub-aggregations may stand beside the type or inside its body."""
    subs = spec.get("aggs") or spec.get("aggregations") or {}
    kinds = [k for k in spec if k not in ("aggs", "aggregations", "meta")]
    if len(kinds) != 1:
        raise ParsingError("parsing_exception: an aggregation takes exactly one type")
    kind = kinds[0]
    if kind not in METRICS + BUCKETS:
        raise ParsingError(f"parsing_exception: unknown aggregation [{kind}]")
    body = dict(spec[kind])
    subs = subs or body.pop("aggs", None) or body.pop("aggregations", None) or {}
    if not body.get("field"):
        raise ParsingError(f"parsing_exception: [{kind}] requires field")
    return kind, body, subs


def number(fields: Fields, name: str) -> Column:
    """The field as a double; numeric strings count, anything else is missing."""
    c = fields.column(name)
    return c.cast("double") if fields.is_number(name) else c.try_cast("double")


def metric(kind: str, name: str, fields: Fields) -> Column:
    if fields.type(name) is None:
        return F.lit(0).cast("bigint") if kind in ("value_count", "cardinality") else F.max(F.lit(None).cast("double"))
    x = number(fields, name)
    if kind == "stats":
        return F.struct(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"))
    if kind == "value_count":
        return F.count(fields.column(name))
    if kind == "cardinality":
        return F.count_distinct(fields.column(name))
    return {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[kind](x)


def metrics(df: DataFrame, specs: dict[str, dict], fields: Fields) -> DataFrame:
    """All metrics of the request in one aggregate, one row."""
    return df.agg(*(metric(k, b["field"], fields).alias(n) for n, (k, b, _) in ((n, split(s)) for n, s in specs.items())))


def millis(c: Column, t: T.DataType | None) -> Column:
    """Epoch milliseconds of a timestamp, date, number (seconds below 1e12) or string."""
    if isinstance(t, T.TimestampNTZType):
        c, t = F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()), None
        return F.unix_millis(F.from_utc_timestamp(c, F.current_timezone()))
    if isinstance(t, T.NumericType):
        return F.when(F.abs(c) < 1e12, c * 1000).otherwise(c).cast("bigint")
    if isinstance(t, T.StringType):
        digits = c.try_cast("bigint")
        return F.coalesce(F.when(F.abs(digits) < 10**12, digits * 1000).otherwise(digits), F.unix_millis(c.try_cast("timestamp")))
    return F.unix_millis(c.cast("timestamp"))


def bucket_key(kind: str, body: dict, fields: Fields) -> Column:
    name = body["field"]
    if fields.type(name) is None:
        return F.lit(None).cast("string")
    c, t = fields.column(name), fields.type(name)
    if kind == "terms":
        return F.explode(F.array_distinct(c)) if fields.is_array(name) else c
    if kind == "histogram":
        step = float(body.get("interval") or 0)
        if step <= 0:
            raise ParsingError("parsing_exception: interval must be above 0")
        offset = float(body.get("offset", 0))
        return F.floor((number(fields, name) - offset) / step) * step + offset
    unit = body.get("calendar_interval") or body.get("interval")
    fixed = body.get("fixed_interval") or (unit if unit and unit not in CALENDAR else None)
    if fixed:
        m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", str(fixed))
        if not m or not int(m[1]):
            raise ParsingError(f"parsing_exception: bad interval {fixed!r}")
        step_ms = int(m[1]) * _FIXED[m[2]]
        return (F.floor(millis(c, t) / step_ms) * step_ms).cast("bigint")
    if unit is None:
        raise ParsingError("parsing_exception: date_histogram needs an interval")
    if isinstance(t, T.TimestampNTZType):
        return millis(F.date_trunc(CALENDAR[unit], c).cast("timestamp_ntz"), t)
    return F.unix_millis(F.date_trunc(CALENDAR[unit], F.timestamp_millis(millis(c, t))))


def _range_bounds(body: dict) -> list[tuple[str, float | None, float | None]]:
    text = lambda v: "*" if v is None else str(float(v))
    return [(r.get("key") or f"{text(r.get('from'))}-{text(r.get('to'))}", r.get("from"), r.get("to")) for r in body["ranges"]]


def in_range(x: Column, low, high) -> Column:
    out = x.isNotNull()
    if low is not None:
        out = out & (x >= float(low))
    if high is not None:
        out = out & (x < float(high))
    return F.coalesce(out, F.lit(False))


def ranged(df: DataFrame, body: dict, fields: Fields, subs: dict[str, dict] | None = None) -> DataFrame:
    """key, from, to, doc_count and the metrics of subs, one row for each range, empty ones too; ranges may overlap.  One aggregate over the rows."""
    x, bounds, subs = number(fields, body["field"]), _range_bounds(body), subs or {}
    rows, aggs = [], []
    for k, (key, low, high) in enumerate(bounds):
        inside = in_range(x, low, high)
        aggs.append(F.count_if(inside).alias(f"c{k}"))
        cols = [F.lit(key).alias("key"), F.lit(low).cast("double").alias("from"), F.lit(high).cast("double").alias("to"), F.col(f"c{k}").alias("doc_count")]
        for n, s in subs.items():
            kind, b, _ = split(s)
            v = F.when(inside, number(fields, b["field"]))
            f = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "value_count": F.count, "cardinality": F.count_distinct}[kind]
            aggs.append(f(v).alias(f"c{k}_{n}"))
            cols.append(F.col(f"c{k}_{n}").alias(n))
        rows.append(F.struct(*cols))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def buckets(df: DataFrame, kind: str, body: dict, fields: Fields, subs: dict[str, dict] | None = None) -> DataFrame:
    """key, doc_count and the metrics of subs for a terms, histogram or date_histogram aggregation, in its order."""
    subs = subs or {}
    keyed = df.withColumn("key", bucket_key(kind, body, fields)).where("key is not null")
    found = keyed.groupBy("key").agg(F.count("*").alias("doc_count"), *(metric(k, b["field"], fields).alias(n) for n, (k, b, _) in ((n, split(s)) for n, s in subs.items())))
    least = int(body.get("min_doc_count", 0))
    found = found.where(F.col("doc_count") >= least) if least > 1 else found
    if kind == "terms":
        return found.orderBy(*_order(body)).limit(int(body.get("size") or 10))
    return found.orderBy("key")


def _order(body: dict) -> list[Column]:
    order = body.get("order") or {"_count": "desc"}
    parts = order if isinstance(order, list) else [order]
    cols = []
    for part in parts:
        for name, way in part.items():
            c = F.col({"_count": "doc_count", "_key": "key", "_term": "key"}.get(name, f"`{name}`" if "." not in name else name))
            cols.append(c.desc_nulls_last() if str(way).lower() == "desc" else c.asc_nulls_last())
    return [*cols, F.col("key").asc()]


def terms_with_other(df: DataFrame, body: dict, fields: Fields) -> DataFrame:
    """Top terms with sum_other_doc_count, the documents of all other buckets, on every row."""
    keyed = df.select(bucket_key("terms", body, fields).alias("key")).where("key is not null")
    counts = keyed.groupBy("key").agg(F.count("*").alias("doc_count"))
    top = counts.orderBy(*_order(body)).limit(int(body.get("size") or 10))
    total = counts.agg(F.sum("doc_count").alias("__all"))
    of_top = top.agg(F.sum("doc_count").alias("__top"))
    return top.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(of_top)).select("key", "doc_count", (F.col("__all") - F.col("__top")).alias("sum_other_doc_count"))


def nested(df: DataFrame, outer: tuple[str, dict], inner: tuple[str, dict], fields: Fields) -> DataFrame:
    """Buckets within buckets: key, doc_count, sub_key, sub_doc_count.  Inner sizes hold within each outer bucket."""
    two = df.withColumn("key", bucket_key(*outer, fields)).where("key is not null").withColumn("sub_key", bucket_key(*inner, fields))
    counts = two.groupBy("key", "sub_key").agg(F.count("*").alias("sub_doc_count"))
    w = Window.partitionBy("key")
    order = [F.desc("sub_doc_count"), F.asc("sub_key")] if inner[0] == "terms" else [F.asc("sub_key")]
    # an array under an inner terms aggregation counts a document once for each element, so outer counts are taken apart
    counts = counts.withColumn("doc_count", F.sum("sub_doc_count").over(w)) if not fields.is_array(inner[1]["field"]) else counts.join(two.drop("sub_key").groupBy("key").agg(F.count("*").alias("doc_count")), "key")
    counts = counts.where("sub_key is not null").withColumn("__r", F.row_number().over(w.orderBy(*order)))
    if inner[0] == "terms":
        counts = counts.where(F.col("__r") <= int(inner[1].get("size") or 10))
    if outer[0] == "terms":
        parents = counts.select("key", "doc_count").distinct().orderBy(*_order(outer[1])).limit(int(outer[1].get("size") or 10)).select("key")
        counts = counts.join(F.broadcast(parents), "key")
    return counts.select("key", "doc_count", "sub_key", "sub_doc_count")


def filled(buckets_df: DataFrame, step: float) -> DataFrame:
    """A histogram's buckets with the empty ones between its first and last."""
    ends = buckets_df.agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a is not null")
    n = F.round((F.col("b") - F.col("a")) / step).cast("bigint")
    every = ends.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("k")).select((F.col("a") + F.col("k") * step).cast(buckets_df.schema["key"].dataType).alias("key"))
    return every.join(buckets_df, "key", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("bigint")))


def evaluate(df: DataFrame, specs: dict[str, dict], fields: Fields) -> dict:
    """The aggregations part of a response.  Metrics of one level run as one job; bucket aggregations as one each, and one for each nested level."""
    out: dict = {}
    plain = {n: s for n, s in specs.items() if split(s)[0] in METRICS}
    if plain:
        row = metrics(df, plain, fields).first()
        for n, s in plain.items():
            out[n] = row[n].asDict() if split(s)[0] == "stats" else {"value": row[n]}
    for name, spec in specs.items():
        if name not in plain:
            out[name] = _bucketed(df, spec, fields)
    return {n: out[n] for n in specs}


def _plain(v):
    return int(v) if isinstance(v, float) and v == int(v) else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def _bucketed(df: DataFrame, spec: dict, fields: Fields) -> dict:
    kind, body, subs = split(spec)
    own = {n: s for n, s in subs.items() if split(s)[0] in METRICS}
    deep = {n: s for n, s in subs.items() if n not in own}
    if kind == "range":
        simple = {n: s for n, s in own.items() if split(s)[0] != "stats"}
        rows = ranged(df, body, fields, simple).collect()
        found = []
        for r, (_, low, high) in zip(rows, _range_bounds(body)):
            b = {"key": r["key"], "doc_count": r["doc_count"], **({"from": float(low)} if low is not None else {}), **({"to": float(high)} if high is not None else {}), **{n: {"value": r[n]} for n in simple}}
            rest = {n: s for n, s in subs.items() if n not in simple}
            if rest:
                b |= evaluate(df.where(in_range(number(fields, body["field"]), low, high)), rest, fields)
            found.append(b)
        return {"buckets": found}
    rows = buckets(df, kind, body, fields, own).collect()
    found = []
    for r in rows:
        b = {"key": _plain(r["key"]), "doc_count": r["doc_count"]}
        for n, s in own.items():
            b[n] = r[n].asDict() if split(s)[0] == "stats" else {"value": r[n]}
        found.append(b)
    if deep and rows:
        keyed = df.withColumn("__key", bucket_key(kind, body, fields)).where(F.col("__key").isin([r["key"] for r in rows]))
        for n, s in deep.items():
            by = _deeper(keyed, s, fields, ["__key"])
            for r, b in zip(rows, found):
                b[n] = by.get((r["key"],), {"buckets": []})
    if kind == "terms":
        total = df.select(bucket_key(kind, body, fields).alias("key")).where("key is not null").count()
        return {"doc_count_error_upper_bound": 0, "sum_other_doc_count": total - sum(r["doc_count"] for r in rows), "buckets": found}
    return {"buckets": found}


def _deeper(df: DataFrame, spec: dict, fields: Fields, above: list[str]) -> dict:
    """A nested bucket aggregation for all parents at once: result by the parents' keys."""
    kind, body, subs = split(spec)
    own = {n: s for n, s in subs.items() if split(s)[0] in METRICS}
    deep = {n: s for n, s in subs.items() if n not in own}
    name = f"__key{len(above)}"
    if kind == "range":
        bounds = _range_bounds(body)
        x = number(fields, body["field"])
        keys = F.explode(F.filter(F.array(*(F.when(in_range(x, a, b), F.lit(k)) for k, (_, a, b) in enumerate(bounds))), lambda v: v.isNotNull()))
        keyed = df.withColumn(name, keys)
    else:
        keyed = df.withColumn(name, bucket_key(kind, body, fields)).where(F.col(name).isNotNull())
    counts = keyed.groupBy(*above, name).agg(F.count("*").alias("doc_count"), *(metric(k, b["field"], fields).alias(n) for n, (k, b, _) in ((n, split(s)) for n, s in own.items())))
    counts = counts.withColumn("key", F.col(name))
    w = Window.partitionBy(*above)
    if kind == "terms":
        counts = counts.withColumns({"__all": F.sum("doc_count").over(w), "__r": F.row_number().over(w.orderBy(*_order(body)))}).where(F.col("__r") <= int(body.get("size") or 10))
    else:
        counts = counts.withColumns({"__all": F.lit(0), "__r": F.row_number().over(w.orderBy("key"))})
    out: dict = {}
    rows = counts.orderBy(*above, "__r").collect()
    below = {n: _deeper(keyed, s, fields, [*above, name]) for n, s in deep.items()}
    for r in rows:
        parent = tuple(r[a] for a in above)
        b = {"key": _range_bounds(body)[r[name]][0] if kind == "range" else _plain(r[name]), "doc_count": r["doc_count"]}
        for n, s in own.items():
            b[n] = r[n].asDict() if split(s)[0] == "stats" else {"value": r[n]}
        for n in deep:
            b[n] = below[n].get((*parent, r[name]), {"buckets": []})
        here = out.setdefault(parent, {"doc_count_error_upper_bound": 0, "sum_other_doc_count": r["__all"], "buckets": []} if kind == "terms" else {"buckets": []})
        here["buckets"].append(b)
        if kind == "terms":
            here["sum_other_doc_count"] -= r["doc_count"]
    return out
