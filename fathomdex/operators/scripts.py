"""Update scripts and ingest pipelines as columns.  Only the statements named here exist; nothing is evaluated as code."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ast import ParsingError

_SET = re.compile(r"ctx\._source\.([A-Za-z_][\w.\-]*)\s*(\+?=)\s*(.+)", re.S)
_REMOVE = re.compile(r"ctx\._source\.remove\(\s*(['\"])([^'\"]+)\1\s*\)")


def _statements(source: str) -> list[str]:
    """Split at semicolons outside quotes."""
    return [s for s in (m.strip() for m in re.findall(r"(?:'[^']*'|\"[^\"]*\"|[^;'\"])+", source)) if s]


def literal(raw: str):
    raw = raw.strip()
    if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "'\"":
        return raw[1:-1]
    try:
        return json.loads(raw)
    except ValueError:
        raise ParsingError(f"script_exception: unsupported literal {raw!r}") from None


def parse(script: dict | str) -> list[tuple[str, str, object]]:
    """(set | inc | remove, field, value) of each statement of a script."""
    source = script if isinstance(script, str) else script.get("source") or script.get("inline") or ""
    out: list[tuple[str, str, object]] = []
    for s in _statements(source):
        if m := _REMOVE.fullmatch(s):
            out.append(("remove", m[2], None))
        elif m := _SET.fullmatch(s):
            v = literal(m[3])
            if m[2] == "+=" and (isinstance(v, bool) or not isinstance(v, (int, float))):
                raise ParsingError(f"script_exception: += takes a number, not {m[3]!r}")
            out.append(("inc" if m[2] == "+=" else "set", m[1], v))
        else:
            raise ParsingError(f"script_exception: unsupported statement {s!r}")
    if not out:
        raise ParsingError("script_exception: empty script")
    return out


def value_column(v) -> Column:
    if isinstance(v, dict):
        return F.struct(*(value_column(x).alias(k) for k, x in v.items()))
    if isinstance(v, list):
        return F.array(*map(value_column, v))
    return F.lit(v)


def _assign(df: DataFrame, path: str, make, where: Column) -> DataFrame:
    """df with path set to make(old value) on rows of where; structs on the way are made if they are missing."""
    head, *rest = path.split(".")
    old_type = df.schema[head].dataType if head in df.columns else None
    old = F.col(f"`{head}`") if old_type is not None else F.lit(None)

    def into(c: Column, t: T.DataType | None, rest: list[str]) -> Column:
        if not rest:
            return make(c, t)
        inner_t = next((f.dataType for f in t.fields if f.name == rest[0]), None) if isinstance(t, T.StructType) else None
        inner = into(c[rest[0]] if inner_t is not None else F.lit(None), inner_t, rest[1:])
        if not isinstance(t, T.StructType):
            return F.struct(inner.alias(rest[0]))
        others = [c[f.name].alias(f.name) for f in t.fields if f.name != rest[0]]
        return F.struct(*others, inner.alias(rest[0]))

    new = into(old, old_type, rest)
    if old_type is None:
        return df.withColumn(head, F.when(where, new))
    if isinstance(old_type, T.StructType) and rest:
        # both branches need one type: rows outside where get the same fields, with what they had
        same = into_same(old, old_type, rest, new, df, head, where)
        return df.withColumn(head, same)
    kept = old
    new_type = df.select(new.alias("x")).schema["x"].dataType
    if new_type != old_type and not isinstance(new_type, T.NullType):
        if isinstance(new_type, T.NumericType) and isinstance(old_type, T.NumericType):
            wide = old_type if isinstance(old_type, (T.DoubleType, T.FloatType)) else T.DoubleType() if isinstance(new_type, (T.DoubleType, T.FloatType, T.DecimalType)) else T.LongType()
            kept, new = old.cast(wide), new.cast(wide)
        else:
            kept, new = old.cast("string"), new.cast("string")
    return df.withColumn(head, F.when(where, new).otherwise(kept))


def into_same(old: Column, t: T.StructType, rest: list[str], new: Column, df: DataFrame, head: str, where: Column) -> Column:
    """The struct after a nested assignment, with the assigned leaf chosen row by row."""
    made = df.select(new.alias("x")).schema["x"].dataType

    def merge(a: Column, at: T.DataType | None, b: Column, bt: T.DataType, path: list[str]) -> Column:
        if not path:
            if at is None or at == bt:
                return F.when(where, b).otherwise(a if at is not None else F.lit(None).cast(bt))
            wide = "double" if isinstance(at, T.NumericType) and isinstance(bt, T.NumericType) else "string"
            return F.when(where, b.cast(wide)).otherwise(a.cast(wide))
        fields = []
        known = {f.name: f.dataType for f in at.fields} if isinstance(at, T.StructType) else {}
        for f in bt.fields:
            x = a[f.name] if f.name in known else None
            if f.name == path[0]:
                fields.append(merge(x, known.get(f.name), b[f.name], f.dataType, path[1:]).alias(f.name))
            else:
                fields.append((x if x is not None else F.lit(None).cast(f.dataType)).alias(f.name))
        return F.when(where | a.isNotNull(), F.struct(*fields)) if isinstance(at, T.StructType) else F.when(where, F.struct(*fields))

    return merge(old, t, new, made, rest)


def apply(df: DataFrame, script: dict | str, where: Column | None = None) -> DataFrame:
    """df with the script run on the rows of where (all by default).  A field removed everywhere stays as a column of nulls."""
    (flag,) = [n for n in ("__hit", "__hit_", "__hit__") if n not in df.columns][:1]
    out = df.withColumn(flag, F.lit(True) if where is None else where)  # tested once, before any statement changes a field
    hit = F.col(flag)
    for kind, name, v in parse(script):
        if kind == "set":
            out = _assign(out, name, lambda c, t, v=v: F.lit(None).cast(t) if v is None and t is not None else value_column(v), hit)
        elif kind == "inc":
            out = _assign(out, name, lambda c, t, v=v: F.coalesce(c + F.lit(v), F.lit(v)) if isinstance(t, T.NumericType) else F.lit(v), hit)
        elif "." in name:
            out = _assign(out, name, lambda c, t: F.lit(None).cast(t if t is not None else "string"), hit)
        elif name in out.columns:
            out = out.withColumn(name, F.when(~hit, F.col(f"`{name}`")))
    return out.drop(flag)


def run_pipeline(df: DataFrame, pipeline: dict) -> DataFrame:
    """An ingest pipeline over all rows: its set and rename processors in order; a rename of a field that is not there does nothing."""
    for p in pipeline.get("processors") or []:
        (kind, o), = p.items()
        if kind == "set":
            df = df.withColumn(o["field"], value_column(o.get("value")))
        elif kind == "rename":
            if o["field"] in df.columns and o["field"] != o["target_field"]:
                df = df.drop(o["target_field"]).withColumnRenamed(o["field"], o["target_field"])
        else:
            raise ParsingError(f"parsing_exception: unknown processor [{kind}]")
    return df
