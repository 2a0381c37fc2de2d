"""Mappings: declared types to Spark types, and validation of documents as one column that says what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ast import ParsingError

_TEXTUAL = ("text", "keyword", "date", "ip", "geo_point")
_NUMERIC = {"byte": T.ByteType(), "short": T.ShortType(), "integer": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "scaled_float": T.DoubleType()}
TYPES = (*_TEXTUAL, *_NUMERIC, "boolean", "object", "nested")


class Mapping:
    """properties: declared type by field; dynamic: true, false or strict.  Unknown declared types are not validated."""

    def __init__(self, body: dict | None = None):
        body = body or {}
        body = body.get("mappings", body)
        d = body.get("dynamic", True)
        self.dynamic = {True: "true", False: "false"}.get(d, str(d)) if isinstance(d, bool) else str(d)
        if self.dynamic not in ("true", "false", "strict"):
            raise ParsingError(f"mapper_parsing_exception: dynamic [{d}]")
        self.properties = {f: (p.get("type") or ("object" if "properties" in p else None)) for f, p in (body.get("properties") or {}).items()}

    def to_json(self) -> dict:
        return {"dynamic": self.dynamic, "properties": {f: {"type": t} for f, t in self.properties.items()}}

    def text_types(self) -> dict[str, str]:
        """What search needs: which strings are not analysed text."""
        return {f: t for f, t in self.properties.items() if t in TYPES}

    def spark_type(self, field: str) -> T.DataType:
        t = self.properties.get(field)
        if t in _NUMERIC:
            return _NUMERIC[t]
        return {"boolean": T.BooleanType(), "date": T.TimestampType(), "object": T.MapType(T.StringType(), T.StringType()), "nested": T.ArrayType(T.MapType(T.StringType(), T.StringType())), "geo_point": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])}.get(t, T.StringType())

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f, self.spark_type(f)) for f in self.properties])

    def unknown_fields(self, columns) -> list[str]:
        return [c for c in columns if c not in self.properties and not c.startswith("_")]

    def problem(self, df: DataFrame) -> Column:
        """Null for a valid row, else the first field's trouble; strict mappings also refuse a value under a field that is not declared."""
        tests = [F.when(~_accepts(F.col(f"`{f}`"), df.schema[f].dataType, t), F.lit(f"mapper_parsing_exception: failed to parse field [{f}] of type [{t}]")) for f, t in self.properties.items() if f in df.columns and t in TYPES]
        if self.dynamic == "strict":
            tests += [F.when(F.col(f"`{c}`").isNotNull(), F.lit(f"mapper_parsing_exception: strict mapping does not allow [{c}]")) for c in self.unknown_fields(df.columns)]
        return F.coalesce(*tests) if tests else F.lit(None).cast("string")

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(valid rows, rejected rows with their _error)."""
        marked = df.withColumn("_error", self.problem(df))
        return marked.where("_error is null").drop("_error"), marked.where("_error is not null")


def _accepts(c: Column, have: T.DataType, want: str) -> Column:
    """Whether a value of its JSON kind suits the declared type; null suits all."""
    if isinstance(have, T.ArrayType) and want != "nested":
        return F.coalesce(F.forall(c, lambda x: _accepts(x, have.elementType, want)), F.lit(True))
    if want in _TEXTUAL:
        ok = isinstance(have, (T.StringType, T.NullType)) or want == "date" and isinstance(have, (T.TimestampType, T.TimestampNTZType, T.DateType)) or want == "geo_point" and isinstance(have, T.StructType)
    elif want in _NUMERIC:
        ok = isinstance(have, (T.NumericType, T.BooleanType, T.NullType))
    elif want == "boolean":
        if isinstance(have, T.StringType):
            return c.isNull() | c.isin("true", "false")
        ok = isinstance(have, (T.BooleanType, T.NullType))
    else:
        ok = isinstance(have, (T.StructType, T.MapType, T.NullType)) or want == "nested" and isinstance(have, T.ArrayType)
    return F.lit(True) if ok else c.isNull()
