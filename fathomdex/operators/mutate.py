"""Writes as plans over immutable DataFrames: each takes an index's rows and gives its rows afterwards.

An index's rows have _id and, once written through here, _seq_no, _primary_term and _version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import dsl
from ..plans.compile import Fields, compile, holds
from . import scripts

VERSIONS = {"_seq_no": "bigint", "_primary_term": "bigint", "_version": "bigint"}
#: Controls of a bulk row beside its source.
CONTROLS = {"line": "bigint", "_op": "string", "_id": "string", "if_seq_no": "bigint", "if_primary_term": "bigint", "version": "bigint", "version_type": "string", "fields": "array<string>"}


def versioned(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(1).cast(t) for c, t in VERSIONS.items() if c not in df.columns})


def source_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in VERSIONS and c not in ("_id", "_index")]


def aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with all fields of either; where types differ, numbers widen and anything else becomes a string."""
    ta, tb = ({f.name: f.dataType for f in x.schema.fields} for x in (a, b))

    def widest(x: T.DataType | None, y: T.DataType | None) -> T.DataType:
        if x is None or isinstance(x, T.NullType):
            return y
        if y is None or isinstance(y, T.NullType) or x == y:
            return x
        if isinstance(x, T.NumericType) and isinstance(y, T.NumericType):
            return T.DoubleType() if any(isinstance(t, (T.FractionalType,)) for t in (x, y)) else T.LongType()
        return T.StringType()

    names = [*ta, *(c for c in tb if c not in ta)]
    kinds = {c: widest(ta.get(c), tb.get(c)) for c in names}
    cast = lambda df, t: df.select(*((F.col(f"`{c}`") if c in t else F.lit(None)).cast(kinds[c]).alias(c) for c in names))
    return cast(a, ta), cast(b, tb)


def upsert(base: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """base with changes written over it by _id; of several changes to one _id the last in order counts, and each counts as a write.  One shuffle."""
    new = changes.withColumn("__n", F.col(order).cast("bigint") + 1 if order else F.lit(1).cast("bigint"))
    if order and order not in base.columns:
        new = new.drop(order)
    a, b = aligned(versioned(base).withColumn("__n", F.lit(None).cast("bigint")), new.drop(*[c for c in VERSIONS if c in new.columns]))
    w = Window.partitionBy("_id")
    every = a.unionByName(b).withColumns({"__writes": F.count("__n").over(w), "__seq": F.max("_seq_no").over(w), "__ver": F.max("_version").over(w), "__term": F.max("_primary_term").over(w)})
    last = every.withColumn("__r", F.row_number().over(w.orderBy(F.col("__n").desc_nulls_last()))).where("__r = 1")
    bump = lambda c: (F.coalesce(F.col(c), F.lit(0)) + F.col("__writes")).cast("bigint")
    return last.withColumns({"_seq_no": bump("__seq"), "_version": bump("__ver"), "_primary_term": F.coalesce("__term", F.lit(1)).cast("bigint")}).drop("__n", "__writes", "__seq", "__ver", "__term", "__r")


def partial_update(base: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base with each patch row's fields set on the document of its _id, _ids that are not there).

    The patch's column `fields` (array of names) says which fields a row sets, null ones included; without it a row sets all its non-null ones.
    """
    names = [c for c in source_of(patch) if c != "fields"]
    a, b = aligned(base, patch.drop("fields"))
    has = "fields" in patch.columns
    p = b.select("_id", F.struct(*(F.col(f"`{c}`") for c in names)).alias("__p")) if not has else aligned(base, patch)[1].select("_id", F.struct(*(F.col(f"`{c}`") for c in names), "fields").alias("__p"))
    joined = a.join(p, "_id", "left")

    def new(c: str) -> Column:
        given = F.col("__p")[c]
        present = F.array_contains(F.col("__p.fields"), c) if has else given.isNotNull()
        return F.when(F.coalesce(present, F.lit(False)), given).otherwise(F.col(f"`{c}`"))

    out = joined.withColumns({c: new(c) for c in names}).drop("__p")
    return out.select(*a.columns), patch.select("_id").join(base.select("_id"), "_id", "left_anti")


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("_id"), "_id", "left_anti")


def delete_by_query(base: DataFrame, query: dict | None, mapping: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row of total, deleted)."""
    hit = holds(dsl.parse(query), Fields(base, mapping))
    return base.where(~hit), base.agg(F.count_if(hit).alias("total"), F.count_if(hit).alias("deleted"))


def update_by_query(base: DataFrame, query: dict | None, script: dict | str, mapping: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows, matching ones changed by the script and a version on; one row of total, updated)."""
    hit = holds(dsl.parse(query), Fields(base, mapping))
    marked = base.withColumn("__u", hit)
    out = scripts.apply(marked, script, F.col("__u"))
    bump = {c: F.col(c) + F.col("__u").cast("bigint") for c in ("_seq_no", "_version") if c in base.columns}
    return out.withColumns(bump).drop("__u"), base.agg(F.count_if(hit).alias("total"), F.count_if(hit).alias("updated"))


def reindex(source: DataFrame, dest: DataFrame | None = None, query: dict | None = None, script=None, pipeline: dict | None = None, max_docs: int | None = None, sort=None, op_type: str = "index", mapping: dict | None = None) -> DataFrame:
    """dest's rows with the source's matching rows written over them; op_type create leaves those that are there."""
    fields = Fields(source, mapping)
    rows = source.where(compile(dsl.parse(query), fields)).drop("_index", *[c for c in VERSIONS if c in source.columns])
    if max_docs is not None:
        from ..plans.search import sort_columns

        keys = [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in sort_columns(sort, fields)] if sort else []
        rows = rows.orderBy(*keys, "_id").limit(max_docs)
    if script:
        rows = scripts.apply(rows, script)
    if pipeline:
        rows = scripts.run_pipeline(rows, pipeline)
    if dest is None:
        return versioned(rows)
    if op_type == "create":
        rows = rows.join(dest.select("_id"), "_id", "left_anti")
    return upsert(dest, rows)


def bulk(base: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows afterwards, one result per operation: line, _op, _id, status, error).

    ops: CONTROLS, of which line, _op (index, create, update, delete) and _id must be there, and the source's fields.  Operations on one _id apply in line
    order, each to what those before it left, under optimistic concurrency: create of what exists, a sequence number or term that is not the current
    one, and an older version conflict (409); update and delete of what is not there are 404.  update sets the fields named by `fields`, or its non-null ones.
    One shuffle of the index and the operations by _id.
    """
    missing = {c: F.lit(None).cast(t) for c, t in CONTROLS.items() if c not in ops.columns}
    ops = ops.withColumns(missing)
    names = [c for c in ops.columns if c not in CONTROLS]
    a, b = aligned(versioned(base).drop("_index"), ops.select("_id", *names))
    kinds = {f.name: f.dataType for f in b.schema.fields}
    fields = [c for c in a.columns if c not in VERSIONS and c != "_id"]
    kinds |= {f.name: f.dataType for f in a.schema.fields}
    col = lambda c: F.col(f"`{c}`") if c in ops.columns else F.lit(None)
    op = F.struct("line", "_op", "if_seq_no", "if_primary_term", "version", "version_type", "fields", *(col(c).cast(kinds[c]).alias(f"f_{c}") for c in fields))
    grouped = ops.groupBy("_id").agg(F.array_sort(F.collect_list(op), lambda x, y: F.when(x["line"] < y["line"], -1).when(x["line"] > y["line"], 1).otherwise(0)).alias("__ops"))
    joined = a.withColumn("__there", F.lit(True)).join(grouped, "_id", "full_outer")
    result = "array<struct<line:bigint,_op:string,status:int,error:string>>"
    start = F.struct(
        F.coalesce("__there", F.lit(False)).alias("exists"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in VERSIONS),
        *(F.col(f"`{c}`").alias(f"f_{c}") for c in fields),
        F.array().cast(result).alias("results"),
    )

    def step(s: Column, o: Column) -> Column:
        there, kind = s["exists"], o["_op"]
        external = F.coalesce(o["version_type"], F.lit("internal"))
        given = o["version"].isNotNull()
        differs = lambda want, have: want.isNotNull() & (~there | (want != have))
        older = there & ((external == "external_gte") & (o["version"] < s["_version"]) | (external == "internal") & (o["version"] > 0) & (o["version"] <= s["_version"]))
        conflict = (kind == "create") & there | differs(o["if_seq_no"], s["_seq_no"]) | differs(o["if_primary_term"], s["_primary_term"]) | F.coalesce(older, F.lit(False))
        invalid = ~kind.isin("index", "create", "update", "delete") | ~external.isin("internal", "external", "external_gte") | external.isin("external", "external_gte") & F.coalesce(o["version"] <= 0, F.lit(True))
        absent = kind.isin("update", "delete") & ~there
        status = F.when(invalid, 400).when(absent, 404).when(conflict, 409).when(kind.isin("index", "create") & ~there, 201).otherwise(200)
        error = F.when(invalid, "illegal_argument_exception").when(absent, "document_missing_exception").when(conflict, "version_conflict_engine_exception")
        ok = status < 300

        def value(c: str) -> Column:
            old, new = s[f"f_{c}"], o[f"f_{c}"]
            named = F.coalesce(F.array_contains(o["fields"], c), new.isNotNull())
            return F.when(~ok, old).when(kind == "update", F.when(named, new).otherwise(old)).when(kind == "delete", F.lit(None).cast(kinds[c])).otherwise(new)

        version = F.when(given & (o["version"] > 0), o["version"]).otherwise(s["_version"] + 1)
        return F.struct(
            F.when(ok, kind != "delete").otherwise(there).alias("exists"),
            F.when(ok, s["_seq_no"] + 1).otherwise(s["_seq_no"]).alias("_seq_no"),
            F.when(ok, F.coalesce(o["if_primary_term"], F.greatest(s["_primary_term"], F.lit(1).cast("bigint")))).otherwise(s["_primary_term"]).alias("_primary_term"),
            F.when(ok, version).otherwise(s["_version"]).alias("_version"),
            *(value(c).alias(f"f_{c}") for c in fields),
            F.concat(s["results"], F.array(F.struct(o["line"].alias("line"), kind.alias("_op"), status.alias("status"), error.alias("error")))).cast(result).alias("results"),
        )

    done = joined.select("_id", F.aggregate(F.coalesce("__ops", F.array().cast(grouped.schema["__ops"].dataType)), start, step).alias("s"))
    after = done.where("s.exists").select("_id", *(F.col("s")[f"f_{c}"].alias(c) for c in fields), *(F.col("s")[c].alias(c) for c in VERSIONS))
    results = done.where(F.size("s.results") > 0).select("_id", F.explode("s.results").alias("r")).select("r.line", "r._op", "_id", "r.status", "r.error")
    return after, results
