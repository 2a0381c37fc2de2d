"""Import and export: NDJSON bulk bodies, CSV, JSON lines, dumps and snapshots.  Rows never pass through the driver."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import mutate
from ..plans.ast import ParsingError
from . import storage


@dataclass(frozen=True)
class ImportOptions:
    """batch and retries are kept for compatibility; Spark's tasks batch and retry on their own."""

    id_field: str | None = None
    skip_header: bool = False
    delimiter: str = ","
    batch: int = 100
    retries: int = 3

    def __post_init__(self):
        if self.batch <= 0 or self.retries < 0 or len(self.delimiter) != 1:
            raise ValueError("batch must be above 0, retries not negative, the delimiter one character")


def read_csv(spark: SparkSession, path: str, options: ImportOptions = ImportOptions()) -> DataFrame:
    """Columns field_0, field_1, ... as strings, and _id from the id field if one is named."""
    df = spark.read.csv(path, header=False, sep=options.delimiter, quote='"', escape='"', multiLine=False, inferSchema=False)
    if options.skip_header:
        df = spark.read.csv(path, header=True, sep=options.delimiter, quote='"', escape='"', inferSchema=False)
    df = df.toDF(*(f"field_{k}" for k in range(len(df.columns))))
    return df.withColumn("_id", F.col(options.id_field)) if options.id_field else df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None, id_field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, broken lines).  A line that is no JSON object is set aside, not fatal."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if schema is None:
        schema = spark.read.json(path, mode="DROPMALFORMED").schema
    own = T.StructType([*(f for f in schema.fields if f.name != "_corrupt"), T.StructField("_corrupt", T.StringType())])
    parsed = lines.select("value", F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    broken = F.col("d").isNull() | F.col("d._corrupt").isNotNull()
    docs = parsed.where(~broken).select(*(F.col(f"d.`{f.name}`").alias(f.name) for f in own.fields if f.name != "_corrupt"))
    if id_field:
        docs = docs.withColumn("_id", F.col(f"`{id_field}`").cast("string"))
    return docs, parsed.where(broken).select("value")


def write_csv(df: DataFrame, path: str, fields: list[str], header: bool = True) -> None:
    """The fields as strings; a missing field or value is an empty string."""
    cols = [(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) if f in df.columns else F.lit("")).alias(f) for f in fields]
    df.select(*cols).write.csv(path, header=header, emptyValue="", quote='"', escape='"')


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(*mutate.source_of(df)).write.json(path, ignoreNullFields=False)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


_ACTION = r'^\s*\{\s*"(index|create|update|delete)"\s*:\s*\{.*\}\s*\}\s*$'


def _paired(lines: DataFrame, order: list[str]) -> DataFrame:
    """lines with `name` (of an action they look like), `following` (the next line's value in the body), `owned` (a source of the line before) and `n`, numbered from 0.

    A line that looks like no action, and one that looks like a delete, leave nobody waiting for a source; so a line is owned if an odd number of other
    actions stand right before it.  Lines are split by ranges of their order; a split knows where it last started anew and how many lines
    it has, and what it needs of the split before is one row.
    """
    spark = lines.sparkSession
    name = F.regexp_extract("value", _ACTION, 1)
    kept = lines.where(F.trim("value") != "").withColumn("name", F.when(name != "", name))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = kept.repartitionByRange(parts, "body", *order).sortWithinPartitions("body", *order).withColumn("part", F.spark_partition_id())
    ranges = storage.settled(ranges.withColumn("k", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("bigint"), 33)))
    w = Window.partitionBy("part").orderBy("k")  # a range of lines, not a key's
    new_body = (F.lag("body").over(w) != F.col("body")) & F.lag("body").over(w).isNotNull()
    marked = ranges.withColumns({
        "start": F.when(F.coalesce(new_body, F.lit(False)), F.col("k") - 1),
        "anew": F.when(F.col("name").isNull() | (F.col("name") == "delete"), F.col("k")),
        "next_value": F.lead("value").over(w), "next_body": F.lead("body").over(w),
    })
    summary = marked.groupBy("part").agg(F.count("*").alias("n"), F.max(F.greatest("start", "anew")).alias("anew"), F.min_by("body", "k").alias("first"), F.max_by("body", "k").alias("last")).orderBy("part").collect()  # a row a range
    carried, at, waiting, before = [], 0, 0, None
    for r in summary:
        waiting = waiting if r["first"] == before else 0
        carried.append((r["part"], at, waiting))
        waiting = r["n"] - 1 - r["anew"] if r["anew"] is not None else waiting + r["n"]
        at, before = at + r["n"], r["last"]
    known = spark.createDataFrame(carried, "part int, __at bigint, waiting bigint")
    after = {a["part"]: b["part"] for a, b in zip(summary, summary[1:])}
    firsts = marked.where("k = 0").select(F.col("part").alias("of"), F.col("value").alias("first_value"), F.col("body").alias("first_body"))
    chain = spark.createDataFrame(list(after.items()), "part int, of int")
    known = known.join(chain.join(firsts, "of").select("part", "first_value", "first_body"), "part", "left")
    joined = marked.join(F.broadcast(known), "part")  # a row, and one line of text, a range
    last = F.greatest(F.max("start").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max("anew").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    count = F.when(last.isNull(), F.col("waiting") + F.col("k")).otherwise(F.col("k") - 1 - last)
    is_last = F.col("next_body").isNull()
    following = F.when(~is_last & (F.col("next_body") == F.col("body")), F.col("next_value")).when(is_last & (F.col("first_body") == F.col("body")), F.col("first_value"))
    return joined.select(*lines.columns, "name", (count % 2 == 1).alias("owned"), following.alias("following"), (F.col("__at") + F.col("k")).alias("n"))


def bulk_operations(lines: DataFrame, order: str | list[str], schema: T.StructType, index: str | None = None) -> DataFrame:
    """mutate.bulk's operations from the lines of NDJSON bodies: `value`, and the column `order` that numbers them, or several.

    An action line (an object whose one key is index, create, update or delete, with an object under it) owns the next line unless it deletes.  As
    a source may look like an action, lines are paired by counting from the start: line by line within each body, a body being one value of
    the optional column `body`; bodies apply one after another, by name.
    """
    order = [order] if isinstance(order, str) else order
    several = "body" in lines.columns
    found = _paired(lines if several else lines.withColumn("body", F.lit("")), order)
    ops = found.where("name is not null and not owned")
    source = F.when(F.col("name") != "delete", F.col("following"))
    meta = F.from_json("value", "map<string,struct<_index:string,_id:string,if_seq_no:bigint,if_primary_term:bigint,version:bigint,version_type:string>>")
    ops = ops.withColumn("m", F.element_at(F.map_values(meta), 1))
    ops = ops.withColumn("doc", F.when(F.col("name") == "update", F.get_json_object(source, "$.doc")).otherwise(source))
    d = F.from_json("doc", schema)
    line = F.col("n") if several or len(order) > 1 else F.col(order[0]).cast("bigint")
    return ops.select(
        line.alias("line"), F.col("name").alias("_op"), F.coalesce("m._id", F.expr("uuid()")).alias("_id"), F.coalesce("m._index", F.lit(index)).alias("_index"),
        "m.if_seq_no", "m.if_primary_term", "m.version", "m.version_type", F.json_object_keys("doc").alias("fields"), *(d[f.name].alias(f.name) for f in schema.fields),
    )


#: What puts the lines of numbered_lines in order within a body: where their split of the file starts, and a number that rises in it.
PLACE = ["at", "line"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place, PLACE; each file is a body, read in splits like any other text."""
    return with_place(spark.read.text(path)).withColumn("line", F.monotonically_increasing_id())


def with_place(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("_metadata.file_path").alias("body"), F.col("_metadata.file_block_start").alias("at"), "value")


# dumps

_META = "__dump_meta__"


def dump(frames: dict[str, DataFrame], path: str) -> int:
    """NDJSON of {_index, _id, _source} rows, and a last row that says how many there are; returns that number."""
    out = None
    for name, df in sorted(frames.items()):
        rows = df.select(F.lit(name).alias("_index"), "_id", F.to_json(F.struct(*(F.col(f"`{c}`") for c in mutate.source_of(df))), {"ignoreNullFields": "false"}).alias("s"))
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        raise ValueError("nothing to dump")
    spark = out.sparkSession
    line = F.concat(F.lit('{"_index":'), _quoted("_index"), F.lit(',"_id":'), _quoted("_id"), F.lit(',"_source":'), "s", F.lit("}"))
    out.select(line.alias("value")).write.text(f"{path}/data")
    n = spark.read.text(f"{path}/data").count()
    schemas = {name: df.select(*mutate.source_of(df)).schema.jsonValue() for name, df in frames.items()}
    storage.write_text(spark, f"{path}/meta.json", json.dumps({_META: True, "total": n, "indices": sorted(frames), "schemas": schemas, "finished_at": int(time.time())}))
    return n


def _quoted(c: str) -> Column:
    """A string as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1)


def restore(catalog, path: str, target: str | None = None) -> int:
    """Writes a dump's rows into its indices, or all into target; returns their number, which must be the dump's."""
    spark = catalog.spark
    meta = json.loads(storage.read_text(spark, f"{path}/meta.json"))
    lines = spark.read.text(f"{path}/data").select(F.get_json_object("value", "$._index").alias("_index"), F.get_json_object("value", "$._id").alias("_id"), F.get_json_object("value", "$._source").alias("s"))
    total = 0
    for name in meta["indices"]:
        mine = lines.where(F.col("_index") == name)
        rows = mine.select("_id", F.from_json("s", T.StructType.fromJson(meta["schemas"][name])).alias("d")).select("_id", "d.*")
        to = target or name
        if not catalog.exists(to):
            catalog.create(to)
        total += mine.count()
        catalog.put(to, rows)
    if total != meta["total"]:
        raise ValueError(f"the dump has {total} rows, its meta row says {meta['total']}")
    return total


# snapshots


def snapshot(catalog, repository: str, name: str, pattern: str = "_all") -> dict:
    """Parquet of each index and _meta.json, written last: a snapshot without it does not exist."""
    if not re.fullmatch(r"[a-z0-9][a-z0-9_.\-]*", name):
        raise ParsingError(f"invalid_snapshot_name_exception: [{name}]")
    spark, base = catalog.spark, f"{catalog.location(repository)}/{name}"
    if storage.exists(spark, f"{base}/_meta.json"):
        raise ValueError(f"invalid_snapshot_name_exception: [{name}] exists")
    meta: dict = {"snapshot": name, "state": "SUCCESS", "created_at": int(time.time()), "indices": {}}
    for n in catalog.resolve(pattern):
        catalog.frame(n).write.mode("overwrite").parquet(f"{base}/{n}")
        m = catalog.meta(n)
        meta["indices"][n] = {"doc_count": spark.read.parquet(f"{base}/{n}").count(), "mappings": m.mapping.to_json(), "settings": m.settings}
    storage.write_text(spark, f"{base}/_meta.json", json.dumps(meta))
    return meta


def get_snapshot(catalog, repository: str, name: str) -> dict | None:
    repository = catalog.location(repository)
    return json.loads(storage.read_text(catalog.spark, f"{repository}/{name}/_meta.json")) if storage.exists(catalog.spark, f"{repository}/{name}/_meta.json") else None


def list_snapshots(catalog, repository: str) -> list[str]:
    repository = catalog.location(repository)
    return [n for n in storage.names(catalog.spark, repository) if storage.exists(catalog.spark, f"{repository}/{n}/_meta.json")]


def restore_snapshot(catalog, repository: str, name: str, indices: list[str] | None = None, rename=None) -> dict:
    """Replaces each index by what the snapshot has, after its row count is verified; rename maps names."""
    meta = get_snapshot(catalog, repository, name)
    if meta is None:
        raise KeyError(f"snapshot_missing_exception: [{name}]")
    done = {}
    for n, m in meta["indices"].items():
        if indices is not None and n not in indices:
            continue
        df = catalog.spark.read.parquet(f"{catalog.location(repository)}/{name}/{n}")
        count = df.count()
        if count != m["doc_count"]:
            raise ValueError(f"snapshot_restore_exception: [{n}] has {count} rows, not {m['doc_count']}")
        to = rename(n) if rename else n
        if to not in catalog.indices:
            catalog.create(to, {"mappings": m["mappings"], "settings": m["settings"]})
        catalog.write(to, df)
        done[to] = count
    return done


def delete_snapshot(catalog, repository: str, name: str) -> bool:
    there = get_snapshot(catalog, repository, name) is not None
    if there:
        storage.remove(catalog.spark, f"{catalog.location(repository)}/{name}")
    return there
