"""Catalog, writes, scripts, mappings, files, lifecycle and streams."""

import datetime as dt
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomdex import cli
from fathomdex.operators import lifecycle, mutate, scoring, scripts, suggest
from fathomdex.operators.mapping import Mapping
from fathomdex.plans import builder as B
from fathomdex.plans import dsl
from fathomdex.plans.ast import ParsingError
from fathomdex.plans.compile import Fields
from fathomdex.sources import files
from fathomdex.sources.catalog import Catalog, Conflict, Missing
from fathomdex.streaming import ingest


@pytest.fixture()
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture()
def base(spark):
    return spark.createDataFrame([("1", "a", 10), ("2", "b", 20), ("3", "c", None)], "_id string, s string, v int")


def test_patterns_and_aliases(catalog, spark):
    df = spark.createDataFrame([("1", "v")], "_id string, k string")
    for n in ("idx_a1", "idx_a2", "idx_b1", "other"):
        catalog.create(n, None, df)
    assert catalog.resolve("idx_*") == ["idx_a1", "idx_a2", "idx_b1"] and catalog.resolve("*1") == ["idx_a1", "idx_b1"]
    assert catalog.resolve("idx_*,-idx_a*") == ["idx_b1"] and catalog.resolve("-other,*") == ["idx_a1", "idx_a2", "idx_b1"] and len(catalog.resolve()) == 4
    assert catalog.resolve("*dx*b*") == ["idx_b1"]
    with pytest.raises(Missing):
        catalog.resolve("nope")
    catalog.add_alias("both", "idx_a1", filter=B.term("k", "w"))
    catalog.add_alias("both", "idx_a2", is_write_index=True)
    assert catalog.count("both") == 1 and catalog.count("both,idx_a1") == 2 and catalog.write_index("both") == "idx_a2"
    catalog.switch_alias("both", "idx_a1", "idx_b1")
    assert catalog.resolve("both") == ["idx_a2", "idx_b1"]
    with pytest.raises(Missing):
        catalog.update_aliases([{"add": {"alias": "both", "index": "other"}}, {"remove": {"alias": "none", "index": "other"}}])
    assert catalog.resolve("both") == ["idx_a2", "idx_b1"]
    for bad in ("_x", "", "a/b", "x" * 256):
        with pytest.raises(ParsingError):
            catalog.create(bad)
    with pytest.raises(Conflict):
        catalog.create("other")
    assert catalog.drop("idx_a*") == ["idx_a1", "idx_a2"] and catalog.resolve("both") == ["idx_b1"]
    assert rows(catalog.cat_indices(), "index", "docs_count") == [("idx_b1", 1), ("other", 1)]
    assert catalog.health()["status"] == "green" and catalog.nodes()[0]["master"] == "*"


def test_indices_with_other_types_unite(catalog, spark):
    catalog.create("a", None, spark.createDataFrame([("1", 5)], "_id string, x int"))
    catalog.create("b", None, spark.createDataFrame([("1", 2.5, "y")], "_id string, x double, z string"))
    catalog.create("c", None, spark.createDataFrame([("1", "text")], "_id string, x string"))
    assert rows(catalog.scan("a,b"), "_index", "x", "z") == [("a", 5.0, None), ("b", 2.5, "y")]
    assert {r.x for r in catalog.scan().collect()} == {"5.0", "2.5", "text"}


def test_templates(catalog):
    catalog.components["base"] = {"template": {"settings": {"s": 1, "t": 1}}}
    catalog.put_template("low", {"index_patterns": ["log-*"], "priority": 1, "template": {"settings": {"s": 9}}})
    catalog.put_template("high", {"index_patterns": ["log-x*"], "priority": 5, "composed_of": ["base"], "template": {"settings": {"t": 2}, "mappings": {"properties": {"lang": {"type": "keyword"}}}, "aliases": {"logs": {}}}})
    m = catalog.create("log-x1", {"settings": {"own": True}})
    assert m.settings == {"s": 1, "t": 2, "own": True} and m.mapping.properties == {"lang": "keyword"} and catalog.resolve("logs") == ["log-x1"]
    assert catalog.simulate("log-y")["settings"] == {"s": 9}
    with pytest.raises(ParsingError):
        catalog.put_template("bad", {})


def test_documents(catalog, spark, base):
    catalog.create("t", {"mappings": {"dynamic": "strict", "properties": {"s": {"type": "keyword"}, "v": {"type": "integer"}}}})
    assert catalog.put("t", base).count() == 0
    assert catalog.get("t", "2")["_source"] == {"s": "b", "v": 20} and catalog.get("t", "9") is None and catalog.has("t", "1") and not catalog.has("t", "9")
    bad = catalog.put("t", spark.createDataFrame([("4", "d", "extra")], "_id string, s string, w string"))
    assert "strict" in bad.first()._error and catalog.count("t") == 3
    catalog.put("t", spark.createDataFrame([("2", "B", 21, 0), ("2", "BB", 22, 1)], "_id string, s string, v int, n int"), order="n")
    got = catalog.get("t", "2")
    assert got["_source"] == {"s": "BB", "v": 22} and got["_version"] == 3
    assert catalog.delete_by_query("t", B.term("s", "BB"))["deleted"] == 1 and catalog.count("t") == 2
    assert catalog.update_by_query("t", B.term("s", "a"), "ctx._source.v += 5")["updated"] == 1 and catalog.get("t", "1")["_source"]["v"] == 15
    first = catalog.search("t", {"query": B.term("s", "a")}, cached=True)
    assert catalog.search("t", {"query": B.term("s", "a")}, cached=True) is first
    catalog.delete_by_query("t", B.term("s", "a"))
    assert catalog.search("t", {"query": B.term("s", "a")}, cached=True)["hits"]["total"]["value"] == 0
    assert rows(catalog.sql("SELECT s FROM t WHERE s = 'c'"), "s") == [("c",)]
    catalog.close("t")
    with pytest.raises(Conflict):
        catalog.frame("t")
    catalog.open("t")
    catalog.save()
    again = Catalog.load(spark, catalog.root)
    assert again.count("t") == catalog.count("t") and again.meta("t").mapping.dynamic == "strict"
    with pytest.raises(Conflict):
        catalog.put_mapping("t", {"properties": {"v": {"type": "text"}}})
    assert catalog.stats("t")["docs"]["count"] == 1 and catalog.store_bytes("t") > 0


def test_reindex_and_pipelines(catalog, spark, base):
    catalog.create("a", None, base)
    catalog.pipelines["p"] = {"processors": [{"set": {"field": "kind", "value": "x"}}, {"rename": {"field": "s", "target_field": "t"}}, {"rename": {"field": "none", "target_field": "u"}}]}
    assert catalog.reindex("a", "b", query=B.range_("v", gte=10), pipeline="p", script="ctx._source.v = 1")["total"] == 2
    assert rows(catalog.frame("b"), "_id", "t", "kind", "v") == [("1", "a", "x", 1), ("2", "b", "x", 1)]
    assert catalog.reindex("a", "b", op_type="create")["total"] == 3
    assert rows(catalog.frame("b").where("_id = '1'"), "t", "v") == [("a", 1)]
    assert catalog.reindex("a", "c", max_docs=1, sort=[{"v": "desc"}])["total"] == 1 and catalog.has("c", "2")
    assert rows(catalog.simulate_pipeline("p", base), "_id", "t")[0] == ("1", "a")
    assert [r.text for r in catalog.suggest("a,b", {"x": {"text": "B", "prefix": {"field": "s"}}})["x"].collect()] == ["b"]
    with pytest.raises(Missing):
        catalog.simulate_pipeline("none", base)
    with pytest.raises(ParsingError):
        scripts.run_pipeline(base, {"processors": [{"grok": {}}]})


def test_partial_update(spark, base):
    patch = spark.createDataFrame([("1", None, 11, ["v", "s"]), ("3", "C", None, ["s"]), ("9", "x", 1, ["s"])], "_id string, s string, v int, fields array<string>")
    after, missing = mutate.partial_update(base, patch)
    assert rows(after, "_id", "s", "v") == [("1", None, 11), ("2", "b", 20), ("3", "C", None)] and rows(missing, "_id") == [("9",)]


def test_bulk_is_sequential_per_document(spark, base):
    ops = spark.createDataFrame(
        [(1, "create", "4", "d", None, None, None), (2, "update", "4", None, 44, None, None), (3, "delete", "4", None, None, None, None), (4, "update", "4", "x", None, None, None), (5, "create", "4", "again", None, None, None), (6, "create", "1", "no", None, None, None), (7, "index", "1", "A", 1, 1, None), (8, "index", "1", "late", 1, 1, None), (9, "delete", "9", None, None, None, None), (10, "index", "2", "v", 5, None, 7), (11, "index", "2", "w", 6, None, 7), (12, "odd", "2", None, None, None, None)],
        "line bigint, _op string, _id string, s string, v int, if_seq_no bigint, version bigint",
    )
    after, results = mutate.bulk(base, ops)
    assert [r.status for r in results.orderBy("line").collect()] == [201, 200, 200, 404, 201, 409, 200, 409, 404, 200, 409, 400]
    assert rows(after, "_id", "s", "v", "_version") == [("1", "A", 1, 2), ("2", "v", 5, 7), ("3", "c", None, 1), ("4", "again", None, 4)]


def test_external_versions(spark, base):
    ops = spark.createDataFrame([(1, "index", "1", "x", 5, "external"), (2, "index", "1", "y", 5, "external_gte"), (3, "index", "1", "z", 4, "external_gte"), (4, "index", "2", "z", None, "external")], "line bigint, _op string, _id string, s string, version bigint, version_type string")
    assert [r.status for r in mutate.bulk(base, ops)[1].orderBy("line").collect()] == [200, 200, 409, 400]


def test_bulk_bodies(catalog, spark, tmp_path):
    body = ['{"index":{"_index":"x","_id":"1"}}', '{"s":"a"}', '{"delete":{"_index":"x","_id":"1"}}', '{"create":{"_index":"x","_id":"2"}}', '{"index":{"a":{}}}', '{"update":{"_index":"y","_id":"3"}}', '{"doc":{"s":"u"}}', '{"index":{"_index":"y","_id":"4"}}', '{"s":"é \\"q\\""}', ""]
    (tmp_path / "b.ndjson").write_text("\n".join(body))
    schema = T.StructType([T.StructField("s", T.StringType())])
    ops = files.bulk_operations(files.numbered_lines(spark, str(tmp_path / "b.ndjson")), files.PLACE, schema)
    assert [(r._op, r._index, r._id, r.s) for r in ops.orderBy("line").collect()] == [("index", "x", "1", "a"), ("delete", "x", "1", None), ("create", "x", "2", None), ("update", "y", "3", "u"), ("index", "y", "4", 'é "q"')]
    results = catalog.bulk(ops)
    assert rows(results, "_index", "_id", "_op", "status") == [("x", "1", "delete", 200), ("x", "1", "index", 201), ("x", "2", "create", 201), ("y", "3", "update", 404), ("y", "4", "index", 201)]
    assert catalog.count("x") == 1 and catalog.count("y") == 1
    with pytest.raises(ParsingError):
        catalog.bulk(ops, most=2)


@pytest.mark.parametrize("script,want", [
    ("ctx._source.s = 'q'", ("q", 10)), ("ctx._source.v += 2; ctx._source.s = \"a;b\"", ("a;b", 12)), ("ctx._source.v = null", ("a", None)), ("ctx._source.remove('s')", (None, 10)), ("ctx._source.v = -3", ("a", -3)), ("ctx._source.v = 'text'", ("a", "text")), ("ctx._source.v += 0.5", ("a", 10.5)),
])
def test_scripts(base, script, want):
    got = {r._id: (r.s, r.v) for r in scripts.apply(base, script, F.col("_id") == "1").collect()}
    assert got["1"] == want and got["2"][0] == "b" and str(got["2"][1]) in ("20", "20.0")


def test_scripts_of_new_and_nested_fields(spark, base):
    out = scripts.apply(base, "ctx._source.n += 4; ctx._source.o.p = [1, 2]; ctx._source.flag = true", F.col("_id") == "1")
    assert rows(out, "_id", "n", "o.p", "flag") == [("1", 4, [1, 2], True), ("2", None, None, None), ("3", None, None, None)]
    user = spark.createDataFrame([("1", ("ann", 5)), ("2", None)], "_id string, user struct<name string, age int>")
    out = scripts.apply(user, "ctx._source.user.age += 1; ctx._source.user.city = 'x'")
    assert rows(out, "_id", "user.name", "user.age", "user.city") == [("1", "ann", 6, "x"), ("2", None, 1, "x")]


@pytest.mark.parametrize("bad", ["", "ctx._source.v *= 2", "import os", "ctx._source.v += 'x'", "ctx._source.v = os.system('x')", {"lang": "other"}])
def test_bad_scripts_raise(bad):
    with pytest.raises(ParsingError):
        scripts.parse(bad)


@pytest.mark.parametrize("kind,value,ok", [("keyword", "x", True), ("keyword", 5, False), ("integer", 5, True), ("integer", True, True), ("integer", "5", False), ("double", 2.5, True), ("boolean", True, True), ("boolean", "true", True), ("boolean", "yes", False), ("date", "2026-01-01", True), ("date", 5, False), ("object", {"a": 1}, True), ("object", "a", False), ("ip", "1.2.3.4", True), ("odd", 5, True)])
def test_mapping_types(spark, kind, value, ok):
    df = spark.createDataFrame([("1", value), ("2", None)], T.StructType([T.StructField("_id", T.StringType()), T.StructField("f", {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), dict: T.MapType(T.StringType(), T.LongType())}[type(value)])]))
    good, bad = Mapping({"properties": {"f": {"type": kind}}}).split(df)
    assert good.count() == 1 + ok and bad.count() == 1 - ok


def test_mapping_schema():
    m = Mapping({"mappings": {"properties": {"a": {"type": "long"}, "b": {"type": "date"}, "c": {"properties": {}}}}})
    assert m.schema().simpleString() == "struct<a:bigint,b:timestamp,c:map<string,string>>" and m.dynamic == "true"
    with pytest.raises(ParsingError):
        Mapping({"dynamic": "sometimes"})


def test_csv_and_json_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text('name,age,email\nann,5,"a,b"\nbob,,b@x\n')
    df = files.read_csv(spark, str(tmp_path / "p.csv"), files.ImportOptions(id_field="field_0", skip_header=True))
    assert rows(df, "_id", "field_1", "field_2") == [("ann", "5", "a,b"), ("bob", None, "b@x")]
    assert files.read_csv(spark, str(tmp_path / "p.csv")).count() == 3 == files.line_count(spark, str(tmp_path / "p.csv"))
    (tmp_path / "j.jsonl").write_text('{"name":"ann","age":5}\nbroken{\n\n{"name":"bob","age":6}\n')
    good, bad = files.read_json_lines(spark, str(tmp_path / "j.jsonl"), id_field="name")
    assert rows(good, "_id", "age") == [("ann", 5), ("bob", 6)] and rows(bad, "value") == [("broken{",)]
    with pytest.raises(ValueError):
        files.ImportOptions(batch=0)


def test_dump_restore_and_cli(catalog, spark, tmp_path):
    odd = spark.createDataFrame([("1", 'quote " and \\ and é', [1, 2], None), ("2", None, None, 2.5)], "_id string, s string, a array<int>, d double")
    catalog.create("a", None, odd)
    catalog.create("b", None, odd.drop("a"))
    catalog.write("a", catalog.frame("a"))
    catalog.write("b", catalog.frame("b"))
    catalog.save()
    path = str(tmp_path / "dump")
    assert cli.main(["dump", "--catalog", catalog.root, "--path", path]) == 0
    line = json.loads(spark.read.text(f"{path}/data").first()[0])
    assert set(line) == {"_index", "_id", "_source"}
    other = Catalog(spark, str(tmp_path / "other"))
    assert files.restore(other, path) == 4
    assert rows(other.frame("a"), "_id", "s", "a", "d") == rows(odd, "_id", "s", "a", "d")
    assert files.restore(other, path, "all") == 4 and other.count("all") == 2


def test_snapshots(catalog, spark, base, tmp_path):
    repository = str(tmp_path / "snapshots")
    catalog.create("a", {"mappings": {"properties": {"s": {"type": "keyword"}}}}, base)
    assert files.snapshot(catalog, repository, "one")["indices"]["a"]["doc_count"] == 3
    catalog.delete_by_query("a", None)
    assert catalog.count("a") == 0
    assert files.restore_snapshot(catalog, repository, "one") == {"a": 3} and catalog.count("a") == 3
    assert files.restore_snapshot(catalog, repository, "one", rename=lambda n: f"{n}-copy") == {"a-copy": 3} and catalog.meta("a-copy").mapping.properties == {"s": "keyword"}
    assert files.list_snapshots(catalog, repository) == ["one"]
    with pytest.raises(ValueError):
        files.snapshot(catalog, repository, "one")
    os.remove(max((tmp_path / "snapshots/one/a").glob("*.parquet"), key=lambda p: p.stat().st_size))
    with pytest.raises(Exception):
        files.restore_snapshot(catalog, repository, "one")
    assert files.delete_snapshot(catalog, repository, "one") and not files.delete_snapshot(catalog, repository, "one")
    with pytest.raises(KeyError):
        files.restore_snapshot(catalog, repository, "one")


@pytest.mark.parametrize("text,want", [("30d", 2_592_000), ("1h30m", 5400), ("500ms", 0.5), ("", 0), (None, 0), ("5m", 300)])
def test_durations(text, want):
    assert lifecycle.seconds(text) == want


def test_lifecycle(catalog, spark, base):
    with pytest.raises(ValueError):
        lifecycle.seconds("soon")
    catalog.policies["p"] = {"policy": {"phases": {"hot": {"actions": {"rollover": {"max_docs": 3}}}, "warm": {"min_age": "1d", "actions": {"forcemerge": {"max_num_segments": 1}, "set_priority": {"priority": 5}}}, "delete": {"min_age": "10d"}}}}
    catalog.create("free", None, base, now=0)
    catalog.create("logs-000", {"settings": {"index.lifecycle.name": "p"}}, base, now=0)
    catalog.add_alias("logs", "logs-000")
    assert lifecycle.tick(catalog, 10) == [("logs-000", "rollover:logs-1")]
    assert catalog.resolve("logs") == ["logs-1"] and lifecycle.tick(catalog, 20) == []
    done = lifecycle.tick(catalog, 2 * 86_400)
    assert ("logs-000", "phase:warm") in done and ("logs-000", "forcemerge") in done and catalog.meta("logs-000").settings["index.priority"] == 5
    assert ("logs-000", "delete") in lifecycle.tick(catalog, 11 * 86_400) and not catalog.exists("logs-000") and catalog.exists("free")


def test_tasks(catalog, spark):
    key = catalog.tasks.submit("count", lambda: {"total": spark.range(10).count()})
    assert catalog.tasks.wait(key, 60)["status"] == "completed" and catalog.tasks.get(key)["progress"] == {"total": 10}
    bad = catalog.tasks.submit("fail", lambda: 1 / 0)
    assert catalog.tasks.wait(bad, 60)["status"] == "failed" and len(catalog.tasks.list()) == 2 and len(catalog.tasks.list("fail")) == 1
    assert not catalog.tasks.cancel(key) and catalog.tasks.get("none") is None


def test_streams(catalog, spark, tmp_path):
    src, cp = tmp_path / "in", str(tmp_path / "cp")
    src.mkdir()
    schema = "k bigint, v string, n bigint, ts timestamp"
    write = lambda name, rs: spark.createDataFrame(rs, schema).coalesce(1).write.mode("append").json(str(src))
    at = dt.datetime(2026, 1, 1, 0, 10)
    catalog.create("s")
    write("a", [(1, "old", 1, at), (1, "new", 2, at), (2, "x", 1, at)])
    ingest.into_index(ingest.read_json(spark, str(src), schema), catalog, "s", cp, "k", "n").awaitTermination()
    assert rows(catalog.frame("s"), "_id", "v", "_version") == [("1", "new", 2), ("2", "x", 1)]
    write("b", [(2, "y", 1, at + dt.timedelta(hours=1))])
    ingest.into_index(ingest.read_json(spark, str(src), schema), catalog, "s", cp, "k", "n").awaitTermination()
    assert rows(catalog.frame("s"), "_id", "v", "_version") == [("1", "new", 2), ("2", "y", 2)]
    once = ingest._Once(spark, cp)
    assert once.seen(1) and not once.seen(2)
    out = ingest.date_histogram(ingest.read_json(spark, str(src), schema), "ts", "1 hour", value="n")
    out.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.doc_count for r in spark.table("hours").collect()) == [1, 3]


def test_bulk_streams(catalog, spark, tmp_path):
    src = tmp_path / "bulk"
    src.mkdir()
    (src / "1.ndjson").write_text('{"index":{"_index":"z","_id":"1"}}\n{"s":"first"}\n')
    (src / "2.ndjson").write_text('{"index":{"_index":"z","_id":"1"}}\n{"s":"second"}\n{"delete":{"_index":"z","_id":"7"}}\n')
    schema = T.StructType([T.StructField("s", T.StringType())])
    ingest.bulk_into(ingest.read_bulk(spark, str(src)), catalog, schema, str(tmp_path / "cp2")).awaitTermination()
    assert rows(catalog.frame("z"), "_id", "s", "_version") == [("1", "second", 2)]


def _paired(lines):
    """(line number, op, source) of the operations of one body, read one line after another."""
    out, k = [], 0
    while k < len(lines):
        m = re.match(r'\{"(index|create|update|delete)":\{.*\}\}$', lines[k])
        if m and m[1] != "delete":
            out.append((k, m[1], lines[k + 1] if k + 1 < len(lines) else None))
            k += 2
            continue
        if m:
            out.append((k, "delete", None))
        k += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bulk_lines_against_reading_them_in_turn(spark, seed):
    """Sources that look like actions, stray lines and runs of deletes, over bodies that are cut anywhere."""
    r = random.Random(seed)
    some = ['{"index":{"_id":"%d"}}', '{"create":{"_id":"%d"}}', '{"delete":{"_id":"%d"}}', '{"s":"%d"}']
    bodies = {f"b{b}": [r.choices(some, (5, 2, 2, 3))[0] % k for k in range(r.choice((1, 7, 120)))] for b in range(6)}
    rows = [(b, k, v) for b, lines in bodies.items() for k, v in enumerate(lines)]
    r.shuffle(rows)
    found = files._paired(spark.createDataFrame(rows, "body string, line bigint, value string"), ["line"]).where("name is not null and not owned")
    got = {}
    for x in found.orderBy("n").collect():
        got.setdefault(x.body, []).append((x.line, x.name, None if x.name == "delete" else x.following))
    want = {b: _paired(lines) for b, lines in bodies.items()}
    assert got == {b: x for b, x in want.items() if x}
    total = sum(map(len, bodies.values()))
    assert sorted(x.n for x in files._paired(spark.createDataFrame(rows, "body string, line bigint, value string"), ["line"]).collect()) == list(range(total))


def test_small_writes_are_deltas_and_read_like_full_ones(catalog, spark, monkeypatch):
    from fathomdex.sources import catalog as C

    r = random.Random(5)
    base = spark.createDataFrame([(str(k), f"s{k}", k) for k in range(50)], "_id string, s string, v int")
    for name in ("deltas", "full"):
        catalog.create(name)
        catalog.write(name, mutate.versioned(base))
    for step in range(5):
        new = spark.createDataFrame([(str(r.randrange(70)), f"x{step}", step) for _ in range(6)], "_id string, s string, v int").dropDuplicates(["_id"]).cache()
        new.count()
        ops = spark.createDataFrame([(k, r.choice(("index", "delete", "update", "create")), str(r.randrange(70)), f"b{step}") for k in range(8)], "line bigint, _op string, _id string, s string")
        for name, small in (("deltas", 100_000), ("full", -1)):
            monkeypatch.setattr(C, "DELTA_ROWS", small)
            catalog.put(name, new)
            got = catalog.bulk(ops, name)
            statuses = rows(got, "line", "status") if name == "deltas" else statuses
            assert rows(got, "line", "status") == statuses
        assert rows(catalog.frame("deltas"), "_id", "s", "v", "_seq_no", "_version") == rows(catalog.frame("full"), "_id", "s", "v", "_seq_no", "_version")
    assert not catalog.meta("full").deltas
    assert [x["kind"] for x in catalog.segments("deltas")][0] == "base" and len(catalog.meta("deltas").deltas) == 10 - C.MOST_DELTAS - 1
    catalog.compact("deltas")
    assert len(catalog.segments("deltas")) == 1


def test_readers_keep_what_a_write_replaces(catalog, spark):
    catalog.create("a")
    catalog.write("a", mutate.versioned(spark.createDataFrame([("1",)], "_id string")))
    held = catalog.frame("a")
    catalog.write("a", mutate.versioned(spark.createDataFrame([("2",), ("3",)], "_id string")))
    assert held.count() == 1 and catalog.count("a") == 2
    assert catalog.vacuum() == 1 and catalog.vacuum() == 0


def test_postings_answer_like_a_scan(catalog, spark):
    r = random.Random(3)
    docs = [(str(k), " ".join(r.choices(["red", "ring", "small", "old", "bolt", "Größe", "x-ray"], k=r.randint(0, 9))), None if k % 7 == 0 else r.choice(["ring one", "two bolts", ""]), k % 5) for k in range(200)]
    catalog.create("p", {"settings": {"index.postings": ["a", "b"]}})
    catalog.write("p", mutate.versioned(spark.createDataFrame(docs, "_id string, a string, b string, n int")))
    p, df = catalog.postings("p"), catalog.frame("p")
    fields = Fields(df, None)
    bodies = [B.match("a", "red x"), {"match": {"a": {"query": "red small", "operator": "and"}}}, B.match_phrase("a", "old bolt"), B.multi_match("ring bolts", ["a", "b"]), B.multi_match("ring", ["a", "b"], "most_fields"), B.match("a", "absent"),
              B.bool_(must=[B.match("a", "red"), B.match("b", "ring two")], filter=[B.range_("n", gte=2)], must_not=[B.match("a", "old")])]
    for body in bodies:
        node = dsl.parse(body)
        assert p.answers(node, fields)
        got = {x._id: round(x._score, 9) for x in p.matching_scored(df, node, fields).collect()}
        assert got == {x._id: round(x._score, 9) for x in scoring.matching_scored(df, node, fields).collect()}
    assert not p.answers(dsl.parse(B.multi_match("ri", ["a", "b"], "phrase_prefix")), fields) and not p.answers(dsl.parse(B.bool_(should=[B.match("a", "red")])), fields)
    for f in ("a", "b"):
        assert rows(p.terms(f), "token", "freq", "source") == rows(suggest.dictionary(df, f), "token", "freq", "source")
    first = catalog.search("p", {"query": B.match("a", "red")})["hits"]["total"]["value"]
    catalog.put("p", spark.createDataFrame([("new", "red", None, 1)], "_id string, a string, b string, n int"))
    assert catalog.postings("p") is None and catalog.search("p", {"query": B.match("a", "red")})["hits"]["total"]["value"] == first + 1
    catalog.compact("p")
    assert catalog.search("p", {"query": B.match("a", "red")})["hits"]["total"]["value"] == first + 1 and catalog.postings("p") is not None
