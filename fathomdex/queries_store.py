"""Registered queries of the inverted index, the catalog's services, files and requests: each runs the operation itself, and its SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import aggs, lifecycle, mutate, scoring, suggest
from .operators.suggest import MultiSuggest
from .plans import builder as B
from .plans import dsl, search, sqlsubset
from .plans.compile import Fields
from .queries import _DICTIONARY, KEYS, _fresh, _orders, bm25_sql, has, indexed, mapping, read, register, toks
from .sources import files, storage
from .sources.catalog import Catalog


def _rows(values) -> str:
    """SQL of (what, outcome) rows."""
    one = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else f"{v}"
    return "SELECT * FROM (VALUES " + ", ".join(f"({one(a)}, {one(b)})" for a, b in values) + ") AS v(what, outcome)"


def _outcomes(spark, pairs):
    return spark.createDataFrame([(a, None if b is None else str(b)) for a, b in pairs], "what string, outcome string")


def _raised(f) -> str:
    """The name of what f raises, or 'nothing'."""
    try:
        f()
    except Exception as e:
        return type(e).__name__
    return "nothing"


# the inverted index


@register("x_postings", f"SELECT token, count(*) AS df, sum(tf) AS tf, sum(n) AS lengths FROM (SELECT doc_id, t AS token, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(tk) AS t, len(tk) AS n FROM (SELECT doc_id, {toks('text')} AS tk FROM documents)) GROUP BY ALL) GROUP BY token")
def _postings(spark, sf_dir):
    p = indexed(spark, sf_dir, "documents", "text")
    return p._postings.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.sum("length").alias("lengths"))


@register("x_statistics", f"SELECT count(text) AS n, round(avg(len({toks('text')})), 6) AS length FROM documents")
def _statistics(spark, sf_dir):
    n, length = indexed(spark, sf_dir, "documents", "text").stats("text")
    return spark.createDataFrame([(n, round(length, 6))], "n bigint, length double")


for _name, _query, _where in (
    ("or", B.match("text", "und license"), f"{has('text', 'und')} OR {has('text', 'license')}"),
    ("and", {"match": {"text": {"query": "the that", "operator": "and"}}}, f"{has('text', 'the')} AND {has('text', 'that')}"),
    ("phrase", B.match_phrase("text", "MIT License"), has("text", "mit license")),
    ("bool", B.bool_(must=[B.match("text", "the"), B.match_phrase("text", "mit license")], filter=[B.term("lang", "en")], must_not=[B.range_("n_chars", gte=4000)]), f"{has('text', 'the')} AND {has('text', 'mit license')} AND lang = 'en' AND n_chars < 4000"),
):

    @register(f"x_match_{_name}", f"SELECT doc_id FROM documents WHERE {_where}")
    def _matched(spark, sf_dir, query=_query):
        df = search.identified(read(spark, sf_dir, "documents"), "doc_id")
        return search.plan(df, {"query": query}, mapping("documents"), indexed(spark, sf_dir, "documents", "text")).matched.select("doc_id")


@register("x_multi_match", f"SELECT p_partkey FROM part WHERE {has('p_name', 'ring')} OR {has('p_type', 'ring')} OR {has('p_name', 'economy')} OR {has('p_type', 'economy')}")
def _multi(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "part"), "p_partkey")
    return search.plan(df, {"query": B.multi_match("ring economy", ["p_name", "p_type"])}, None, indexed(spark, sf_dir, "part", "p_name", "p_type")).matched.select("p_partkey")


@register("x_term_suggest", f"SELECT token AS text, CASE WHEN levenshtein(token, 'rign') > 0 THEN freq / (levenshtein(token, 'rign') + 1) ELSE freq END AS score, freq FROM {_DICTIONARY} WHERE starts_with(token, 'r') AND levenshtein(token, 'rign') <= 2 ORDER BY score DESC, text LIMIT 5")
def _x_term(spark, sf_dir):
    return suggest.term(indexed(spark, sf_dir, "part", "p_name", "p_type"), "p_name", "rign")


@register("x_completion", f"SELECT token AS text, 1.0::DOUBLE AS score, source FROM {_DICTIONARY} WHERE starts_with(token, 'g') ORDER BY text LIMIT 10")
def _x_completion(spark, sf_dir):
    return suggest.completion(indexed(spark, sf_dir, "part", "p_name", "p_type"), "p_name", "G")


_EDITS = "least(" + ", ".join(f"levenshtein(left(token, {k}), 'wegd')" for k in (3, 4, 5)) + ")"


@register("g_completion_fuzzy", f"SELECT token AS text, 1 / (1 + {_EDITS}) AS score, source FROM {_DICTIONARY} WHERE starts_with(token, 'w') AND {_EDITS} <= 1 ORDER BY score DESC, text LIMIT 10")
def _fuzzy_completion(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "part"), "p_partkey")
    return suggest.suggest(df, {"c": {"prefix": "wegd", "completion": {"field": "p_name", "fuzzy": {"fuzziness": 1}}}})["c"]


@register("g_multi", f"WITH d AS (SELECT * FROM {_DICTIONARY}), a AS (SELECT 'begin' AS name, token AS text, 1.0::DOUBLE AS score FROM d WHERE starts_with(token, 'b') ORDER BY text LIMIT 10), b AS (SELECT 'near' AS name, token AS text, CASE WHEN levenshtein(token, 'bolt') > 0 THEN freq / (levenshtein(token, 'bolt') + 1) ELSE freq END AS score FROM d WHERE starts_with(token, 'b') AND levenshtein(token, 'bolt') <= 2 ORDER BY score DESC, text LIMIT 5) SELECT name, text, score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, name DESC) = 1")
def _multi_suggest(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "part"), "p_partkey")
    return MultiSuggest("bolt").add("near", "term", "p_name").add("begin", "completion", "p_name", "b").merged(df, 10)


@register("g_across_indices", f"SELECT token AS text, freq FROM (SELECT t AS token, count(*) AS freq FROM (SELECT unnest(list_distinct({toks('text')})) AS t FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) GROUP BY t) WHERE starts_with(token, 'l') AND levenshtein(token, 'license') <= 2 ORDER BY CASE WHEN levenshtein(token, 'license') > 0 THEN freq / (levenshtein(token, 'license') + 1) ELSE freq END DESC, text LIMIT 5")
def _suggest_across(spark, sf_dir):
    c = Catalog(spark)
    for n, t in (("a", "documents"), ("b", "benchmark")):
        c.create(n, None, search.identified(read(spark, sf_dir, t), KEYS[t]).select("_id", "text"))
    return c.suggest("a,b", {"s": {"text": "license", "term": {"field": "text"}}})["s"].select("text", "freq")


@register("g_parser", _rows([("completion", "completion"), ("none", "ParsingError"), ("phrase", "phrase"), ("prefix", "prefix"), ("term", "term"), ("unknown", "ParsingError")]))
def _suggest_parser(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "part"), "p_partkey")
    out = [(k, k if list(suggest.suggest(df, {"text": "ring", "s": {k: {"field": "p_name"}}})) == ["s"] else None) for k in ("term", "completion", "prefix", "phrase")]
    return _outcomes(spark, out + [("unknown", _raised(lambda: suggest.suggest(df, {"s": {"fuzzy": {"field": "p_name"}}}))), ("none", _raised(lambda: suggest.suggest(df, {"s": {"text": "x"}})))])


# requests


@register("q_bad_multi_match", _rows([("best_fields", "nothing"), ("bool_prefix", "ParsingError"), ("unknown query", "ParsingError")]))
def _bad(spark, sf_dir):
    kinds = {k: lambda k=k: dsl.parse({"multi_match": {"query": "x", "fields": ["p_name"], "type": k}}) for k in ("best_fields", "bool_prefix")}
    return _outcomes(spark, [(k, _raised(f)) for k, f in kinds.items()] + [("unknown query", _raised(lambda: dsl.parse({"matches": {"a": "b"}})))])


@register("q_range_pushed", "SELECT count(*) AS n, 1 AS pushed FROM lineitem WHERE l_extendedprice >= 90000")
def _pushed(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    hit = df.where(search.C.compile(dsl.parse(B.range_("l_extendedprice", gte=90000)), Fields(df)))
    plan = hit._jdf.queryExecution().executedPlan().toString()
    return hit.agg(F.count("*").alias("n"), F.lit(int("GreaterThanOrEqual(l_extendedprice,90000.0)" in plan)).alias("pushed"))


@register("q_bloom_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (7, 77, 4999)")
def _bloom(spark, sf_dir):
    c = Catalog(spark)
    c.create("orders", {"settings": {"index.bloom_fields": ["o_orderkey"]}})
    c.write("orders", mutate.versioned(_orders(spark, sf_dir)))
    return c.frame("orders").where(F.col("_id").isin("7", "77", "4999")).select("o_orderkey", "o_orderstatus")


@register("s_text_query_gate", _rows([("bool of filters", "False"), ("bool with match", "True"), ("match", "True"), ("match_all", "False"), ("query_string", "True"), ("term", "False")]))
def _gate(spark, sf_dir):
    bodies = {"match": B.match("a", "b"), "term": B.term("a", "b"), "match_all": {"match_all": {}}, "bool with match": B.bool_(must=[B.match("a", "b")]), "bool of filters": B.bool_(filter=[B.term("a", "b")]), "query_string": B.query_string("b", ["a"])}
    return _outcomes(spark, [(k, scoring.is_text_query(dsl.parse(b))) for k, b in bodies.items()])


@register("p_response", bm25_sql("documents", "CAST(doc_id AS VARCHAR) AS _id, lang", "text", ["license"], "f0 > 0 AND lang = 'en'") + " ORDER BY score DESC, _id LIMIT 7")
def _response(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "documents"), "doc_id", "docs")
    r = search.search(df, {"query": B.bool_(must=[B.match("text", "license")], filter=[B.term("lang", "en")]), "size": 7, "_source": ["lang"]}, mapping("documents"))
    hits = r["hits"]["hits"]
    assert r["timed_out"] is False and r["_shards"]["failed"] == 0 and all(h["_index"] == "docs" for h in hits) and r["hits"]["max_score"] == max(h["_score"] for h in hits)
    return spark.createDataFrame([(h["_id"], h["_source"]["lang"], round(h["_score"], 6)) for h in hits], "_id string, lang string, score double")


@register("p_total_all", "SELECT count(*) AS value, 'eq' AS relation FROM orders WHERE o_orderstatus = 'F'")
def _total_all(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "orders"), "o_orderkey")
    return spark.createDataFrame([search.plan(df, B.Search().term("o_orderstatus", "F").build() | {"track_total_hits": True}, mapping("orders")).total()], "value bigint, relation string")


@register("p_cache", "SELECT 'hits' AS what, CAST(count(*) AS VARCHAR) AS outcome FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'again from the cache', 'True' UNION ALL SELECT 'kept after a write', 'False' UNION ALL SELECT 'hits after a write', CAST(count(*) + 1 AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'")
def _cache(spark, sf_dir):
    c = Catalog(spark)
    c.create("orders", {"mappings": {"properties": {"o_orderstatus": {"type": "keyword"}}}})
    c.write("orders", mutate.versioned(_orders(spark, sf_dir)))
    body = {"query": B.term("o_orderstatus", "P"), "size": 0, "track_total_hits": True}
    first = c.search("orders", body, cached=True)
    again = c.search("orders", body, cached=True) is first
    c.put("orders", spark.createDataFrame([("new", -1, "P", 1.0)], "_id string, o_orderkey bigint, o_orderstatus string, o_totalprice double"))
    other = c.search("orders", body, cached=True)
    return _outcomes(spark, [("hits", first["hits"]["total"]["value"]), ("again from the cache", again), ("kept after a write", other is first), ("hits after a write", other["hits"]["total"]["value"])])


@register("p_scroll", "SELECT (row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1) // 70 AS page, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def _scroll(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "orders"), "o_orderkey")
    pages = search.scroll(df, {"query": B.term("o_orderstatus", "P"), "_source": ["o_orderkey"]}, mapping("orders"), 70)
    return spark.createDataFrame([(k, r["o_orderkey"]) for k, page in enumerate(pages) for r in page], "page bigint, o_orderkey bigint")


@register("a_of_nothing", _rows([("avg", "None"), ("cardinality", "0"), ("max", "None"), ("sum", "None"), ("terms", "0"), ("value_count", "0")]))
def _of_nothing(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "orders"), "o_orderkey").where("false")
    kinds = {k: {k: {"field": "o_totalprice"}} for k in ("avg", "cardinality", "max", "sum", "value_count")} | {"terms": {"terms": {"field": "o_orderstatus"}}}
    out = aggs.evaluate(df, kinds, Fields(df, mapping("orders")))
    return _outcomes(spark, [(k, str(len(v["buckets"]) if "buckets" in v else v["value"])) for k, v in out.items()])


@register("a_builder", "SELECT o_orderstatus AS key, count(*) AS doc_count, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _by_builder(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "orders"), "o_orderkey")
    body = B.Search().match_all().page(0, 0).agg(B.terms_agg("by", "o_orderstatus").sub(B.avg_agg("mean", "o_totalprice"))).build()
    out = search.search(df, body, mapping("orders"))["aggregations"]["by"]["buckets"]
    return spark.createDataFrame([(b["key"], b["doc_count"], round(b["mean"]["value"], 4)) for b in out], "key string, doc_count bigint, mean double")


@register("l_sql_malformed", _rows([("DELETE FROM a", "ParsingError"), ("SELECT", "ParsingError"), ("SELECT a FROM t", "nothing"), ("SELECT a FROM t LIMIT x", "ParsingError"), ("SELECT a FROM t WHERE", "ParsingError")]))
def _malformed(spark, sf_dir):
    return _outcomes(spark, [(t, _raised(lambda t=t: sqlsubset.parse(t))) for t in ("SELECT a FROM t", "SELECT", "DELETE FROM a", "SELECT a FROM t WHERE", "SELECT a FROM t LIMIT x")])


# the catalog's services


@register("c_exists", "SELECT CAST(k AS VARCHAR) AS _id, k IN (SELECT o_orderkey FROM orders) AS there FROM (VALUES (1), (77), (-5), (99999999)) AS v(k)")
def _exists(spark, sf_dir):
    c = Catalog(spark)
    c.create("orders", None, _orders(spark, sf_dir))
    return spark.createDataFrame([(i, c.has("orders", i)) for i in ("1", "77", "-5", "99999999")], "_id string, there boolean")


@register("c_names", "SELECT * FROM (VALUES ('log-1'), ('log-2')) AS v(name)")
def _names(spark, sf_dir):
    path = _fresh(spark)
    for n in ("log-2", "other", "log-1"):
        storage.write_text(spark, f"{path}/{n}", n)
    return spark.createDataFrame([(n,) for n in storage.names(spark, path) if n.startswith("log-")], "name string")


@register("c_health", "SELECT 'yellow' AS status, 1 AS nodes, 1 AS unassigned, (SELECT count(*) FROM orders) AS docs")
def _health(spark, sf_dir):
    c = Catalog(spark)
    c.create("orders", None, _orders(spark, sf_dir))
    c.create("empty")
    h = c.health()
    return spark.createDataFrame([(h["status"], len(c.nodes()), h["unassigned_shards"], c.stats("orders")["docs"]["count"])], "status string, nodes int, unassigned int, docs bigint")


@register("c_index_admin", "SELECT what, outcome FROM (VALUES ('again', 'Conflict'), ('bad name', 'ParsingError'), ('change a type', 'Conflict'), ('closed', 'Conflict'), ('dropped', 'False'), ('exists', 'True'), ('missing', 'Missing'), ('setting', '3')) AS v(what, outcome) UNION ALL SELECT 'open again', CAST(count(*) AS VARCHAR) FROM orders")
def _admin(spark, sf_dir):
    c = Catalog(spark)
    c.create("orders", {"mappings": {"properties": {"o_orderkey": {"type": "long"}}}}, _orders(spark, sf_dir))
    out = [("exists", c.exists("orders")), ("again", _raised(lambda: c.create("orders"))), ("bad name", _raised(lambda: c.create("_no"))), ("missing", _raised(lambda: c.frame("nothing")))]
    c.put_mapping("orders", {"properties": {"more": {"type": "keyword"}}})
    out.append(("change a type", _raised(lambda: c.put_mapping("orders", {"properties": {"o_orderkey": {"type": "text"}}}))))
    c.update_settings("orders", {"index.priority": 3})
    out.append(("setting", c.meta("orders").settings["index.priority"]))
    c.close("orders")
    out.append(("closed", _raised(lambda: c.frame("orders"))))
    c.open("orders")
    out.append(("open again", c.count("orders")))
    c.drop("orders")
    return _outcomes(spark, [*out, ("dropped", c.exists("orders"))])


@register("c_entries", _rows([("component in use", "Conflict"), ("delete", "Missing"), ("get", "True"), ("policy in use", "Conflict"), ("policy of a bad phase", "ParsingError"), ("repository", "True"), ("template of no pattern", "ParsingError"), ("unknown processor", "ParsingError")]))
def _entries(spark, sf_dir):
    c = Catalog(spark)
    c.put_component("base", {"template": {"settings": {"index.lifecycle.name": "logs"}}})
    c.put_template("logs", {"index_patterns": ["log-*"], "composed_of": ["base"]})
    c.put_policy("logs", {"policy": {"phases": {"delete": {"min_age": "30d"}}}})
    c.put_pipeline("tidy", {"processors": [{"set": {"field": "a", "value": 1}}]})
    c.put_repository("backup", "/some/folder")
    c.create("log-1")
    got = c.get_template("logs")["composed_of"] == ["base"] and c.get_policy("logs") and c.get_pipeline("tidy") and c.get_component("base")
    out = [("get", bool(got)), ("component in use", _raised(lambda: c.delete_component("base"))), ("policy in use", _raised(lambda: c.delete_policy("logs"))), ("repository", c.location("backup") == "/some/folder" == c.location("/some/folder"))]
    out += [("policy of a bad phase", _raised(lambda: c.put_policy("x", {"phases": {"tepid": {}}}))), ("template of no pattern", _raised(lambda: c.put_template("x", {}))), ("unknown processor", _raised(lambda: c.put_pipeline("x", {"processors": [{"grok": {}}]})))]
    c.delete_pipeline("tidy")
    return _outcomes(spark, [*out, ("delete", _raised(lambda: c.get_pipeline("tidy")))])


@register("c_templates", _rows([("alias", "True"), ("mapping", "keyword"), ("other index", "None"), ("priority", "high"), ("setting", "2")]))
def _templates(spark, sf_dir):
    c = Catalog(spark)
    c.put_component("fields", {"template": {"mappings": {"properties": {"level": {"type": "keyword"}}}, "settings": {"n": 1}}})
    c.put_template("low", {"index_patterns": "log-*", "priority": 1, "template": {"settings": {"which": "low"}}})
    c.put_template("high", {"index_patterns": ["log-a*"], "priority": 5, "composed_of": ["fields"], "template": {"settings": {"which": "high", "n": 2}, "aliases": {"all-logs": {}}}})
    m = c.create("log-a1")
    o = c.create("other")
    return _outcomes(spark, [("mapping", m.mapping.text_types()["level"]), ("priority", m.settings["which"]), ("setting", m.settings["n"]), ("alias", "log-a1" in c.aliases["all-logs"]), ("other index", str(o.settings.get("which")))])


@register("w_lifecycle", "SELECT 'logs-1' AS what, 'True' AS outcome UNION ALL SELECT 'actions', 'rollover:logs-1 phase:warm set_priority phase:delete delete' UNION ALL SELECT 'durations', '129600.0 0.5' UNION ALL SELECT 'rows before', CAST(count(*) AS VARCHAR) FROM orders")
def _lifecycle(spark, sf_dir):
    c = Catalog(spark)
    c.put_policy("p", {"policy": {"phases": {"hot": {"actions": {"rollover": {"max_docs": 10}}}, "warm": {"min_age": "1d", "actions": {"set_priority": {"priority": 5}}}, "delete": {"min_age": "3d"}}}})
    c.create("logs", {"settings": {"index.lifecycle.name": "p"}}, _orders(spark, sf_dir), now=0.0)
    before, done = c.count("logs"), []
    for now in (10.0, 86_400.0 * 1.5, 86_400.0 * 3 + 5):
        done += [a for n, a in lifecycle.tick(c, now) if n == "logs"]
    return _outcomes(spark, [("logs-1", c.exists("logs-1") and "logs" not in c.indices), ("actions", " ".join(done)), ("durations", f"{lifecycle.seconds('1d12h')} {lifecycle.seconds('500ms')}"), ("rows before", before)])


@register("w_tasks", "SELECT 'completed' AS status, count(*) AS n FROM orders UNION ALL SELECT 'failed', NULL")
def _tasks(spark, sf_dir):
    c = Catalog(spark)
    df = read(spark, sf_dir, "orders")

    def fails():
        raise ValueError("no")

    done = [c.tasks.wait(c.tasks.submit("count", w)) for w in (lambda: {"n": df.count()}, fails)]
    return spark.createDataFrame([(t["status"], t["progress"].get("n")) for t in done], "status string, n bigint")


_SMALL = "SELECT 'files' AS what, '1' AS outcome UNION ALL SELECT 'rows', CAST(count(*) + 1 AS VARCHAR) FROM orders UNION ALL SELECT 'version', '2' UNION ALL SELECT 'gone', 'None' UNION ALL SELECT 'after compaction', CAST(count(*) AS VARCHAR) FROM orders"


@register("w_delta", _SMALL)
def _delta(spark, sf_dir):
    c = Catalog(spark)
    c.create("orders")
    c.write("orders", mutate.versioned(_orders(spark, sf_dir)))
    c.put("orders", spark.createDataFrame([("1", 1, "X", 0.5), ("new", -1, "X", 1.0)], "_id string, o_orderkey bigint, o_orderstatus string, o_totalprice double"))
    path = c.meta("orders").deltas[0]
    n = sum(x.endswith(".parquet") for x in storage.names(spark, path))
    out = [("files", n), ("rows", c.count("orders")), ("version", c.get("orders", "1")["_version"])]
    c.bulk(spark.createDataFrame([(0, "delete", "77")], "line bigint, _op string, _id string"), "orders")
    out.append(("gone", str(c.get("orders", "77"))))
    c.compact("orders")
    assert not c.meta("orders").deltas
    return _outcomes(spark, [*out, ("after compaction", c.count("orders"))])


@register("w_in_flight", _rows([("bulk", "Conflict"), ("bulk after another ended", "nothing")]))
def _in_flight(spark, sf_dir):
    c, ops = Catalog(spark), spark.createDataFrame([(0, "index", "1", "a")], "line bigint, _op string, _id string, s string")
    while c.flights.acquire(blocking=False):
        pass
    first = _raised(lambda: c.bulk(ops, "x"))
    c.flights.release()
    return _outcomes(spark, [("bulk", first), ("bulk after another ended", _raised(lambda: c.bulk(ops, "x")))])


# files


@register("io_options", _rows([("a batch of 0", "ValueError"), ("a long delimiter", "ValueError"), ("defaults", "nothing"), ("retries below 0", "ValueError")]))
def _options(spark, sf_dir):
    o = files.ImportOptions
    return _outcomes(spark, [("defaults", _raised(o)), ("a batch of 0", _raised(lambda: o(batch=0))), ("retries below 0", _raised(lambda: o(retries=-1))), ("a long delimiter", _raised(lambda: o(delimiter="::")))])


@register("io_line_count", "SELECT count(*) AS n FROM customer")
def _line_count(spark, sf_dir):
    path = _fresh(spark)
    files.write_json_lines(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), path)
    return spark.createDataFrame([(files.line_count(spark, path),)], "n bigint")


@register("io_broken_lines", "SELECT 'documents' AS what, CAST(count(*) AS VARCHAR) AS outcome FROM customer UNION ALL SELECT 'broken', '2'")
def _broken(spark, sf_dir):
    path, df = _fresh(spark), read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    df.select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([("{not json",), ("[1, 2",)], "value string")).write.text(path)
    docs, broken = files.read_json_lines(spark, path, df.schema)
    return _outcomes(spark, [("documents", docs.count()), ("broken", broken.count())])


@register("io_snapshots", _rows([("a name twice", "ValueError"), ("bad name", "ParsingError"), ("deleted", "True"), ("left", "second"), ("listed", "first second"), ("missing", "KeyError"), ("state", "SUCCESS")]))
def _snapshots(spark, sf_dir):
    c = Catalog(spark)
    c.create("nation", None, read(spark, sf_dir, "nation"), "n_nationkey")
    c.put_repository("backup", _fresh(spark))
    for n in ("first", "second"):
        files.snapshot(c, "backup", n)
    out = [("listed", " ".join(files.list_snapshots(c, "backup"))), ("state", files.get_snapshot(c, "backup", "first")["state"]), ("a name twice", _raised(lambda: files.snapshot(c, "backup", "first"))), ("bad name", _raised(lambda: files.snapshot(c, "backup", "No!")))]
    out += [("deleted", files.delete_snapshot(c, "backup", "first")), ("left", " ".join(files.list_snapshots(c, "backup"))), ("missing", _raised(lambda: files.restore_snapshot(c, "backup", "first")))]
    return _outcomes(spark, out)


@register("io_cli", "SELECT p_partkey, p_name FROM part")
def _cli(spark, sf_dir):
    from . import cli

    path, root = _fresh(spark), _fresh(spark)
    c = Catalog(spark, root)
    c.create("part")
    c.write("part", mutate.versioned(search.identified(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")))
    c.save()
    for args in (["dump"], ["restore", "--target", "again"]):
        cli.main([*args, "--catalog", root, "--path", path])
    return Catalog.load(spark, root).frame("again").select("p_partkey", "p_name")


@register("io_bulk_files", "SELECT 'a' AS _index, CAST(c_custkey AS VARCHAR) AS _id, c_name FROM customer WHERE c_custkey % 10 <> 0")
def _bulk_files(spark, sf_dir):
    """NDJSON files read line by line in splits, sources that look like actions among them, and applied."""
    c = read(spark, sf_dir, "customer")
    path = _fresh(spark)
    head = lambda op: F.concat(F.lit('{"' + op + '":{"_index":"a","_id":"'), "c_custkey", F.lit('"}}'))
    body = F.when(F.col("c_custkey") % 10 == 0, F.lit('{"index":{"c_name":"looks like an action"}}')).otherwise(F.to_json(F.struct("c_name")))
    gone = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("\n"), head("delete"))).otherwise("")
    c.select(F.concat(head("index"), F.lit("\n"), body, gone).alias("value")).repartition(3).write.text(path)
    catalog = Catalog(spark)
    catalog.bulk(files.bulk_operations(files.numbered_lines(spark, path), files.PLACE, c.select("c_name").schema), None, most=None)
    return catalog.scan("a").select("_index", "_id", "c_name")
