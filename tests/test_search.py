"""Requests, builders, aggregations, suggestions and the SQL subset on small tables."""

import datetime as dt

import pytest

from fathomdex.functions import geo
from fathomdex.operators import aggs, scoring, suggest
from fathomdex.plans import builder as B
from fathomdex.plans import dsl, search, sqlsubset
from fathomdex.plans.ast import ParsingError
from fathomdex.plans.compile import Fields, compile


@pytest.fixture(scope="module")
def index(spark):
    def make(rows, schema):
        return spark.createDataFrame([(str(k + 1), *r) for k, r in enumerate(rows)], "_id string, " + schema).withColumn("_index", __import__("pyspark").sql.functions.lit("t"))

    return make


def ids(df, query, mapping=None):
    return sorted(r._id for r in df.where(compile(dsl.parse(query), Fields(df, mapping))).collect())


@pytest.fixture(scope="module")
def words(index):
    return index([("the quick brown fox", "fox runs fast"), ("the lazy dog", "dog sleeps"), ("fox and hound", "best friends"), ("completely unrelated", "no animals here")], "title string, body string")


@pytest.fixture(scope="module")
def mixed(index):
    rows = [(f"hello world {i}", f"cat{i}", 10 * i, ["t1", f"t{i}"], i % 2 == 0, dt.datetime(2026, 8, i)) for i in range(1, 11)]
    return index(rows, "title string, cat string, price int, tags array<string>, active boolean, ts timestamp")


KEYS = {"cat": "keyword", "tags": "keyword"}


@pytest.mark.parametrize("query,want", [
    (B.multi_match("fox", ["title", "body"]), ["1", "3"]), (B.multi_match("quick brown", ["title"], "phrase"), ["1"]), (B.multi_match("quick bro", ["title"], "phrase_prefix"), ["1"]),
    (B.query_string("+fox -dog", ["title"]), ["1", "3"]), (B.query_string("body:fast"), ["1"]), (B.query_string("fox OR dog", ["title"]), ["1", "2", "3"]), (B.query_string("fox"), ["1", "3"]),
    (B.simple_query_string("fox (hound", ["title"]), ["3"]), (B.simple_query_string('"broken', ["title"]), []), (B.match_phrase("title", "brown quick"), []),
    (B.bool_(must=[B.match("title", "fox")], must_not=[B.match("body", "fast")]), ["3"]), (B.bool_(), ["1", "2", "3", "4"]), (None, ["1", "2", "3", "4"]), ({}, ["1", "2", "3", "4"]),
    (B.bool_(must_not=[B.match("nowhere", "x")]), ["1", "2", "3", "4"]), (B.match("title", "FOX, dog!"), ["1", "2", "3"]), (B.match("title", "..."), []), (B.fuzzy("title", "qick"), ["1"]), (B.terms_set("title", ["fox", "hound", "dog"], 2), ["3"]),
])
def test_text_queries(words, query, want):
    assert ids(words, query) == want


@pytest.mark.parametrize("query,want", [
    (B.range_("price", gt=50), [6, 7, 8, 9, 10]), (B.range_("price", gt="50"), [6, 7, 8, 9, 10]), (B.match("title", "world 5"), list(range(1, 11))), (B.match("title", "world 5", "and"), [5]), (B.term("cat", "cat3"), [3]), (B.term("tags", "t1"), list(range(1, 11))),
    (B.terms("tags", ["t2", "t9"]), [2, 9]), (B.term("active", True), [2, 4, 6, 8, 10]), (B.term("active", "false"), [1, 3, 5, 7, 9]), (B.range_("ts", gte="2026-08-09"), [9, 10]), (B.exists("tags"), list(range(1, 11))), (B.exists("nope"), []), (B.term("price", "abc"), []), (B.term("cat", None), []),
    (B.prefix("cat", "cat1"), [1, 10]), (B.wildcard("cat", "c?t1*"), [1, 10]), (B.regexp("cat", "cat[45]"), [4, 5]), (B.range_("price"), []),
])
def test_typed_queries(mixed, query, want):
    assert ids(mixed, query, KEYS) == sorted(map(str, want))


@pytest.mark.parametrize("bad", [{"nonsense": {}}, {"bool": {"must": [{"what": {}}]}}, {"match": {"a": 1, "b": 2}}, {"terms": {"a": "x"}}, {"multi_match": {"query": "x", "fields": ["a"], "type": "odd"}}, {"query_string": {"query": '"open', "fields": ["title"]}}, {"match": {}, "term": {}}])
def test_malformed_queries_raise(words, bad):
    with pytest.raises(ParsingError):
        compile(dsl.parse(bad), Fields(words))


def test_nulls_are_not_matches(index):
    df = index([("a b", 1), (None, None), ("c", 3)], "t string, n int")
    assert ids(df, B.bool_(must_not=[B.match("t", "a")])) == ["2", "3"]
    assert ids(df, B.bool_(must_not=[B.range_("n", gte=2)])) == ["1", "2"]
    every = {"1", "2", "3"}
    for q in (B.match("t", "a"), B.range_("n", lt=9), B.exists("t"), B.prefix("t", "c")):
        assert set(ids(df, q)) | set(ids(df, B.bool_(must_not=[q]))) == every and not set(ids(df, q)) & set(ids(df, B.bool_(must_not=[q])))


def test_bm25(index):
    df = index([("the quick brown fox",), ("the quick brown fox jumps",), ("jumps over the lazy dog",), ("she sells sea shells",)], "title string")
    s = {r._id: r._score for r in scoring.with_score(df, dsl.parse(B.match("title", "the fox")), Fields(df)).collect()}
    assert s["1"] > s["2"] > s["3"] and s["4"] == 1.0
    one = {r._id: r._score for r in scoring.with_score(df, dsl.parse(B.match("title", "the")), Fields(df)).collect()}
    assert one["1"] > one["2"] == one["3"] > 0
    tf = index([("go go go is great",), ("go is great",), ("great",)], "title string")
    s = {r._id: r._score for r in scoring.with_score(tf, dsl.parse(B.match("title", "go")), Fields(tf)).collect()}
    assert s["1"] > s["2"]


def test_request_and_response(mixed):
    s = B.Search().match("title", "world").sort("price", "desc").page(1, 3).source(["ti*", "price"], ["tit*"]).highlight("title", pre="[", post="]").agg(B.terms_agg("tags", "tags"), B.stats_agg("p", "price")).track_total_hits(5)
    r = s.run(mixed, KEYS)
    assert [h["_source"] for h in r["hits"]["hits"]] == [{"price": 90}, {"price": 80}, {"price": 70}]
    assert r["hits"]["total"] == {"value": 5, "relation": "gte"}
    assert r["hits"]["hits"][0]["highlight"] == {"title": ["hello [world] 9"]}
    assert r["aggregations"]["tags"]["buckets"][0] == {"key": "t1", "doc_count": 10}
    assert B.stats_result(r, "p") == {"count": 10, "min": 10.0, "max": 100.0, "avg": 55.0, "sum": 550.0}
    assert search.search(mixed, {"size": 0})["hits"]["hits"] == []
    assert len(search.search(mixed)["hits"]["hits"]) == 10
    assert search.search(mixed, {"_source": False, "size": 1})["hits"]["hits"][0] == {"_index": "t", "_id": "1", "_score": 1.0}
    with pytest.raises(ParsingError):
        search.search(mixed, {"qurey": {}})
    assert search.count(mixed, B.term("cat", "cat1"), KEYS) == 1


def test_scores_order_hits_and_ties_break_by_id(words):
    hits = B.Search().match("title", "the fox").run(words)["hits"]["hits"]
    assert [h["_id"] for h in hits][0] == "1" and [h["_score"] for h in hits] == sorted((h["_score"] for h in hits), reverse=True)


def test_sort_modes_and_missing_last(index):
    df = index([([3, 1, 2],), ([9],), (None,), ([5, 5, 0, 4],)], "v array<int>")
    order = lambda mode, way: [h["_id"] for h in B.Search().match_all().sort("v", way, mode).run(df)["hits"]["hits"]]
    assert order("min", "asc") == ["4", "1", "2", "3"]
    assert order("max", "desc") == ["2", "4", "1", "3"]
    assert order("sum", "asc") == ["1", "2", "4", "3"]
    assert order("avg", "asc") == ["1", "4", "2", "3"]
    assert order("median", "asc") == ["1", "4", "2", "3"]
    with pytest.raises(ParsingError):
        search.plan(df, {"sort": [{"_script": {"script": {"source": "__import__('os')"}}}]})


def test_scroll_reads_every_hit_once(mixed):
    pages = list(search.scroll(mixed, {"query": B.range_("price", gt=20)}, size=3))
    assert [len(p) for p in pages] == [3, 3, 2]
    assert sorted(r["_id"] for p in pages for r in p) == sorted(map(str, range(3, 11)))


DAY = 86_400


@pytest.fixture(scope="module")
def colours(index):
    t = 1_672_531_200
    rows = [("red", 10.0, t, "hot"), ("blue", 20.0, t + DAY, "hot"), ("red", 30.0, t + 2 * DAY, "warm"), ("green", 40.0, t + 3 * DAY, "cold"), ("blue", 50.0, t + 4 * DAY, "cold"), ("blue", 60.0, t + 5 * DAY, "warm")]
    return index(rows, "color string, price double, ts bigint, tag string")


def test_aggregations(colours):
    f = Fields(colours)
    r = aggs.evaluate(colours, {
        "color": {"terms": {"field": "color"}}, "two": {"terms": {"field": "color", "size": 2}}, "avg": {"avg": {"field": "price"}}, "sum": {"sum": {"field": "price"}}, "lo": {"min": {"field": "price"}}, "hi": {"max": {"field": "price"}},
        "n": {"value_count": {"field": "color"}}, "card": {"cardinality": {"field": "color"}}, "h": {"histogram": {"field": "price", "interval": 20}}, "r": {"range": {"field": "price", "ranges": [{"to": 30}, {"from": 30, "to": 50}, {"from": 50}]}},
        "d": {"date_histogram": {"field": "ts", "calendar_interval": "day"}}, "sub": {"terms": {"field": "color"}, "aggs": {"p": {"avg": {"field": "price"}}, "t": {"terms": {"field": "tag"}}}},
        "deep": {"histogram": {"field": "price", "interval": 30}, "aggs": {"c": {"terms": {"field": "color"}, "aggs": {"r": {"range": {"field": "price", "ranges": [{"from": 0, "to": 25}]}}}}}},
    }, f)
    pairs = lambda n: [(b["key"], b["doc_count"]) for b in r[n]["buckets"]]
    assert pairs("color") == [("blue", 3), ("red", 2), ("green", 1)]
    assert pairs("two") == [("blue", 3), ("red", 2)] and r["two"]["sum_other_doc_count"] == 1
    assert (r["avg"]["value"], r["sum"]["value"], r["lo"]["value"], r["hi"]["value"], r["n"]["value"], r["card"]["value"]) == (35, 210, 10, 60, 6, 3)
    assert pairs("h") == [(0, 1), (20, 2), (40, 2), (60, 1)]
    assert pairs("r") == [("*-30.0", 2), ("30.0-50.0", 2), ("50.0-*", 2)]
    assert [k for k, _ in pairs("d")] == [(1_672_531_200 + k * DAY) * 1000 for k in range(6)]
    blue = r["sub"]["buckets"][0]
    assert round(blue["p"]["value"], 6) == round(130 / 3, 6) and [(b["key"], b["doc_count"]) for b in blue["t"]["buckets"]] == [("cold", 1), ("hot", 1), ("warm", 1)]
    first = r["deep"]["buckets"][0]["c"]["buckets"]
    assert [(b["key"], b["r"]["buckets"][0]["doc_count"]) for b in first] == [("blue", 1), ("red", 1)]


def test_aggregations_of_nothing(colours):
    none = colours.where("price < 0")
    r = aggs.evaluate(none, {"a": {"avg": {"field": "price"}}, "s": {"stats": {"field": "price"}}, "t": {"terms": {"field": "color"}}, "x": {"max": {"field": "missing"}}, "r": {"range": {"field": "price", "ranges": [{"from": 0}]}}}, Fields(colours))
    assert r["a"]["value"] is None and r["x"]["value"] is None and r["t"]["buckets"] == []
    assert r["s"] == {"count": 0, "min": None, "max": None, "avg": None, "sum": 0.0} and r["r"]["buckets"][0]["doc_count"] == 0


@pytest.mark.parametrize("bad", [{"a": {"odd": {"field": "x"}}}, {"a": {}}, {"a": {"avg": {"field": "price"}, "sum": {"field": "price"}}}, {"a": {"avg": {}}}, {"a": {"histogram": {"field": "price", "interval": 0}}}, {"a": {"date_histogram": {"field": "ts", "calendar_interval": "fortnight"}}}])
def test_malformed_aggregations_raise(colours, bad):
    with pytest.raises(ParsingError):
        aggs.evaluate(colours, bad, Fields(colours))


def test_negative_histogram_keys_floor(index):
    df = index([(-1.0,), (1.0,), (0.25,)], "x double")
    assert [r.key for r in aggs.buckets(df, "histogram", {"field": "x", "interval": 0.5}, Fields(df)).collect()] == [-1.0, 0.0, 1.0]


def test_suggesters(index):
    df = index([("the quick brown fox",), ("the quick brown fox jumps",), ("jumps over the lazy dog",), ("the apple pie",), ("she sells sea shells",)], "title string")
    assert suggest.term(df, "title", "quik").first().text == "quick"
    assert [r.text for r in suggest.completion(df, "title", "s").collect()] == ["sea", "sells", "she", "shells"]
    assert [r.text for r in suggest.prefix(df, "title", "ap").collect()] == ["apple"]
    assert suggest.phrase(df, "title", "quik browm").first().text == "quick brown"
    r = B.Search().match_all().suggest("s", "term", "title", "jmps").run(df)
    assert r["suggest"]["s"][0]["options"][0]["text"] == "jumps"
    with pytest.raises(ParsingError):
        suggest.suggest(df, {"s": {"text": "x"}})


def test_distances():
    assert geo.metres("1.5km") == 1500 and geo.metres("2mi") == 3218.688 and geo.metres(7) == 7
    with pytest.raises(ValueError):
        geo.metres("far")


@pytest.mark.parametrize("bad", ["SELECT FROM t", "SELECT * FROM", "SELECT * FROM t WHERE", "SELECT * FROM t WHERE a =", "SELECT * FROM t LIMIT", "NOT A SQL", "SELECT * FROM t WHERE (a = 1", "SELECT * FROM t WHERE a = 'x", "SELECT * FROM t trailing", ""])
def test_malformed_sql_raises(bad):
    with pytest.raises(ParsingError):
        sqlsubset.parse(bad)


@pytest.mark.parametrize("text", [
    "SELECT a, b FROM t WHERE x = 1 AND y != 'it''s' OR z IN (1, 2.5, 'q') ORDER BY a DESC, b ASC LIMIT 5 OFFSET 2", "SELECT * FROM t WHERE (a > 1 OR b <= 2) AND c LIKE 'pre%'", "SELECT * FROM t", 'SELECT "odd name" FROM t WHERE "select" = TRUE',
])
def test_sql_survives_a_round_trip(text):
    s = sqlsubset.parse(text)
    again = sqlsubset.parse(sqlsubset.to_sql(s.index, s.body))
    assert again == s


def test_sql_runs_like_spark_sql(mixed, spark):
    mixed.createOrReplaceTempView("mixed")
    for text in ("SELECT cat FROM mixed WHERE price >= 30 AND (cat != 'cat4' OR active = TRUE) ORDER BY price DESC LIMIT 4 OFFSET 1", "SELECT cat, price FROM mixed WHERE cat IN ('cat1', 'cat2') ORDER BY cat", "SELECT COUNT(*) AS n FROM mixed WHERE price < 55.5", "SELECT cat FROM mixed WHERE cat LIKE 'cat1%'"):
        assert [tuple(r) for r in sqlsubset.run(text, lambda t: mixed).collect()] == [tuple(r) for r in spark.sql(text).collect()]
    with pytest.raises(ParsingError):
        sqlsubset.run("SELECT nope FROM mixed", lambda t: mixed)
