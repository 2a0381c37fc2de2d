"""The registered queries of the search engine, each over its whole table, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis
from .operators import aggs, highlight, mutate, scoring, scripts, suggest
from .operators.mapping import Mapping
from .plans import builder as B
from .plans import dsl, search, sqlsubset
from .plans.compile import Fields, compile
from .sources.catalog import Catalog
from .sources.postings import Postings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEYS = {"documents": "doc_id", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "customer": "c_custkey", "benchmark": "item_id", "pages": "page_id", "nation": "n_nationkey", "supplier": "s_suppkey"}
KEYWORDS = {"orders": ("o_orderstatus", "o_orderpriority"), "events": ("event_type",), "customer": ("c_name", "c_mktsegment"), "lineitem": ("l_returnflag", "l_linestatus"), "documents": ("lang", "source"), "part": ("p_brand", "p_type"), "pages": ("url",), "conversations": ("role",)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mapping(table: str) -> dict[str, str]:
    return dict.fromkeys(KEYWORDS.get(table, ()), "keyword")


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# SQL of the analyzer's parts


def toks(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"


def padded(c: str) -> str:
    return f"(' ' || array_to_string({toks(c)}, ' ') || ' ')"


def has(c: str, t: str) -> str:
    return f"coalesce(contains({padded(c)}, ' {t} '), false)"


# predicates


def _predicate(name: str, table: str, query: dict, where: str, *, keywords: bool = True, prepare=None, source: str | None = None):
    key = KEYS.get(table, None)
    cols = [key] if key else ["l_orderkey", "l_linenumber"]

    @register(name, f"SELECT {', '.join(cols)} FROM {source or table} WHERE {where}")
    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        df = prepare(df) if prepare else df
        return df.where(compile(dsl.parse(query), Fields(df, mapping(table) if keywords else None))).select(*cols)


_predicate("q_match_all", "documents", {"match_all": {}}, "true")
_predicate("q_match_or", "documents", {"match": {"text": "und license"}}, f"{has('text', 'und')} OR {has('text', 'license')}")
_predicate("q_match_and", "documents", {"match": {"text": {"query": "the that", "operator": "and"}}}, f"{has('text', 'the')} AND {has('text', 'that')}")
_predicate("q_match_phrase", "documents", {"match_phrase": {"text": "MIT License"}}, has("text", "mit license"))
_predicate("q_match_phrase_prefix", "documents", {"match_phrase_prefix": {"text": "under the m"}}, f"contains({padded('text')}, ' under the m')")
_predicate("q_match_phrase_prefix_keyword", "customer", B.match_phrase_prefix("c_mktsegment", "BU"), "starts_with(c_mktsegment, 'BU')")
_either = f"{has('p_name', 'ring')} OR {has('p_type', 'ring')} OR {has('p_name', 'economy')} OR {has('p_type', 'economy')}"
for _kind in ("best_fields", "most_fields", "cross_fields"):
    _predicate(f"q_multi_match_{_kind}", "part", B.multi_match("ring economy", ["p_name", "p_type"], _kind), _either, keywords=False)
_predicate("q_multi_match_phrase", "part", B.multi_match("red ring", ["p_name", "p_type"], "phrase"), f"{has('p_name', 'red ring')} OR {has('p_type', 'red ring')}", keywords=False)
_predicate("q_multi_match_phrase_prefix", "part", B.multi_match("red wi", ["p_name", "p_type"], "phrase_prefix"), " OR ".join(f"(len({toks(c)}) >= 2 AND {has(c, 'red')} AND len(list_filter({toks(c)}, lambda x: starts_with(x, 'wi'))) > 0)" for c in ("p_name", "p_type")), keywords=False)
for _name, _text, _sql in (
    ("must", "+red +ring", f"{has('p_name', 'red')} AND {has('p_name', 'ring')}"),
    ("must_not", "+ring -red", f"{has('p_name', 'ring')} AND NOT {has('p_name', 'red')}"),
    ("or", "red OR old", f"{has('p_name', 'red')} OR {has('p_name', 'old')}"),
    ("implicit_and", "red widget", f"{has('p_name', 'red')} AND {has('p_name', 'widget')}"),
    ("phrase", '"small gizmo"', has("p_name", "small gizmo")),
    ("field", "p_type:promo ring", f"{has('p_type', 'promo')} AND {has('p_name', 'ring')}"),
    ("mixed", 'ring OR "old bolt" -small', f"({has('p_name', 'ring')} OR {has('p_name', 'old bolt')}) AND NOT {has('p_name', 'small')}"),
):
    _predicate(f"q_query_string_{_name}", "part", B.query_string(_text, ["p_name"]), _sql, keywords=False)
_predicate("q_query_string_all_fields", "part", B.query_string("promo"), " OR ".join(has(c, "promo") for c in ("p_name", "p_brand", "p_type")), keywords=False)
_predicate("q_simple_query_string", "part", B.simple_query_string("(red* | ring)", ["p_name"]), f"{has('p_name', 'red')} AND {has('p_name', 'ring')}", keywords=False)
_predicate("q_term_text", "documents", B.term("text", "license"), has("text", "license"))
_predicate("q_term_text_two_words", "part", B.term("p_name", "red ring"), "false", keywords=False)
_predicate("q_term_keyword", "orders", B.term("o_orderpriority", "1-URGENT"), "o_orderpriority = '1-URGENT'")
_predicate("q_term_number", "part", B.term("p_size", 7), "p_size = 7")
_predicate("q_terms", "events", B.terms("event_type", ["click", "signup"]), "event_type IN ('click', 'signup')")
_predicate("q_terms_text", "part", B.terms("p_name", ["ring", "bolt"]), f"{has('p_name', 'ring')} OR {has('p_name', 'bolt')}")
_predicate("q_range_number", "lineitem", B.range_("l_extendedprice", gte=1000, lt=20000.5), "l_extendedprice >= 1000 AND l_extendedprice < 20000.5")
_predicate("q_range_time", "orders", B.range_("o_orderdate", gte="1996-01-01", lte="1996-12-31"), "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
_predicate("q_range_string", "customer", B.range_("c_mktsegment", gt="BUILDING", lte="HOUSEHOLD"), "c_mktsegment > 'BUILDING' AND c_mktsegment <= 'HOUSEHOLD'")
_predicate("q_bool_must_filter", "documents", B.bool_(must=[B.match("text", "the"), B.match("text", "license")], filter=[B.term("lang", "en"), B.range_("n_chars", gte=500)]), f"{has('text', 'the')} AND {has('text', 'license')} AND lang = 'en' AND n_chars >= 500")
_predicate("q_bool_should", "documents", B.bool_(should=[B.term("lang", "de"), B.match("text", "license")]), f"lang = 'de' OR {has('text', 'license')}")
_predicate("q_bool_should_optional", "documents", B.bool_(filter=[B.term("lang", "fr")], should=[B.match("text", "que")]), "lang = 'fr'")
_predicate("q_bool_minimum_should_match", "orders", B.bool_(should=[B.term("o_orderstatus", "F"), B.range_("o_totalprice", gt=200000), B.term("o_orderpriority", "5-LOW")], minimum_should_match=2), "CAST(o_orderstatus = 'F' AS INT) + CAST(o_totalprice > 200000 AS INT) + CAST(o_orderpriority = '5-LOW' AS INT) >= 2")
_predicate("q_bool_must_not", "events", B.bool_(must_not=[B.term("event_type", "view"), B.range_("value", lt=5)]), "event_type <> 'view' AND NOT value < 5")
_predicate("q_bool_nested", "orders", B.bool_(filter=[B.bool_(should=[B.term("o_orderstatus", "P"), B.bool_(must=[B.term("o_orderstatus", "O")], must_not=[B.term("o_orderpriority", "5-LOW")])]), B.range_("o_totalprice", gte=1000)]), "(o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderpriority <> '5-LOW')) AND o_totalprice >= 1000")
_blank = lambda df: df.withColumn("p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_name")))
_BLANK = "(SELECT * REPLACE (CASE WHEN p_size % 3 <> 0 THEN p_name END AS p_name) FROM part)"
_predicate("q_exists", "part", B.exists("p_name"), "p_name IS NOT NULL", prepare=_blank, source=_BLANK)
_predicate("q_must_not_keeps_missing", "part", B.bool_(must_not=[B.match("p_name", "ring")]), f"NOT {has('p_name', 'ring')}", prepare=_blank, source=_BLANK)
_predicate("q_prefix", "customer", B.prefix("c_name", "Customer#00000000"), "starts_with(c_name, 'Customer#00000000')")
_predicate("q_prefix_text", "part", B.prefix("p_name", "wi"), f"len(list_filter({toks('p_name')}, lambda x: starts_with(x, 'wi'))) > 0")
_predicate("q_wildcard", "pages", B.wildcard("url", "http*/fr/*page=?&*"), r"regexp_full_match(url, 'http.*/fr/.*page=.&.*')")
_predicate("q_wildcard_text", "part", B.wildcard("p_name", "?i*t"), f"len(list_filter({toks('p_name')}, lambda x: regexp_full_match(x, '.i.*t'))) > 0")
_predicate("q_regexp", "pages", B.regexp("url", "https?://[a-z.]+/(de|es)/[0-9]+.*"), r"regexp_full_match(url, 'https?://[a-z.]+/(de|es)/[0-9]+.*')")
_predicate("q_fuzzy", "part", B.fuzzy("p_name", "wigdet"), f"len(list_filter({toks('p_name')}, lambda x: levenshtein(x, 'wigdet') <= 2)) > 0")
_predicate("q_fuzzy_one", "part", B.fuzzy("p_name", "rung", 1), f"len(list_filter({toks('p_name')}, lambda x: levenshtein(x, 'rung') <= 1)) > 0")
_predicate("q_terms_set", "part", B.terms_set("p_name", ["red", "ring", "small", "bolt"], 2), " + ".join(f"CAST({has('p_name', t)} AS INT)" for t in ("red", "ring", "small", "bolt")) + " >= 2")
_located = lambda df: df.withColumn("place", F.struct((F.col("c_custkey") % 180 - 90).cast("double").alias("lat"), (F.col("c_custkey") % 360 - 180).cast("double").alias("lon")))
_LOCATED = "(SELECT *, CAST(c_custkey % 180 - 90 AS DOUBLE) AS lat, CAST(c_custkey % 360 - 180 AS DOUBLE) AS lon FROM customer)"
_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - 48.85) / 2), 2) + cos(radians(48.85)) * cos(radians(lat)) * pow(sin(radians(lon - 2.35) / 2), 2))))"
_predicate("q_geo_distance", "customer", B.geo_distance("place", 48.85, 2.35, "4000km"), f"{_HAVERSINE} <= 4000000", prepare=_located, source=_LOCATED)
_predicate("q_geo_bounding_box", "customer", B.geo_bounding_box("place", 60, -10, 30, 40), "lat <= 60 AND lat >= 30 AND lon >= -10 AND lon <= 40", prepare=_located, source=_LOCATED)


# scores


def bm25(c: str, tokens: list[str], table: str) -> str:
    """SQL of the sum over tokens for the rows of t, whose columns are the table's with tk its tokens and s the statistics."""
    return " + ".join(f"coalesce(ln(1 + (s.n - s.d{k} + 0.5) / (s.d{k} + 0.5)) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len(tk) / s.l)), 0)" for k, _ in enumerate(tokens))


def bm25_sql(table: str, key: str, c: str, tokens: list[str], where: str) -> str:
    freq = ", ".join(f"len(list_filter(tk, lambda x: x = '{t}')) AS f{k}" for k, t in enumerate(tokens))
    stats = ", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k, _ in enumerate(tokens))
    return f"""WITH a AS (SELECT *, {toks(c)} AS tk FROM {table}), t AS (SELECT *, {freq} FROM a), s AS (SELECT count({c}) AS n, avg(len(tk)) AS l, {stats} FROM t)
SELECT {key}, round(CASE WHEN {bm25(c, tokens, table)} > 0 THEN {bm25(c, tokens, table)} ELSE 1.0 END, 6) AS score FROM t, s WHERE {where}"""


_INDEXED: dict[tuple, Postings] = {}


def indexed(spark: SparkSession, sf_dir: str, table: str, *fields: str) -> Postings:
    """The inverted index of a table's text fields, made once in a session, as a catalog does when rows are written."""
    from .sources import postings

    key = (spark.sparkContext.applicationId, sf_dir, table, fields)
    if key not in _INDEXED:
        df = search.identified(read(spark, sf_dir, table), KEYS[table])
        _INDEXED[key] = postings.build(df, list(fields), _fresh(spark))
    return _INDEXED[key]


def _scored(name: str, table: str, query: dict, sql: str):
    @register(name, sql)
    def by_postings(spark, sf_dir):
        df = search.identified(read(spark, sf_dir, table), KEYS[table])
        found = indexed(spark, sf_dir, table, "text").matching_scored(df, dsl.parse(query), Fields(df, mapping(table)))
        return found.select(KEYS[table], F.round("_score", 6).alias("score"))

    @register(name.replace("s_", "s_scan_"), sql)
    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        return scoring.matching_scored(df, dsl.parse(query), Fields(df, mapping(table))).select(KEYS[table], F.round("_score", 6).alias("score"))


_scored("s_bm25_one", "documents", B.match("text", "license"), bm25_sql("documents", "doc_id", "text", ["license"], "f0 > 0"))
_scored("s_bm25_several", "documents", B.match("text", "the under license"), bm25_sql("documents", "doc_id", "text", ["the", "under", "license"], "f0 + f1 + f2 > 0"))
_scored("s_bm25_phrase", "documents", B.match_phrase("text", "mit license"), bm25_sql("documents", "doc_id", "text", ["mit", "license"], "contains(' ' || array_to_string(tk, ' ') || ' ', ' mit license ')"))
_scored("s_bm25_bool", "documents", B.bool_(must=[B.match("text", "license the")], filter=[B.term("lang", "en")]), bm25_sql("documents", "doc_id", "text", ["license", "the"], "f0 + f1 > 0 AND lang = 'en'"))


def _two_fields(combine: str) -> str:
    one = lambda c: f"coalesce(CASE WHEN f_{c} > 0 THEN ln(1 + (s.n_{c} - s.d_{c} + 0.5) / (s.d_{c} + 0.5)) * f_{c} * 2.2 / (f_{c} + 1.2 * (0.25 + 0.75 * len(tk_{c}) / s.l_{c})) ELSE 0 END, 0)"
    cols = ("p_name", "p_type")
    a = ", ".join(f"{toks(c)} AS tk_{c}" for c in cols)
    f = ", ".join(f"len(list_filter(tk_{c}, lambda x: x = 'small')) AS f_{c}" for c in cols)
    s = ", ".join(f"count({c}) AS n_{c}, avg(len(tk_{c})) AS l_{c}, count(*) FILTER (f_{c} > 0) AS d_{c}" for c in cols)
    return f"WITH a AS (SELECT *, {a} FROM part), t AS (SELECT *, {f} FROM a), s AS (SELECT {s} FROM t) SELECT p_partkey, round({combine.format(*map(one, cols))}, 6) AS score FROM t, s WHERE f_p_name + f_p_type > 0"


for _kind, _how in (("best_fields", "greatest({}, {})"), ("most_fields", "{} + {}")):

    @register(f"s_multi_match_{_kind}", _two_fields(_how))
    def _multi(spark, sf_dir, kind=_kind):
        df = read(spark, sf_dir, "part")
        return scoring.matching_scored(df, dsl.parse(B.multi_match("small", ["p_name", "p_type"], kind)), Fields(df)).select("p_partkey", F.round("_score", 6).alias("score"))


@register("s_field_stats", f"SELECT count(text) AS total_docs, round(avg(len({toks('text')})), 6) AS avg_field_len FROM documents")
def _field_stats(spark, sf_dir):
    return scoring.field_stats(read(spark, sf_dir, "documents"), "text").withColumn("avg_field_len", F.round("avg_field_len", 6))


@register("s_top_k", bm25_sql("documents", "doc_id", "text", ["license", "the"], "f0 + f1 > 0") + " ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 20")
def _top_k(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "documents"), "doc_id")
    found = indexed(spark, sf_dir, "documents", "text").matching_scored(df, dsl.parse(B.match("text", "license the")), Fields(df))
    return found.withColumn("score", F.round("_score", 6)).orderBy(F.desc("score"), "_id").limit(20).select("doc_id", "score")


# presentation


def _planned(spark, sf_dir, table: str, s: B.Search) -> DataFrame:
    return s.plan(search.identified(read(spark, sf_dir, table), KEYS[table]), mapping(table)).hits.drop("_id", "_score")


@register("p_source_filter", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def _source_filter(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "orders"), "o_orderkey")
    p = B.Search().term("o_orderstatus", "P").source(["o_order*"], ["*date"]).plan(df, mapping("orders"))
    return p.matched.select(*search.source_columns(df, p.body["_source"]))


@register("p_sort_several", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority DESC, o_totalprice ASC, CAST(o_orderkey AS VARCHAR) LIMIT 25")
def _sorted(spark, sf_dir):
    return _planned(spark, sf_dir, "orders", B.Search().term("o_orderstatus", "P").sort("o_orderpriority", "desc").sort("o_totalprice").page(0, 25).source(["o_orderkey", "o_totalprice"]))


@register("p_page", "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY value DESC, CAST(event_id AS VARCHAR) LIMIT 10 OFFSET 30")
def _page(spark, sf_dir):
    return _planned(spark, sf_dir, "events", B.Search().term("event_type", "click").sort("value", "desc").page(30, 10).source(["event_id"]))


@register("p_sort_script", "SELECT p_partkey FROM part ORDER BY p_retailprice * 2.0 - p_size % 7.0 DESC, CAST(p_partkey AS VARCHAR) LIMIT 10")
def _by_script(spark, sf_dir):
    return _planned(spark, sf_dir, "part", B.Search().match_all().sort_script("doc['p_retailprice'].value * 2 - doc['p_size'].value % 7", "desc").source(["p_partkey"]))


@register("p_sort_geo", f"SELECT c_custkey FROM {_LOCATED} ORDER BY round({_HAVERSINE}, 3), CAST(c_custkey AS VARCHAR) LIMIT 12")
def _by_distance(spark, sf_dir):
    df = search.identified(_located(read(spark, sf_dir, "customer")), "c_custkey")
    (c, _), = search.sort_columns([{"_geo_distance": {"place": {"lat": 48.85, "lon": 2.35}, "order": "asc"}}], Fields(df))
    return df.orderBy(F.round(c, 3), "_id").limit(12).select("c_custkey")


@register("p_sort_mode", "SELECT user_id, round(list_aggregate(v, 'median'), 6) AS mid FROM (SELECT user_id, list(value) AS v FROM events GROUP BY 1) ORDER BY list_aggregate(v, 'median') DESC, CAST(user_id AS VARCHAR) LIMIT 15")
def _by_mode(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v")), "user_id")
    (c, _), = search.sort_columns([{"v": {"order": "desc", "mode": "median"}}], Fields(df))
    return df.orderBy(c.desc_nulls_last(), "_id").limit(15).select("user_id", F.round(c, 6).alias("mid"))


@register("p_total_hits", "SELECT least(count(*), 500) AS value, CASE WHEN count(*) > 500 THEN 'gte' ELSE 'eq' END AS relation FROM orders WHERE o_orderstatus = 'F'")
def _total(spark, sf_dir):
    df = search.identified(read(spark, sf_dir, "orders"), "o_orderkey")
    p = search.plan(df, B.Search().term("o_orderstatus", "F").build() | {"track_total_hits": 500}, mapping("orders"))
    return spark.createDataFrame([p.total()], "value bigint, relation string")


_MARKED = "array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda x: CASE WHEN lower(x) IN ('mit', 'license') THEN '<em>' || x || '</em>' ELSE x END), '')"


@register("p_highlight", f"SELECT doc_id, {_MARKED} AS fragment FROM documents WHERE {has('text', 'mit')} OR {has('text', 'license')}")
def _highlight(spark, sf_dir):
    df = read(spark, sf_dir, "documents")
    node, fields = dsl.parse(B.match("text", "mit license")), Fields(df, mapping("documents"))
    marks = highlight.highlight_map(node, {"fields": {"text": {}}}, fields)
    return df.where(compile(node, fields)).select("doc_id", F.get(marks["text"], 0).alias("fragment"))


# aggregations


def _agg(name: str, table: str, kind: str, body: dict, sql: str, subs: dict | None = None, rounded: tuple = ()):
    @register(name, sql)
    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        fields = Fields(df, mapping(table))
        out = aggs.ranged(df, body, fields, subs) if kind == "range" else aggs.buckets(df, kind, body, fields, subs)
        return out.withColumns({c: F.round(c, 4) for c in rounded})


_agg("a_terms", "orders", "terms", {"field": "o_orderpriority"}, "SELECT o_orderpriority AS key, count(*) AS doc_count FROM orders GROUP BY 1")
_agg("a_terms_top", "events", "terms", {"field": "user_id", "size": 7}, "SELECT user_id AS key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
_agg("a_terms_order", "customer", "terms", {"field": "c_nationkey", "size": 5, "order": {"total": "desc"}}, "SELECT c_nationkey AS key, count(*) AS doc_count, round(sum(c_acctbal), 4) AS total FROM customer GROUP BY 1 ORDER BY sum(c_acctbal) DESC, 1 LIMIT 5", {"total": {"sum": {"field": "c_acctbal"}}}, ("total",))
_agg("a_terms_metrics", "lineitem", "terms", {"field": "l_returnflag"}, "SELECT l_returnflag AS key, count(*) AS doc_count, round(avg(l_quantity), 4) AS q, round(sum(l_extendedprice), 4) AS s, min(l_discount) + 0.0 AS lo, max(l_tax) AS hi, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1", {"q": {"avg": {"field": "l_quantity"}}, "s": {"sum": {"field": "l_extendedprice"}}, "lo": {"min": {"field": "l_discount"}}, "hi": {"max": {"field": "l_tax"}}, "n": {"cardinality": {"field": "l_suppkey"}}}, ("q", "s"))
_agg("a_histogram", "lineitem", "histogram", {"field": "l_extendedprice", "interval": 5000}, "SELECT floor(l_extendedprice / 5000) * 5000.0 AS key, count(*) AS doc_count FROM lineitem GROUP BY 1")
_agg("a_histogram_metric", "part", "histogram", {"field": "p_size", "interval": 10, "min_doc_count": 2}, "SELECT floor(p_size / 10.0) * 10.0 AS key, count(*) AS doc_count, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1 HAVING count(*) >= 2", {"price": {"avg": {"field": "p_retailprice"}}}, ("price",))
for _unit in ("minute", "hour", "day", "month"):
    _agg(f"a_date_histogram_{_unit}", "events", "date_histogram", {"field": "ts", "calendar_interval": _unit}, f"SELECT epoch_ms(date_trunc('{_unit}', ts)) AS key, count(*) AS doc_count FROM events GROUP BY 1")
_agg("a_date_histogram_fixed", "events", "date_histogram", {"field": "ts", "fixed_interval": "90m"}, "SELECT epoch_ms(ts) // 5400000 * 5400000 AS key, count(*) AS doc_count FROM events GROUP BY 1")
for _unit in ("week", "quarter", "year"):
    _agg(f"a_date_histogram_{_unit}", "orders", "date_histogram", {"field": "o_orderdate", "calendar_interval": _unit}, f"SELECT epoch_ms(date_trunc('{_unit}', o_orderdate)::TIMESTAMP) AS key, count(*) AS doc_count, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1", {"total": {"sum": {"field": "o_totalprice"}}}, ("total",))
_RANGES = [{"to": 10}, {"from": 10, "to": 30}, {"from": 20, "key": "many"}, {"from": 900}]
_BOUNDS = (("*-10.0", None, 10), ("10.0-30.0", 10, 30), ("many", 20, None), ("900.0-*", 900, None))
_inside = lambda a, b: " AND ".join([*([f"l_quantity >= {a}"] if a is not None else []), *([f"l_quantity < {b}"] if b is not None else [])])
_agg("a_range", "lineitem", "range", {"field": "l_quantity", "ranges": _RANGES}, " UNION ALL ".join(f"SELECT '{k}' AS key, CAST({'NULL' if a is None else a} AS DOUBLE) AS \"from\", CAST({'NULL' if b is None else b} AS DOUBLE) AS \"to\", count(*) FILTER ({_inside(a, b)}) AS doc_count, round(avg(l_tax) FILTER ({_inside(a, b)}), 4) AS tax FROM lineitem" for k, a, b in _BOUNDS), {"tax": {"avg": {"field": "l_tax"}}}, ("tax",))


@register("a_terms_other", "WITH c AS (SELECT user_id AS key, count(*) AS doc_count FROM events GROUP BY 1), t AS (SELECT * FROM c ORDER BY 2 DESC, 1 LIMIT 5) SELECT *, CAST((SELECT sum(doc_count) FROM c) - (SELECT sum(doc_count) FROM t) AS BIGINT) AS sum_other_doc_count FROM t")
def _other(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    return aggs.terms_with_other(df, {"field": "user_id", "size": 5}, Fields(df))


@register("a_terms_array", f"SELECT x AS key, count(*) AS doc_count FROM (SELECT unnest(list_distinct({toks('p_name')})) AS x FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def _array_terms(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(analysis.tokens(F.col("p_name")).alias("words"))
    return aggs.buckets(df, "terms", {"field": "words", "size": 12}, Fields(df))


@register("a_terms_nested", "WITH c AS (SELECT source AS key, lang AS sub_key, count(*) AS sub_doc_count, sum(count(*)) OVER (PARTITION BY source) AS doc_count FROM documents GROUP BY 1, 2), p AS (SELECT key FROM c GROUP BY key ORDER BY max(doc_count) DESC, key LIMIT 6) SELECT key, CAST(doc_count AS BIGINT) AS doc_count, sub_key, sub_doc_count FROM c JOIN p USING (key) QUALIFY row_number() OVER (PARTITION BY key ORDER BY sub_doc_count DESC, sub_key) <= 2")
def _nested(spark, sf_dir):
    df = read(spark, sf_dir, "documents")
    return aggs.nested(df, ("terms", {"field": "source", "size": 6}), ("terms", {"field": "lang", "size": 2}), Fields(df, mapping("documents")))


@register("a_date_histogram_nested", "SELECT epoch_ms(date_trunc('day', ts)) AS key, sum(count(*)) OVER (PARTITION BY date_trunc('day', ts))::BIGINT AS doc_count, event_type AS sub_key, count(*) AS sub_doc_count FROM events GROUP BY date_trunc('day', ts), event_type")
def _nested_days(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    return aggs.nested(df, ("date_histogram", {"field": "ts", "calendar_interval": "day"}), ("terms", {"field": "event_type"}), Fields(df, mapping("events")))


@register("a_histogram_filled", "WITH b AS (SELECT floor(l_extendedprice / 250) * 250.0 AS key, count(*) AS doc_count FROM lineitem GROUP BY 1) SELECT CAST(k * 250 AS DOUBLE) AS key, coalesce(doc_count, 0) AS doc_count FROM (SELECT unnest(range(CAST((SELECT min(key) FROM b) / 250 AS BIGINT), CAST((SELECT max(key) FROM b) / 250 AS BIGINT) + 1)) AS k) LEFT JOIN b ON b.key = k * 250.0")
def _filled(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return aggs.filled(aggs.buckets(df, "histogram", {"field": "l_extendedprice", "interval": 250}, Fields(df)), 250.0)


for _kind, _sql in (("avg", "round(avg(l_extendedprice), 4)"), ("sum", "round(sum(l_extendedprice), 4)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("value_count", "count(l_extendedprice)"), ("cardinality", "count(DISTINCT l_extendedprice)")):

    @register(f"a_{_kind}", f"SELECT {_sql} AS value FROM lineitem")
    def _metric(spark, sf_dir, kind=_kind):
        df = read(spark, sf_dir, "lineitem")
        out = aggs.metrics(df, {"value": {kind: {"field": "l_extendedprice"}}}, Fields(df))
        return out.withColumn("value", F.round("value", 4)) if kind in ("avg", "sum") else out


@register("a_stats", "SELECT count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, round(sum(value), 4) AS sum FROM events WHERE event_type = 'purchase'")
def _stats(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    fields = Fields(df, mapping("events"))
    out = aggs.metrics(df.where(compile(dsl.parse(B.term("event_type", "purchase")), fields)), {"s": {"stats": {"field": "value"}}}, fields)
    return out.select("s.*").withColumns({"avg": F.round("avg", 6), "sum": F.round("sum", 4)})


@register("a_several", "SELECT round(avg(o_totalprice), 4) AS price, count(DISTINCT o_custkey) AS customers, max(o_totalprice) AS most, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def _several(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    fields = Fields(df, mapping("orders"))
    found = df.where(compile(dsl.parse(B.bool_(filter=[B.term("o_orderstatus", "F"), B.range_("o_totalprice", gte=1000)])), fields))
    out = aggs.metrics(found, {"price": {"avg": {"field": "o_totalprice"}}, "customers": {"cardinality": {"field": "o_custkey"}}, "most": {"max": {"field": "o_totalprice"}}, "n": {"value_count": {"field": "o_orderkey"}}}, fields)
    return out.withColumn("price", F.round("price", 4))


# suggestions

_DICTIONARY = f"(SELECT t AS token, count(*) AS freq, min(CAST(p_partkey AS VARCHAR)) AS source FROM (SELECT p_partkey, unnest(list_distinct({toks('p_name')})) AS t FROM part) GROUP BY t)"


@register("g_term", f"SELECT token AS text, CASE WHEN levenshtein(token, 'rign') > 0 THEN freq / (levenshtein(token, 'rign') + 1) ELSE freq END AS score, freq FROM {_DICTIONARY} WHERE starts_with(token, 'r') AND levenshtein(token, 'rign') <= 2 ORDER BY score DESC, text LIMIT 5")
def _suggest_term(spark, sf_dir):
    return suggest.term(search.identified(read(spark, sf_dir, "part"), "p_partkey"), "p_name", "rign")


@register("g_completion", f"SELECT token AS text, 1.0::DOUBLE AS score, source FROM {_DICTIONARY} WHERE starts_with(token, 'g') ORDER BY text LIMIT 10")
def _suggest_completion(spark, sf_dir):
    return suggest.completion(search.identified(read(spark, sf_dir, "part"), "p_partkey"), "p_name", "G")


@register("g_prefix", f"SELECT token AS text, 1.0::DOUBLE AS score FROM {_DICTIONARY} WHERE starts_with(token, 're') ORDER BY text LIMIT 10")
def _suggest_prefix(spark, sf_dir):
    return suggest.prefix(read(spark, sf_dir, "part"), "p_name", "re")


_PHRASE = f"""WITH d AS (SELECT * FROM {_DICTIONARY}), w AS (SELECT * FROM (VALUES (0, 'smal'), (1, 'rinq'), (2, 'xyzzy'), (3, 'bolt')) AS v(pos, word)),
n AS (SELECT pos, token, levenshtein(token, word) AS dist, row_number() OVER (PARTITION BY pos ORDER BY levenshtein(token, word), freq DESC, token) AS r FROM w JOIN d ON left(token, 1) = left(word, 1) AND levenshtein(token, word) <= 2)
SELECT string_agg(coalesce(token, word), ' ' ORDER BY w.pos) AS text, avg(coalesce(1 / (1 + dist), 0)) AS score FROM w LEFT JOIN n ON w.pos = n.pos AND r = 1"""


@register("g_phrase", _PHRASE)
def _suggest_phrase(spark, sf_dir):
    return suggest.phrase(search.identified(read(spark, sf_dir, "part"), "p_partkey"), "p_name", "smal rinq xyzzy bolt")


@register("g_dictionary", f"SELECT token, freq FROM {_DICTIONARY}")
def _dictionary(spark, sf_dir):
    return suggest.dictionary(search.identified(read(spark, sf_dir, "part"), "p_partkey"), "p_name").select("token", "freq")


# SQL subset


def _sql(name: str, text: str, oracle: str | None = None):
    @register(name, oracle or text)
    def run(spark, sf_dir):
        return sqlsubset.run(text, lambda t: read(spark, sf_dir, t))


_sql("l_sql_select", "SELECT o_orderkey, o_totalprice FROM orders")
_sql("l_sql_where", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice >= 1000.5 AND o_orderpriority != '5-LOW'")
_sql("l_sql_in", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND value > 10")
_sql("l_sql_like", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'MA%'")
_sql("l_sql_order_limit", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
_sql("l_sql_count", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'")


@register("l_roundtrip", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice < 50000 OR o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def _roundtrip(spark, sf_dir):
    body = {"_source": ["o_orderkey"], "query": B.bool_(filter=[B.term("o_orderstatus", "F"), B.bool_(should=[B.range_("o_totalprice", lt=50000), B.terms("o_orderpriority", ["1-URGENT", "2-HIGH"])])])}
    return sqlsubset.run(sqlsubset.to_sql("orders", body), lambda t: read(spark, sf_dir, t))


# several indices


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Text tables as indices text-documents, text-benchmark and talk, with aliases."""
    c = Catalog(spark, f"{sf_dir}/unused")  # nothing is written
    c.create("text-documents", {"mappings": {"properties": {"lang": {"type": "keyword"}, "source": {"type": "keyword"}}}}, read(spark, sf_dir, "documents"), "doc_id")
    c.create("text-benchmark", None, read(spark, sf_dir, "benchmark"), "item_id")
    c.create("talk", None, read(spark, sf_dir, "conversations").withColumn("_id", F.concat_ws("-", "conv_id", "turn")))
    c.add_alias("german", "text-documents", filter=B.term("lang", "de"))
    c.add_alias("everything", "text-benchmark")
    c.add_alias("everything", "talk")
    return c


def _across(name: str, pattern: str, sql: str):
    @register(name, sql)
    def run(spark, sf_dir):
        c = catalog(spark, sf_dir)
        df = c.scan(pattern)
        return df.where(compile(dsl.parse(B.match("text", "the")), Fields(df, c.mapping_of(pattern)))).groupBy("_index").agg(F.count("*").alias("n"), F.min("_id").alias("first"))


_THE = {"text-documents": f"SELECT 'text-documents' AS _index, count(*) AS n, min(CAST(doc_id AS VARCHAR)) AS first FROM documents WHERE {has('text', 'the')}", "text-benchmark": f"SELECT 'text-benchmark' AS _index, count(*) AS n, min(CAST(item_id AS VARCHAR)) AS first FROM benchmark WHERE {has('text', 'the')}", "talk": f"SELECT 'talk' AS _index, count(*) AS n, min(conv_id || '-' || turn) AS first FROM conversations WHERE {has('text', 'the')}"}
_across("i_all", "_all", " UNION ALL ".join(_THE.values()))
_across("i_pattern", "text-*", _THE["text-documents"] + " UNION ALL " + _THE["text-benchmark"])
_across("i_exclude", "*,-text-d*", _THE["text-benchmark"] + " UNION ALL " + _THE["talk"])
_across("i_alias", "everything", _THE["text-benchmark"] + " UNION ALL " + _THE["talk"])
_across("i_alias_filter", "german", _THE["text-documents"] + " AND lang = 'de' HAVING count(*) > 0")


@register("i_score_per_index", " UNION ALL ".join("SELECT '%s' AS _index, CAST(%s AS VARCHAR) AS _id, score FROM (%s)" % (i, k, bm25_sql(t, k, "text", ["the"], "f0 > 0")) for i, t, k in (("text-documents", "documents", "doc_id"), ("text-benchmark", "benchmark", "item_id"))))
def _per_index(spark, sf_dir):
    c = catalog(spark, sf_dir)
    df = c.scan("text-*")
    return scoring.matching_scored(df, dsl.parse(B.match("text", "the")), Fields(df, c.mapping_of("text-*"))).select("_index", "_id", F.round("_score", 6).alias("score"))


# writes


def _orders(spark, sf_dir) -> DataFrame:
    return search.identified(read(spark, sf_dir, "orders"), "o_orderkey").select("_id", "o_orderkey", "o_orderstatus", "o_totalprice")


@register("w_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS _version FROM orders UNION ALL SELECT -1 - o_orderkey, 'X', 1 FROM orders WHERE o_orderkey % 50 = 0")
def _upsert(spark, sf_dir):
    base = _orders(spark, sf_dir)
    new = base.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    more = base.where("o_orderkey % 50 = 0").select((-1 - F.col("o_orderkey")).cast("string").alias("_id"), (-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), "o_totalprice")
    return mutate.upsert(base, new.union(more)).select("o_orderkey", "o_orderstatus", "_version")


@register("w_partial_update", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _partial(spark, sf_dir):
    base = search.identified(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    patch = search.identified(read(spark, sf_dir, "labels"), "doc_id").drop("doc_id")
    return mutate.partial_update(base, patch)[0].drop("_id")


@register("w_delete", "SELECT o_orderkey FROM orders WHERE NOT o_orderkey % 7 = 0")
def _delete(spark, sf_dir):
    base = _orders(spark, sf_dir)
    return mutate.delete(base, base.where("o_orderkey % 7 = 0")).select("o_orderkey")


@register("w_delete_by_query", "SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 250000")
def _delete_by_query(spark, sf_dir):
    return mutate.delete_by_query(_orders(spark, sf_dir), B.range_("o_totalprice", gt=250000))[0].select("o_orderkey")


@register("w_update_by_query", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'seen' END AS note, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus FROM orders")
def _update_by_query(spark, sf_dir):
    script = "ctx._source.o_totalprice += 100; ctx._source.note = 'seen'; ctx._source.remove('o_orderstatus')"
    return mutate.update_by_query(_orders(spark, sf_dir), B.term("o_orderstatus", "P"), script, mapping("orders"))[0].drop("_id")


@register("w_reindex", "SELECT o_orderkey, o_totalprice, 'copied' AS o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _reindex(spark, sf_dir):
    return mutate.reindex(_orders(spark, sf_dir), query=B.term("o_orderstatus", "F"), script="ctx._source.o_orderstatus = 'copied'", mapping=mapping("orders")).select("o_orderkey", "o_totalprice", "o_orderstatus")


@register("w_pipeline", "SELECT doc_id, lang AS language, 'web' AS kind FROM documents")
def _pipeline(spark, sf_dir):
    return scripts.run_pipeline(read(spark, sf_dir, "documents").select("doc_id", "lang"), {"processors": [{"rename": {"field": "lang", "target_field": "language"}}, {"set": {"field": "kind", "value": "web"}}]})


def _operations(spark, sf_dir) -> DataFrame:
    """create on every 3rd order and on as many new ids, delete of every 4th, an update guarded by a sequence number on every 5th."""
    o = _orders(spark, sf_dir).select("_id", "o_orderkey", F.lit("W").alias("o_orderstatus"))
    part = lambda k, op, line: o.where(f"o_orderkey % {k} = 0").withColumns({"_op": F.lit(op), "line": F.col("o_orderkey") * 10 + line})
    new = part(3, "create", 1).withColumns({"_id": F.concat(F.lit("n"), "_id"), "if_seq_no": F.lit(None).cast("bigint")})
    guarded = part(5, "update", 3).withColumns({"if_seq_no": F.lit(1).cast("bigint"), "fields": F.array(F.lit("o_orderstatus"))})
    out = part(3, "create", 0).unionByName(new, True).unionByName(part(4, "delete", 2), True)
    return out.unionByName(guarded, True)


_OPS = """SELECT o_orderkey * 10 AS line, 'create' AS _op, CAST(o_orderkey AS VARCHAR) AS _id, 409 AS status FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey * 10 + 1, 'create', 'n' || o_orderkey, 201 FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey * 10 + 2, 'delete', CAST(o_orderkey AS VARCHAR), 200 FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey * 10 + 3, 'update', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 4 = 0 THEN 404 ELSE 200 END FROM orders WHERE o_orderkey % 5 = 0"""


@register("w_bulk_results", _OPS)
def _bulk_results(spark, sf_dir):
    return mutate.bulk(_orders(spark, sf_dir), _operations(spark, sf_dir))[1].select("line", "_op", "_id", "status")


@register("w_bulk_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN o_orderkey % 5 = 0 THEN 'W' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS _version FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'n' || o_orderkey, 'W', 1 FROM orders WHERE o_orderkey % 3 = 0")
def _bulk_rows(spark, sf_dir):
    return mutate.bulk(_orders(spark, sf_dir), _operations(spark, sf_dir))[0].select("_id", "o_orderstatus", "_version")


@register("w_version_conflict", "SELECT o_orderkey AS line, CASE WHEN o_orderkey % 3 <= 1 THEN 409 ELSE 200 END AS status FROM orders")
def _conflicts(spark, sf_dir):
    o = _orders(spark, sf_dir)
    ops = o.select("_id", F.lit("index").alias("_op"), F.col("o_orderkey").alias("line"), "o_orderkey", (F.col("o_orderkey") % 3).alias("version"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(9)).cast("bigint").alias("if_seq_no"))
    return mutate.bulk(o, ops)[1].select("line", "status")


@register("w_mapping_validate", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'mapper_parsing_exception: failed to parse field [value] of type [boolean]' WHEN event_type = 'error' THEN 'mapper_parsing_exception: strict mapping does not allow [props]' END AS problem FROM events")
def _validate(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("user_id") % 2 == 0, F.lit("maybe")).otherwise("true").alias("value"), F.when(F.col("event_type") == "error", F.col("props")).alias("props"))
    m = Mapping({"dynamic": "strict", "properties": {"event_id": {"type": "long"}, "event_type": {"type": "keyword"}, "value": {"type": "boolean"}}})
    return df.select("event_id", m.problem(df).alias("problem"))


# catalog, files and streams


@register("c_get", "SELECT o_orderkey, o_orderstatus FROM orders WHERE CAST(o_orderkey AS VARCHAR) = '77'")
def _get(spark, sf_dir):
    return _orders(spark, sf_dir).where(F.col("_id") == "77").limit(1).select("o_orderkey", "o_orderstatus")


@register("c_count", f"SELECT count(*) AS count FROM documents WHERE {has('text', 'license')}")
def _count(spark, sf_dir):
    df = read(spark, sf_dir, "documents")
    return df.where(compile(dsl.parse(B.match("text", "license")), Fields(df))).agg(F.count("*").alias("count"))


@register("c_cat_indices", "SELECT 'talk' AS \"index\", count(*) AS docs_count FROM conversations UNION ALL SELECT 'text-benchmark', count(*) FROM benchmark UNION ALL SELECT 'text-documents', count(*) FROM documents")
def _cat(spark, sf_dir):
    return catalog(spark, sf_dir).cat_indices().select("index", "docs_count")


@register("io_csv", "SELECT CAST(c_custkey AS VARCHAR) AS field_0, c_name AS field_1, '' AS field_2, CAST(c_custkey AS VARCHAR) AS _id FROM customer")
def _csv(spark, sf_dir):
    from .sources import files

    path = _fresh(spark)
    files.write_csv(read(spark, sf_dir, "customer"), path, ["c_custkey", "c_name", "not_there"])
    return files.read_csv(spark, path, files.ImportOptions(id_field="field_0", skip_header=True)).fillna("", ["field_2"])


@register("io_json_lines", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _json_lines(spark, sf_dir):
    from .sources import files

    path = _fresh(spark)
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files.write_json_lines(df, path)
    return files.read_json_lines(spark, path, df.schema)[0]


@register("io_bulk_ndjson", "SELECT c_custkey * 2 AS line, CASE WHEN c_custkey % 9 = 0 THEN 'create' ELSE 'index' END AS _op, CAST(c_custkey AS VARCHAR) AS _id, c_name FROM customer UNION ALL SELECT 1000000000 + c_custkey, 'delete', CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE c_custkey % 10 = 0")
def _ndjson(spark, sf_dir):
    from .sources import files

    c = read(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 9 == 0, "create").otherwise("index")
    heads = c.select((F.col("c_custkey") * 2).alias("line"), F.concat(F.lit('{"'), kind, F.lit('":{"_id":"'), "c_custkey", F.lit('"}}')).alias("value"))
    bodies = c.select((F.col("c_custkey") * 2 + 1).alias("line"), F.to_json(F.struct("c_name")).alias("value"))
    gone = c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1_000_000_000).alias("line"), F.concat(F.lit('{"delete":{"_id":"'), "c_custkey", F.lit('"}}')).alias("value"))
    return files.bulk_operations(heads.union(bodies).union(gone), "line", c.select("c_name").schema).select("line", "_op", "_id", "c_name")


@register("io_snapshot", "SELECT o_orderkey, o_orderstatus FROM orders")
def _snapshot(spark, sf_dir):
    from .sources import files

    c = Catalog(spark)
    c.create("orders", None, _orders(spark, sf_dir))
    path = _fresh(spark)
    files.snapshot(c, path, "first")
    c.drop("orders")
    files.restore_snapshot(c, path, "first")
    return c.frame("orders").select("o_orderkey", "o_orderstatus")


@register("io_dump_restore", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _dump(spark, sf_dir):
    from .sources import files

    c = Catalog(spark)
    c.create("part", None, read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "p_partkey")
    path = _fresh(spark)
    files.dump({"part": c.frame("part")}, path)
    files.restore(c, path, "part-again")
    return c.frame("part-again").select("p_partkey", "p_name", "p_retailprice")


@register("st_ingest_events", "SELECT event_id, user_id, value FROM events")
def _ingest(spark, sf_dir):
    from .streaming import ingest

    c = Catalog(spark)
    c.create("events")
    schema = read(spark, sf_dir, "events").schema
    stream = ingest.read_parquet(spark, f"{sf_dir}/events.parquet*", schema)
    ingest.into_index(stream, c, "events", _fresh(spark), "event_id").awaitTermination()
    return c.frame("events").select("event_id", "user_id", "value")


@register("st_date_histogram", "SELECT epoch_ms(date_trunc('hour', ts)) AS key, event_type, count(*) AS doc_count, round(sum(value), 4) AS sum_value FROM events GROUP BY 1, 2")
def _windows(spark, sf_dir):
    from .streaming import ingest

    schema = read(spark, sf_dir, "events").schema
    stream = ingest.read_parquet(spark, f"{sf_dir}/events.parquet*", schema)
    out = ingest.date_histogram(stream, "ts", "1 hour", late="60 days", by="event_type", value="value")
    name = "windows_" + _fresh(spark).rpartition("-")[2]
    q = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _fresh(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).withColumn("sum_value", F.round("sum_value", 4))


def _fresh(spark) -> str:
    import uuid

    from .sources import storage

    return f"{storage.scratch(spark)}/query-{uuid.uuid4().hex}"


from . import queries_store  # noqa: E402, F401  registers the queries of the catalog, files and services


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text, a filter, scores, a page and highlights in one request."""
    df = search.identified(read(spark, sf_dir, "documents"), "doc_id", "documents")
    s = B.Search().bool(must=[B.match("text", "the in license")], filter=[B.term("lang", "en")]).page(0, 10).source(["doc_id", "lang", "source", "n_chars"]).highlight("text")
    return s.plan(df, mapping("documents")).hits
