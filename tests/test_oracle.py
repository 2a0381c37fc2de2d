"""Every registered query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from fathomdex import queries

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def test_all_have_sql():
    assert queries.QUERIES.keys() == queries.SQL.keys()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    c = duck.execute(queries.SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(x)]) for x in sorted(names)]) for r in c.fetchall())
    assert sorted(repr([plain(r[x]) for x in sorted(names)]) for r in df.collect()) == want


def test_typed_predicates_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = queries.QUERIES["q_range_number"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_extendedprice,1000.0)" in plan and "LessThan(l_extendedprice,20000.5)" in plan
    plan = queries.QUERIES["q_term_keyword"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "o_orderdate" not in plan


def test_scores_need_no_shuffle_of_documents(spark, sf_dir):
    plan = queries.QUERIES["s_scan_bm25_several"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_postings_are_read_by_bucket_and_token_and_no_text_is(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = queries.QUERIES["s_bm25_several"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert "In(token, [license,the,under])" in plan
    assert "RLIKE" not in plan and "regexp_count" not in plan and "text#" not in plan.split("ReadSchema")[0]


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"_id", "_score", "highlight"} <= set(rows[0].asDict())
    assert list(rows) == sorted(rows, key=lambda r: (-r._score, r._id))
