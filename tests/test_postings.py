"""The inverted index as it is built: blocks of postings against a count of each document's tokens."""

import random
from collections import Counter

from pyspark.sql import functions as F

from fathomdex.functions import analysis
from fathomdex.sources import postings, storage


def built(spark, docs, fields=("a", "b")):
    df = spark.createDataFrame(docs, "_id string, a string, b string").coalesce(1)
    return postings.build(df, list(fields), f"{storage.scratch(spark)}/test-{random.randrange(1 << 60)}")


def test_what_is_shuffled_and_sorted_are_tokens_of_stretches_not_of_documents(spark):
    docs = [(str(k), "red ring " * (k % 3 + 1) + "old", None) for k in range(500)]
    p = built(spark, docs, ["a"])
    assert p._postings.count() == 1500
    assert spark.read.parquet(f"{p.path}/postings").count() == 3 + 1  # a block a token, and the statistics
    assert p.stats("a") == (500, sum(2 * (k % 3 + 1) + 1 for k in range(500)) / 500) and p.frequencies([("a", "red"), ("a", "")]) == {("a", "red"): 500}


def test_blocks_hold_every_posting_whatever_ends_a_stretch(spark, monkeypatch):
    r = random.Random(5)
    names = ["line\nfeed", "back\\slash", "\\n", "\\0", "\\s", "", "é", "two words"]
    docs = [(names[k] if k < len(names) else str(k), *(r.choice([None, "", " ;; "]) if r.random() < 0.2 else " ".join(r.choices(["Red", "ring", "Größe", "x-ray", "İx", "K9", "日本", "a" * 300], k=r.randint(0, 9))) for _ in range(2))) for k in range(120)]
    lowered = {d[0]: [None if t is None else analysis.tokenize(t) for t in d[1:]] for d in docs}
    want = sorted((f, t, i, n, len(w)) for i, own in lowered.items() for f, w in zip("ab", own) if w for t, n in Counter(w).items())
    for docs_most, bytes_most, rows in ((16384, 64 << 20, 256), (7, 64 << 20, 3), (16384, 200, 1)):
        # read by the closure's module in the workers, so the blocks are made here and not by build
        monkeypatch.setattr(postings, "STRETCH_DOCS", docs_most)
        monkeypatch.setattr(postings, "STRETCH_BYTES", bytes_most)
        monkeypatch.setattr(postings, "ROWS", rows)
        import pyarrow as pa

        table = pa.table({n: pa.array([None if d[k] is None else d[k].lower() if k else d[k] for d in docs], pa.string()) for k, n in enumerate(("_id", "a", "b"))})
        found = [x for b in postings._blocks(["a", "b"])(iter(table.to_batches(max_chunksize=50))) for x in b.to_pylist() if x["token"]]
        blocks = spark.createDataFrame(found, postings._BLOCK)
        got = blocks.select("field", "token", F.posexplode(postings._listed(F.col("ids"))).alias("k", "_id"), F.split("tf", " ").alias("tf"), F.split("lengths", " ").alias("n"))
        assert sorted((x.field, x.token, x._id, int(x.tf[x.k]), int(x.n[x.k])) for x in got.collect()) == want
    p = built(spark, docs)
    assert sorted((x.field, x.token, x._id, x.tf, x.length) for x in p._postings.collect()) == want
    for k, f in enumerate("ab"):
        own = [w[k] for w in lowered.values() if w[k] is not None]
        assert p.stats(f) == (len(own), sum(map(len, own)) / len(own))
        assert {(x.token, x.freq, x.source) for x in p.terms(f).collect()} == {(t, sum(t in w for w in own), min((i for i, w in lowered.items() if w[k] and t in w[k]), key=str.encode)) for t in {t for w in own for t in w}}


def test_an_index_without_documents_or_ids(spark):
    p = built(spark, [])
    assert p.stats("a") == (0, 0.0) and p._postings.count() == 0 and p.holders([("a", "red")]).count() == 0
    p = built(spark, [(None, "red", None), ("7", "red red", None)])
    assert p.frequencies([("a", "red")]) == {("a", "red"): 2} and {(x._id, x.tf) for x in p._postings.collect()} == {(None, 1), ("7", 2)}
    assert [x.source for x in p.terms("a").collect()] == ["7"]
