"""The pipeline against brute force, stage by stage, and the contract of its stages."""

import re

import brute
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from fathomdex.llm import bpe, decontamination, mixing, ngram_jaccard, quality_rules, registry, token_binary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    failed = {r.doc_id for r in registry.queries()["op5_quality_rules"](spark, sf_dir).where("not kept_v2_all").collect()}
    left = {i: x for i, x in docs.items() if i not in failed}
    group = brute.components(brute.jaccard([(i, t) for i, (t, _) in left.items()], ngram_jaccard.N, ngram_jaccard.THRESHOLD))
    left = {i: x for i, x in left.items() if group.get(i, i) == i}
    bad = {d for d, _ in brute.contaminated([(i, t) for i, (t, _) in left.items()], items, decontamination.UNIT, decontamination.THRESHOLD, decontamination.QUESTION, decontamination.ANSWER)}
    left = {i: x for i, x in left.items() if i not in bad}
    chosen = brute.mixed([(i, t, s) for i, (t, s) in left.items()], mixing.WEIGHTS, mixing.BLOCK_TOKENS, mixing.BUDGET, mixing.ALPHA, mixing.SEED, mixing.SHARD_TOKENS)
    enc = tiktoken.Encoding("test", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken"), special_tokens={})
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got = {r.doc_id: token_binary.read_tokens(bytes(r.packed), r.block_offsets, r.n_tokens, r.bits).tolist() for r in rows}
    assert len(got) == len(rows) > 0
    assert got == {i: enc.encode_ordinary(docs[i][0]) for i in chosen}
    assert failed and bad and group


def test_stages(spark, sf_dir, frame):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "decontamination", "mixing", "token_binary"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        empty = f(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
        if name != "token_binary":
            assert empty.columns == COLUMNS
    extra = docs.limit(30).withColumn("gone", F.lit(1))
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, extra, sf_dir).columns == [*COLUMNS, "gone"]


def test_stages_take_odd_rows(spark, sf_dir, odd_rows, frame):
    """Nulls, empty and very long texts, repeated rows and clashing columns: what each stage keeps of its predecessor's rows."""
    docs = frame([*odd_rows, *odd_rows], clash=True)
    kept = {}
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf_dir).cache()
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=repr)
    assert kept["quality_rules"] == sorted([x for x in (None, 4, 5, 5, 6, 7, 7, -9) for _ in "12" if x != 8] + [8] * (2 * (8 in kept["quality_rules"])), key=repr)
    assert kept["ngram_jaccard_join"] == sorted([*({*kept["quality_rules"]} - {6}), 7], key=repr)  # one id has two texts
    assert kept["decontamination"] == kept["ngram_jaccard_join"]
    assert set(kept["mixing"]) <= set(kept["decontamination"]) - {None} and kept["token_binary"] == kept["mixing"]


def test_run_leaves_only_its_result(spark, sf_dir):
    import os

    from fathomdex.sources.storage import scratch

    corpus_pipeline.run(spark, sf_dir)
    where = scratch(spark).removeprefix("file:")
    left = [os.listdir(f"{where}/{x}") for x in os.listdir(where) if x.startswith("pipeline-")]
    assert left and all(x == ["4_token_binary"] for x in left)


def test_clean_documents_pass_the_filters(spark, sf_dir):
    """Labelled good and not toxic: kept by the quality stage."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1 and toxic = 0").select("doc_id"), "doc_id", "left_semi")
    kept = corpus_pipeline.STAGES[0][1](spark, good, sf_dir)
    assert kept.count() >= 0.98 * good.count()


def test_sources_stay_apart():
    """Nothing else in the library imports the subpackage."""
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "fathomdex").rglob("*.py"):
        if "llm" not in p.relative_to(root / "fathomdex").parts:
            assert not re.search(r"\bllm\b", p.read_text())
