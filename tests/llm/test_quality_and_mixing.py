import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from fathomdex.llm import mixing
from fathomdex.llm import quality_rules as Q

LABELS = "doc_id bigint, quality int, toxic int"


def test_ledger_of_odd_rows(frame, odd_rows):
    rows = Q.ledger(frame(odd_rows, clash=True)).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].failed == Q.BIT["null_text"] | Q.BIT["no_words"] and by[1].n_chars == 0
    assert by[2].failed == by[3].failed == Q.BIT["no_words"]
    assert by[5].failed == 0 and by[5].kept_v2_all and by[4].n_words == 40_000
    assert Q.ledger(frame([])).count() == 0
    kept = Q.keep(frame(odd_rows, clash=True))
    assert kept.columns == frame(odd_rows, clash=True).columns
    assert kept.count() == sum(r.kept_v2_all for r in rows)


@pytest.mark.parametrize("rule,text", [
    ("few_letters", "1 2 3 4 " * 10), ("marked_up", "a # b | c <d> e"), ("shouting", "buy!! now!! it is good"), ("upper_case", "THIS IS LOUD " * 8), ("repeated_words", "word word word word word other word word word"),
    ("wordless_chunks", "word 1 word 2 3 " * 5), ("long_words", "x" * 60), ("no_words", "\n"),
])
def test_each_rule_fails_its_case(frame, rule, text):
    assert Q.ledger(frame([(1, text)])).first().failed & Q.BIT[rule]


def test_ablation_is_the_ledger_recounted(frame):
    docs = frame([(1, "fine words here"), (2, "# # *"), (3, ""), (4, "x" * 60), (5, "oh!! " + "y" * 90), (6, None)])
    ledger = Q.ledger(docs)
    failed = [r.failed for r in ledger.collect()]
    for r in Q.ablation(ledger).collect():
        bit = Q.BIT[r.rule]
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(bool(f & bit) for f in failed), sum(f == bit for f in failed), sum(f & ~bit == 0 for f in failed))


def _labelled(frame, spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    docs, labels = [], []
    for k in range(300):
        toxic = k % 10 == 0
        w = [word() for _ in range(40)]
        if toxic:
            for _ in range(5):
                w.insert(r.randrange(len(w)), "grumpf" + word())
        docs.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_stems_are_learned_from_labels(frame, spark):
    docs, labels = _labelled(frame, spark)
    table = spark.createDataFrame([x for x in labels if x[0] < 200] + [(None, 1, 1), (1, None, None), (2, 1, None), (999, 0, 1)], LABELS).withColumn("text", F.lit("x"))
    stems = Q.learn_stems(frame(docs), table)
    assert any("grumpf".startswith(s) for s in stems)
    kept = {r.doc_id for r in Q.keep(frame(docs, clash=True), table).collect()}
    assert not {k for k, _, toxic in labels if toxic} & kept  # those without a label too
    assert len({k for k, _, toxic in labels if not toxic} - kept) <= 3
    assert Q.learn_stems(frame(docs), table.limit(0)) == [] == Q.learn_stems(frame([]), table)


@pytest.mark.parametrize("text", ["x" * 1_000_000, "1" * 1_000_000, "!" * 1_000_000, "1!" * 500_000, "日本" * 500_000, "# " * 500_000, " " * 1_000_000])
def test_a_text_without_white_space_takes_linear_time(frame, text):
    import time

    docs = frame([(1, text)]).cache()
    Q.ledger(docs.limit(0)).collect(), docs.count()
    began = time.monotonic()
    r = Q.ledger(docs).first()
    assert r.n_chars == len(text) and time.monotonic() - began < 10


_CHUNKS = ["!!", "a!!", "!!!", "a!!b!!", "!a!!", "1!!", "é1", "12", "!", "a", "日!!", "--x--", "A!", "!! !!"]


def test_counts_of_chunks_against_plain_python(frame):
    r = random.Random(9)
    docs = [(k, r.choice(("", " ", "\n")).join("".join(r.choice(_CHUNKS) for _ in range(r.randint(1, 3))) + r.choice((" ", "\n", "\t\r", "  ")) for _ in range(12))) for k in range(80)]
    texts = dict(docs)
    for x in Q.ledger(frame(docs)).collect():
        chunks = [c for c in texts[x.doc_id].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if c]
        assert (x.n_words, x.n_shouted, x.n_alone) == (len(chunks), sum("!!" in c[1:] for c in chunks), sum(any(map(str.isalpha, c)) for c in chunks))
        assert x.n_repeated == sum(a == b for a, b in zip(chunks, chunks[1:]))


def test_the_sample_is_bounded_and_copies_count_once(frame, spark):
    docs = [(k, "the same toxic copy with unmistakable words") for k in range(50)] + [(100 + k, f"plain words number w{k}") for k in range(50)]
    labels = spark.createDataFrame([(k, 1, int(k < 100)) for k, _ in docs], LABELS)
    assert Q.learn_stems(frame(docs), labels) == []


@pytest.mark.parametrize("weights", [{}, {"a": 0.2, "c": 0.5}])
def test_mixing_against_one_seat_at_a_time(frame, weights):
    r = random.Random(2)
    docs = [(k, "w " * r.choice((1, 5, 40, 300)), r.choice(("a", "a", "a", "b", "c", None))) for k in range(400)] + [(3, "w " * 7, "b"), (None, "w", "a"), (900, None, "a"), (901, "", "b")]
    options = {"weights": weights, "block_tokens": 128, "budget": 0.6, "alpha": 0.5, "seed": 7, "shard_tokens": 9000}
    rows = mixing.plan(frame(docs, clash=True), **options).collect()
    assert {x.doc_id for x in rows} == brute.mixed(docs, **options)
    assert len({x.shard for x in rows}) > 1
    assert all(x.block < x.quota for x in rows)
    kept = mixing.select(frame(docs, clash=True), **options)
    assert kept.columns == frame(docs, clash=True).columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(i for i, *_ in docs if i in {x.doc_id for x in rows})


def test_given_weights_give_sainte_lague_quotas(frame):
    docs = [(k, "w " * 100, "abc"[k % 3]) for k in range(600)]
    rows = mixing.plan(frame(docs), weights={"a": 5, "b": 3, "c": 1}, block_tokens=100, budget=0.3).collect()
    got = {s: len({(x.shard, x.block) for x in rows if x.source == s}) for s in "abc"}
    assert got == brute.sainte_lague(180, {"a": 5, "b": 3, "c": 1}, dict.fromkeys("abc", 200))


def test_tokens_follow_the_weights_however_long_documents_are(frame):
    """A source of documents of many blocks and one of short documents, at equal weights."""
    docs = [(k, "w " * 900, "long") for k in range(200)] + [(1000 + k, "w " * 7, "short") for k in range(30_000)] + [(50_000 + k, "w " * r, "mixed") for k, r in enumerate((1, 2000, 3, 150) * 100)]
    rows = mixing.plan(frame(docs), weights={"long": 0.25, "short": 0.25, "mixed": 0.5}, block_tokens=100, budget=0.5, shard_tokens=150_000).collect()
    got = Counter()
    for x in rows:
        got[x.source] += x.n_tokens
    total = sum(got.values())
    assert len({x.shard for x in rows}) > 1
    assert all(abs(got[s] / total - w) < 0.03 for s, w in (("long", 0.25), ("short", 0.25), ("mixed", 0.5))), got


def test_mixing_of_odd_rows(frame, odd_rows):
    assert mixing.plan(frame([])).count() == 0
    ids = {x.doc_id for x in mixing.plan(frame(odd_rows), budget=1.0).collect()}
    assert ids == {i for i, *_ in odd_rows if i is not None}
    assert {x.source for x in mixing.plan(frame(odd_rows), budget=1.0).collect()} == {"", "a", "b", "c"}
