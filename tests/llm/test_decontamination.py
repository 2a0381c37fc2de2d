import random
import re

import brute
import pytest

from fathomdex.llm import decontamination as D
from fathomdex.llm.common import WordIds

ITEMS = "item_id bigint, text string"


def _made(seed, n_items=25, n_docs=60):
    r = random.Random(seed)
    common, rare = [f"c{k}" for k in range(30)], [f"r{k}" for k in range(600)]
    sentence = lambda n: " ".join(r.choice(common if r.random() < 0.5 else rare) for _ in range(n)).capitalize() + "."
    items = [(k, " ".join(sentence(r.randint(3, 60)) for _ in range(r.randint(1, 3)))) for k in range(n_items)]
    docs = []
    for k in range(n_docs):
        parts = [sentence(r.randint(1, 80)) for _ in range(r.randint(0, 4))]
        if r.random() < 0.6:
            t = items[r.randrange(n_items)][1].split()
            if r.random() < 0.5:  # altered, more or less
                t = [r.choice(rare) if r.random() < r.choice((0.05, 0.3)) else x for x in t]
            if r.random() < 0.2:
                t = t[: len(t) // 2]
            parts.insert(r.randint(0, len(parts)), " ".join(t))
        docs.append((k, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed,threshold,question", [(1, 0.6, 0.7), (2, 0.3, 0.3), (3, 0.8, 0.0)])
def test_against_scores_of_all_pairs(frame, spark, seed, threshold, question):
    docs, items = _made(seed)
    want = brute.contaminated(docs, items, D.UNIT, threshold, question, question)
    index = D.Index([(i, t, None) for i, t in items])
    ids_of = WordIds(index.numbers)
    got = {(d, h[0]) for d, t in docs for h in index.search(ids_of.of(t), t, threshold, question, question)}
    assert got == want and want


def test_wand_finds_all_units_above_the_threshold():
    docs, items = _made(7)
    index = D.Index([(i, t, None) for i, t in items])
    per = -(-len(index.units) // index.blocks)
    r = random.Random(2)
    for _ in range(200):
        terms = r.sample(range(len(index.numbers)), 25)
        for b in range(index.blocks):
            scores = {}
            for t in terms:
                for u, v in index.by_block.get((t, b), ()):
                    assert u // per == b
                    scores[u] = scores.get(u, 0) + v
            got = dict(index.wand(terms, b, 0.1))
            assert got.keys() == {u for u, v in scores.items() if v >= 0.1}


def test_query_finds_whole_items(spark, sf_dir):
    from fathomdex.llm.registry import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries()["op6_decontamination"](spark, sf_dir).collect()}
    assert got == brute.contaminated(docs, items, D.UNIT, D.THRESHOLD, D.QUESTION, D.ANSWER)
    assert got >= {(d, i) for d, t in docs for i, x in items if " ".join(brute.words(x)) in " ".join(brute.words(t))}


def test_odd_rows(frame, odd_rows, spark):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (2, odd_rows[0][1]), (None, odd_rows[0][1]), (3, None), (4, ""), (5, "!!")], ITEMS)
    got = D.contaminated(frame(odd_rows, clash=True), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(5, 1), (5, 2), (6, 1), (6, 2)]
    assert D.contaminated(frame([]), items).count() == 0
    assert D.contaminated(frame(odd_rows), spark.createDataFrame([], ITEMS)).count() == 0
    kept = D.clean(frame(odd_rows, clash=True), items)
    assert kept.columns == frame(odd_rows, clash=True).columns
    assert kept.count() == len(odd_rows) - 3


def test_answers_of_their_own_column(frame, spark):
    items = spark.createDataFrame([(1, "which river crosses the old town of ferrania today", "the quiet blue marn")], ITEMS + ", answer string")
    docs = frame([(1, "intro. which river crosses the old town of ferrania today? the quiet blue marn, of course"), (2, "which river crosses the old town of ferrania today? nobody knows")])
    assert [r.doc_id for r in D.contaminated(docs, items).collect()] == [1]


def test_items_with_their_last_sentence_changed_or_missing(frame, spark):
    """Without an answer column the last sentence is no answer that must be there; with one, it is."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    body = " ".join(word() for _ in range(30))
    text = lambda last: f"{body}. {last}"
    items = spark.createDataFrame([(1, text("One two three four."))], ITEMS)
    rows = [(1, text("One two three four.")), (2, text("One two three five.")), (3, body + "."), (4, text("Other words altogether stand here.")), (5, " ".join(body.split()[:15])), (6, "One two three four.")]
    assert sorted(x.doc_id for x in D.contaminated(frame(rows), items).collect()) == [1, 2, 3, 4]
    assert sorted(x.doc_id for x in D.clean(frame(rows), items).collect()) == [5, 6]
    given = spark.createDataFrame([(1, body, "one two three four")], ITEMS + ", answer string")
    assert [x.doc_id for x in D.contaminated(frame(rows), given).collect()] == [1]


@pytest.mark.parametrize("seed,threshold,question", [(1, 0.6, 0.7), (2, 0.3, 0.3)])
def test_whole_items_against_all_pairs(frame, spark, seed, threshold, question):
    """What either the question and the derived answer or, as one question, the whole item finds."""
    docs, items = _made(seed)
    as_one = [(i, re.sub(r"[.!?]", "", t)) for i, t in items]  # one sentence, so without an answer
    want = brute.contaminated(docs, items, D.UNIT, threshold, question, question) | brute.contaminated(docs, as_one, D.UNIT, threshold, question, question)
    got = {(x.doc_id, x.item_id) for x in D.contaminated(frame(docs), spark.createDataFrame(items, ITEMS), threshold, question, question).collect()}
    assert got == want > brute.contaminated(docs, items, D.UNIT, threshold, question, question)


def test_large_benchmarks_are_searched_in_parts(frame, spark, monkeypatch):
    """Results, scores included, are the same however many parts the postings come in."""
    docs, items = _made(11)
    table = spark.createDataFrame(items, ITEMS)
    rows = lambda: sorted(map(tuple, D.contaminated(frame(docs), table).collect()))
    whole = rows()
    monkeypatch.setattr(D, "PART_WORDS", 300)
    assert len(list(D._parts(D._items(table)))) > 3
    assert rows() == whole and whole
