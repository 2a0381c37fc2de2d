import math
import random

import brute
import pytest

from fathomdex.llm import bpe, lm_scoring

PIECES = {p: math.log(x) for p, x in {"▁": 0.1, "▁a": 0.1, "a": 0.1, "ab": 0.2, "b": 0.1, "ba": 0.1, "aba": 0.05, "▁ab": 0.05, "<0xC3>": 0.01, "<0xA9>": 0.01}.items()}


def test_forward_sums_every_segmentation():
    lattice, r = lm_scoring.Lattice(PIECES), random.Random(5)
    for _ in range(100):
        s = "▁" + "".join(r.choice("abé") for _ in range(r.randint(0, 8)))
        assert math.isclose(lattice.log_prob(s), brute.log_prob(PIECES, s), rel_tol=1e-9)
        assert math.isclose(sum(map(lattice.log_prob, lattice.fragments(s))), lattice.log_prob(s), rel_tol=1e-9)


def test_expected_counts_are_of_the_posterior():
    from collections import Counter

    lattice, found = lm_scoring.Lattice(PIECES), Counter()
    lattice.expect("▁ab", 3, found)
    cuts = {("▁ab",): 0.05, ("▁a", "b"): 0.01, ("▁", "ab"): 0.02, ("▁", "a", "b"): 0.001}
    total = sum(cuts.values())
    for p in ("▁ab", "▁a", "▁", "ab", "a", "b"):
        assert math.isclose(found[p], 3 * sum(w for c, w in cuts.items() if p in c) / total, rel_tol=1e-9)


def test_scores_of_odd_rows(frame, odd_rows):
    rows = lm_scoring.lm_scores(frame(odd_rows, clash=True)).collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].log_prob is None and by[1][0].n_words is None
    assert by[2][0].log_prob == 0 and by[2][0].bits_per_char is None
    assert by[5][0] == by[5][1]
    assert by[4][0].log_prob < -100_000
    assert lm_scoring.lm_scores(frame([])).count() == 0 == lm_scoring.lm_scores(frame([(1, None)])).where('corpus_rank is not null').count()


def test_query_against_plain_sums(spark, sf_dir):
    """Scores of all whole documents by the vocabulary's own weights, and each one's rank among all."""
    from fathomdex.llm.registry import queries

    model = lm_scoring.load_pieces(f"{bpe.DEFAULT_DIR}/piece_bpe_32k.model")
    assert math.isclose(sum(map(math.exp, model.values())), 1, rel_tol=1e-6)
    longest = max(map(len, model))
    rows = queries()["op2_lm_scores"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r.log_prob, brute.document_log_prob(model, texts[r.doc_id], longest), rel_tol=1e-9, abs_tol=1e-9)
    values = sorted(r.bits_per_char for r in rows if r.bits_per_char is not None)
    assert all((r.corpus_rank is None) == (r.bits_per_char is None) for r in rows)
    for r in rows:
        if r.bits_per_char is not None:
            assert math.isclose(r.corpus_rank, sum(v < r.bits_per_char for v in values) / len(values), abs_tol=1e-12)


def test_a_score_depends_on_its_text_alone(frame):
    one = lm_scoring.lm_scores(frame([(1, "some words of prose")])).first()
    many = lm_scoring.lm_scores(frame([(k, "zorb quaxil vlim") for k in range(50)] + [(99, "some words of prose")])).where("doc_id = 99").first()
    assert one.log_prob == many.log_prob


def test_ranks_of_repeated_rows_and_ties(frame):
    rows = lm_scoring.lm_scores(frame([(k, "the same text") for k in range(60)] + [(100 + k, "xq" * (k + 1)) for k in range(40)] + [(300, None), (301, "")])).collect()
    values = [r.bits_per_char for r in rows if r.bits_per_char is not None]
    assert len({r.corpus_rank for r in rows if r.doc_id < 60}) == 1
    for r in rows:
        assert r.corpus_rank is None if r.bits_per_char is None else math.isclose(r.corpus_rank, sum(v < r.bits_per_char for v in values) / 100)


def test_training_makes_the_corpus_likelier(frame):
    docs = frame([(k, "zorb quaxil zorb vlim " * 50) for k in range(20)])
    prior = lm_scoring.load_pieces(f"{bpe.DEFAULT_DIR}/piece_bpe_32k.model")
    before = lm_scoring.score(docs, prior).first().log_prob
    assert lm_scoring.score(docs, lm_scoring.train(docs, prior, prior=1000.0)).first().log_prob > before


@pytest.mark.parametrize("text", ["a", "a  b\tc", "x" * 3000])
def test_long_words_and_white_space(frame, text):
    r = lm_scoring.lm_scores(frame([(1, text)])).first()
    assert r.n_words == len(text.split()) and r.n_chars == sum(map(len, text.split())) + r.n_words and math.isfinite(r.log_prob)
