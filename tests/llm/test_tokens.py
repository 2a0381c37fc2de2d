import random

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomdex.llm import bpe, token_binary, token_counts

VOCABULARY = f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("test", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})


_TEXT = st.text(alphabet=st.sampled_from(list("ab Zé\n\t'.!?19 日 ")), max_size=60)
_state = {}


def coders():
    if not _state:
        whole = bpe.whole_tokens(VOCABULARY)
        _state["c"] = (token_counts.Counts(VOCABULARY, whole), bpe.encoder(VOCABULARY), whole)
    return _state["c"]


@settings(max_examples=400, deadline=None)
@given(_TEXT)
def test_chunks_agree_with_the_encoder(text):
    counts, enc, whole = coders()
    pre = regex.findall(bpe.PATTERN, text)
    n, one, rest = counts.of(text)
    assert (n, one) == (len(pre), sum(p in whole for p in pre))
    assert one + rest == len(enc.encode_ordinary(text))


def test_whole_tokens_are_proved(encoding):
    whole = bpe.whole_tokens(VOCABULARY)
    assert len(whole) > 30_000
    for s in random.Random(1).sample(sorted(whole), 2000):
        assert encoding.encode_ordinary(s) == [whole[s]]


def test_counts_of_odd_rows(frame, odd_rows, encoding):
    got = sorted(map(tuple, token_counts.token_counts(frame(odd_rows, clash=True)).select("doc_id", "n_tokens").collect()), key=repr)
    want = sorted(((i, None if t is None else len(encoding.encode_ordinary(t))) for i, t, *_ in odd_rows), key=repr)
    assert got == want
    assert token_counts.token_counts(frame([])).count() == 0


def test_query_is_exact(spark, sf_dir, encoding):
    from fathomdex.llm.registry import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries()["op1_token_counts"](spark, sf_dir).collect():
        assert r.n_tokens == len(encoding.encode_ordinary(docs[r.doc_id])) == r.n_whole + r.n_merged


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 20).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=70))), st.integers(1, 16), st.integers(0, 70), st.integers(0, 70))
def test_packing_round_trip_and_random_access(made, block, start, stop):
    bits, ids = made
    offsets, data = token_binary.pack_blocks(np.array(ids, np.uint32), bits, block)
    assert token_binary.read_tokens(data, offsets, len(ids), bits, block=block).tolist() == ids
    assert token_binary.read_tokens(data, offsets, len(ids), bits, start, stop, block=block).tolist() == ids[start:stop]
    assert len(data) <= sum(-(-len(ids[k : k + block]) * bits // 8) for k in range(0, len(ids), block))


def test_width():
    assert [token_binary.width(n) for n in (1, 2, 3, 4, 5, 256, 257, 50_256, 65_536, 65_537)] == [1, 1, 2, 2, 3, 8, 9, 16, 16, 17]


def test_binary_of_odd_rows_and_the_query(frame, odd_rows, spark, sf_dir, encoding):
    from fathomdex.llm.registry import queries

    rows = token_binary.token_binary(frame(odd_rows, clash=True)).collect()
    texts = sorted(((i, t) for i, t, *_ in odd_rows), key=repr)
    got = sorted(((r.doc_id, None if r.packed is None else encoding.decode(token_binary.read_tokens(bytes(r.packed), r.block_offsets, r.n_tokens, r.bits).tolist())) for r in rows), key=repr)
    assert got == texts
    assert token_binary.token_binary(frame([])).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries()["op7_token_binary"](spark, sf_dir).collect():
        assert token_binary.read_tokens(bytes(r.packed), r.block_offsets, r.n_tokens, r.bits).tolist() == encoding.encode_ordinary(docs[r.doc_id])


@pytest.mark.parametrize("c", [" ", "\n", "\u3000", "a", "1", "-", "é", "a\u00a0"])
def test_very_long_runs(c, frame):
    """A million of one character between words; the library's own expression ends the process on such white space."""
    counts, enc, _ = coders()
    text = "a b" + c * (1_000_000 // len(c)) + "b c"
    if c.isspace():
        want = enc.encode_ordinary("a b") + enc._encode_single_piece(c * 999_999) + enc.encode_ordinary(c + "b c")
    else:
        want = [x for p in regex.findall(bpe.PATTERN, text) for x in enc._encode_single_piece(p)]
    assert bpe.encode(enc, text) == want
    assert sum(counts.of(text)[1:]) == len(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "  ", "\n\n\n", " \t  ", "b c", "é", "\u3000 \u3000", " "]), max_size=12))
def test_cut_runs_agree_with_the_encoder(parts):
    _, enc, _ = coders()
    text, long = "".join(parts), (bpe.RUN, bpe._LONG)
    try:
        bpe.RUN, bpe._LONG = 2, __import__("re").compile(bpe._LONG.pattern.replace("{10000,}", "{2,}"))
        assert bpe.encode(enc, text) == enc.encode_ordinary(text)
    finally:
        bpe.RUN, bpe._LONG = long


def test_a_page_of_white_space_does_not_end_the_job(frame):
    docs = frame([(1, "a" + " " * 1_000_000 + "b"), (2, "c d"), (3, " " * 1_000_000)])
    counted = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert counted == {r.doc_id: r.n_tokens for r in token_binary.token_binary(docs).collect()} and counted[1] > 2
