import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fathomdex.llm import line_dedup, ngram_jaccard


def _edited(r, s):
    k = r.randrange(len(s))
    return r.choice((s[:k] + s[k + 1 :], s[:k] + r.choice("abc ") + s[k:], s[:k] + r.choice("abc") + s[k + 1 :]))


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_all_pairs(frame, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("ab ") for _ in range(r.randint(18, 26))).strip() or "x" for _ in range(12)]
    docs = []
    for i in range(25):
        lines = [s if (x := r.random()) < 0.3 else _edited(r, s) if x < 0.7 else _edited(r, _edited(r, s)) for s in r.choices(base, k=4)]
        docs.append((i, "\n".join((" " + s + "\r") if r.random() < 0.2 else s for s in lines)))
    docs += [(100 + k, t) for k, t in enumerate(("Yes.\nNo.\nYes.", "\n\nYes.\nYep.\n \t", "a\nb\na", base[0][:19] + "\n" + base[0][:19] + "\n" + base[0][:18]))]
    gone = brute.line_dedup(docs, 20)
    got = {(x.doc_id, x.line_no) for x in line_dedup.duplicate_lines(frame(docs)).collect()}
    assert got == gone and gone
    for x in line_dedup.line_dedup(frame(docs)).collect():
        lines = dict(docs)[x.doc_id].split("\n")
        assert x.text == "\n".join(s for k, s in enumerate(lines) if (x.doc_id, k) not in gone)
        assert (x.n_lines, x.n_removed) == (len(lines), sum(i == x.doc_id for i, _ in gone))


def test_lines_of_odd_rows(frame, odd_rows):
    rows = line_dedup.line_dedup(frame(odd_rows, clash=True)).collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
    assert by[1][0].text is None and by[1][0].n_lines is None
    assert (by[2][0].text, by[2][0].n_lines, by[2][0].n_removed) == ("", 1, 0)
    assert {x.text for x in by[None]} == {odd_rows[0][1], None}
    assert by[6][0].n_removed == 0  # four characters more than that of 5
    assert by[4][0].text == odd_rows[5][1]
    assert by[3][0].n_removed == 0  # empty lines
    assert line_dedup.line_dedup(frame([])).count() == 0


def test_very_long_lines_one_edit_apart(frame):
    r = random.Random(6)
    line = "".join(r.choice("abcdefgh ") for _ in range(200_000)).strip()
    k = 77_777
    docs = [(1, line), (2, line[:k] + line[k + 1 :]), (3, line[:k] + "Z" + line[k + 1 :]), (4, line[:k] + "ZZ" + line[k:])]
    got = {(x.doc_id, x.kept_doc_id) for x in line_dedup.duplicate_lines(frame(docs)).collect()}
    assert got == {(2, 1), (3, 1)}


def test_joins_that_are_not_broadcast_find_the_same(frame, monkeypatch):
    docs = [(k, f"line {k % 7} of a page with boilerplate\nthe same\nanother line, number {k} of very many") for k in range(60)]
    rows = lambda: sorted(map(tuple, line_dedup.duplicate_lines(frame(docs)).collect()))
    want = rows()
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert rows() == want and len(want) > 60


def test_the_earliest_of_many_copies_stays(frame):
    line = "the very same line in very many documents"
    docs = [(k, line if k % 2 else line.replace("very m", "wery m")) for k in range(300)]
    got = line_dedup.line_dedup(frame(docs)).where("n_removed = 0").collect()
    assert [x.doc_id for x in got] == [0]


def _copies(seed, vocabulary, n_groups=12):
    r = random.Random(seed)
    word = lambda: "w%d" % int(vocabulary * r.random() ** 2)
    docs, i = [], 0
    shared = [word() for _ in range(60)]
    for _ in range(n_groups):
        base = [word() for _ in range(r.choice((2, 4, 12, 40, 150)))]
        if r.random() < 0.4:
            base += shared
        for _ in range(r.choice((1, 1, 2, 5, 14))):
            w = [word() if r.random() < r.choice((0, 0.02, 0.06, 0.15)) else x for x in base]
            docs.append((i * 7 % 1009, " ".join(w)))
            i += 1
    return docs


def _wanted(docs, n, t):
    """{doc_id: (class_id, copy_of, n_copies, n_links)} by brute force, over rows with distinct ids."""
    pairs = brute.jaccard(docs, n, t)
    label, found = brute.components(pairs), {}
    for pair, s in pairs.items():
        for i, j in (pair, pair[::-1]):
            x = found.setdefault(i, [label[i], i, 0, 0])
            x[3] += 1
            if s > 1 - 1e-12:
                x[1], x[2] = min(x[1], j), x[2] + 1
    return {i: tuple(x) for i, x in found.items()}


def _links(df, *options):
    return {r.doc_id: (r.class_id, r.copy_of, r.n_copies, r.n_links) for r in ngram_jaccard.jaccard_links(df, *options).collect()}


@pytest.mark.parametrize("seed,vocabulary,n,t", [(1, 3000, 5, 0.5), (2, 40, 3, 0.5), (3, 12, 2, 0.4), (4, 3000, 3, 0.8)])
def test_links_against_all_pairs(frame, seed, vocabulary, n, t):
    docs = _copies(seed, vocabulary)
    docs += [(2000 + k, x) for k, (_, x) in enumerate(docs[::5])]
    want = _wanted(docs, n, t)
    assert _links(frame(docs), n, t) == want and want
    assert ngram_jaccard.jaccard_links(frame(docs), n, t).count() == len(want)


@pytest.mark.parametrize("seed,n,t", [(1, 5, 0.5), (2, 2, 0.4)])
def test_class_pairs_and_membership(frame, seed, n, t):
    docs = _copies(seed, 200)
    docs += [(2000 + k, x) for k, (_, x) in enumerate(docs[::4])]
    rep = {r.doc_id: r.copy_of for r in ngram_jaccard.membership(frame(docs), n).collect()}
    got = [(r.doc_a, r.doc_b, r.jaccard) for r in ngram_jaccard.class_pairs(frame(docs), n, t).collect()]
    want = {(rep[a], rep[b]): s for (a, b), s in brute.jaccard(docs, n, t).items() if rep[a] != rep[b]}
    want = {(min(p), max(p)): s for p, s in want.items()}
    assert len(got) == len(want) > 0
    assert all(abs(want[a, b] - s) < 1e-9 for a, b, s in got)


def test_tiles_and_shuffled_joins_lose_nothing(frame, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", 7)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_BYTES", 0)
    docs = _copies(9, 60, 20)
    assert _links(frame(docs), 2, 0.6) == _wanted(docs, 2, 0.6)


def test_equal_bits_of_different_grams_lose_nothing(frame, monkeypatch):
    """Where only 4 bits of a gram travel, nearly all collide."""
    whole = ngram_jaccard.mix
    monkeypatch.setattr(ngram_jaccard, "mix", lambda x: whole(x) & whole(x).dtype.type(0xFFFFFF000000000F))
    docs = _copies(8, 500, 8)
    flush = ngram_jaccard._Packed(5, 8)
    for _, t in docs:
        list(flush(__import__("pyarrow").record_batch({"doc_id": [0], "text": [t]})))
    out, shared = flush.flush(), ngram_jaccard._Shared()
    rows = []
    for k in range(len(out["bucket"])):
        shared.rows.append(tuple(out[c][k] for c in ("sids", "sizes", "counts", "grams")))
        shared.rows.append(shared.rows[-1])  # read by another task as well
        rows += list(shared.flush())
    held = {}
    for r in rows:
        for sid, grams in zip(r["sid"].tolist(), r["grams"].tolist()):
            held[sid] = held.get(sid, 0) + grams
    hashes = ngram_jaccard.WordHashes()
    for a, b in brute.jaccard(docs, 5, 0.5):
        for i in (a, b):
            g = ngram_jaccard.gram_set(hashes, dict(docs)[i], 5)
            if brute.grams(dict(docs)[a], 5) != brute.grams(dict(docs)[b], 5):
                assert len(g) / 2 <= held[ngram_jaccard._names(g)[0]] <= len(g)


def _sets(groups, seed=4):
    import numpy as np

    r, sets = random.Random(seed), []
    for base, count, *part in groups:
        for _ in range(count):
            own = set(r.sample(base, int(len(base) * (part[0] if part else 0.92)))) | {10_000_000 + 50 * len(sets) + k for k in range(0 if part else r.randint(0, 6))}
            sets.append(np.array(sorted(own), np.uint64))
    return sets


def _divided(monkeypatch, sets, threshold):
    """(pairs, [(depth, rows) of each block that was joined])."""
    import numpy as np

    region, blocks, plain = ngram_jaccard.Region(sets, threshold), [], ngram_jaccard.Region.pairs

    def seen(self, rows, mine=None, depth=0, radius=None):
        blocks.append((depth, len(rows)))
        yield from plain(self, rows, mine, depth, radius)

    monkeypatch.setattr(ngram_jaccard.Region, "pairs", seen)
    found = [(int(a), int(b)) for x, y, _ in region.pairs(np.arange(len(sets))) for a, b in zip(x, y)]
    assert len(found) == len(set(found))
    full = [set(map(int, s)) for s in sets]
    assert set(found) == {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(full[a] & full[b]) / len(full[a] | full[b]) >= threshold}
    return found, blocks


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_clusters_of_one_window_are_divided(monkeypatch, threshold):
    """600 sets in 30 clusters, at the query's own threshold and constants: no cell holds more than its cluster."""
    found, blocks = _divided(monkeypatch, _sets([(range(g * 1000, g * 1000 + 120), 20) for g in range(30)]), threshold)
    assert max(n for depth, n in blocks if depth == 1) <= 40 and found or threshold == 0.9


def test_cells_are_divided_again(monkeypatch):
    """Clusters of a family are 0.6 apart.  One loose member makes a cell so wide that all the family is in its window; at half the radius it is apart."""
    groups = []
    for f in range(4):
        common = list(range(f * 100_000, f * 100_000 + 72))
        for g in range(8):
            base = common + list(range(f * 100_000 + 1000 * (g + 1), f * 100_000 + 1000 * (g + 1) + 48))
            groups += [(base, 30, 0.98), (base, 1, 0.8)]
    sets = _sets(groups)
    _, blocks = _divided(monkeypatch, sets, 0.5)
    assert max(n for depth, n in blocks if depth == 1) <= 260 < len(sets)
    assert any(depth == 1 and n > ngram_jaccard.LEAF for depth, n in blocks)
    assert max(n for depth, n in blocks if depth == 2) <= 40


def test_links_of_odd_rows(frame, odd_rows):
    df = frame(odd_rows, clash=True)
    assert {(r.doc_id, r.class_id, r.copy_of, r.n_copies, r.n_links) for r in ngram_jaccard.jaccard_links(df).collect()} == {(5, 5, 5, 0, 1), (6, 5, 6, 0, 1)}
    assert ngram_jaccard.jaccard_links(frame([])).count() == 0
    assert ngram_jaccard.keep_one(frame([])).count() == 0
    twice = frame([(1, "one text of seven words stands here"), (1, "another text that has seven words too"), (2, "another text that has seven words too"), (3, "One text of seven words stands here!")])
    assert {(r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard.jaccard_links(twice).collect()} == {(1, 1, 2), (2, 1, 1), (3, 1, 1)}


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 620)] + [(k, (k + 1) % 10 + 900) for k in range(900, 910)] + [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(150)] + [(7, 7)]
    got = {x.node: x.least for x in ngram_jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: j for i, j in brute.components(edges).items() if i != j}


def test_one_of_each_group_stays(frame, odd_rows):
    docs = _copies(5, 2000)
    group = brute.components(brute.jaccard(docs, ngram_jaccard.N, ngram_jaccard.THRESHOLD))
    left = {r.doc_id for r in ngram_jaccard.keep_one(frame(docs)).collect()}
    assert left == {i for i, _ in docs if group.get(i, i) == i}
    kept = ngram_jaccard.keep_one(frame(odd_rows, clash=True))
    assert kept.columns == frame(odd_rows, clash=True).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-9, 1, 2, 3, 4, 5, 5, 7, 7, 8]
    assert kept.where("doc_id is null").count() == 2


def test_one_row_of_repeated_ones(frame, odd_rows, spark):
    docs = frame(odd_rows, clash=True)
    got = corpus_pipeline.near_duplicates(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [-9, 1, 2, 3, 4, 5, 7, 7, 8]
    twice = frame([*odd_rows, *((i, t, "0") for i, t, _ in odd_rows)], clash=True)
    rows = ngram_jaccard.one_row(twice)
    assert rows.columns == twice.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in rows.collect()))) == sorted(map(repr, {(i, t) for i, t, _ in odd_rows}))
    assert {r.source for r in rows.collect()} <= {"0", None} and {r["__text"] for r in rows.collect()} == {"x"}
    assert ngram_jaccard.one_row(twice.select("text", "doc_id")).count() == rows.count()
    assert ngram_jaccard.one_row(frame([])).count() == 0


def _through(f, columns, schema):
    out = [*(f(pa.RecordBatch.from_arrays([pa.array(columns[c], type=t) for c, t in schema.items()], names=[*schema])) or ()), *(f.close() or ())]
    return {c: [v for x in out for v in x[c]] for c in (out[0] if out else ())}


PACKED = {"bucket": pa.int32(), "sids": pa.binary(), "sizes": pa.binary(), "counts": pa.binary(), "grams": pa.binary()}


def test_grams_are_packed_and_sorted_in_bounded_memory(monkeypatch):
    """Of a bucket's grams only some are held in wide arrays: workers of an executor share its memory with the JVM."""
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(900)]
    sets = [np.union1d(s, t[:50]) for s, t in zip(sets, sets[1:] + sets[:1])]
    monkeypatch.setattr(ngram_jaccard, "gram_set", lambda hashes, text, n: sets[int(text)])
    n = sum(map(len, sets))
    assert n > 2_500_000
    tracemalloc.start()
    packed = _through(ngram_jaccard._Packed(5, 1), {"doc_id": range(900), "text": [*map(str, range(900))]}, {"doc_id": pa.int64(), "text": pa.string()})
    for_packing, _ = tracemalloc.get_traced_memory()[1], tracemalloc.reset_peak()
    shared = _through(ngram_jaccard._Shared(), packed, PACKED)
    for_sorting = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(for_packing, for_sorting) < 40 * n
    assert sum(map(len, packed["grams"])) == 4 * n
    by: dict = {}
    for s, k in zip(shared["sid"], shared["grams"]):
        by[s] = by.get(s, 0) + k
    # 50 with each neighbour, and a few that are equal in the packed bits
    assert len(by) == 900 and all(100 <= k < 110 for k in by.values())


@pytest.mark.parametrize("seed", range(3))
def test_grams_in_parts_are_shared_as_in_one(monkeypatch, seed):
    r = np.random.default_rng(seed)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 60)).astype(np.uint64)) for _ in range(80)]
    sets += sets[:20]  # copies, read again
    monkeypatch.setattr(ngram_jaccard, "gram_set", lambda hashes, text, n: sets[int(text)])

    def found():
        packed = _through(ngram_jaccard._Packed(5, 3), {"doc_id": range(100), "text": [*map(str, range(100))]}, {"doc_id": pa.int64(), "text": pa.string()})
        rows = sorted(zip(*packed.values()), key=lambda x: x[0])
        shared = _through(ngram_jaccard._Shared(), dict(zip(packed, zip(*rows))), PACKED)
        by: dict = {}
        for s, z, p, k, m in zip(*(shared[c] for c in ("sid", "size", "pivot", "grams", "sets"))):
            had = by.get((s, p), (z, 0, 0))
            by[s, p] = (z, had[1] + k, max(had[2], m))
        return by

    own = {ngram_jaccard._names(s)[0]: {*s.tolist()} for s in sets}
    want: dict = {}
    for g in range(400):
        held = sorted(s for s, x in own.items() if g in x)
        for s in held if len(held) > 1 else ():
            z, k, m = want.get((s, held[0]), (len(own[s]), 0, 0))
            want[s, held[0]] = (z, k + 1, max(m, len(held)))
    assert found() == want
    monkeypatch.setattr(ngram_jaccard, "HELD", 100)
    monkeypatch.setattr(ngram_jaccard, "SORTED", 37)
    monkeypatch.setattr(ngram_jaccard, "CACHE", 10)
    assert found() == want
