"""Exact self-join of documents by the Jaccard similarity of their word n-gram sets, as a join in metric space.

Jaccard distance d = 1 - similarity is a metric; t = 1 - threshold is the distance within which two sets are linked.  Documents with equal sets are one
class, of which one row travels; links are found between classes.  In n-gram space documents that share no passage are all at distance 1
from each other, so the first windows are found by shared grams, without a distance computed:

1.  The grams of every class travel packed, bucket by bucket of the gram hash, and numpy finds in each bucket which are shared.  A set with
    a partner shares at least the threshold's part of its grams with others; the rest leave.
2.  First pivots and windows d(x, p) < 1: the least set that holds a gram is the gram's pivot; a set is in the windows of the pivots it shares grams with.
    Pivots that stand for less than half the threshold's part of its grams altogether are left out, the most widespread grams (boilerplate) first: two
    sets of the threshold's similarity share more grams than both leave out, so one pivot remains that both have.
3.  Boundaries: a pair is decided in the first window that both are in.  Each window's size and the earlier window that holds most of it are aggregates;
    those in that one are only replicas, and all others its core.  In the window, the distances to the pivot are computed, and by the triangle
    inequality only replicas at most t beyond its farthest core member stay.
4.  A window joins recursively: pivots are taken among its sets so that each set is within a radius r of one, with r + t < 1, and belongs to the Voronoi cell of the
    nearest; r_q is the cell's own radius.  A set of a later cell is replicated to the cell of q if d(x, q) <= r_q + t, which no partner of
    a member exceeds.  Large cells are divided again, with half the radius, until they are small or do not shrink; exact intersections
    decide, where |d(x, p) - d(y, p)| <= t.  Windows too large for one task are joined as tiles.

Every step keeps each pair of the threshold, so the result is exact.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE, WordHashes, distinct, gram_hashes, map_columns, mix, settled, texts, unused, without

N = 5
THRESHOLD = 0.5
#: Grams of one bucket, about; of those that a task packs and sorts at a time.  They bound memory, not results.
BUCKET, HELD, SORTED = 3_000_000, 1_000_000, 500_000
#: Sets of a region that one task holds of each side; larger regions are joined tile by tile.
TILE = 1500
#: Cells up to this size are not divided again, and divisions after one another at most.
LEAF, DEPTH = 128, 8
#: Earlier windows of a set that are looked at to find the one that holds most of a window.
EARLIER = 8
#: Bytes up to which the sets that have a place are sent to all executors to meet their texts; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20
PAIRS = "doc_a bigint, doc_b bigint, jaccard double"
#: Either two documents of different classes that are connected, or a class and a number of documents linked to its own.
FOUND = "doc_a bigint, doc_b bigint, h1 bigint, h2 bigint, links bigint"


def gram_set(hashes: WordHashes, text: str | None, n: int) -> np.ndarray:
    return distinct(gram_hashes(hashes.of(text), n))


def _names(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    x = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def _named(n: int):
    """First reading: the name and size of each document's set."""
    hashes = WordHashes()

    def batch(b):
        out: dict = {"doc_id": [], "h1": [], "h2": [], "n": []}
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            g = gram_set(hashes, t, n)
            if len(g):
                for c, v in zip(out, (i, *_names(g), len(g))):
                    out[c].append(v)
        yield out

    return batch


class _Packed:
    """Second reading: grams, packed by bucket: for each set its name, size and number of grams there, then 32 more bits of each gram."""

    def __init__(self, n, buckets):
        self.n, self.buckets, self.hashes = n, buckets, WordHashes()
        self.sids, self.grams, self.held, self.known = [], [], 0, set()

    def __call__(self, batch):
        for t in batch.column(1).to_pylist():
            g = gram_set(self.hashes, t, self.n)
            if not len(g):
                continue
            sid = _names(g)[0]
            if sid in self.known:
                continue
            if len(self.known) > CACHE:
                self.known.clear()
            self.known.add(sid)
            self.sids.append(sid)
            self.grams.append(mix(g))
            self.held += len(g)
            if self.held > HELD:
                yield self.flush()

    def close(self):
        if self.held:
            yield self.flush()

    def flush(self):
        size = np.array([len(g) for g in self.grams])
        g, sids = np.concatenate(self.grams), np.array(self.sids, np.int64)
        self.sids, self.grams, self.held = [], [], 0
        b = ((g >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.uint16 if self.buckets < 65536 else np.int32)
        g = g.astype("<u4")
        by = np.argsort(b, kind="stable")
        g, ends = g[by], np.searchsorted(b[by], np.arange(self.buckets + 1, dtype=b.dtype))
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)[by]
        out: dict = {"bucket": [], "sids": [], "sizes": [], "counts": [], "grams": []}
        for k in range(self.buckets):
            lo, hi = ends[k], ends[k + 1]
            if lo < hi:
                own, n = np.unique(row[lo:hi], return_counts=True)
                for c, v in zip(out, (k, sids[own].tobytes(), size[own].astype("<u4").tobytes(), n.astype("<u4" if n.max() > 65535 else "<u2").tobytes(), g[lo:hi].tobytes())):
                    out[c].append(v)
        return out


class _Shared:
    """Reads the rows of one bucket after another: (sid, size, pivot, number of grams, most sets that hold one) of the grams that several sets share."""

    def __init__(self):
        self.bucket, self.rows = None, []

    def __call__(self, batch):
        for r in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if r[0] != self.bucket:
                yield from self.flush()
                self.bucket = r[0]
            self.rows.append(r[1:])

    def close(self):
        yield from self.flush()

    def flush(self):
        rows, self.rows = self.rows, []
        if not rows:
            return
        sets = np.concatenate([np.frombuffer(s, np.int64) for s, *_ in rows])
        sizes = np.concatenate([np.frombuffer(z, "<u4") for _, z, *_ in rows])
        counts = np.concatenate([np.frombuffer(c, "<u2" if len(c) * 4 == len(s) else "<u4").astype(np.int64) for s, _, c, _ in rows])
        gram = np.concatenate([np.frombuffer(g, "<u4") for *_, g in rows])
        del rows
        sets, once, place = np.unique(sets, return_index=True, return_inverse=True)  # numbers in the order of the names
        size = sizes[once].astype(np.int64)
        again = np.ones(len(place), bool)
        again[once] = False  # a set that several tasks read counts once
        place = np.repeat(np.where(again, -1, place).astype(np.int32), counts)
        parts = len(gram) // SORTED + 1
        for k in range(parts):  # all sets of a gram are in one part
            here = (place >= 0) & (gram >= k * 2**32 // parts) & (gram <= (k + 1) * 2**32 // parts - 1)
            yield from self.part(gram[here], place[here], sets, size)

    @staticmethod
    def part(gram, place, sets, size):
        key = gram.astype(np.int64) << 32 | place
        key.sort()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        key, times = key[at], np.diff(np.r_[at, len(key)])  # grams of a set that are equal in these bits count each
        gram, own = key >> 32, key & 0xFFFFFFFF
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else at
        df = np.diff(np.r_[first, len(gram)])
        pivot, df = np.repeat(own[first], df), np.repeat(df, df)  # the least set of the gram
        keep = df > 1
        own, pivot, df, times = own[keep], pivot[keep], df[keep], times[keep]
        if len(own):
            key = own << 32 | pivot
            by = np.argsort(key, kind="stable")
            key, df, times = key[by], df[by], times[by]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            yield {"sid": sets[key[at] >> 32], "size": size[key[at] >> 32], "pivot": sets[key[at] & 0xFFFFFFFF], "grams": np.add.reduceat(times, at), "sets": np.maximum.reduceat(df, at)}


class Region:
    """Exact pairs among the sets of one window (or tile), found by division into cells around pivots."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.t, self.threshold = 1 - threshold, threshold
        self.size = np.array([len(s) for s in sets])
        grams = np.concatenate(sets)
        rows = np.repeat(np.arange(len(sets)), self.size)
        _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
        keep = count[inverse] > 1  # a gram of one set only adds to no intersection
        shared = np.flatnonzero(count > 1)
        renumber = np.zeros(len(count), np.int64)
        renumber[shared] = np.arange(len(shared))
        self.rows, self.cols, self.width = rows[keep], renumber[inverse[keep]], len(shared)
        self.starts = np.searchsorted(self.rows, np.arange(len(sets) + 1))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of rows a with rows b."""
        out = np.zeros((len(a), len(b)), np.float32)
        step = max(64, 4_000_000 // max(1, len(a) + len(b)))
        ca, ra = self._take(a)
        cb, rb = self._take(b)
        for lo in range(0, self.width, step):
            x, y = (self._dense(c, r, len(k), lo, step) for c, r, k in ((ca, ra, a), (cb, rb, b)))
            if x is not None and y is not None:
                out += x @ y.T
        return out

    def _take(self, rows):
        idx = np.concatenate([np.arange(self.starts[r], self.starts[r + 1]) for r in rows]) if len(rows) else np.empty(0, np.int64)
        return self.cols[idx], np.repeat(np.arange(len(rows)), self.starts[rows + 1] - self.starts[rows])

    def _dense(self, cols, rows, n, lo, step):
        k = (cols >= lo) & (cols < lo + step)
        if not k.any():
            return None
        x = np.zeros((n, min(step, self.width - lo)), np.float32)
        x[rows[k], cols[k] - lo] = 1
        return x

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        c = self.common(a, b)
        return 1 - c / (self.size[a][:, None] + self.size[b][None, :] - c)

    def cells(self, rows: np.ndarray, radius: float) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(members, replicas) of each Voronoi cell, as places in rows; None if there is no use in dividing them."""
        left, found, d = np.ones(len(rows), bool), 0, []
        while left.any():
            some = np.flatnonzero(left)[:32]
            new = self.distance(rows, rows[some])
            chosen: list[int] = []
            for k in range(len(some)):
                if not chosen or new[some[k], chosen].min() > radius:
                    chosen.append(k)
            d.append(new[:, chosen])
            left &= d[-1].min(1) > radius
            left[some[chosen]] = False
            found += len(chosen)
            if found > len(rows) // 4:
                return None  # mostly sets far from all others
        d = np.concatenate(d, 1)
        nearest = d.argmin(1)
        out = []
        for q in range(d.shape[1]):
            own = nearest == q
            if own.any():
                near = (nearest > q) & (d[:, q] <= d[own, q].max() + self.t + 1e-5)
                out.append((np.flatnonzero(own), np.flatnonzero(near)))
        return out if max(len(a) + len(b) for a, b in out) <= 0.8 * len(rows) else None

    def pairs(self, rows: np.ndarray, mine: np.ndarray | None = None, depth: int = 0, radius: float | None = None):
        """(i, j, similarity) with i < j of rows.  mine has a bit for each division, set for members and not for replicas: a pair needs one of each."""
        mine = np.zeros(len(rows), np.int64) if mine is None else mine
        radius = (1 - self.t) / 2 if radius is None else radius
        if len(rows) > LEAF and depth < DEPTH and (parts := self.cells(rows, radius)):
            for own, near in parts:
                every = np.concatenate((own, near))
                flag = np.r_[np.full(len(own), 1 << depth), np.zeros(len(near), np.int64)]
                yield from self.pairs(rows[every], mine[every] | flag, depth + 1, radius / 2)
            return
        full = (1 << depth) - 1
        pivot = self.distance(rows, rows[:1])[:, 0]
        by = np.argsort(self.size[rows], kind="stable")
        rows, mine, pivot = rows[by], mine[by], pivot[by]
        for lo in range(0, len(rows), 512):
            a = np.arange(lo, min(lo + 512, len(rows)))
            # partners of these rows that are not smaller: by size within the threshold
            most = self.size[rows[a[-1]]] / self.threshold + 1e-6
            b = np.arange(lo, np.searchsorted(self.size[rows], most, side="right"))
            near = np.abs(pivot[a][:, None] - pivot[b][None, :]) <= self.t + 1e-5
            near &= b[None, :] > a[:, None]
            if full:
                near &= (mine[a][:, None] | mine[b][None, :]) == full
            if not near.any():
                continue
            c = self.common(rows[a], rows[b])
            s = self.size[rows[a]][:, None] + self.size[rows[b]][None, :] - c
            x, y = np.nonzero(near & (c + 1e-9 >= self.threshold * s - 1e-6))
            exact = c[x, y].astype(np.float64) / s[x, y]
            i, j = rows[a[x]], rows[b[y]]
            ok = exact >= self.threshold - 1e-12
            yield np.minimum(i, j)[ok], np.maximum(i, j)[ok], exact[ok]


class _Join:
    """Consumes rows sorted by part (window, tile); every part is joined when its last row is in."""

    def __init__(self, threshold: float, pairs: bool):
        self.threshold, self.pairs, self.key, self.rows = threshold, pairs, None, []

    def __call__(self, batch):
        cols = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for region, i, j, block, core, earlier, sid, h2, rep, copies, data in zip(*cols):
            if (region, i, j) != self.key:
                yield from self.flush()
                self.key = (region, i, j)
            self.rows.append((rep, core, block, np.frombuffer(data, np.uint64), sid, h2, earlier, copies))

    def close(self):
        yield from self.flush()

    def flush(self):
        # rows of one set come from rows of docs that are repeated
        rows, self.rows = list({(r[4], r[5]): r for r in self.rows}.values()), []
        if len(rows) < 2:
            return
        rows.sort(key=lambda r: r[0])
        region, i, j = self.key
        rep, copies = (np.array([r[k] for r in rows], np.int64) for k in (0, 7))
        core, block = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        if not core.any():
            return
        r = Region([r[3] for r in rows], self.threshold)
        everyone = np.arange(len(rows))
        pivot = next((k for k, x in enumerate(rows) if x[4] == region), int(np.flatnonzero(core)[0]))
        d = r.distance(everyone, np.array([pivot]))[:, 0]
        everyone = everyone[core | (d <= d[core].max() + r.t + 1e-5)]
        before = _bits([x[6] for x in rows])
        root, links = list(range(len(rows))), np.zeros(len(rows), np.int64)

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges: list[tuple[int, int]] = []
        for a, b, s in r.pairs(everyone):
            k = ~(before[a] & before[b]).any(1)  # else decided in an earlier window
            if i != j:
                k &= block[a] != block[b]
            a, b, s = a[k], b[k], s[k]
            if self.pairs:
                yield {"doc_a": np.minimum(rep[a], rep[b]), "doc_b": np.maximum(rep[a], rep[b]), "jaccard": s}
                continue
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((min(x, y), max(x, y)))
        if not self.pairs and links.any():
            a, b = (rep[[e[k] for e in edges]].tolist() for k in (0, 1))
            with_links = np.flatnonzero(links)
            none, missing = [None] * len(with_links), [None] * len(edges)
            yield {
                "doc_a": a + none, "doc_b": b + none, "h1": missing + [rows[k][4] for k in with_links], "h2": missing + [rows[k][5] for k in with_links], "links": missing + links[with_links].tolist(),
            }


def _bits(lists: list[list[int]]) -> np.ndarray:
    """The lists' values as bits, a row for each list."""
    number: dict[int, int] = {}
    for x in lists:
        for v in x:
            number.setdefault(v, len(number))
    out = np.zeros((len(lists), len(number) // 64 + 1), np.uint64)
    for k, x in enumerate(lists):
        for v in x:
            at = number[v]
            out[k, at // 64] |= np.uint64(1) << np.uint64(at % 64)
    return out


def _classes(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, (doc_id, h1, h2) of each document's sets, (h1, h2, rep, copies, grams) of each class); rep is the least doc_id of copies documents."""
    d = texts(docs).where("doc_id is not null and text is not null")
    named = settled(map_columns(d, functools.partial(_named, n), "doc_id bigint, h1 bigint, h2 bigint, n bigint"))
    once = named.groupBy("h1", "h2", "doc_id").agg(F.max("n").alias("n"))  # repeated rows are one document
    return d, once.select("doc_id", "h1", "h2"), settled(once.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("grams")))


def _few(df: DataFrame, weight: Column | int) -> DataFrame:
    """df, settled already, to be broadcast if its rows' weights in bytes are few."""
    size = df.agg(F.sum(weight if isinstance(weight, Column) else F.lit(weight))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _join(d: DataFrame, classes: DataFrame, n: int, threshold: float, pairs: bool) -> DataFrame:
    """Rows of PAIRS between different classes, by their least documents; or, if not pairs, of FOUND."""
    buckets = max(8, math.ceil((classes.agg(F.sum("grams")).first()[0] or 0) / BUCKET))

    # Up to the windows, 64 bits name a set: if two sets share them, each only gets the other's places as well.
    packed = map_columns(d, functools.partial(_Packed, n, buckets), "bucket int, sids binary, sizes binary, counts binary, grams binary").repartitionById(buckets, "bucket")
    shared = map_columns(packed, _Shared, "sid bigint, size bigint, pivot bigint, grams bigint, sets bigint")
    by_pivot = shared.groupBy("sid", "pivot").agg(F.max("size").alias("size"), F.sum("grams").alias("grams"), F.max("sets").alias("sets"))
    pivots = F.array_sort(F.collect_list(F.struct((-F.col("sets")).alias("s"), "grams", "pivot")))  # of one set's grams
    each = by_pivot.groupBy("sid").agg(F.max("size").alias("size"), F.sum("grams").alias("shared"), pivots.alias("pivots")).where(F.col("shared") >= F.col("size") * threshold - 1e-9)
    fits = lambda left, x: (left + x["grams"]) * 2 < F.col("size") * threshold - 1e-9
    start = F.struct(F.lit(0).cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("own"))
    leave = F.aggregate("pivots", start, lambda a, x: F.struct(F.when(fits(a["left"], x), a["left"] + x["grams"]).otherwise(a["left"]).alias("left"), F.when(fits(a["left"], x), a["own"]).otherwise(F.concat(a["own"], F.array(x["pivot"]))).alias("own")))
    own = settled(each.select("sid", F.array_sort(leave["own"]).alias("own")))

    member = own.select("sid", F.explode("own").alias("region"), "own")
    before = F.filter("own", lambda x: x < F.col("region"))
    sizes = member.groupBy("region").agg(F.count("*").alias("size"))
    held = member.select("region", F.explode(F.slice(before, 1, EARLIER)).alias("p")).groupBy("region", "p").agg(F.count("*").alias("k"))
    most = held.groupBy("region").agg(F.max_by("p", F.struct("k", -F.col("p"))).alias("most"), F.max("k").alias("k"))
    windows = settled(sizes.where("size > 1").join(most, "region", "left").where("k is null or k < size").select("region", "size", "most"))
    placed = member.join(_few(windows, 32), "region").select("region", "sid", F.coalesce(~F.array_contains("own", F.col("most")), F.lit(True)).alias("core"), F.ceil(F.col("size") / TILE).cast("int").alias("blocks"), before.alias("earlier"))
    tiles = (
        placed.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .groupBy("sid").agg(F.collect_list(F.struct("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "core", "earlier")).alias("places"))
    )
    wanted = settled(tiles.join(classes.select(F.col("h1").alias("sid"), "h2", F.col("rep").alias("doc_id"), "copies"), "sid"))
    weight = 64 + F.aggregate("places", F.lit(0), lambda a, x: a + 48 + 8 * F.size(x["earlier"]))
    one = d.join(_few(wanted, weight), "doc_id").select("sid", "h2", "doc_id", "copies", "places", "text")

    def load():
        hashes = WordHashes()

        def batch(b):
            sets = [gram_set(hashes, t, n) for t in b.column(5).to_pylist()]
            keep = pa.array([_names(x) == (h1, h2) for x, h1, h2 in zip(sets, b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_())  # where one doc_id has several texts, the one this set came from
            data = pa.array([x.tobytes() for x in sets], pa.binary())
            yield {c: x.filter(keep) for c, x in zip(("sid", "h2", "rep", "copies", "places", "grams"), (*(b.column(k) for k in range(5)), data))}

        return batch

    place = "struct<region:bigint,i:int,j:int,block:int,core:boolean,earlier:array<bigint>>"
    sets = map_columns(one, load, f"sid bigint, h2 bigint, rep bigint, copies bigint, places array<{place}>, grams binary")
    part = ["region", "i", "j"]
    rows = sets.select("sid", "h2", "rep", "copies", "grams", F.explode("places").alias("p")).select("p.region", "p.i", "p.j", "p.block", "p.core", "p.earlier", "sid", "h2", "rep", "copies", "grams")
    return map_columns(rows.repartition(*part).sortWithinPartitions(*part), lambda: _Join(threshold, pairs), PAIRS if pairs else FOUND)


def class_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs doc_a < doc_b of the least documents of different classes whose sets have a Jaccard similarity of at least threshold, with it.

    Documents whose sets are equal are a class; membership() has them.  What is in no class is in no pair.
    """
    d, _, classes = _classes(docs, n)
    return _join(d, classes, n, threshold, True).where("doc_a != doc_b")


def membership(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, copy_of) of every document with a word: the least doc_id of its class."""
    _, named, classes = _classes(docs, n)
    return named.join(classes.select("h1", "h2", F.col("rep").alias("copy_of")), ["h1", "h2"]).select("doc_id", "copy_of")


def components(edges: DataFrame) -> DataFrame:
    """(node, least) of every node of the edges (a, b): the least node that it is connected with.

    Alternating star steps, each cut from its lineage by a checkpoint.  Least neighbours are aggregated, combined before they are shuffled, and joined
    back, so that a node with very many neighbours is a skewed join and not one task.
    """
    edges, before = settled(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            break
        before = now
        # large star: each node's larger neighbours go to its least neighbour, or to itself
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        edges = settled(large.join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), "m").where("b != m").select(F.col("m").alias("a"), "b").distinct())
    return edges.select(F.col("b").alias("node"), F.col("a").alias("least"))


def jaccard_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document that has a link: doc_id, class_id, copy_of, n_copies, n_links.

    Two documents are linked if their sets of word n-grams have a Jaccard similarity of at least threshold; n_links counts a document's links, n_copies those
    to documents of an equal set, copy_of is the least of these and itself, and class_id the least document that it is connected with by links.
    Words are runs of letters, digits and underscores in lower case; a document of fewer than n words has one gram, all its words; one
    without words, with a null text or a null doc_id has no link.  Repeated rows are one document.  Different sets of one doc_id are documents
    of their own as far as links are counted; the doc_id has one row, with the sums, and the least class_id and copy_of.  Extra columns are not read.
    """
    d, named, classes = _classes(docs, n)
    found = settled(_join(d, classes, n, threshold, False))
    links = found.where("h1 is not null").groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    label = components(found.where("h1 is null").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
    linked = settled(
        classes.join(links, ["h1", "h2"], "left").where("copies > 1 or links > 0").join(label, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", F.coalesce("least", "rep").alias("class_id"), F.col("rep").alias("copy_of"), (F.col("copies") - 1).alias("n_copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    rows = named.join(_few(linked, 48), ["h1", "h2"])
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of"), F.sum("n_copies").alias("n_copies"), F.sum("n_links").alias("n_links"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents of jaccard_links that are not their class's least doc_id; null doc_ids and texts stay.

    Repeated rows of a doc_id are one document and stay or go together; one_row takes one of them.
    """
    gone = settled(jaccard_links(docs, n, threshold).where("doc_id != class_id").select("doc_id"))
    return without(docs, gone)


def one_row(docs: DataFrame) -> DataFrame:
    """docs with one row of each (doc_id, text), that of the least source if the table has that column; nulls are equal to nulls.

    Only hashes are counted, and only the texts of repeated rows are shuffled.
    """
    (key,) = unused(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    again = settled(keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    n = again.count()
    if not n:
        return docs
    again = F.broadcast(again) if n <= 1_000_000 else again
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = keyed.join(again, key, "left_semi").drop(key)
    if others:
        least = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in others else F.lit("")
        rows = rows.groupBy("doc_id", "text").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in others)), least).alias(key)).select("doc_id", "text", f"{key}.*")
    else:
        rows = rows.distinct()
    return keyed.join(again, key, "left_anti").drop(key).unionByName(rows)
