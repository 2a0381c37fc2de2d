"""Near-exact deduplication of lines over the whole corpus, by a deletion-neighbourhood join with edit bound 1.

Lines are compared without the spaces, tabs and carriage returns at their ends.  A line occurrence goes if an earlier one (by doc_id,
then line number) has the same string, whatever its length, or, from NEAR_CHARS characters on, one within one insertion, deletion or substitution;
the earliest stays.  Empty lines stay.

1.  Equal lines meet by a 128-bit hash; the first occurrence stands for the string.
2.  Two strings one edit apart agree outside the block that holds the edit, when the shorter is cut into BLOCKS equal blocks.  So each
    string emits one key per block and role (shorter or equal; longer by one): a hash of all but that block.  Strings whose
    keys nobody shares have no neighbour and leave; no pair is lost.
3.  For each shared key, the string emits the hashed deletion neighbourhood of that block: the block without its i-th character (with i, for
    substitutions), the whole block as the shorter, and the block without any one character as the longer.  Equal variants join.
    All strings of one substitution variant are one edit apart, so the earliest is the only partner that counts, and an
    insertion variant has one shorter string: the join is linear however many copies there are.
4.  Each joined pair's edit distance is verified on the strings themselves, and later ones go.

Keys and variants are never gathered in groups: the least and greatest holder of each are aggregated, combined before they are shuffled, and joined
back to the holders, so that a key of a third of all lines is a skewed join, which is split, and not one task.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, distinct, map_columns, mix, settled, texts

BLOCKS = 4
#: Length from which on lines one edit apart are the same: one edit makes another word, or another number, of a shorter one.
NEAR_CHARS = 20
#: Bytes up to which the smaller side of a join is sent to all executors; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20
_ENDS = " \t\r"
_h = xxhash.xxh3_64_intdigest


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bounds(m: int) -> list[int]:
    return [k * m // BLOCKS for k in range(BLOCKS + 1)]


def _outside(s: str, m: int, j: int) -> int:
    o = _bounds(m)
    tail = m - o[j + 1]
    return _h(f"{s[: o[j]]}\0{s[len(s) - tail :]}", m * BLOCKS + j)


def _block_keys(s: str) -> list[int]:
    """2 * BLOCKS keys: first as the shorter or equal string, then as the longer."""
    n = len(s)
    return [_signed(_outside(s, m, j)) for m in (n, n - 1) for j in range(BLOCKS)]


#: Base of the polynomial hash of a block, modulo 2 ** 64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def _variants(s: str, slot: int) -> tuple[np.ndarray, int]:
    """(hashed variants, how many of the first are s as the whole, shorter string of an insertion) of the block named by a slot of _block_keys.

    With the polynomial's sums up to each character, the block without its i-th character is hashed in constant time, however long the line.
    """
    n, j = len(s), slot % BLOCKS
    m = n if slot < BLOCKS else n - 1
    o = _bounds(m)
    key, block = np.uint64(_outside(s, m, j)), s[o[j] : o[j + 1] + n - m]
    c = mix(np.frombuffer(block.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, len(c) - 1), _BASE, np.uint64))))[: len(c)]
    p = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * power)))
    cut = p[:-1] + (p[-1] - p[1:]) * _INVERSE
    if slot >= BLOCKS:
        return distinct(mix(cut ^ key)), 0
    place = np.arange(1, len(c) + 1, dtype=np.uint64)
    return np.concatenate((mix(p[-1:] ^ key), mix(mix(cut ^ key) * np.uint64(_BASE) + place))), 1


def one_edit(a: str, b: str) -> bool:
    """Whether two different strings are one insertion, deletion or substitution apart; by comparing halves, so that long lines cost little."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    lo, hi = 0, len(a)
    while lo < hi:  # the length of the common beginning
        k = (lo + hi + 1) // 2
        lo, hi = (k, hi) if a[lo:k] == b[lo:k] else (lo, k - 1)
    return a[lo + (len(a) == len(b)) :] == b[lo + 1 :]


def joined(big: DataFrame, small: DataFrame, on, how: str, per_row: int, per_element: str | None = None) -> DataFrame:
    """big joined with small, which is settled already: broadcast if its bytes, so many a row and those of an array column's elements, are few, else shuffled."""
    size = small.agg((F.count("*") * per_row + F.coalesce(F.sum(F.expr(per_element)) if per_element else F.lit(0), F.lit(0))).alias("n")).first()["n"]
    return big.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)


def duplicate_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no, distance) of each occurrence that goes.

    A repeated string's partner is its first occurrence; a first occurrence's is its earliest neighbour."""
    d = texts(docs).where("doc_id is not null and text is not null")

    def scan(with_keys):
        def batch(b):
            ids, nos, a, c, keys = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, line in enumerate(t.split("\n")):
                    s = line.strip(_ENDS)
                    if s:
                        ids.append(i)
                        nos.append(k)
                        x = xxhash.xxh3_128_intdigest(s)
                        a.append(_signed(x >> 64))
                        c.append(_signed(x & (1 << 64) - 1))
                        keys.append(_block_keys(s) if with_keys and len(s) >= near_chars else None)
            yield {"doc_id": ids, "line_no": nos, "h1": a, "h2": c, "keys": keys}

        return batch

    lines, bare = (map_columns(d, functools.partial(scan, k), "doc_id bigint, line_no int, h1 bigint, h2 bigint, keys array<bigint>") for k in (True, False))
    at = F.struct("doc_id", "line_no")
    first = settled(lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    # a second reading of the text joins the repeats to their first: a line with very many copies is a skewed join, which is split, not one huge group
    same = bare.select("h1", "h2", at.alias("at")).join(first.where("n > 1").select("h1", "h2", "first"), ["h1", "h2"]).where("at != first").select("at", "first", F.lit(0).alias("distance"))

    # a string's first 64 bits are its name here
    keyed = first.where("keys is not null").select("h1", "first", F.posexplode("keys").alias("slot", "slot_key"))
    shared_keys = settled(keyed.groupBy("slot_key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("slot_key"))
    shared = (
        joined(keyed, shared_keys, "slot_key", "left_semi", 16)
        .groupBy("first").agg(F.collect_set("slot").alias("slots"))
        .groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "slots")).alias("wanted"))
    )
    wanted = settled(shared)

    def spread():
        def batch(b):
            ids, nos, vs, whole, size = [], [], [], [], []
            for i, t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = t.split("\n")
                for x in want:
                    if x["line_no"] >= len(found):
                        continue  # another text under the same doc_id
                    s = found[x["line_no"]].strip(_ENDS)
                    for slot in x["slots"]:
                        v, first = _variants(s, slot)
                        ids.append(i)
                        nos.append(x["line_no"])
                        size.append(len(v))
                        vs.append(v)
                        whole.append(np.arange(len(v)) < first)
            if ids:
                yield {"doc_id": np.repeat(ids, size), "line_no": np.repeat(nos, size), "variant": as_long(np.concatenate(vs)), "whole": np.concatenate(whole)}

        return batch

    d2 = joined(d, wanted, "doc_id", "inner", 64, "aggregate(wanted, 0, (a, x) -> a + 32 + 8 * size(x.slots))").select("doc_id", "text", "wanted")
    variants = settled(map_columns(d2, spread, "doc_id bigint, line_no int, variant bigint, whole boolean"))
    holders = variants.groupBy("variant").agg(F.min(at).alias("least"), F.max(at).alias("most"), F.min(F.when(F.col("whole"), at)).alias("shorter")).where("least != most")
    partner = F.coalesce("shorter", "least")
    near = (
        joined(variants.select(at.alias("at"), "variant"), settled(holders.select("variant", partner.alias("partner"))), "variant", "inner", 48)
        .where("at != partner").select(F.least("partner", "at").alias("a"), F.greatest("partner", "at").alias("b")).distinct()
    )
    near = settled(near)
    # verification: the two strings, from their documents
    ends = near.select(F.explode(F.array("a", "b")).alias("at")).distinct().groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_set("at.line_no").alias("nos"))
    strings = joined(d, settled(ends), "doc_id", "inner", 64, "4 * size(nos)").select("doc_id", F.explode("nos").alias("line_no"), "text").select(F.struct("doc_id", "line_no").alias("at"), F.trim(F.get(F.split("text", "\n", -1), F.col("line_no")), F.lit(_ENDS)).alias("s")).groupBy("at").agg(F.min("s").alias("s"))
    strings = settled(strings)

    def verify():
        def batch(b):
            yes = pa.array([x != y and one_edit(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield {"at": b.column(1).filter(yes), "first": b.column(0).filter(yes), "distance": [1] * pc.sum(yes.cast("int32")).as_py() if len(yes) else []}

        return batch

    pairs = near.join(strings.select(F.col("at").alias("a"), F.col("s").alias("sa")), "a").join(strings.select(F.col("at").alias("b"), F.col("s").alias("sb")), "b")
    place = "struct<doc_id:bigint,line_no:int>"
    checked = map_columns(pairs.select("a", "b", "sa", "sb"), verify, f"at {place}, first {place}, distance int")
    gone = same.union(checked).groupBy("at").agg(F.min(F.struct("first", "distance")).alias("k"))
    return gone.select("at.doc_id", "at.line_no", F.col("k.first.doc_id").alias("kept_doc_id"), F.col("k.first.line_no").alias("kept_line_no"), F.col("k.distance").alias("distance"))


def line_dedup(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """One row per input row: doc_id, text without the lines that go, n_lines, n_removed.

    Empty lines stay; lines shorter than near_chars go for an equal one only.  A null text stays null with null counts, an empty one has one (empty) line.  Rows with a
    null doc_id have no place in the order: they are returned unchanged and are nobody's earliest.  Rows that share a doc_id are
    one document; if their texts differ, each loses the lines at the numbers named for that id.  Extra columns are not read.
    """
    d = texts(docs)
    gone = settled(duplicate_lines(docs, near_chars).groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("line_no").alias("gone")))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, k: ~F.array_contains(F.col("gone"), k))
    return joined(d, gone, d.doc_id == gone.gone_id, "left", 64, "4 * size(gone)").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNotNull(), F.size(lines)).cast("bigint").alias("n_lines"),
        F.when(F.col("text").isNotNull(), F.coalesce(F.size("gone"), F.lit(0))).cast("bigint").alias("n_removed"),
    )
