"""Language-model scoring by the marginal likelihood over a subword lattice.

A word is the white-space-delimited chunk with the vocabulary's word mark before it.  Every way to cut it into pieces of an existing
vocabulary is a path through its lattice; the path's weight is the product of its pieces' probabilities, and the forward
recursion, in log space, adds up all paths.  No piece crosses a word, so a document's probability is the product of its words'.

The pieces' existing scores are merge ranks, as the model file has them; Zipf's law turns a rank into a probability, 1 / (rank + ZIPF) over the sum of all.
A row's probability depends on its text alone.  Weights can also be trained on a table of one's own (train: one round of expected counts) and given
to score.

How likely a text is compared with all others is what the corpus is asked for: corpus_rank is the share of all scored rows that have fewer bits a character.
It is exact: rows are counted by value (combined per task, so that copies cost one row), the distinct values are sorted by ranges, each range
summed up for itself, and the sums of the ranges before it added.

Cost: one narrow scoring pass; (value, rows) shuffled by value, then by range; scores joined with their ranks by value, never texts.  The driver holds one
number a piece and one a range.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import CACHE, map_columns, settled, texts

MARK = "▁"
#: Added to a piece's rank before it becomes a weight, 1 / (rank + ZIPF).
ZIPF = 2.7
#: Pieces' worth of the prior beside the corpus counts.
PRIOR = 100_000.0
SCHEMA = "doc_id bigint, n_words bigint, n_chars bigint, log_prob double, bits_per_char double"
#: Bytes up to which the distinct scores with their ranks are sent to all executors; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def load_pieces(path: str) -> dict[str, float]:
    """Log prior by piece, from the model file's own scores; byte pieces, as <0xNN>, get the last rank."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    rank = {m.id_to_piece(i): float(n) if m.is_byte(i) else -m.get_score(i) for i in range(n) if not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i))}
    w = {p: 1.0 / (max(r, 0.0) + ZIPF) for p, r in rank.items()}
    total = sum(w.values())
    return {p: math.log(x / total) for p, x in w.items()}


class Lattice:
    """All segmentations of a string into pieces."""

    def __init__(self, log_p: dict[str, float]):
        self.log_p = log_p
        self.root: dict = {}
        self.inside: set[str] = set()
        self.bytes_ = [log_p.get(f"<0x{k:02X}>", -40.0) for k in range(256)]
        for p, s in log_p.items():
            if len(p) == 6 and p.startswith("<0x"):
                continue
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = s
            self.inside.update(map("".join, zip(p, p[1:])))

    def fragments(self, word: str) -> list[str]:
        """word, cut wherever no piece can cross: its probability is the product of theirs."""
        inside = self.inside
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def edges(self, s: str):
        """For each start, (end, log weight) of every piece; a character that no piece spells is spelt by its bytes."""
        out = []
        for i in range(len(s)):
            node, here = self.root, []
            for j in range(i, len(s)):
                node = node.get(s[j])
                if node is None:
                    break
                if "" in node:
                    here.append((j + 1, node[""]))
            if not here or here[0][0] != i + 1:
                here.insert(0, (i + 1, sum(self.bytes_[b] for b in s[i].encode("utf-8", "replace"))))
            out.append(here)
        return out

    def forward(self, edges) -> list[float]:
        n, exp, log1p, low = len(edges), math.exp, math.log1p, -math.inf
        a = [low] * (n + 1)
        a[0] = 0.0
        for i in range(n):
            x = a[i]
            for j, s in edges[i]:
                y, z = a[j], x + s
                a[j] = z if y == low else z + log1p(exp(y - z)) if z > y else y + log1p(exp(z - y))
        return a

    def log_prob(self, s: str) -> float:
        """forward's last value, without the list of edges."""
        n, root, exp, log1p = len(s), self.root, math.exp, math.log1p
        a: list = [None] * (n + 1)
        a[0] = 0.0
        for i in range(n):
            x, node, j, alone = a[i], root, i, True
            while j < n:
                node = node.get(s[j])
                if node is None:
                    break
                j += 1
                w = node.get("")
                if w is not None:
                    y, z = a[j], x + w
                    a[j] = z if y is None else z + log1p(exp(y - z)) if z > y else y + log1p(exp(z - y))
                    if j == i + 1:
                        alone = False
            if alone:
                y, z = a[i + 1], x + sum(self.bytes_[b] for b in s[i].encode("utf-8", "replace"))
                a[i + 1] = z if y is None else z + log1p(exp(y - z)) if z > y else y + log1p(exp(z - y))
        return a[n]

    def expect(self, s: str, count: int, into: Counter) -> None:
        """Adds count times the expected number of each piece in s."""
        edges = self.edges(s)
        a, n, low = self.forward(edges), len(edges), -math.inf
        b = [low] * n + [0.0]
        for i in range(n - 1, -1, -1):
            for j, w in edges[i]:
                y, z = b[i], b[j] + w
                b[i] = z if y == low else z + math.log1p(math.exp(y - z)) if z > y else y + math.log1p(math.exp(z - y))
        for i in range(n):
            for j, w in edges[i]:
                p = count * math.exp(a[i] + w + b[j] - a[n])
                if j == i + 1 and s[i] not in self.log_p:
                    for c in s[i].encode("utf-8", "replace"):
                        into[f"<0x{c:02X}>"] += p
                else:
                    into[s[i:j]] += p


class _CountFragments:
    def __init__(self, log_p):
        self.lattice, self.chunks = Lattice(log_p), Counter()

    def __call__(self, batch):
        for t in batch.column(1).to_pylist():
            if t:
                self.chunks.update(t.split())
                if len(self.chunks) > CACHE:
                    yield self.flush()

    def close(self):
        if self.chunks:
            yield self.flush()

    def flush(self):
        out: Counter = Counter()
        for w, n in self.chunks.items():
            for f in self.lattice.fragments(MARK + w):
                out[f] += n
        self.chunks.clear()
        return {"fragment": list(out), "n": list(out.values())}


class _Expect:
    def __init__(self, log_p):
        self.lattice, self.found = Lattice(log_p), Counter()

    def __call__(self, batch):
        for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            self.lattice.expect(s, n, self.found)

    def close(self):
        if self.found:
            yield {"piece": list(self.found), "n": list(self.found.values())}


def train(docs: DataFrame, log_prior: dict[str, float], prior: float = PRIOR) -> dict[str, float]:
    """Log probability by piece, from all of docs."""
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(log_prior)
    fragments = map_columns(texts(docs), lambda: _CountFragments(given.value), "fragment string, n bigint").groupBy("fragment").agg(F.sum("n").alias("n"))
    expected = map_columns(fragments, lambda: _Expect(given.value), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = {r.piece: r.n for r in expected.collect()}  # at most one row per piece of the vocabulary
    total = math.fsum(counts.values()) + prior
    return {p: math.log((counts.get(p, 0.0) + prior * math.exp(s)) / total) for p, s in log_prior.items()}


def score(docs: DataFrame, log_p: dict[str, float]) -> DataFrame:
    """One row per input row, by an already trained model."""
    given = docs.sparkSession.sparkContext.broadcast(log_p)

    class Words(dict):
        def __init__(self):
            self.lattice, self.parts = Lattice(given.value), {}

        def __missing__(self, word: str) -> float:
            total = 0.0
            for f in self.lattice.fragments(MARK + word):
                x = self.parts.get(f)
                if x is None:
                    x = self.lattice.log_prob(f)
                    if len(f) <= 64:
                        self.parts[f] = x
                total += x
            if len(self.parts) > CACHE:
                self.parts.clear()
            if len(word) <= 64:
                if len(self) > CACHE:
                    self.clear()
                self[word] = total
            return total

    def make():
        known = Words()

        def batch(b):
            n_words, n_chars, logs = [], [], []
            for t in b.column(1).to_pylist():
                if t is None:
                    for x in (n_words, n_chars, logs):
                        x.append(None)
                    continue
                ws = t.split()
                n_words.append(len(ws))
                n_chars.append(sum(map(len, ws)) + len(ws))
                logs.append(math.fsum(map(known.__getitem__, ws)))
            yield {"doc_id": b.column(0), "n_words": n_words, "n_chars": n_chars, "log_prob": logs, "bits_per_char": [None if not n else -x / n / math.log(2) for x, n in zip(logs, n_chars)]}

        return batch

    return map_columns(texts(docs), make, SCHEMA)


def with_rank(scores: DataFrame, value: str = "bits_per_char", name: str = "corpus_rank") -> DataFrame:
    """scores, settled already, and the share of all rows with a value that have a lesser one; null where there is no value."""
    spark = scores.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = scores.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranges = settled(counted.repartitionByRange(parts, "v").select("v", "n", F.spark_partition_id().alias("part")))
    sums = {r.part: (r.n, r.k) for r in ranges.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}  # a row a range
    total, before = 0, []
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part][0]
    if not total:
        return scores.withColumn(name, F.lit(None).cast("double"))
    ranges = ranges.join(F.broadcast(spark.createDataFrame(before, "part int, start bigint")), "part")  # a row a range
    running = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranges.select(F.col("v").alias("__v"), ((F.col("start") + F.coalesce(F.sum("n").over(running), F.lit(0))) / total).alias(name))
    small = 24 * sum(k for _, k in sums.values()) <= BROADCAST_BYTES
    return scores.join(F.broadcast(ranks) if small else ranks, scores[value] == ranks["__v"], "left").drop("__v")


def lm_scores(docs: DataFrame, vocabulary: str = f"{bpe.DEFAULT_DIR}/piece_bpe_32k.model") -> DataFrame:
    """Scores each row by the vocabulary's own weights: doc_id, n_words, n_chars (with one mark per word), log_prob (natural), bits_per_char, corpus_rank.

    A null text has nulls; one without words has log_prob 0 and null bits_per_char and corpus_rank.  Repeated rows are scored and count one by one, equal
    scores have equal ranks; a null doc_id stays null; runs of white space count as one; extra columns are not read.  An empty table scores to an
    empty table.
    """
    return with_rank(settled(score(docs, load_pieces(vocabulary))))
