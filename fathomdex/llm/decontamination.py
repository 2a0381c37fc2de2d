"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage by block-max WAND.

Items are cut into units of at most UNIT words.  A passage is a window of two UNITs of words, starting every UNIT, so that any unit
that a document holds lies whole in some passage; every passage of every document is a query.  A unit's BM25 score is divided by
that of the unit itself, which makes one threshold mean the same for all.  Postings lie in blocks of units of
similar size with each term's highest impact there; blocks whose bound stays below the threshold are skipped, the rest are searched by
WAND, so that all units above the threshold are found.  Each hit is verified on the words around it: enough of the
question's word pairs and of the answer's must be there.  The answer is the item's column of that name if the table has it, else
its last sentence (none if it has only one).  As that is a guess, an item without a given answer is also found by the question's part of the
word pairs of the whole item, whatever became of its last sentence.

Document frequencies and the average length are of all the benchmark's units.  The documents are read without a shuffle.  The postings are broadcast:
they are as large as the benchmark, whose size is checked; those of a larger benchmark come in several parts, each of which is searched in a
reading of its own, with the same results.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, distinct, map_columns, settled, texts, without, words

UNIT = 48
BLOCK_UNITS = 4
#: Blocks of one index part at most; with more units, blocks are larger.
MOST_BLOCKS = 256
THRESHOLD = 0.6
QUESTION = ANSWER = 0.7
#: Words of one index part; about 100 bytes each in memory.
PART_WORDS = 1_000_000
SCHEMA = "doc_id bigint, item_id bigint, position bigint, bm25 double, question_overlap double, answer_overlap double"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
K1, B = 1.2, 0.75


def split_item(text: str, answer: str | None) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    if answer is not None:
        return words(text), words(answer)
    parts = _SENTENCE.split(text.strip())
    return (words(text), []) if len(parts) < 2 else (words(" ".join(parts[:-1])), words(parts[-1]))


def _pairs(w: list) -> set:
    return set(zip(w, w[1:])) if len(w) > 1 else set((x,) for x in w)


def units_of(text: str, answer: str | None) -> list[list[str]]:
    """The item's words, its answer's last, in units of at most UNIT, as even as can be."""
    w = words(text) + (words(answer) if answer is not None else [])
    n = -(-len(w) // UNIT)
    return [w[j * len(w) // n : (j + 1) * len(w) // n] for j in range(n)]


class Statistics:
    """What BM25 needs of all units: how many there are, their words, and each word's document frequency.  As large as the benchmark's vocabulary."""

    def __init__(self, items):
        self.n, self.words, self.df = 0, 0, Counter()
        for _, text, answer in items:
            for u in units_of(text, answer):
                self.n += 1
                self.words += len(u)
                self.df.update(set(u))

    def idf(self, word: str) -> float:
        d = self.df[word]
        return math.log(1 + (self.n - d + 0.5) / (d + 0.5))


class Index:
    def __init__(self, items: list[tuple[int, str, str | None]], whole: bool = False, statistics: Statistics | None = None):
        """whole: items whose answer is only their last sentence are also found by the overlap of the whole item.  statistics: of a benchmark that items are part of."""
        statistics = statistics or Statistics(items)
        self.items, units = [], []
        for item, text, answer in items:
            q, a = split_item(text, answer)
            own = units_of(text, answer)
            if not own:
                continue
            all_ = [x for u in own for x in u]
            k = len(self.items)
            self.items.append((item, q, a, len(all_), all_ if whole and answer is None and a else None))
            units += [(k, u) for u in own]
        units.sort(key=lambda u: len(u[1]))
        self.units = [k for k, _ in units]
        self.numbers: dict[str, int] = {}
        for _, w in units:
            for x in w:
                self.numbers.setdefault(x, len(self.numbers))
        tf = [Counter(w) for _, w in units]
        n, avg = len(units), statistics.words / max(1, statistics.n)
        idf = {x: statistics.idf(x) for x in self.numbers}
        per = max(BLOCK_UNITS, -(-n // MOST_BLOCKS))
        self.blocks = -(-n // per) if n else 0
        self.bound = np.zeros((len(self.numbers) + 1, max(1, self.blocks)), np.float32)  # the last row, all zeros, is for other words
        self.by_block: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for u, c in enumerate(tf):
            size = sum(c.values())
            w = {x: idf[x] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / avg)) for x, f in c.items()}
            own = sum(w.values())
            for x, v in w.items():
                t = self.numbers[x]
                self.by_block[t, u // per].append((u, v / own))
                self.bound[t, u // per] = max(self.bound[t, u // per], v / own)
        self.bound *= np.float32(1 + 1e-5)

    def passages(self, ids: np.ndarray, threshold: float) -> dict[int, np.ndarray]:
        """Start of each passage whose bound reaches the threshold in some block, with those blocks."""
        at = np.flatnonzero(ids >= 0)
        width = len(self.numbers) + 1
        key = at // UNIT * width + ids[at]
        key = distinct(np.concatenate([key, key[at >= UNIT] - width]))  # each word is in the passage that starts with its unit and in the one before
        passage, term = key // width, key % width
        if not len(passage):
            return {}
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        reached = np.add.reduceat(self.bound[term], first, axis=0) >= threshold
        return {int(passage[first[k]]) * UNIT: np.flatnonzero(reached[k]) for k in np.flatnonzero(reached.any(1))}

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All units of the block that score at least threshold for these distinct terms."""
        lists = [[p, 0, float(self.bound[t, block])] for t in terms if (p := self.by_block.get((t, block)))]
        out = []
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            reach, pivot = 0.0, None
            for k, x in enumerate(lists):
                reach += x[2]
                if reach >= threshold:
                    pivot = k
                    break
            if pivot is None:
                break
            unit = lists[pivot][0][lists[pivot][1]][0]
            if lists[0][0][lists[0][1]][0] == unit:
                score = 0.0
                for x in lists:
                    if x[0][x[1]][0] != unit:
                        break
                    score += x[0][x[1]][1]
                    x[1] += 1
                if score >= threshold:
                    out.append((unit, score))
            else:
                for x in lists[:pivot]:
                    while x[1] < len(x[0]) and x[0][x[1]][0] < unit:
                        x[1] += 1
            lists = [x for x in lists if x[1] < len(x[0])]
        return out

    def search(self, ids: np.ndarray, text: str, threshold: float, question: float, answer: float):
        """The best verified hit of each item: (item, word position, score, question overlap, answer overlap)."""
        best, w = {}, None
        for start, blocks in self.passages(ids, threshold).items():
            terms = distinct(ids[start : start + 2 * UNIT])
            terms = terms[terms >= 0].tolist()
            for block in blocks:
                for unit, score in self.wand(terms, int(block), threshold):
                    item, q, a, size, whole = self.items[self.units[unit]]
                    w = w if w is not None else words(text)
                    near = _pairs(w[max(0, start - size) : start + 2 * UNIT + size]) | _pairs_of_one(q, a, w, start, size)
                    qo, ao = (None if not x else len(_pairs(x) & near) / len(_pairs(x)) for x in (q, a))
                    if (qo is None or qo >= question) and (ao is None or ao >= answer) or whole and len(_pairs(whole) & near) >= question * len(_pairs(whole)):
                        found = (round(score, 6), -start, qo, ao)
                        if item not in best or found[:2] > best[item][:2]:
                            best[item] = found
        return [(item, -f[1], f[0], f[2], f[3]) for item, f in sorted(best.items())]


def _pairs_of_one(q, a, w, start, size) -> set:
    """Single words near the passage, for a question or an answer of one word."""
    return set((x,) for x in w[max(0, start - size) : start + 2 * UNIT + size]) if len(q) == 1 or len(a) == 1 else set()


def _items(benchmark: DataFrame) -> DataFrame:
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    return settled(b.where("item_id is not null and text is not null").distinct().orderBy("item_id", "text", "answer"))


def _parts(items: DataFrame):
    """The items in parts of PART_WORDS; one part for any usual benchmark."""
    part, size = [], 0
    for r in items.toLocalIterator():
        part.append((r.item_id, r.text, r.answer))
        size += len(r.text) // 5 + 1
        if size > PART_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, position, bm25, question_overlap, answer_overlap): each document and item it holds, at its best passage.

    position counts words from 0.  An overlap is null where the item has no such part; where no answer is given, one of them may be below its threshold, if
    the whole item's overlap reaches the question's.  Null texts, empty texts and null item texts match nothing;
    rows with a null doc_id are not searched; repeated rows give one result; items with equal texts are all reported; extra columns are not read.
    """
    spark = docs.sparkSession
    d = texts(docs).where("doc_id is not null and text is not null")
    out, items = None, _items(benchmark)
    statistics = Statistics(items.toLocalIterator())
    for part in _parts(items):
        index = spark.sparkContext.broadcast(Index(part, True, statistics))

        def make(index=index):
            ids_of, ix = WordIds(index.value.numbers), index.value

            def batch(b):
                cols: dict = {x: [] for x in ("doc_id", "item_id", "position", "bm25", "question_overlap", "answer_overlap")}
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = ids_of.of(t)
                    if len(ids):
                        for hit in ix.search(ids, t, threshold, question, answer):
                            for c, v in zip(cols, (i, *hit)):
                                cols[c].append(v)
                yield cols

            return batch

        found = map_columns(d, make, SCHEMA)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    best = F.max_by(F.struct("position", "bm25", "question_overlap", "answer_overlap"), F.struct("bm25", -F.col("position")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, of documents that hold no item; rows with a null doc_id or text stay."""
    gone = settled(contaminated(docs, benchmark, **options).select("doc_id").distinct())
    return without(docs, gone)
