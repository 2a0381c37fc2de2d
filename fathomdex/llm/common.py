"""Helpers shared by the corpus operators: column selection, Arrow mapping, word hashing, checkpointing."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.storage import scratch

WORD = re.compile(r"\w+")
#: Entries a Python worker keeps in one of its caches (words, of those of words' numbers) before it starts afresh; it bounds memory, not results.
CACHE, WORDS = 300_000, 200_000
#: Rows that a Python worker turns into objects at a time.
ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator needs, with known types, whatever else the table carries."""
    kinds = {"doc_id": "long", "text": "string", "source": "string"}
    return docs.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in ("doc_id", "text", *more)))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that docs does not have, in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def without(docs: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is not (how = left_anti) or is (left_semi) among ids, one settled column; few ids are broadcast."""
    (name,) = unused(docs, "id")
    ids = ids.toDF(name)
    return docs.join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, docs["doc_id"].cast("long") == ids[name], how)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: Python workers are used again, and would keep as much as their largest task took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def map_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | None]], schema: str) -> DataFrame:
    """mapInArrow over dictionaries of columns.  make() runs once per task and returns the function for one batch, of at most ROWS rows."""
    spark = df.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for out in f(batch) or ():
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) if not isinstance(out[x.name], pa.Array) else out[x.name].cast(x.type) for x in arrow], schema=arrow)
        if hasattr(f, "close"):
            for out in f.close() or ():
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)
        f = batch = out = None
        release()

    return df.mapInArrow(run, schema)


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, so that a lost executor costs nothing that is read again."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters, digits and underscores, in lower case."""
    return WORD.findall(text.lower()) if text else []


_MARKS = ".,;:!?\"'()[]{}*#%&-"
#: What WordHashes gives for a chunk without a word, and for one with several.
NONE, SEVERAL = 0, 1


class WordValues(dict):
    """One integer for each word of a text, in order.  Chunks between white space are looked up whole, as most hold one word."""

    def value(self, word: str) -> int:
        """At least 2."""
        raise NotImplementedError

    def __missing__(self, chunk: str) -> int:
        low = chunk.lower()
        if low.isalnum() or (low := low.strip(_MARKS)).isalnum():
            h = self.value(low)  # what is stripped is in no word
        else:
            found = WORD.findall(low)
            h = NONE if not found else SEVERAL if len(found) > 1 else self.value(found[0])
        if len(chunk) <= 64:
            if len(self) > WORDS:
                self.clear()
            self[chunk] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        chunks = text.split()
        h = np.fromiter(map(self.__getitem__, chunks), np.uint64, len(chunks))
        if (h == SEVERAL).any():
            flat: list[int] = []
            for chunk, x in zip(chunks, h.tolist()):
                if x == SEVERAL:
                    flat.extend(map(self.value, WORD.findall(chunk.lower())))
                elif x != NONE:
                    flat.append(x)
            return np.array(flat, np.uint64)
        return h[h != NONE]


class WordHashes(WordValues):
    def value(self, word: str) -> int:
        return hash_word(word)


class WordIds(WordValues):
    """Numbers of the words of a vocabulary; of() gives -1 for other words."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def value(self, word: str) -> int:
        return self.numbers.get(word, -1) + 3

    def of(self, text: str | None) -> np.ndarray:
        return super().of(text).astype(np.int64) - 3


def hash_word(word: str) -> int:
    return max(xxhash.xxh3_64_intdigest(word), 2)


_C = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x = x ^ (x >> np.uint64(27))
    x = x * _B
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Its values, each once, in order.  For large arrays of integers, much faster than np.unique, which hashes."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; of the whole text if it has fewer words; empty for none."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = out * _C + h[k : len(h) - n + 1 + k]  # a polynomial of word hashes, modulo 2 ** 64
    return mix(out)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
