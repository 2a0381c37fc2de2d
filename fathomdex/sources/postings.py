"""An inverted index kept beside an index's rows: postings, dictionary and statistics, made once when rows are written and read by every text query.

Postings are blocks (field, token, ids, tf, lengths) in Parquet folders by bucket of the token's hash, sorted by token within a file: a query reads the folders
of its tokens, and in them the row groups that hold them.  A block has the documents of one stretch of one task's rows, so that what is shuffled
and sorted are tokens of stretches and not of documents.  The dictionary has each token's document frequency and least document; the statistics are one
row a field.  Texts are read once, and queries never read them.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import analysis
from ..operators import scoring
from ..plans import ast as A
from ..plans.compile import Fields, compile, holds
from . import storage

BUCKETS = 32
#: Documents, and bytes of texts and tokens' places, from which a stretch ends: they bound a block and what a worker holds, not the index.
STRETCH_DOCS, STRETCH_BYTES = 16384, 64 << 20
#: Documents that a worker splits at a time.
ROWS = 256
#: Bytes of candidates' ids and frequencies up to which they are sent to all executors; beyond, they are shuffled to the rows.
BROADCAST_BYTES = 32 << 20
#: ids, tf and lengths are lists of equal length, joined to one string each, as a string costs much less to shuffle and write than an array: ids by line feeds, the others by spaces.
#: freq, words and source are the number of ids, the sum of tf and the least id.  Under the token '', which no text has, they are a field's documents and words in one task.
_BLOCK = StructType().add("field", "string").add("token", "string").add("freq", "long").add("words", "long").add("source", "string").add("ids", "string").add("tf", "string").add("lengths", "string")


def _bucket(field: Column, token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(field, token), F.lit(buckets)).cast("int")


_LETTER = np.zeros(256, bool)
_LETTER[[ord(c) for c in analysis.LETTERS]] = True


def _split(texts: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The tokens of lowered texts, none of them null, one text after another, and each text's number of them: analysis.tokens of all at once."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held if held is not None else b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    word = _LETTER[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = word[begins]  # no token goes on into the next text
    starts = np.append(np.flatnonzero(first[word]), np.count_nonzero(word))
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data[word])])
    return tokens, np.diff(np.searchsorted(np.flatnonzero(first), ends))


def _escaped(ids: pa.StringArray) -> pa.StringArray:
    """ids without line feeds, and a mark where there is none; _listed gives them back."""
    return pc.replace_substring(pc.replace_substring(ids, "\\", "\\s"), "\n", "\\n").fill_null("\\0")


def _listed(joined: Column) -> Column:
    given = lambda x: F.when(x != "\\0", F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))
    return F.when(joined.contains("\\"), F.transform(F.split(joined, "\n"), given)).otherwise(F.split(joined, "\n"))


def _block(field: str, ids: pa.Array, tokens: pa.Array, lengths: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A row a token of the documents, by token and in it by id."""
    n = len(ids)
    by_id = pc.sort_indices(ids).to_numpy().astype(np.int64)
    place = np.empty(n, np.int64)
    place[by_id] = np.arange(n)
    coded = tokens.dictionary_encode()
    ordered = pc.sort_indices(coded.dictionary)
    distinct = len(ordered)
    rank = np.empty(distinct, np.int64)
    rank[ordered.to_numpy()] = np.arange(distinct)
    key = rank[coded.indices.to_numpy()]
    key *= n
    key += np.repeat(place, lengths)
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))  # of each token in each document
    tf = np.diff(first, append=len(key))
    at, doc = np.divmod(key[first], n)
    doc = by_id[doc]
    freq = np.bincount(at, minlength=distinct)
    starts = np.concatenate(([0], np.cumsum(freq)))
    joined = lambda values, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values.cast(pa.string())), by)
    columns = [pa.repeat(field, distinct), coded.dictionary.take(ordered), pa.array(freq), pa.array(np.add.reduceat(tf, starts[:-1])), ids.take(pa.array(doc[starts[:-1]])), joined(_escaped(ids).take(pa.array(doc)), "\n"), joined(pa.array(tf), " "), joined(pa.array(lengths[doc]), " ")]
    return pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, schema)], schema=schema)


def _blocks(fields: list[str]):
    """For mapInArrow over _id and the lowered texts of fields: the blocks, and a row of statistics a field."""
    schema = to_arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words = [0] * len(fields), [0] * len(fields)
        held, rows, size = [[] for _ in fields], 0, 0

        def ended() -> Iterator[pa.RecordBatch]:
            for k, f in enumerate(fields):
                ids, tokens, lengths = zip(*held[k]) if held[k] else ((), (), ())
                held[k] = []
                if sum(map(len, tokens)):
                    yield _block(f, pa.concat_arrays(ids), pa.concat_arrays(tokens), np.concatenate(lengths), schema)

        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for k in range(len(fields)):
                texts = b.column(k + 1)
                ids, texts = b.column(0).filter(texts.is_valid()).cast(pa.string()), texts.drop_null().cast(pa.large_binary())
                tokens, lengths = _split(texts)
                docs[k] += len(texts)
                words[k] += len(tokens)
                size += int(lengths.sum()) * 8 + texts.nbytes
                held[k].append((ids, tokens, lengths))
            rows += b.num_rows
            if size >= STRETCH_BYTES or rows >= STRETCH_DOCS:
                yield from ended()
                rows = size = 0
        yield from ended()
        yield pa.RecordBatch.from_pylist([{"field": f, "token": "", "freq": docs[k], "words": words[k], "source": None, "ids": "", "tf": "", "lengths": ""} for k, f in enumerate(fields)], schema=schema)
        pa.default_memory_pool().release_unused()

    return run


def build(df: DataFrame, fields: list[str], path: str, buckets: int = BUCKETS) -> Postings:
    """Writes the inverted index of df's text fields, with _id, under path.

    Tokens are counted where their document is, and blocks shuffled once, to their buckets; AQE then splits the folders of frequent tokens over several files.
    """
    spark = df.sparkSession
    texts = df.select(F.col("_id").cast("string").alias("_id"), *(F.lower(F.col(f"`{f}`")).alias(f"t{k}") for k, f in enumerate(fields)))
    placed = texts.mapInArrow(_blocks(list(fields)), _BLOCK).withColumn("bucket", _bucket(F.col("field"), F.col("token"), buckets)).hint("rebalance", F.col("bucket"))
    placed.sortWithinPartitions("bucket", "field", "token", "source").write.partitionBy("bucket").parquet(f"{path}/postings")
    written = _written(spark, path)
    found = written.where(F.col("token") != "").groupBy("token", "field").agg(F.sum("freq").alias("freq"), F.min("source").alias("source"))
    found.repartitionByRange("field", "token").sortWithinPartitions("field", "token").select("field", "token", "freq", "source").write.parquet(f"{path}/terms")
    totals = written.where(F.col("bucket").isin(_buckets(spark, [(f, "") for f in fields], buckets)) & (F.col("token") == "")).groupBy("field").agg(F.sum("freq").alias("n"), F.sum("words").alias("words"))
    sums = {r.field: [r.n, r.words] for r in totals.collect()}  # a row a field
    storage.write_text(spark, f"{path}/stats.json", json.dumps({"fields": {f: sums.get(f, [0, 0]) for f in fields}, "buckets": buckets, "blocks": True}))
    return Postings(spark, path)


def _written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(StructType([*_BLOCK.fields]).add("bucket", "integer")).parquet(f"{path}/postings")


def _buckets(spark: SparkSession, pairs: list[tuple[str, str]], buckets: int) -> list[int]:
    """Of a query's own (field, token)s."""
    if not pairs:
        return []
    return sorted(set(spark.range(1).select(F.array(*(_bucket(F.lit(f), F.lit(t), buckets) for f, t in pairs)).alias("b")).first().b))


class Postings:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        state = json.loads(storage.read_text(spark, f"{path}/stats.json"))
        self.fields, self.buckets, self.blocks = state["fields"], state["buckets"], state.get("blocks", False)

    @functools.cached_property
    def _postings(self) -> DataFrame:
        """bucket, field, token, _id, tf, length."""
        if not self.blocks:  # written before there were blocks
            return self.spark.read.parquet(f"{self.path}/postings")
        zipped = F.arrays_zip(_listed(F.col("ids")), *(F.split(c, " ").cast("array<int>") for c in ("tf", "lengths")))
        return _written(self.spark, self.path).where(F.col("token") != "").select("bucket", "field", "token", F.inline(zipped).alias("_id", "tf", "length"))

    @functools.cached_property
    def _terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def terms(self, field: str) -> DataFrame:
        """token, freq, source of a field, as suggest.dictionary has them."""
        return self._terms.where(F.col("field") == field).select("token", "freq", "source")

    def stats(self, field: str) -> tuple[int, float]:
        """Documents with the field, and their average length in tokens."""
        n, words = self.fields[field]
        return n, words / n if n else 0.0

    def frequencies(self, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Document frequency of each (field, token)."""
        if not pairs:
            return {}
        one_of = functools.reduce(operator.or_, ((F.col("field") == f) & (F.col("token") == t) for f, t in pairs))
        return {(r.field, r.token): r.freq for r in self._terms.where(one_of).select("field", "token", "freq").collect()}  # at most a row a pair

    def holders(self, pairs: list[tuple[str, str]]) -> DataFrame:
        """_id and, for the k-th (field, token) of pairs, __t{k}, its frequency there, and __w{k}, the field's length; documents with one of them at least."""
        one_of = functools.reduce(operator.or_, ((F.col("field") == f) & (F.col("token") == t) for f, t in pairs))
        hit = self._postings.where(F.col("bucket").isin(_buckets(self.spark, pairs, self.buckets)) & F.col("token").isin(sorted({t for _, t in pairs})) & one_of)
        which = lambda k: (F.col("field") == pairs[k][0]) & (F.col("token") == pairs[k][1])
        aggs = [F.max(F.when(which(k), F.col(c))).alias(f"__{n}{k}") for k in range(len(pairs)) for c, n in (("tf", "t"), ("length", "w"))]
        return hit.groupBy("_id").agg(*aggs)

    # queries

    def answers(self, node: A.Node, fields: Fields) -> bool:
        """Whether every match of node holds a scored token, so that postings alone name the candidates: a match, phrase or multi_match, or a bool that must have one."""
        if isinstance(node, A.Bool):
            return not node.should and any(self.answers(x, fields) for x in node.must) and all(c.fields and c.tokens for c in scoring.clauses(node, fields)) and self._covers(node, fields)
        named = node.fields if isinstance(node, (A.Phrase, A.MultiMatch)) else (node.field,) if isinstance(node, A.Match) else ()
        return bool(named) and getattr(node, "type", "") != "phrase_prefix" and all(fields.is_text(f) for f in named) and self._covers(node, fields)

    def _covers(self, node: A.Node, fields: Fields) -> bool:
        parts = scoring.clauses(node, fields)
        return bool(parts) and all(c.tokens and c.fields and all(f in self.fields for f in c.fields) for c in parts)

    def matching_scored(self, df: DataFrame, node: A.Node, fields: Fields) -> DataFrame:
        """The rows of df, whose postings these are, that match node, with _score: scoring.matching_scored without a pass over all texts.  Needs answers(node)."""
        parts = [c for c in scoring.clauses(node, fields) if c.fields and c.tokens]
        pairs = list(dict.fromkeys((f, t) for c in parts for f in c.fields for t in c.tokens))
        df_of = self.frequencies(pairs)
        found = self.holders(pairs)
        has = lambda f, t: F.col(f"__t{pairs.index((f, t))}").isNotNull()

        def holding(n: A.Node) -> Column:
            """n, over rows joined with holders: by frequencies where they decide, else by the row, but only where they allow it."""
            if isinstance(n, A.Bool):
                tests = [holding(x) for x in n.must] + [compile(x, fields) for x in n.filter] + [~holds(x, fields) for x in n.must_not]
                return functools.reduce(operator.and_, tests)
            own = scoring.clauses(n, fields)
            if not self.answers(n, fields):
                return compile(n, fields)
            some = functools.reduce(operator.or_, (has(f, t) for c in own for f in c.fields for t in c.tokens))
            if isinstance(n, A.Match) and (n.operator != "and" or len(own[0].tokens) == 1):
                return some
            if isinstance(n, A.Match):
                return functools.reduce(operator.and_, (has(n.field, t) for t in own[0].tokens))
            return F.when(some, compile(n, fields)).otherwise(F.lit(False))

        def one(k: int) -> Column:
            n, avg = self.stats(pairs[k][0])
            d = df_of.get(pairs[k], 0)
            tf = F.col(f"__t{k}")
            idf = F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5)))
            return F.coalesce(idf * tf * (scoring.K1 + 1) / (tf + scoring.K1 * (1 - scoring.B + scoring.B * F.col(f"__w{k}") / F.lit(avg or 1.0))), F.lit(0.0))

        total = []
        for c in parts:
            by_field = [functools.reduce(operator.add, (one(pairs.index((f, t))) for t in c.tokens)) for f in c.fields]
            total.append(by_field[0] if len(by_field) == 1 else F.greatest(*by_field) if c.combine == "max" else functools.reduce(operator.add, by_field))
        score = functools.reduce(operator.add, total)
        most = sum(df_of.get(p, 0) for p in pairs) * (32 + 8 * len(pairs))
        joined = df.join(F.broadcast(found) if most <= BROADCAST_BYTES else found, "_id").where(holding(node))
        return joined.withColumn("_score", F.when(score > 0, score).otherwise(1.0)).select(*(F.col(f"`{c}`") for c in df.columns), "_score")
