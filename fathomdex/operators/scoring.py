"""BM25 without an inverted index: one aggregate for the statistics, one narrow pass for the scores.

For a query's few tokens, term frequencies are counted in place, so nothing is exploded or shuffled; only a row of statistics per index
(documents with the field, average length, one document frequency per token) is joined back, by broadcast.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analysis
from ..plans import ast as A
from ..plans import querystring
from ..plans.compile import Fields, compile

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Clause:
    """Scores of the fields for the tokens, combined by sum or max."""

    fields: tuple
    tokens: tuple
    combine: str = "sum"


def clauses(node: A.Node, fields: Fields, nested: bool = False) -> list[Clause]:
    """What of a query is scored: match, phrases, multi_match and query strings, at the top or in must and should of a top-level bool."""
    toks = lambda s: tuple(dict.fromkeys(analysis.tokenize(s)))
    if isinstance(node, A.Match) and fields.is_text(node.field):
        return [Clause((node.field,), toks(node.text))]
    if isinstance(node, A.Phrase):
        return [Clause(tuple(f for f in node.fields if fields.is_text(f)), toks(node.text))]
    if isinstance(node, A.MultiMatch):
        return [Clause(tuple(f for f in node.fields if fields.is_text(f)), toks(node.text), "sum" if node.type == "most_fields" else "max")]
    if isinstance(node, A.QueryString):
        return clauses(querystring.parse(node, fields.text_fields()), fields, nested)
    if isinstance(node, A.Bool):
        return [c for x in node.must + node.should for c in clauses(x, fields, True)]
    return []


def is_text_query(node: A.Node) -> bool:
    return any(isinstance(x, (A.Match, A.Phrase, A.MultiMatch, A.QueryString)) for x in A.walk(node))


def field_stats(df: DataFrame, field: str, by: str | None = None) -> DataFrame:
    """total_docs and avg_field_len of a text field, per index if by names its column."""
    c = F.col(f"`{field}`")
    aggs = [F.count(c).alias("total_docs"), F.avg(analysis.token_count(c)).alias("avg_field_len")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def with_score(df: DataFrame, node: A.Node, fields: Fields, where: Column | None = None, index: str = "_index") -> DataFrame:
    """df, filtered by where, with _score.  Statistics are over all of df, per index; documents no clause scores have 1.0."""
    parts = [c for c in clauses(node, fields) if c.fields and c.tokens]
    kept = df if where is None else df.where(where)
    if not parts:
        return kept.withColumn("_score", F.lit(1.0))
    pairs = list(dict.fromkeys((f, t) for c in parts for f in c.fields for t in c.tokens))
    names = list(dict.fromkeys(f for f, _ in pairs))
    aggs = []
    for i, f in enumerate(names):
        aggs += [F.count(F.col(f"`{f}`")).alias(f"__n{i}"), F.avg(analysis.token_count(F.col(f"`{f}`"))).alias(f"__l{i}")]
    aggs += [F.count_if(analysis.any_token(F.col(f"`{f}`"), [t])).alias(f"__d{k}") for k, (f, t) in enumerate(pairs)]
    per_index = index in df.columns
    stats = df.groupBy(index).agg(*aggs) if per_index else df.agg(*aggs)  # one row per index, at most 1000 by name resolution
    # each frequency and length is a column of its own, so that it is counted once however often the formula uses it
    counted = {f"__t{k}": analysis.frequency(F.col(f"`{f}`"), t) for k, (f, t) in enumerate(pairs)} | {f"__w{i}": analysis.token_count(F.col(f"`{f}`")) for i, f in enumerate(names)}
    kept = kept.withColumns(counted)
    joined = kept.join(F.broadcast(stats), index) if per_index else kept.crossJoin(F.broadcast(stats))

    def one(k: int) -> Column:
        i = names.index(pairs[k][0])
        tf, d, n = F.col(f"__t{k}"), F.col(f"__d{k}"), F.col(f"__n{i}")
        idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
        return F.coalesce(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"__w{i}") / F.col(f"__l{i}"))), F.lit(0.0))

    total = []
    for c in parts:
        by_field = [functools.reduce(operator.add, (one(pairs.index((f, t))) for t in c.tokens)) for f in c.fields]
        total.append(by_field[0] if len(by_field) == 1 else F.greatest(*by_field) if c.combine == "max" else functools.reduce(operator.add, by_field))
    out = joined.withColumn("_score", functools.reduce(operator.add, total))
    out = out.withColumn("_score", F.when(F.col("_score") > 0, F.col("_score")).otherwise(1.0))
    return out.drop(*[c for c in stats.columns if c.startswith("__")], *counted)


def matching_scored(df: DataFrame, node: A.Node, fields: Fields) -> DataFrame:
    return with_score(df, node, fields, compile(node, fields))
