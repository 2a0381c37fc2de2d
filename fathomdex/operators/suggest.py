"""Suggesters over a dictionary DataFrame: one row per token of a field, with its document frequency and least document id.

Each takes an index's rows, from which the dictionary is made, or its postings, which have it already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis
from ..plans.ast import ParsingError


def dictionary(df: DataFrame, field: str, id_column: str = "_id") -> DataFrame:
    if hasattr(df, "terms"):
        return df.terms(field)
    t = F.explode(F.array_distinct(analysis.tokens(F.col(f"`{field}`"))))
    return df.select(F.col(f"`{id_column}`").alias("id"), t.alias("token")).groupBy("token").agg(F.count("*").alias("freq"), F.min("id").alias("source"))


def term(df: DataFrame, field: str, text: str, max_edits: int = 2, prefix_length: int = 1, min_word_length: int = 3, size: int = 5, sort: str = "score", id_column: str = "_id") -> DataFrame:
    """text, score, freq: dictionary tokens near the query's tokens, the exact ones included."""
    words = [t for t in dict.fromkeys(analysis.tokenize(text)) if len(t) >= max(3, min_word_length)]
    k, found = max(1, prefix_length), dictionary(df, field, id_column)
    spark = found.sparkSession
    if not words:
        return spark.createDataFrame([], "text string, score double, freq bigint")
    near = F.explode(F.array(*(F.when(F.col("token").startswith(w[:k]), F.levenshtein("token", F.lit(w), max_edits)).otherwise(-1) for w in words))).alias("dist")
    scored = found.where(" or ".join(f"startswith(token, '{w[:k]}')" for w in words)).select("token", "freq", near).where("dist >= 0")
    merged = scored.groupBy(F.col("token").alias("text")).agg(F.max(F.when(F.col("dist") > 0, F.col("freq") / (F.col("dist") + 1)).otherwise(F.col("freq").cast("double"))).alias("score"), F.sum("freq").alias("freq"))
    order = [F.desc("freq"), F.desc("score")] if sort == "frequency" else [F.desc("score")]
    return merged.orderBy(*order, "text").limit(size)


def completion(df: DataFrame, field: str, text: str, size: int = 10, id_column: str = "_id", fuzziness: int = 0) -> DataFrame:
    """text, score, source: tokens that begin with the text, in order; with fuzziness, those that begin within so many edits of it, nearer ones first.

    Then the score is 1 / (1 + edits), and the first letter must be the text's.
    """
    start, found = text.lower(), dictionary(df, field, id_column)
    if not fuzziness or len(start) < 2:
        return found.where(F.col("token").startswith(start)).select(F.col("token").alias("text"), F.lit(1.0).alias("score"), "source").orderBy("text").limit(size)
    lengths = range(max(1, len(start) - fuzziness), len(start) + fuzziness + 1)
    edits = F.array_min(F.array(*(F.levenshtein(F.substring("token", 1, k), F.lit(start)) for k in lengths)))
    near = found.where(F.col("token").startswith(start[0])).withColumn("edits", edits).where(F.col("edits") <= fuzziness)
    return near.select(F.col("token").alias("text"), (1 / (1 + F.col("edits"))).alias("score"), "source").orderBy(F.desc("score"), "text").limit(size)


def prefix(df: DataFrame, field: str, text: str, size: int = 10) -> DataFrame:
    if hasattr(df, "terms"):
        found = df.terms(field).select(F.col("token").alias("text"))
    else:
        found = df.select(F.explode(F.array_distinct(analysis.tokens(F.col(f"`{field}`")))).alias("text"))
    return found.where(F.col("text").startswith(text.lower())).distinct().select("text", F.lit(1.0).alias("score")).orderBy("text").limit(size)


def phrase(df: DataFrame, field: str, text: str, max_edits: int = 2, id_column: str = "_id") -> DataFrame:
    """text, score: each token of the phrase by its best candidate, itself if it is in the dictionary; score is their mean."""
    words = analysis.tokenize(text)
    found = dictionary(df, field, id_column)
    spark = found.sparkSession
    if not words:
        return spark.createDataFrame([], "text string, score double")
    wanted = F.broadcast(spark.createDataFrame(list(enumerate(words)), "pos int, word string"))
    near = found.join(wanted, F.substring("word", 1, 1) == F.substring("token", 1, 1)).withColumn("dist", F.levenshtein("token", "word", max_edits)).where("dist >= 0")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy("dist", F.desc("freq"), "token"))).where("r = 1")
    every = wanted.join(best.select("pos", "token", "dist"), "pos", "left").select("pos", F.coalesce("token", "word").alias("token"), F.coalesce(1 / (1 + F.col("dist")), F.lit(0.0)).alias("s"))
    rows = every.agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("all"), F.avg("s").alias("score"))
    return rows.select(F.array_join(F.transform("all", lambda x: x["token"]), " ").alias("text"), "score")


def suggest(df: DataFrame, body: dict, id_column: str = "_id") -> dict[str, DataFrame]:
    """Each named suggestion of a request; a shared text may stand beside them."""
    out = {}
    shared = body.get("text", "")
    for name, spec in body.items():
        if name == "text":
            continue
        text = spec.get("text", spec["prefix"] if isinstance(spec.get("prefix"), str) else shared)
        kind = next((k for k in ("term", "completion", "prefix", "phrase") if isinstance(spec.get(k), dict)), None)
        if kind is None:
            raise ParsingError("parsing_exception: a suggestion takes term, completion, prefix or phrase")
        o = spec[kind]
        text = text or o.get("text", "")
        if kind == "term":
            out[name] = term(df, o["field"], text, int(o.get("max_edits", 2)), int(o.get("prefix_length", 1)), int(o.get("min_word_length", 3)), int(o.get("size", 5)), o.get("sort", "score"), id_column)
        elif kind == "completion":
            fuzzy = o.get("fuzzy")
            edits = int(fuzzy.get("fuzziness", 1)) if isinstance(fuzzy, dict) else int(bool(fuzzy))
            out[name] = completion(df, o["field"], text, int(o.get("size", 10)), id_column, edits)
        elif kind == "prefix":
            out[name] = prefix(df, o["field"], text, int(o.get("size", 10)))
        else:
            out[name] = phrase(df, o["field"], text, int(o.get("max_edits", 2)), id_column)
    return out


class MultiSuggest:
    """Several named suggestions as one request; run() gives each one's rows, merged() all of them, best first, with the name."""

    def __init__(self, text: str = ""):
        self.body: dict = {"text": text} if text else {}

    def add(self, name: str, kind: str, field: str, text: str | None = None, **options) -> MultiSuggest:
        if kind not in ("term", "completion", "prefix", "phrase"):
            raise ParsingError(f"parsing_exception: unknown suggester [{kind}]")
        self.body[name] = {kind: {"field": field, **options}} | ({} if text is None else {"text": text})
        return self

    def build(self) -> dict:
        return self.body

    def run(self, df: DataFrame, id_column: str = "_id") -> dict[str, DataFrame]:
        return suggest(df, self.body, id_column)

    def merged(self, df: DataFrame, size: int = 10, id_column: str = "_id") -> DataFrame:
        """name, text, score of the best suggestions of all; of one text the best score counts."""
        rows = None
        for name, found in self.run(df, id_column).items():
            mine = found.select(F.lit(name).alias("name"), "text", F.col("score").cast("double").alias("score"))
            rows = mine if rows is None else rows.unionByName(mine)
        best = rows.groupBy("text").agg(F.max(F.struct("score", "name")).alias("x"))
        return best.select("x.name", "text", "x.score").orderBy(F.desc("score"), "text").limit(size)
