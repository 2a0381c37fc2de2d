"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents are spread over shards by a hash of their id; the number of shards follows the corpus' tokens.  Within a shard, a source's documents
stand one after another in seeded order, and every BLOCK_TOKENS of their tokens are a block: a document of many tokens spans, and costs, several.
The k-th block of a source with weight w has the quotient w / (2 k + 1); a shard's seats, its part of the budget, go to its highest quotients, which
gives every source its integer quota of blocks there, never above what it has.  The quota's blocks, the first in seeded order, are selected: that is,
the documents whose middle token falls in them, so that a source is as likely to get a little more than its quota of tokens as a little less.

WEIGHTS are parts of the tokens; sources without one share what is left, in proportion to tokens ** ALPHA (temperature sampling).

Shuffles: one of (id, source, tokens) by shard and source, then one row per shard, source and block; texts are not moved until the final
semi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, texts, without

BLOCK_TOKENS = 2048
#: Tokens per shard that the number of shards aims at.
SHARD_TOKENS = 1 << 18
#: Part of all blocks that is selected.
BUDGET = 0.8
ALPHA = 0.5
SEED = 20240601
#: Target parts of the tokens of some sources; all others share the rest.
WEIGHTS = {"src0": 0.1, "src1": 0.08, "src2": 0.03}


def plan(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, budget: float = BUDGET, alpha: float = ALPHA, seed: int = SEED, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The selected documents: doc_id, source, shard, block, n_tokens, quota (blocks its source gets in its shard).

    weights: of all tokens, the parts that sources aim at, WEIGHTS unless given; what they leave of 1, or nothing, goes to the other sources.  Tokens are
    what white space separates.  A null source is a source of its own, named ''; a null or empty text has 0 tokens and rides in the block it falls
    in.  Rows that share a doc_id are one document: that of the longest text, then least source.  A row with a null doc_id can't be selected.
    An empty table selects nothing; extra columns are not read.  Sources of weight 0 get nothing unless all others run out.
    """
    d = texts(docs, "source").where("doc_id is not null")
    d = d.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.expr(r"regexp_count(text, '[^ \n\t\r]+')"), F.lit(0)).cast("bigint").alias("n_tokens"))
    d = settled(d.groupBy("doc_id").agg(F.min_by(F.struct("source", "n_tokens"), F.struct(-F.col("n_tokens"), F.col("source"))).alias("x")).select("doc_id", "x.*"))
    given = {k: max(0.0, float(v)) for k, v in (WEIGHTS if weights is None else weights).items()}
    by_source = d.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    other = ~F.col("source").isin(*given) if given else F.lit(True)
    totals = by_source.agg(F.sum("tokens").alias("n"), F.sum(F.when(other, F.pow("tokens", F.lit(alpha)))).alias("w")).first()
    rest = max(0.0, 1 - math.fsum(given.values()))
    weight = F.when(other, F.pow("tokens", F.lit(alpha)) * F.lit(rest) / F.lit(float(totals["w"] or 1)))
    for k, v in given.items():
        weight = weight.when(F.col("source") == k, F.lit(v))
    by_source = by_source.select("source", weight.cast("double").alias("weight"))
    shards = max(1, -(-int(totals["n"] or 0) // shard_tokens))
    d = d.withColumns({"shard": F.pmod(_seeded("doc_id", seed), F.lit(shards)), "place": _seeded("doc_id", seed + 1)})
    run = Window.partitionBy("shard", "source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(run), F.lit(0))
    middle = F.floor((2 * before + F.col("n_tokens")) / (2 * block_tokens))
    blocked = settled(d.withColumns({"block": middle, "end": before + F.col("n_tokens")}).select("doc_id", "source", "shard", "block", "n_tokens", "end"))
    sizes = blocked.groupBy("shard", "source").agg(F.greatest(F.ceil(F.max("end") / block_tokens), F.lit(1)).cast("bigint").alias("blocks"))
    small = by_source.count() <= 100_000
    ranked = sizes.join(F.broadcast(by_source) if small else by_source, "source").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    ranked = ranked.withColumn("quotient", F.col("weight") / (2 * F.col("k") + 1))
    shard = Window.partitionBy("shard")
    chosen = (
        ranked.withColumns({"rank": F.row_number().over(shard.orderBy(F.desc("quotient"), "source", "k")), "all": F.count("*").over(shard)})
        .where(F.col("rank") <= F.ceil(F.col("all") * F.lit(budget)))
        .groupBy("shard", "source").agg(F.count("*").alias("quota"), F.first("blocks").alias("blocks"))
    )
    block = F.least("block", F.col("blocks") - 1)  # an empty text behind the last full block
    return blocked.join(chosen, ["shard", "source"]).withColumn("block", block).where("block < quota").select("doc_id", "source", "shard", "block", "n_tokens", "quota")


def _seeded(column: str, seed: int):
    """A permutation of the ids in integer arithmetic that any SQL engine repeats: (id * a + seed) mod a prime, twice."""
    x = F.pmod(F.pmod(F.col(column), F.lit(P1)) * F.lit(A1) + F.lit(seed % P1), F.lit(P1))
    return F.pmod(x * x + x * F.lit(A2), F.lit(P1))


P1, A1, A2 = 2_147_483_647, 1_103_515_245, 40_503


def select(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that plan() selects."""
    chosen = settled(plan(docs, **options).select("doc_id"))
    return without(docs, chosen, "left_semi")


def _sql_seeded(seed: int) -> str:
    x = f"(((doc_id % {P1} + {P1}) % {P1}) * {A1} + {seed % P1}) % {P1}"
    return f"(CAST({x} AS HUGEINT) * ({x}) + ({x}) * {A2}) % {P1}"


_GIVEN = " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in WEIGHTS.items())
PLAN_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \\n\\t\\r]+')), 0) AS n_tokens FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_tokens DESC, source) = 1),
t AS (SELECT source, CASE source {_GIVEN} END AS given, pow(sum(n_tokens), {ALPHA}) AS free FROM u GROUP BY 1),
s AS (SELECT source, CASE WHEN given IS NULL THEN free * {max(0.0, 1 - math.fsum(WEIGHTS.values()))!r} / (SELECT sum(free) FROM t WHERE given IS NULL) ELSE given END AS weight FROM t),
h AS (SELECT *, {_sql_seeded(SEED)} % greatest(1, CAST(ceil((SELECT sum(n_tokens) FROM u) / {SHARD_TOKENS}.0) AS BIGINT)) AS shard, {_sql_seeded(SEED + 1)} AS place FROM u),
r AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY shard, source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
n AS (SELECT shard, source, greatest(1, CAST(ceil(sum(n_tokens) / {BLOCK_TOKENS}.0) AS BIGINT)) AS blocks FROM h GROUP BY 1, 2),
k AS (SELECT shard, source, blocks, unnest(range(blocks)) AS k FROM n),
q AS (SELECT k.*, row_number() OVER (PARTITION BY shard ORDER BY weight / (2 * k + 1) DESC, source, k) AS rank, count(*) OVER (PARTITION BY shard) AS n FROM k JOIN s USING (source)),
c AS (SELECT shard, source, count(*) AS quota, max(blocks) AS blocks FROM q WHERE rank <= ceil(n * {BUDGET}) GROUP BY 1, 2),
b AS (SELECT doc_id, r.source, shard, least((2 * before + n_tokens) // {2 * BLOCK_TOKENS}, blocks - 1) AS block, n_tokens, quota FROM r JOIN c USING (shard, source))
SELECT doc_id, source, CAST(shard AS BIGINT) AS shard, CAST(block AS BIGINT) AS block, CAST(n_tokens AS BIGINT) AS n_tokens, quota FROM b WHERE block < quota
"""
