"""Queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, license_scan, line_dedup, lm_scoring, mixing, ngram_jaccard, quality_rules, secret_scan, token_binary, token_counts
from .common import table


def _documents(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": _documents(token_counts.token_counts),
        "op2_lm_scores": _documents(lm_scoring.lm_scores),
        "op3_line_dedup": _documents(line_dedup.line_dedup),
        "op4_ngram_jaccard_join": _documents(ngram_jaccard.jaccard_links),
        "op5_quality_rules": lambda spark, sf_dir: quality_rules.ledger(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op6_decontamination": lambda spark, sf_dir: decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op7_token_binary": _documents(token_binary.token_binary),
        "op8_license_scan": _documents(license_scan.license_scan),
        "op9_mixing": _documents(mixing.plan),
        "op10_secret_scan": _documents(secret_scan.secret_scan),
        "quality_ablation": lambda spark, sf_dir: quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))),
    }


_EDGE = " \t\r"
LINE_DEDUP_SQL = f"""
WITH l AS (SELECT doc_id, n, line, trim(line, concat(' ', chr(9), chr(13))) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)),
o AS (SELECT doc_id, n, s, row_number() OVER (ORDER BY doc_id, n) AS pos FROM l WHERE s <> ''),
u AS (SELECT s, min(pos) AS pos, length(s) AS k FROM o GROUP BY s),
h AS (SELECT *, 'a' || m || left(s, m // 2) AS key FROM (SELECT *, unnest([k, k - 1]) AS m FROM u WHERE k >= {line_dedup.NEAR_CHARS})
      UNION ALL SELECT *, 'b' || m || right(s, m - m // 2) FROM (SELECT *, unnest([k, k - 1]) AS m FROM u WHERE k >= {line_dedup.NEAR_CHARS})),
p AS (SELECT DISTINCT b.s, b.pos FROM h a JOIN h b ON a.key = b.key AND a.pos < b.pos AND abs(a.k - b.k) <= 1 WHERE levenshtein(a.s, b.s) <= 1),
g AS (SELECT doc_id, n FROM o JOIN u USING (s) WHERE o.pos <> u.pos UNION SELECT doc_id, n FROM o JOIN p ON o.pos = p.pos)
SELECT doc_id, string_agg(line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL) AS text, count(*) AS n_lines, count(g.n) AS n_removed
FROM l LEFT JOIN g USING (doc_id, n) GROUP BY doc_id
"""
LINE_DEDUP_SQL = LINE_DEDUP_SQL.replace("string_agg(line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL)", "coalesce(string_agg(line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL), '')")

JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {ngram_jaccard.N} THEN list_transform(range(1, len(w) - {ngram_jaccard.N} + 2), lambda i: list_aggregate(w[i : i + {ngram_jaccard.N} - 1], 'string_agg', ' ')) ELSE [list_aggregate(w, 'string_agg', ' ')] END)) AS g FROM w WHERE len(w) > 0),
g AS (SELECT g, min(doc_id) AS c, count(*) AS copies FROM s GROUP BY g),
e AS (SELECT c, len(g) AS n, unnest(g) AS x FROM g),
f AS (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY df, x) AS k FROM f),
q AS (SELECT * FROM r WHERE df > 1 AND k <= n - ceil({ngram_jaccard.THRESHOLD} * n - 1e-9) + 1),
p AS (SELECT DISTINCT a.c AS a, b.c AS b FROM q a JOIN q b ON a.x = b.x AND a.c < b.c AND least(a.n, b.n) >= {ngram_jaccard.THRESHOLD} * greatest(a.n, b.n)),
j AS (SELECT a, b, x.copies AS na, y.copies AS nb, len(list_intersect(x.g, y.g)) AS i, len(x.g) + len(y.g) AS t FROM p JOIN g x ON x.c = a JOIN g y ON y.c = b),
l AS MATERIALIZED (SELECT a, b, na, nb FROM j WHERE i / (t - i) >= {ngram_jaccard.THRESHOLD} - 1e-12),
sym AS MATERIALIZED (SELECT a, b, nb AS n FROM l UNION ALL SELECT b, a, na FROM l),
reached AS (SELECT c AS node, c AS least FROM g UNION SELECT b, least FROM reached JOIN sym ON a = node AND least < b),
class AS (SELECT node, min(least) AS class_id FROM reached GROUP BY 1),
links AS (SELECT a, sum(n) AS links FROM sym GROUP BY 1)
SELECT doc_id, class_id, c AS copy_of, copies - 1 AS n_copies, CAST(copies - 1 + coalesce(links, 0) AS BIGINT) AS n_links
FROM s JOIN g USING (g) JOIN class ON node = c LEFT JOIN links ON a = c WHERE copies > 1 OR links > 0
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": LINE_DEDUP_SQL,
        "op4_ngram_jaccard_join": JACCARD_SQL,
        "op5_quality_rules": quality_rules.LEDGER_SQL,
        "op9_mixing": mixing.PLAN_SQL,
        "quality_ablation": quality_rules.ABLATION_SQL,
    }
