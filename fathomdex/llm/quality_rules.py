"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: its bit in `failed` and its measurements, all integers, are stored.  Policies are versioned
masks over the same ledger, so a new policy or an ablation reads a few numbers a row and never the text.

One narrow pass of built-in expressions; the ledger's aggregates combine on the map side.  One measurement counts words with stems that are typical
of documents labelled toxic; the stems are learned first, from a sample of at most SAMPLE labelled documents of each class, and no list of words is given.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, unused

#: Measurements: (name, Spark SQL, DuckDB SQL).  Words are what spaces and line ends separate.  {t} is the text.
_S = "regexp_count({t}, '%s')"
_D = "len(regexp_extract_all({t}, '%s'))"


def _counted(pattern: str) -> tuple[str, str]:
    return _S % pattern.replace("\\", "\\\\"), _D % pattern


#: Both dialects count the same; Java's expressions go back over what they matched, so there a chunk is entered at its start only, and once.
_START = r"(?<![^ \n\t\r])"
MEASURES = {
    "n_chars": ("length({t})", "length({t})"),
    "n_words": _counted(r"[^ \n\t\r]+"),
    "n_letters": _counted(r"\p{L}"),
    "n_marked": _counted(r"[#$%&*|~^<>=_{}@]+"),
    "n_shouted": (_counted(_START + r"[^ \n\t\r]+?!!")[0], _counted(r"[^ \n\t\r]+!!")[1]),
    "n_upper": _counted(r"\p{Lu}"),
    "n_alone": (_counted(_START + r"[^ \n\t\r\p{L}]*+\p{L}")[0], _counted(r"[^ \n\t\r]*\p{L}[^ \n\t\r]*")[1]),
}
#: A measurement over the list of words: those equal to the one before.
_WORDS_S, _WORDS_D = "filter(split({t}, '[ \\n\\t\\r]+', -1), x -> x != '')", "list_filter(regexp_split_to_array({t}, '[ \\n\\t\\r]+'), lambda x: x <> '')"
MEASURES["n_repeated"] = (
    "coalesce(aggregate(" + _WORDS_S + ", struct(0 as n, '' as p), (a, x) -> struct(a.n + int(x = a.p) as n, x as p), a -> a.n), 0)",
    "coalesce(list_sum(list_transform(list_zip(" + _WORDS_D + ", list_concat([''], " + _WORDS_D + ")), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)), 0)",
)
#: Words with a learned stem; {stems} is a regular expression for the stems at the start of a word, or empty.
STEM_MEASURE = "n_stems"
#: Labelled documents of each class, toxic or not, that the stems are learned from; the least of a seeded order of ids are taken.
SAMPLE = 2000
#: Lengths of stems, in characters.  A stem is in at least 1 of SUPPORT toxic documents of the sample, and three at least, and is LIFT times as frequent in them as in others.
STEM_MIN, STEM_MAX, SUPPORT, LIFT = 3, 8, 100, 20
P, A, SEED = 2_147_483_647, 1_103_515_245, 12_345
_WORD = r"[\p{L}\p{N}_]+"
#: Rules in the order of their bits: (name, condition under which a document fails), over the measurements and in SQL that both engines take.
RULES = (
    ("no_words", "n_words = 0"),
    ("few_letters", "n_words >= 20 and 2 * n_letters < n_chars"),
    ("marked_up", "n_words > 0 and 5 * n_marked > n_words"),
    ("shouting", "n_words > 0 and 5 * n_shouted > n_words"),
    ("upper_case", "n_words >= 20 and 2 * n_upper > n_letters"),
    ("repeated_words", "n_words >= 8 and 4 * n_repeated > n_words"),
    ("wordless_chunks", "n_words >= 20 and 10 * (n_words - n_alone) > 3 * n_words"),
    ("long_words", "n_words > 0 and n_letters > 25 * n_words"),
    ("toxic_stems", "n_stems >= 2"),
    ("null_text", "text_is_null"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versions of the policy: a document is kept if it failed none of the mask's rules.
POLICIES = {
    "v1_junk": BIT["no_words"] | BIT["null_text"] | BIT["few_letters"] | BIT["marked_up"] | BIT["shouting"] | BIT["upper_case"] | BIT["repeated_words"],
    "v2_all": (1 << len(RULES)) - 1,
}
CURRENT = "v2_all"


def learn_stems(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Stems typical of toxic documents, in order; those that begin with another are left out.

    labels: doc_id, toxic; rows with nulls are not used, and a doc_id with several labels is toxic if any says so.  All labelled documents of the
    sample are read; what is counted of a lower-cased beginning of words is in how many of them it is whose longest words differ, as copies and near
    copies have the same and are no further evidence.
    """
    place = F.pmod(F.pmod("doc_id", F.lit(P)) * A + SEED, F.lit(P))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == t).orderBy(place, "doc_id").limit(sample) for t in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * sample rows
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    d = d.select("toxic", words.alias("w")).where(F.size("w") > 0).withColumn("longest", F.array_max(F.transform("w", lambda x: F.struct(F.length(x), x))))
    starts = F.flatten(F.transform(F.filter("w", lambda x: F.length(x) >= STEM_MIN), lambda x: F.transform(F.sequence(F.lit(STEM_MIN), F.least(F.length(x), F.lit(STEM_MAX))), lambda k: F.substring(x, F.lit(1), k))))
    d = settled(d.select(*(F.when(F.col("toxic") == t, F.col("longest")).alias(c) for c, t in (("t", 1), ("n", 0))), F.array_distinct(starts).alias("starts")))
    both = [F.count_distinct(c).alias(c) for c in ("t", "n")]
    n = d.agg(*both).first()
    found = d.select("t", "n", F.explode("starts").alias("stem")).groupBy("stem").agg(*both)
    found = found.where((F.col("t") >= 3) & (F.col("t") * SUPPORT >= n["t"]) & ((2 * F.col("t") + 1) * (n["n"] + 1) >= LIFT * (2 * F.col("n") + 1) * (n["t"] + 1)))
    every = {r.stem for r in found.select("stem").collect()}  # as many as the bounded sample's common stems
    return sorted(x for x in every if not any(x[:k] in every for k in range(STEM_MIN, len(x))))


def _pattern(stems: list[str]) -> str:
    """One expression for all stems, sharing their beginnings."""

    def node(found: list[str]) -> str:
        if "" in found:
            return ""
        by: dict[str, list[str]] = {}
        for x in found:
            by.setdefault(x[0], []).append(x[1:])
        parts = [re.escape(c) + node(rest) for c, rest in sorted(by.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return r"(?<![\p{L}\p{N}_])" + node(stems)


def _measured(t: str, dialect: int) -> dict[str, str]:
    return {m: f"cast(coalesce({sql[dialect].replace('{t}', t)}, 0) as bigint)" for m, sql in MEASURES.items()}


def _mask() -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))


def _ledger(text: str, stems: list[str]) -> tuple[dict[str, Column], Column]:
    """Measurements of the column of that name, and the mask from a struct of them."""
    measured = {m: F.expr(sql) for m, sql in _measured(f"`{text}`", 0).items()}
    measured[STEM_MEASURE] = (F.coalesce(F.regexp_count(F.lower(F.col(f"`{text}`")), F.lit(_pattern(stems))), F.lit(0)) if stems else F.lit(0)).cast("bigint")
    return measured, F.col(f"`{text}`").isNull()


def _with_ledger(docs: DataFrame, stems: list[str]) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of the mask and the measurements, and its name."""
    text, inner, name = unused(docs, "text", "measured", "ledger")
    base = docs.withColumn(text, F.col("text").cast("string"))
    measured, null = _ledger(text, stems)
    base = base.withColumn(inner, F.struct(*(c.alias(m) for m, c in measured.items()), null.alias("text_is_null")))
    mask = F.lit(0)
    for k, (_, rule) in enumerate(RULES):
        inside = re.sub(r"\b(n_[a-z]+|text_is_null)\b", rf"`{inner}`.\1", rule)
        mask = mask + F.when(F.expr(inside), F.lit(1 << k)).otherwise(0)
    return base.withColumn(name, F.struct(mask.cast("bigint").alias("failed"), *(F.col(f"`{inner}`.{m}").alias(m) for m in measured))).drop(text, inner), name


def ledger(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, failed (bit k is rule k of RULES), the measurements, and kept_<policy> for each of POLICIES.

    A null text measures 0 everywhere and fails null_text and no_words; an empty one fails no_words.  Rows are judged one by one, repeated or not; a null
    doc_id stays null; extra columns are not read.  Without labels, or without any toxic one, no stems are known and n_stems is 0.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    x, name = _with_ledger(d, learn_stems(docs, labels) if labels is not None else [])
    x = x.select("doc_id", f"`{name}`.*")
    return x.withColumns({f"kept_{p}": F.expr(f"failed & {m}") == 0 for p, m in POLICIES.items()})


def ablation(ledger_rows: DataFrame, policy: int = POLICIES[CURRENT]) -> DataFrame:
    """For each rule of the policy: documents failing it, failing it alone (kept without that rule), and kept by the policy as it is."""
    f = F.col("failed").bitwiseAND(F.lit(policy))
    aggs = [F.count_if(f == 0).alias("kept")]
    for k, (name, _) in enumerate(RULES):
        if policy >> k & 1:
            aggs += [F.count_if(f.bitwiseAND(F.lit(1 << k)) != 0).alias(f"f_{name}"), F.count_if(f == (1 << k)).alias(f"o_{name}")]
    names = [n for k, (n, _) in enumerate(RULES) if policy >> k & 1]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only"), (F.col("kept") + F.col(f"o_{n}")).alias("n_kept_without")) for n in names)))
    return ledger_rows.agg(*aggs).select(rows.alias("r")).select("r.*")


def keep(docs: DataFrame, labels: DataFrame | None = None, policy: int = POLICIES[CURRENT]) -> DataFrame:
    """The rows of docs, with all their columns, that fail no rule of the policy."""
    x, name = _with_ledger(docs, learn_stems(docs, labels) if labels is not None else [])
    return x.where(F.expr(f"`{name}`.failed & {policy} = 0")).drop(name)


_STEMS_SQL = f"""
known AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
chosen AS (SELECT doc_id, toxic FROM known WHERE toxic IN (0, 1) QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY ((doc_id % {P} + {P}) % {P} * {A} + {SEED}) % {P}, doc_id) <= {SAMPLE}),
sampled AS (SELECT toxic, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents JOIN chosen USING (doc_id)),
apart AS (SELECT toxic, w, list_max(list_transform(w, lambda x: {{'n': length(x), 'x': x}})) AS longest FROM sampled WHERE len(w) > 0),
classes AS (SELECT count(DISTINCT longest) FILTER (toxic = 1) AS t, count(DISTINCT longest) FILTER (toxic = 0) AS n FROM apart),
starts AS (SELECT toxic, longest, unnest(list_distinct(flatten(list_transform(list_filter(w, lambda x: length(x) >= {STEM_MIN}), lambda x: list_transform(range({STEM_MIN}, least(length(x), {STEM_MAX}) + 1), lambda k: left(x, k)))))) AS stem FROM apart),
counted AS (SELECT stem, count(DISTINCT longest) FILTER (toxic = 1) AS t, count(DISTINCT longest) FILTER (toxic = 0) AS n FROM starts GROUP BY stem),
stems AS (SELECT stem FROM counted c, classes k WHERE c.t >= 3 AND c.t * {SUPPORT} >= k.t AND (2 * c.t + 1) * (k.n + 1) >= {LIFT} * (2 * c.n + 1) * (k.t + 1)),
rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
spelt AS (SELECT r, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS w FROM rows),
stemmed AS (SELECT r, count(*) AS n_stems FROM spelt WHERE {" OR ".join(f"left(w, {k}) IN (SELECT stem FROM stems)" for k in range(STEM_MIN, STEM_MAX + 1))} GROUP BY r)"""
LEDGER_SQL = f"""
WITH {_STEMS_SQL.strip()},
m AS (SELECT doc_id, text IS NULL AS text_is_null, {", ".join(f"{sql} AS {m}" for m, sql in _measured("text", 1).items())}, coalesce(n_stems, 0) AS n_stems FROM rows LEFT JOIN stemmed USING (r)),
f AS (SELECT doc_id, CAST({_mask()} AS BIGINT) AS failed, {", ".join([*MEASURES, STEM_MEASURE])} FROM m)
SELECT *, {", ".join(f"(failed & {m}) = 0 AS kept_{p}" for p, m in POLICIES.items())} FROM f
"""
ABLATION_SQL = f"WITH ledger AS ({LEDGER_SQL}) " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER ((failed & {1 << k}) <> 0) AS n_failed, count(*) FILTER (failed = {1 << k}) AS n_only, count(*) FILTER (failed = 0 OR failed = {1 << k}) AS n_kept_without FROM ledger"
    for k, (n, _) in enumerate(RULES)
)
