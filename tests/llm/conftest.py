import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators might use themselves.
CLASH = ("gone", "failed", "n_tokens", "block", "rank", "members", "sid", "h1", "pivot", "w", "k", "line_no", "kept", "__text", "__ledger", "__id", "__measured", "toxic", "Lines")


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (doc_id, text, source) rows, with clashing extra columns if asked."""
    from pyspark.sql import functions as F

    def make(rows, clash=False):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows], DOCS)
        return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, a very long one, repeated rows, one id with two texts."""
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(40_000))
    some = "Some ordinary words of prose stand here, enough of them for every test. Another sentence follows it."
    return [(None, some, "a"), (None, None, None), (1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, long, "a"), (5, some, "b"), (5, some, "b"), (6, some + " End.", "b"), (7, "first text of seven, short", "c"), (7, "second text of seven, other", "c"), (8, "é　ß İ 日本語\r\nx", "c"), (-9, "negative id", "c")]
