"""Highlighting: the query's tokens, wrapped where they stand as whole tokens, in any case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import analysis
from ..plans import ast as A
from ..plans import querystring
from ..plans.compile import Fields


def query_tokens(node: A.Node, fields: Fields) -> list[str]:
    out: list[str] = []
    for x in A.walk(node):
        if isinstance(x, A.QueryString):
            out += query_tokens(querystring.parse(x, fields.text_fields()), fields)
        elif isinstance(x, (A.Match, A.Phrase, A.PhrasePrefix, A.MultiMatch)):
            out += analysis.tokenize(x.text)
        elif isinstance(x, A.Bool) and x.must_not:
            gone = {t for y in x.must_not for t in query_tokens(y, fields)}
            out = [t for t in out if t not in gone]
    return list(dict.fromkeys(out))


def highlighted(c: Column, tokens: list[str], pre: str = "<em>", post: str = "</em>") -> Column:
    """The whole field with its matches wrapped, or null where there is none."""
    safe = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    any_of = "|".join(sorted(tokens, key=len, reverse=True))
    done = F.regexp_replace(c, f"(?i)(?<![A-Za-z0-9])({any_of})(?![A-Za-z0-9])", f"{safe(pre)}$1{safe(post)}")
    return F.when(done != c, done) if tokens else F.lit(None).cast("string")


def highlight_map(node: A.Node, spec: dict, fields: Fields) -> Column:
    """map of field to its one fragment, for string fields with a hit."""
    pre, post = ((spec.get(k) or [d])[0] for k, d in (("pre_tags", "<em>"), ("post_tags", "</em>")))
    toks = query_tokens(node, fields)
    names = [f for f in spec.get("fields", {}) if fields.type(f) is not None and fields.type(f).simpleString() == "string"]
    entries = [F.struct(F.lit(f).alias("key"), F.array(highlighted(fields.column(f), toks, pre, post)).alias("value")) for f in names]
    if not entries:
        return F.create_map().cast("map<string,array<string>>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"][0].isNotNull()))
