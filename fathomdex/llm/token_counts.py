"""Token counts through the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved offline (bpe.whole_tokens).  A document's pre-tokens that are such
strings count one each, without an encoder; only the rest are merged.  Chunk results are kept per worker, so a word costs one
dictionary lookup.  One narrow pass: no shuffle, nothing on the driver but the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import bpe
from .common import map_columns, texts

SCHEMA = "doc_id bigint, n_pre_tokens bigint, n_whole bigint, n_merged bigint, n_tokens bigint"


class Counts(bpe.Chunks):
    """(pre-tokens, of these whole, tokens of the rest), packed in one integer so that documents are sums."""

    A, B = 1 << 84, 1 << 42

    def make(self, pre_tokens: list[str]) -> int:
        rest = [p for p in pre_tokens if p not in self.whole]
        return len(pre_tokens) * self.A + (len(pre_tokens) - len(rest)) * self.B + sum(len(self.bpe._encode_single_piece(p)) for p in rest)

    def join(self, parts) -> tuple[int, int, int]:
        x = sum(parts)
        return x // self.A, x // self.B % self.B, x % self.B


def token_counts(docs: DataFrame, vocabulary: str = f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per input row: doc_id, n_pre_tokens, n_whole (pre-tokens that are one token), n_merged (tokens of all others), n_tokens.

    A null text has null counts, an empty one zeros; a null doc_id stays null; repeated rows are counted one by one; extra columns
    are not read.  Special-token strings in a text are ordinary text.
    """
    whole = docs.sparkSession.sparkContext.broadcast(bpe.whole_tokens(vocabulary))

    def make():
        counts = Counts(vocabulary, whole.value)

        def batch(b):
            found = [(None,) * 3 if t is None else counts.of(t) for t in b.column(1).to_pylist()]
            pre, one, rest = ([x[k] for x in found] for k in range(3))
            yield {"doc_id": b.column(0), "n_pre_tokens": pre, "n_whole": one, "n_merged": rest, "n_tokens": [None if a is None else a + c for a, c in zip(one, rest)]}

        return batch

    return map_columns(texts(docs), make, SCHEMA)
