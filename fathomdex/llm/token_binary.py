"""Token ids as fixed-width bit-packed binary, with block offsets for random access.

Each id takes the fewest bits that hold the vocabulary.  A document's ids are packed in blocks of BLOCK ids, each starting on a
byte; block_offsets has the byte where each block starts, so a reader unpacks any span from the blocks that hold it, by numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import bpe
from .common import map_columns, texts

BLOCK = 1024
SCHEMA = "doc_id bigint, n_tokens bigint, bits int, block_size int, block_offsets array<bigint>, packed binary"


def width(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids' lowest `bits` bits, one after another, lowest bit first; the last byte is filled with zeros."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def pack_blocks(ids: np.ndarray, bits: int, block: int = BLOCK) -> tuple[list[int], bytes]:
    parts = [pack(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    return [0, *np.cumsum([len(p) for p in parts[:-1]]).tolist()] if parts else [], b"".join(parts)


def read_tokens(packed: bytes, block_offsets: list[int], n_tokens: int, bits: int, start: int = 0, stop: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Ids start..stop of one document, touching only the blocks that hold them."""
    stop = n_tokens if stop is None else min(stop, n_tokens)
    if start >= stop:
        return np.empty(0, np.uint32)
    a, b = start // block, (stop - 1) // block
    out = []
    for k in range(a, b + 1):
        end = block_offsets[k + 1] if k + 1 < len(block_offsets) else len(packed)
        out.append(unpack(packed[block_offsets[k] : end], min(block, n_tokens - k * block), bits))
    return np.concatenate(out)[start - a * block : stop - a * block]


def token_binary(docs: DataFrame, vocabulary: str = f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_tokens, bits, block_size, block_offsets, packed.

    A null text has null n_tokens, offsets and data; an empty one 0 tokens, no offsets and empty data; a null doc_id stays null;
    repeated rows are encoded one by one; extra columns are not read.
    """
    bits = width(max(bpe.load_ranks(vocabulary).values()) + 1)

    def make():
        library = bpe.encoder(vocabulary)

        def batch(b):
            ids, texts_ = b.column(0).to_pylist(), b.column(1)
            for at in range(0, len(ids), 500):
                found = [None if t is None else np.array(bpe.encode(library, t), np.uint32) for t in texts_.slice(at, 500).to_pylist()]
                blocks = [(None, None) if x is None else pack_blocks(x, bits, block) for x in found]
                yield {"doc_id": ids[at : at + 500], "n_tokens": [None if x is None else len(x) for x in found], "bits": [bits] * len(found), "block_size": [block] * len(found), "block_offsets": [x for x, _ in blocks], "packed": [x for _, x in blocks]}

        return batch

    return map_columns(texts(docs), make, SCHEMA)
