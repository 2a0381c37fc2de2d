"""Byte-level BPE over whitespace-delimited chunks, with the vocabulary's single-token strings proved beforehand."""

from __future__ import annotations

import base64
import functools
import os
import re

import regex

DEFAULT_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: The pre-token pattern that goes with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(path: str):
    """The library's encoder of the vocabulary; special-token strings are ordinary text to it."""
    import tiktoken

    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


#: White space, as the pattern knows it, from which on a run is cut out before the library sees it: its regular expression goes back over such a run
#: by recursion and ends the process.
RUN = 10_000
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


def encode(library, text: str) -> list[int]:
    """The ids of library.encode_ordinary, for texts with runs of white space of any length.

    The pattern makes one pre-token of all but a run's last character, or of all at the text's end; the last goes with what follows, as it would.
    """
    out, at = [], 0
    if len(text) >= RUN:
        for m in _LONG.finditer(text):
            stop = m.end() - (m.end() < len(text))
            out += library.encode_ordinary(text[at : m.start()]) + library._encode_single_piece(text[m.start() : stop])
            at = stop
    return out + library.encode_ordinary(text[at:] if at else text)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: merge the adjacent pair of lowest rank, the leftmost of equals, until none is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@functools.lru_cache(4)
def whole_tokens(path: str) -> dict[str, int]:
    """The vocabulary strings that provably encode alone as one token: valid text, one pre-token, and merged into one by plain BPE.

    Depends on the vocabulary alone, so it is worked out once, before any document is read.
    """
    ranks, pattern, out = load_ranks(path), regex.compile(PATTERN), {}
    for piece, rank in ranks.items():
        try:
            s = piece.decode()
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(s) and pattern.findall(s) == [s] and merge(piece, ranks) == [rank]:
            out[s] = rank
    return out


class Chunks(dict):
    """What each chunk of text becomes, kept per worker.

    A chunk is a run without space or line feed, with the one space before it if there is one.  No pre-token crosses
    from a non-space into a following single space or line feed, and none starts with a line feed that a non-space follows and goes
    on; hence texts whose white space is only single spaces and line feeds between other characters are split exactly
    by str.split.  All other texts are taken whole, by the pattern.
    """

    ODD = regex.compile(r"\s{2}|[^\S \n]|^\s|\s$")
    #: longer strings are encoded each time, not kept
    KEEP = 64
    SIZE = 200_000

    def __init__(self, path: str, whole: dict[str, int]):
        self.whole, self.pattern, self.bpe = whole, regex.compile(PATTERN), encoder(path)

    def make(self, pre_tokens: list[str]):
        raise NotImplementedError

    def join(self, parts):
        raise NotImplementedError

    def __missing__(self, chunk: str):
        made = self.make(self.pattern.findall(chunk))
        if len(chunk) <= self.KEEP:
            if len(self) > self.SIZE:
                self.clear()
            self[chunk] = made
        return made

    def of(self, text: str):
        if not text:
            return self.join([])
        if self.ODD.search(text):
            return self.join(map(self.__getitem__, self.pattern.findall(text)))
        parts = []
        for k, line in enumerate(text.split("\n")):
            if k:
                parts.append(self["\n"])
            first, *rest = line.split(" ")
            parts.append(self[first])
            parts += map(self.__getitem__, map(" ".__add__, rest))
        return self.join(parts)
