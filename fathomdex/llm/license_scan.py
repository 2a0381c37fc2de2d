"""Licence scan: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment decides.

A template's word K-grams are winnowed: of each WINDOW in a row the least hash stays, so any run of K + WINDOW - 1 of its words that a document
holds contains a fingerprint.  Every K-gram of every document is looked up.  Hits of one template on near diagonals, at most SPREAD apart, are
candidates together: the template is aligned with the words there in a band; what is found is reported with coverage (its matched words) and span, then
its words are masked and the template is aligned again, until nothing more is found, so that a notice that is repeated is found each time.  Of
candidates that overlap, the one with the most matched words, then the fewest gaps, then the higher coverage, then the first template, stays.

One narrow pass over the texts; the templates and their index are a few kilobytes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from .common import WORD, WordIds, map_columns, texts, words
from .license_templates import TEMPLATES

K, WINDOW, BAND, SPREAD = 4, 3, 8, 64
COVERAGE = 0.75
SCHEMA = "doc_id bigint, license string, template string, coverage double, matched int, start bigint, stop bigint"


class Templates:
    def __init__(self, templates=TEMPLATES):
        self.names = [(n, s) for n, s, _ in templates]
        w = [words(t) for _, _, t in templates]
        self.numbers: dict[str, int] = {}
        for x in (x for t in w for x in t):
            self.numbers.setdefault(x, len(self.numbers))
        self.words = [[self.numbers[x] for x in t] for t in w]
        assert min(map(len, w)) >= K
        self.base = len(self.numbers)
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.words):
            g = self.grams(np.array(t, np.int64))[1]
            h = (g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).tolist()
            chosen = set()
            for a in range(max(1, len(g) - WINDOW + 1)):
                chosen.add(min(range(a, min(a + WINDOW, len(g))), key=lambda i: (h[i], -i)))
            for i in chosen:
                self.index[int(g[i])].append((k, i))
        self.prints = np.array(sorted(self.index), np.int64)

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of the K-grams of known words only."""
        if len(ids) < K:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = np.r_[0, np.cumsum(ids >= 0)]
        at = np.flatnonzero(known[K:] - known[:-K] == K)
        g = np.zeros(len(at), np.int64)
        for k in range(K):
            g = g * self.base + ids[at + k]
        return at, g

    def scan(self, ids: np.ndarray, coverage: float):
        """(template, coverage, matched, first word, last word + 1), by place."""
        at, g = self.grams(ids)
        hit = np.flatnonzero(np.isin(g, self.prints))
        if not len(hit):
            return []
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in hit.tolist():
            for k, p in self.index[int(g[i])]:
                by[k].append((int(at[i]) - p, int(at[i])))
        found = []
        for k, hits in by.items():
            hits.sort()
            group: list[tuple[int, int]] = []
            for h in [*hits, None]:
                if h is None or group and (h[0] - group[-1][0] > BAND or h[0] - group[0][0] > SPREAD):
                    found += self.candidates(k, group, ids, coverage)
                    group = []
                if h is not None:
                    group.append(h)
        found = list(dict.fromkeys(found))  # of groups whose bands overlap
        found.sort(key=lambda x: (-x[2], x[4] - x[3] - x[2], -x[1], x[0]))
        out: list = []
        for f in found:
            if all(f[4] <= o[3] or f[3] >= o[4] for o in out):
                out.append(f)
        return sorted(out, key=lambda x: x[3])


    def candidates(self, k: int, group: list[tuple[int, int]], ids: np.ndarray, coverage: float):
        """Every occurrence of template k around the hits (diagonal, position) of one group."""
        t = self.words[k]
        first = max(0, group[0][0] - BAND)
        words_ = ids[first : group[-1][0] + BAND + len(t) + 1].tolist()
        while group:
            a = align(t, words_, group[0][0] - first, group[-1][0] - first)
            if a is None or a[0] / len(t) < coverage:
                return
            yield k, round(a[0] / len(t), 6), a[0], a[1] + first, a[2] + first
            words_[a[1] : a[2]] = [MASKED] * (a[2] - a[1])
            group = [h for h in group if not any(x == MASKED for x in words_[h[1] - first : h[1] - first + K])]


#: In place of words that an alignment has taken; in no template.
MASKED = -9


def align(template: list[int], ids: list[int], low: int, high: int) -> tuple[int, int, int] | None:
    """Best local alignment of the template with the words on diagonals low - BAND .. high + BAND: (matched words, first, last + 1).

    A match is worth 2; a word replaced, left out or put in costs 1.
    """
    lo, width = low - BAND, high - low + 2 * BAND + 1
    zero = (0, 0, None, None)  # score, matched, first, last + 1
    before, best = [zero] * (width + 1), zero
    for i, x in enumerate(template):
        now = [zero] * (width + 1)
        left = zero
        for d in range(width):
            j = lo + d + i
            if 0 <= j < len(ids):
                s = before[d]
                if ids[j] == x:
                    c = (s[0] + 2, s[1] + 1, j if s[2] is None else s[2], j + 1)
                else:
                    c = (s[0] - 1, s[1], s[2], s[3])
                up = before[d + 1]
                if up[0] - 1 > c[0]:
                    c = (up[0] - 1, *up[1:])
                if left[0] - 1 > c[0]:
                    c = (left[0] - 1, *left[1:])
                if c[0] <= 0:
                    c = zero
                now[d] = left = c
                if c[0] > best[0]:
                    best = c
        before = now
    return None if best[2] is None else (best[1], best[2], best[3])


def license_scan(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per notice found: doc_id, license, template, coverage, matched (words), start, stop (characters of the text).

    A document may hold several, the same one again and again too.  Null and empty texts have none; repeated rows report each; a null doc_id is kept as null;
    extra columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(Templates(templates))

    def make():
        t = index.value
        ids_of = WordIds(t.numbers)

        def batch(b):
            cols: dict = {c: [] for c in ("doc_id", "license", "template", "coverage", "matched", "start", "stop")}
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = t.scan(ids_of.of(text), coverage) if text else []
                if found:
                    spans = _spans(text)
                    for k, c, m, first, last in found:
                        for name, v in zip(cols, (i, t.names[k][1], t.names[k][0], c, m, spans[first][0], spans[last - 1][1])):
                            cols[name].append(v)
            yield cols

        return batch

    return map_columns(texts(docs), make, SCHEMA)


def _spans(text: str) -> list[tuple[int, int]]:
    """Where each of words(text) lies in text, whose lower case may be longer than itself."""
    lower = text.lower()
    if len(lower) == len(text):
        return [m.span() for m in WORD.finditer(lower)]
    place = [k for k, c in enumerate(text) for _ in c.lower()]
    place.append(len(text))
    return [(place[min(m.start(), len(place) - 1)], place[min(m.end() - 1, len(place) - 1)] + 1) for m in WORD.finditer(lower)]
