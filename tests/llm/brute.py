"""Slow, plain versions of the operators, for comparison."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"\w+")


def words(text):
    return WORD.findall(text.lower())


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard(docs, n, t):
    """{(a, b): similarity} over (doc_id, text) rows."""
    found = {}
    rows = [(i, grams(x, n)) for i, x in docs if i is not None and x]
    for k, (i, a) in enumerate(rows):
        for j, b in rows[k + 1 :]:
            if a and b and i != j:
                s = len(a & b) / len(a | b)
                if s >= t - 1e-12:
                    pair = (min(i, j), max(i, j))
                    found[pair] = max(s, found.get(pair, 0))
    return found


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def edit1(a, b):
    """Whether two different strings are one insertion, deletion or substitution apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def line_dedup(docs, near_chars):
    """{(doc_id, line_no)} that go, over rows with distinct ids."""
    at = [(i, k, s.strip(" \t\r")) for i, t in sorted(docs) for k, s in enumerate(t.split("\n"))]
    at = [x for x in at if x[2]]
    return {(i, k) for p, (i, k, s) in enumerate(at) if any(s == r or min(len(s), len(r)) >= near_chars and edit1(s, r) for _, _, r in at[:p])}


def log_prob(log_p, s):
    """Sum over every segmentation, one by one."""
    total, todo = 0.0, [(0, 1.0)]
    while todo:
        i, p = todo.pop()
        if i == len(s):
            total += p
            continue
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in log_p:
                todo.append((j, p * math.exp(log_p[s[i:j]])))
            elif j == i + 1:
                todo.append((j, p * math.exp(sum(log_p.get(f"<0x{b:02X}>", -40.0) for b in s[i].encode()))))
    return math.log(total)


def sainte_lague(seats, weights, have):
    """Seats by source, none above what it has: one seat after another to the highest quotient."""
    quota = Counter()
    for _ in range(seats):
        best = max((s for s in weights if quota[s] < have[s]), key=lambda s: (Fraction(weights[s]) / (2 * quota[s] + 1), [-ord(c) for c in s]), default=None)
        if best is None:
            break
        quota[best] += 1
    return quota


def contaminated(docs, items, unit, threshold, question, answer, k1=1.2, b=0.75):
    """{(doc_id, item_id)}: BM25 of every unit against every passage, without an index or bounds."""
    units, parts = [], {}
    for item, text in items:
        w = words(text)
        if not w:
            continue
        split = re.split(r"(?<=[.!?])\s+", text.strip())
        parts[item] = (w, []) if len(split) < 2 else (words(" ".join(split[:-1])), words(split[-1]))
        n = -(-len(w) // unit)
        units += [(item, w[j * len(w) // n : (j + 1) * len(w) // n], len(w)) for j in range(n)]
    df = Counter(x for _, u, _ in units for x in set(u))
    avg = sum(len(u) for _, u, _ in units) / max(1, len(units))
    idf = {x: math.log(1 + (len(units) - d + 0.5) / (d + 0.5)) for x, d in df.items()}
    weigh = lambda u: {x: idf[x] * f * (k1 + 1) / (f + k1 * (1 - b + b * len(u) / avg)) for x, f in Counter(u).items()}
    pairs = lambda w: set(zip(w, w[1:])) if len(w) > 1 else {(x,) for x in w}
    out = set()
    for i, t in docs:
        w = words(t or "")
        for start in range(0, len(w), unit):
            window = set(w[start : start + 2 * unit])
            for item, u, size in units:
                v = weigh(u)
                if sum(x for k, x in v.items() if k in window) / sum(v.values()) < threshold - 1e-9:
                    continue
                near = w[max(0, start - size) : start + 2 * unit + size]
                near = pairs(near) | {(x,) for x in near}
                q, a = parts[item]
                if all(not x or len(pairs(x) & near) / len(pairs(x)) >= least for x, least in ((q, question), (a, answer))):
                    out.add((i, item))
    return out


def mixed(docs, weights, block_tokens, budget, alpha, seed, shard_tokens, p=2_147_483_647, a=1_103_515_245, c=40_503):
    """Ids that are selected, of (doc_id, text, source) rows."""
    place = lambda i, s: (lambda x: (x * x + x * c) % p)((i % p * a + s % p) % p)
    size, src = {}, {}
    for i, t, s in docs:
        if i is None:
            continue
        n, s = len(re.findall(r"[^ \n\t\r]+", t or "")), s or ""
        if i not in size or (-n, s) < (-size[i], src[i]):
            size[i], src[i] = n, s
    total = Counter()
    for i in size:
        total[src[i]] += size[i]
    free = sum(n**alpha for s, n in total.items() if s not in weights)
    weight = {s: weights[s] if s in weights else n**alpha * (1 - sum(weights.values())) / free for s, n in total.items()}
    shards = max(1, -(-sum(total.values()) // shard_tokens))
    by = defaultdict(list)
    for i in size:
        by[place(i, seed) % shards, src[i]].append(i)
    out = set()
    for shard in {h for h, _ in by}:
        have = {s: max(1, math.ceil(sum(size[i] for i in ids) / block_tokens)) for (h, s), ids in by.items() if h == shard}
        quota = sainte_lague(math.ceil(sum(have.values()) * budget), {s: weight[s] for s in have}, have)
        for s in have:
            run = 0
            for i in sorted(by[shard, s], key=lambda i: (place(i, seed + 1), i)):
                if min((2 * run + size[i]) // (2 * block_tokens), have[s] - 1) < quota[s]:
                    out.add(i)
                run += size[i]
    return out


def align(template, ids):
    """(matched, first, last + 1) of the best local alignment over all cells; the first in reading order of equals."""
    zero = (0, 0, None, None)
    before, best = [zero] * (len(ids) + 1), zero
    for x in template:
        now = [zero]
        for j, y in enumerate(ids):
            s = before[j]
            c = (s[0] + 2, s[1] + 1, j if s[2] is None else s[2], j + 1) if x == y else (s[0] - 1, *s[1:])
            for other in (before[j + 1], now[j]):
                if other[0] - 1 > c[0]:
                    c = (other[0] - 1, *other[1:])
            now.append(c if c[0] > 0 else zero)
            if now[-1][0] > best[0]:
                best = now[-1]
        before = now
    return best[1:]


def licences(text, templates, coverage):
    """[(template, matched, first word, last + 1)]: every template against every place, again and again, without an index or a band."""
    found = []
    for k, (_, _, t) in enumerate(templates):
        t, ids = words(t), words(text)
        while True:
            n, first, stop = align(t, ids)
            if n < coverage * len(t) or not n:
                break
            found.append((k, n, first, stop, n / len(t)))
            ids[first:stop] = [None] * (stop - first)
    found.sort(key=lambda x: (-x[1], x[3] - x[2] - x[1], -x[4], x[0]))
    out = []
    for f in found:
        if all(f[3] <= o[2] or f[2] >= o[3] for o in out):
            out.append(f)
    return sorted((f[0], f[1], f[2], f[3]) for f in out)


def secrets(formats, text, least):
    """[(start, stop, format)] of candidates found character by character; likelihoods as products of an automaton's probabilities, one state after another."""
    inside = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+")

    def log_p(a, value):
        q, p = 0, 0.0
        for c in value:
            if c in a.steps[q]:
                q, x = a.steps[q][c]
            else:
                x = math.log(1e-4)
            p += x
        return p + a.stops[q]

    def verdict(value):
        found = None
        for label, (a, threshold) in formats.automata.items():
            s = log_p(a, value) / (len(value) + 1) + math.log(65)
            if formats.kinds[label] == "run" and s >= threshold and (found is None or s > found[1]):
                found = (label, s, log_p(a, value))
        if found:
            plain = log_p(formats.plain, value)
            if value.isdigit():
                plain = max(plain, -math.log(65) - len(value) * math.log(10))
            if value.isalpha():
                plain = max(plain, -math.log(65) - len(value) * math.log(26) - math.log(6) * sum(x.isupper() != y.isupper() for x, y in zip(value, value[1:])))
            if plain >= found[2] + math.log(1e-4):
                found = None
        return found and found[0]

    def runs(s, allowed):
        k = 0
        while k < len(s):
            e = k
            while e < len(s) and s[e] in allowed:
                e += 1
            if e - k >= least:
                yield k, s[k:e] + "=" * (s[e : e + 2] + "x").index("".join(x for x in s[e : e + 2] + "x" if x != "=")[:1])
            k = max(e, k + 1)

    out = []
    for at, run in runs(text, inside | set("/.:")):
        run = run.rstrip("/.:")
        if label := verdict(run):
            out.append((at, at + len(run), label))
            continue
        for k, part in runs(run, inside) if not run.isalpha() else ():
            if part != run and (label := verdict(part)):
                out.append((at + k, at + k + len(part), label))
    return out


def document_log_prob(log_p, text, longest):
    """Of the whole text, by sums of probabilities of all beginnings, scaled; without a trie, fragments, caches or logarithms of sums."""
    total = 0.0
    for w in text.split():
        w = "\u2581" + w
        a, shift = [1.0] + [0.0] * len(w), 0.0
        for j in range(1, len(w) + 1):
            alone = w[j - 1] in log_p
            for i in range(max(0, j - longest), j):
                if w[i:j] in log_p:
                    a[j] += a[i] * math.exp(log_p[w[i:j]])
                elif i == j - 1 and not alone:
                    a[j] += a[i] * math.exp(sum(log_p.get(f"<0x{b:02X}>", -40.0) for b in w[i].encode("utf-8", "replace")))
            if a[j] < 1e-200:
                scale = 1 / a[j]
                for k in range(max(0, j - longest), j + 1):
                    a[k] *= scale
                shift -= math.log(scale)
        total += math.log(a[len(w)]) + shift
    return total
