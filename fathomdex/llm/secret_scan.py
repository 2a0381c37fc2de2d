"""Secret scan by inferred grammars.

For each credential format, the labelled examples make a prefix tree of characters; states whose outgoing frequencies are statistically
compatible (Hoeffding bound) are merged, red-blue, into a probabilistic automaton.  Every candidate of every text - a run of the labelled
credentials' characters, its parts between separators, a private key's block of lines, a name of a secret key with what is assigned to it - is scored by each
automaton, whatever its length: the mean over its characters of log P(format) minus log P of a uniform character.  The threshold of a format lies between its own examples and those of all other labels, and a secret must be
likelier by its format, for all that few candidates are secrets (PRIOR), than as ordinary text: by an automaton of the plain examples, and as a run of
digits or of letters whose case seldom changes.

The labelled examples are made here from the published shapes of the formats, by a seeded generator; a table of (label, value) rows can be
given instead.  Training is on the driver, over a bounded sample (SAMPLE per label); the scan is one narrow pass.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string

from pyspark.sql import DataFrame

from .common import CACHE, map_columns, texts

#: Examples per label that the automata are inferred from.
SAMPLE = 200
ALPHA = 0.05
#: Probability of what a state never saw.
UNSEEN = 1e-4
#: Probability of an end in a state where no example ended.
UNENDED = 1e-9
UNIFORM = math.log(1 / 65)
#: Log odds of a candidate to be a secret before it is looked at.
PRIOR = math.log(1e-4)
#: What may stand inside a candidate without being part of a word, beside letters and digits and up to two = at its end; a part is what separators leave.
JOINED, SEPARATORS = "_-+", "/.:"
#: A block of lines between BEGIN and END, and a key's name with its value: candidates that white space does not end.
BLOCK = r"-----BEGIN [A-Z ]+-----[A-Za-z0-9+/=\s]*-----END [A-Z ]+-----"
ASSIGNED = r"(?i:[a-z_]*secret[a-z_]*key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9/+=]+"
PLAIN = "plain"
SCHEMA = "doc_id bigint, start bigint, stop bigint, format string, log_likelihood double, score double, hint string"


def kind(value: str) -> str:
    """Of a candidate or a credential.  A candidate is scored by the formats whose credentials are of its kind."""
    return "block" if re.fullmatch(BLOCK, value) else "assigned" if re.fullmatch(ASSIGNED, value) else "run"


def labelled(seed: int, n: int) -> list[tuple[str, str]]:
    """n examples of each label, plain ones included."""
    r = random.Random(seed)
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    url = low + up + dig + "-_"

    def plain() -> str:
        syllables = ("the", "tion", "er", "ing", "re", "an", "st", "ou", "ver", "en", "is", "le", "con", "que", "mente", "heit", "ab", "de", "fa", "bed", "ace")
        word = lambda k: "".join(r.choice(syllables) for _ in range(k))
        return r.choice((
            lambda: word(r.randint(5, 12)), lambda: word(3) + "_" + word(3) + "_" + word(2), lambda: word(2).capitalize() + word(3).capitalize() + word(3).capitalize(), lambda: pick(dig, r.randint(16, 20)),
            lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:00", lambda: f"www.{word(3)}.example/{word(2)}/{word(2)}", lambda: "=" * 0 + "-" * r.randint(16, 60), lambda: word(4).upper() + word(4).upper(),
            lambda: r.choice(("secret", "access", "api", "private", "aws_secret", "aws_secret_access", "client", word(1))) + r.choice("_-") + r.choice(("key", "token", "id", "path", "name", word(2))),
            lambda: f"https://{word(2)}.example.com/{word(3)}/{r.randint(1, 9999)}",
        ))()

    make = {
        "aws_secret_key": lambda: r.choice(("aws_secret_access_key", "AWS_SECRET_ACCESS_KEY", "aws_secret_key", "secret_access_key", "secret_key", "SecretAccessKey", "secretKey")) + r.choice(("=", " = ", ": ", '": "', "='", '="')) + pick(low + up + dig + "/+", 40),
        "private_key": lambda: (lambda kind: f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(pick(low + up + dig + "+/", 64) for _ in range(r.randint(1, 6))) + "\n" + pick(low + up + dig + "+/", r.randint(4, 60)) + r.choice(("", "=", "==")) + f"\n-----END {kind}PRIVATE KEY-----")(r.choice(("RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED ", ""))),
        "github_pat": lambda: "github_pat_" + pick(low + up + dig, 22) + "_" + pick(low + up + dig, 59),
        "aws_access_key": lambda: r.choice(("AKIA", "ASIA")) + pick(up + "234567", 16),
        "github_token": lambda: r.choice(("ghp_", "gho_", "ghs_")) + pick(low + up + dig, 36),
        "slack_token": lambda: r.choice(("xoxb-", "xoxp-")) + pick(dig, r.randint(10, 13)) + "-" + pick(dig, r.randint(10, 13)) + "-" + pick(low + up + dig, 24),
        "google_api_key": lambda: "AIza" + pick(url, 35),
        "stripe_key": lambda: r.choice(("sk_live_", "rk_live_", "sk_test_")) + pick(low + up + dig, r.choice((24, 99))),
        "jwt": lambda: "eyJ" + pick(url, r.randint(17, 100)) + ".eyJ" + pick(url, r.randint(40, 800)) + "." + pick(url, r.choice((43, 64, 86, 342, 683))),
        "hex_token": lambda: pick(dig + "abcdef", r.choice((32, 40, 40, 64, 96, 128))),
        "hex_token_upper": lambda: pick(dig + "ABCDEF", r.choice((32, 40, 40, 64, 96, 128))),
        PLAIN: plain,
    }
    return [(label, f()) for label, f in make.items() for _ in range(n)]


class Automaton:
    """States are numbers; next[q][c] = (state, count); ends[q], total[q] are counts."""

    def __init__(self, values: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.through: list[dict[str, int]] = [{}]
        self.ends, self.total = [0], [0]
        for v in sorted(values):
            q = 0
            for c in v:
                self.total[q] += 1
                self.through[q][c] = self.through[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.through.append({})
                    self.ends.append(0)
                    self.total.append(0)
                q = self.next[q][c]
            self.total[q] += 1
            self.ends[q] += 1

    def infer(self, alpha: float = ALPHA) -> "Automaton":
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, seen = [0], {0}
        while True:
            # most evidence first, and loops before jumps: states seen once or twice are compatible with any, the start included
            blue = max(((self.total[b], -k, c) for k, q in enumerate(red) for c, b in self.next[q].items() if b not in seen), default=None)
            if blue is None:
                break
            q, c = red[-blue[1]], blue[2]
            b = self.next[q][c]
            for r in [q, *reversed(red)]:
                if self.compatible(r, b):
                    self.next[q][c] = r
                    self.fold(r, b)
                    break
            else:
                red.append(b)
                seen.add(b)
        return self.compact(red)

    def close(self, a: int, m: int, b: int, n: int) -> bool:
        return not m or not n or abs(a / m - b / n) <= self.bound * (m**-0.5 + n**-0.5)

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if not self.close(self.ends[x], self.total[x], self.ends[y], self.total[y]):
                return False
            for c in self.through[x].keys() | self.through[y].keys():
                if not self.close(self.through[x].get(c, 0), self.total[x], self.through[y].get(c, 0), self.total[y]):
                    return False
            todo += [(self.next[x][c], self.next[y][c]) for c in self.next[x].keys() & self.next[y].keys()]
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.total[x] += self.total[y]
            self.ends[x] += self.ends[y]
            for c, n in self.through[y].items():
                self.through[x][c] = self.through[x].get(c, 0) + n
            for c, z in self.next[y].items():
                if c in self.next[x]:
                    todo.append((self.next[x][c], z))
                else:
                    self.next[x][c] = z

    def compact(self, red: list[int]) -> "Automaton":
        number = {q: k for k, q in enumerate(red)}
        log = math.log
        self.steps = [{c: (number[self.next[q][c]], log(n / self.total[q])) for c, n in self.through[q].items()} for q in red]
        self.stops = [log(max(self.ends[q] / self.total[q], UNENDED)) for q in red]
        del self.next, self.through, self.ends, self.total
        return self

    def log_p(self, value: str) -> float:
        """Log-likelihood; a character that a state never saw costs UNSEEN and leaves the state as it is."""
        q, total = 0, 0.0
        for c in value:
            q, x = self.steps[q].get(c, (q, _UNSEEN))
            total += x
        return total + self.stops[q]

    def score(self, value: str) -> float:
        """Mean log ratio to a uniform character, the end counting as one; any length is judged by the transitions and the end alone."""
        return self.log_p(value) / (len(value) + 1) - UNIFORM


_UNSEEN = math.log(UNSEEN)


class Formats:
    def __init__(self, examples: list[tuple[str, str]]):
        by: dict[str, list[str]] = {}
        for label, value in examples:
            own = by.setdefault(label, [])
            if value and len(own) < 2 * SAMPLE:
                own.append(value)
        self.automata: dict[str, tuple[Automaton, float]] = {}
        self.kinds = {label: max(("run", "assigned", "block"), key=[kind(v) for v in values].count) for label, values in by.items()}
        for label, values in by.items():
            if label == PLAIN or not values:
                continue
            a = Automaton(values[:SAMPLE]).infer()
            own = sorted(a.score(v) for v in values)
            others = [a.score(v) for k, vs in by.items() if k != label for v in vs]
            worst = own[len(own) // 100]
            other = max([s for s in others if s < worst], default=worst - 2)
            self.automata[label] = (a, (worst + max(other, worst - 2)) / 2)
        self.patterns(v for label, values in by.items() if label != PLAIN for v in values)
        self.plain = Automaton(by[PLAIN][:SAMPLE]).infer() if by.get(PLAIN) else None
        self.known: dict[str, tuple | None] = {}

    def patterns(self, credentials) -> None:
        """Candidates are runs of the characters of the labelled credentials, from half the length of the shortest one on."""
        chars, shortest = set(string.ascii_letters + string.digits + JOINED), 16
        for v in credentials:
            if kind(v) == "run" and not re.search(r"\s", v):
                chars.update(v.rstrip("="))
                shortest = min(shortest, len(v))
        one_of = lambda x: "[" + "".join(map(re.escape, sorted(x))) + "]"
        least = max(4, shortest // 2)
        self.candidate = re.compile(rf"{BLOCK}|{ASSIGNED}|{one_of(chars | {*SEPARATORS})}{{{least},}}={{0,2}}")
        self.part = re.compile(rf"{one_of(chars - {*SEPARATORS})}{{{least},}}={{0,2}}")

    def ordinary(self, value: str) -> float:
        """Log-likelihood of what is no secret: by the plain examples, or as a run of digits or of letters whose case seldom changes."""
        out = self.plain.log_p(value) if self.plain else -math.inf
        if value.isdigit():
            out = max(out, UNIFORM - len(value) * math.log(10))
        elif value.isalpha():
            changes = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:]))
            out = max(out, UNIFORM - len(value) * math.log(26) - changes * math.log(6))
        return out

    def best(self, value: str) -> tuple[str, float, float] | None:
        """(format, log-likelihood, score) of the likeliest format that accepts the value, if it is likelier than plain text."""
        if value in self.known:
            return self.known[value]
        out, own = None, kind(value)
        for label, (a, least) in self.automata.items():
            s = a.score(value) if self.kinds[label] == own else -math.inf
            if s >= least and (out is None or s > out[2]):
                out = (label, a.log_p(value), s)
        if out and self.ordinary(value) >= out[1] + PRIOR:
            out = None
        if len(value) <= 64:
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[value] = out
        return out

    def scan(self, text: str):
        """(start, stop, format, log-likelihood, score) of each secret; a run that is none is looked at part by part."""
        for m in self.candidate.finditer(text):
            run = m.group().rstrip(".:/")
            hit = self.best(run)
            if hit:
                yield m.start(), m.start() + len(run), *hit
            elif not run.isalpha():
                for p in self.part.finditer(run):
                    if p.group() != run and (hit := self.best(p.group())):
                        yield m.start() + p.start(), m.start() + p.end(), *hit


@functools.lru_cache(2)
def default_formats(seed: int = 7) -> Formats:
    return Formats(labelled(seed, 2 * SAMPLE))


def secret_scan(docs: DataFrame, credentials: DataFrame | None = None) -> DataFrame:
    """One row per secret: doc_id, start, stop (characters), format, log_likelihood, score, hint (its first four characters).

    credentials: labelled examples (label, value), of which a bounded sample per label, least hash first, is used; rows with nulls are not.  The label
    'plain' is for what is no secret.  Null and empty texts have no secrets; repeated rows report each; a null doc_id stays null; extra columns are not read.
    """
    spark = docs.sparkSession
    if credentials is None:
        formats = default_formats()
    else:
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        w = Window.partitionBy("label").orderBy(F.xxhash64("value"), "value")
        rows = credentials.select(F.col("label").cast("string"), F.col("value").cast("string")).dropna().distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= 2 * SAMPLE)
        formats = Formats([(r.label, r.value) for r in rows.orderBy("label", "k").collect()])
    given = spark.sparkContext.broadcast(formats)

    def make():
        f = given.value

        def batch(b):
            cols: dict = {c: [] for c in ("doc_id", "start", "stop", "format", "log_likelihood", "score", "hint")}
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for start, stop, label, log_p, s in f.scan(text or ""):
                    for c, v in zip(cols, (i, start, stop, label, log_p, s, text[start : start + 4])):
                        cols[c].append(v)
            yield cols

        return batch

    return map_columns(texts(docs), make, SCHEMA)
