"""Secret scans: base patterns, and probabilistic automata inferred from credentials.

Grammar inference: labelled credentials, as sequences of character classes,
form a prefix tree with counts; states whose continuations agree within a
Hoeffding bound are merged, red and blue states in turn, into a deterministic
automaton. A second automaton comes from ordinary tokens. A candidate token is
a secret if its likelihood per character under the first exceeds that under
the second by a threshold set on labelled tokens that neither has seen.

Labels: base matches in a bounded sample of the table and generated
credentials of public token formats, against ordinary tokens of the sample and
generated look-alikes. The scan is one narrow stage over whole texts.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlex.llm.rowflags import row_key

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Further candidates: runs of so many characters that hold a letter and a digit.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Rows sampled by hash for labels, and generated credentials of each format.
SAMPLE_ROWS, LONGEST, PER_FORMAT = 2000, 20_000, 120
ALPHA = 0.05
LEAST_PRECISION = 0.99
START = 0
#: Characters of a training string that go into the prefix tree; a longer one goes on without an end there.
DEPTH = 48
#: Training strings of an automaton at most; more are cut in the order of a seeded shuffle.
MOST_STRINGS = 6000


def _class(c: str) -> str:
    """Character class: digit, hexadecimal or other letter of each case, or the sign itself."""
    if c.isdigit():
        return "0"
    if c.islower():
        return "a" if c <= "f" else "g"
    if c.isupper():
        return "A" if c <= "F" else "G"
    return c


def classes(token: str) -> str:
    return "".join(map(_class, token))


class Automaton:
    """A deterministic automaton with counts, merged from a prefix tree (red-blue order, Hoeffding test).

    Fitting is bounded by ``DEPTH`` characters of a string; what is scored is taken whole.
    """

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.out: list[dict[str, int]] = [defaultdict(int)]
        self.ends, self.seen = [0], [0]
        for s in samples:
            state = START
            self.seen[state] += 1
            for c in s[:DEPTH]:
                self.out[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.out.append(defaultdict(int))
                    self.ends.append(0)
                    self.seen.append(0)
                state = self.next[state][c]
                self.seen[state] += 1
            self.ends[state] += len(s) <= DEPTH
        self._infer(math.sqrt(0.5 * math.log(2 / alpha)))
        self.symbols = len({c for o in self.out for c in o}) + 1
        self.totals: dict[str, int] = defaultdict(int)
        for o in self.out:
            for c, k in o.items():
                self.totals[c] += k
        self.all = sum(self.totals.values()) + 1

    def _differ(self, a: int, b: int, bound: float) -> bool:
        """Whether the two states' own continuations differ by more than chance."""
        na, nb = self.seen[a], self.seen[b]
        limit = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        if abs(self.ends[a] / na - self.ends[b] / nb) > limit:
            return True
        return any(abs(self.out[a].get(c, 0) / na - self.out[b].get(c, 0) / nb) > limit for c in {*self.out[a], *self.out[b]})

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            if self._differ(x, y, bound):
                return False
            stack += [(self.next[x][c], self.next[y][c]) for c in self.next[x].keys() & self.next[y].keys()]
        return True

    def _merge(self, a: int, b: int) -> None:
        """Fold the tree below b into a."""
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            self.seen[x] += self.seen[y]
            self.ends[x] += self.ends[y]
            for c, k in self.out[y].items():
                self.out[x][c] += k
            for c, to in self.next[y].items():
                if c in self.next[x]:
                    stack.append((self.next[x][c], to))
                else:
                    self.next[x][c] = to

    def _infer(self, bound: float) -> None:
        red = [START]
        while True:
            known = set(red)
            blue = sorted({(to, r, c) for r in red for c, to in self.next[r].items() if to not in known}, key=lambda x: (-self.seen[x[0]], x[0]))
            if not blue:
                break
            b, parent, c = blue[0]
            for r in red:
                if self._compatible(r, b, bound):
                    self.next[parent][c] = r
                    self._merge(r, b)
                    break
            else:
                red.append(b)

    def log_likelihood(self, s: str) -> float:
        """Mean log-likelihood per symbol of the whole string; unseen continuations fall back on the symbols' frequencies."""
        state, total = START, 0.0
        for c in s:
            base = (self.totals.get(c, 0) + 0.5) / (self.all + 0.5 * self.symbols)
            if state is None:
                total += math.log(base)
                continue
            n = self.seen[state]
            total += math.log((self.out[state].get(c, 0) + 2 * base) / (n + 2))
            state = self.next[state].get(c)
        return total / max(1, len(s))


class Model:
    def __init__(self, secret: Automaton, plain: Automaton, threshold: float):
        self.secret, self.plain, self.threshold = secret, plain, threshold

    def score(self, token: str) -> float:
        s = classes(token)
        return self.secret.log_likelihood(s) - self.plain.log_likelihood(s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def _clear_of(spans: list[tuple[int, int, int]]):
    """Whether a span overlaps none of the sorted ``spans``: none that begins before its end reaches beyond its start."""
    starts = [a for a, _, _ in spans]
    reach = list(accumulate((b for _, _, b in spans), max))

    def clear(a: int, b: int) -> bool:
        before = bisect_left(starts, b)
        return not before or reach[before - 1] <= a

    return clear


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """Candidates that the automata call secrets and that overlap no base span."""
    out, clear = [], _clear_of(base)
    for m in CANDIDATE.finditer(text):
        if _mixed(m[0]) and clear(m.start(), m.end()) and model.score(m[0]) >= model.threshold:
            out.append((m.start(), 3, m.end()))
    return out


def _generated(r: random.Random) -> tuple[list[str], list[str]]:
    """Credentials of public token formats, and look-alikes that are none."""
    up, low, dig = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    good, bad = [], []
    for _ in range(PER_FORMAT):
        good += ["ghp_" + of(up + low + dig, 36), "sk_live_" + of(up + low + dig, 24), "xoxb-" + of(dig, 12) + "-" + of(up + low + dig, 24), "AIza" + of(up + low + dig + "_-", 35), of(up + low + dig + "+/", 40), "glpat-" + of(up + low + dig + "_-", 20), "eyJ" + of(up + low + dig, 33), of("0123456789ABCDEF", 32)]
        word = lambda: of(low, r.randrange(3, 11))
        bad += ["-".join(word() for _ in range(4)) + "-" + of(dig, 2), "/".join([word(), of(dig, 4), of(dig, 2), word()]), word() + word() + of(dig, r.randrange(1, 4)), "_".join([word(), word(), word(), of(dig, 1)]), of(dig, 4) + "-" + of(dig, 2) + "-" + of(dig, 2) + "_" + word() + word(), word().title() + word().title() + word().title() + of(dig, 1), of(dig, r.randrange(16, 22)), "=" * 12 + word() + of(dig, 2), word() + "-" + of(dig, 4) + "-" + of(dig, 4) + "-" + of(dig, 4)]
    return good, bad


def train(docs: DataFrame, seed: int = 23) -> Model:
    """Automata from generated tokens and from base matches and plain tokens of a sample of the rows.

    The sample is bounded: ``SAMPLE_ROWS`` rows in the order of a hash, of ``LONGEST`` characters at most each;
    repeated rows count once. An automaton is fitted on ``MOST_STRINGS`` strings at most.
    """
    r = random.Random(seed)
    good, bad = _generated(r)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text").between(1, LONGEST))
    # a share that gives somewhat more rows than wanted, cut on the driver: what a task sends doesn't add up with their number
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, own.count()))
    unit = F.pmod(F.xxhash64(row_key(), F.lit(seed)), F.lit(1 << 30))
    rows = own.withColumn("unit", unit).where(F.col("unit") < share * (1 << 30)).dropDuplicates(["unit"]).collect()
    rows = sorted(rows, key=lambda x: (x["unit"], x["text"]))[:SAMPLE_ROWS]
    for row in rows:
        base = base_spans(row["text"])
        for a, kind, b in base:
            value = row["text"][a:b]
            good.append(ASSIGN.match(value)[2] if kind == 0 else value)
        clear = _clear_of(base)
        for m in CANDIDATE.finditer(row["text"]):
            if clear(m.start(), m.end()):
                bad.append(m[0])
    r.shuffle(good)
    r.shuffle(bad)
    held_good, held_bad = good[::4], bad[::4]
    secret = Automaton([classes(x) for i, x in enumerate(good) if i % 4][:MOST_STRINGS])
    plain = Automaton([classes(x) for i, x in enumerate(bad) if i % 4][:MOST_STRINGS])
    model = Model(secret, plain, math.inf)
    scored = sorted([(model.score(x), 1) for x in held_good if _mixed(x)] + [(model.score(x), 0) for x in held_bad if _mixed(x)], reverse=True)
    hit = 0
    for n, (s, ok) in enumerate(scored, 1):
        hit += ok
        if hit >= LEAST_PRECISION * n and s > 0:
            model.threshold = s
    return model


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each document: ``doc_id``, numbers of base spans, their digest, all spans, and added ones' number.

    Null and empty texts have no spans; texts and tokens of any length are scanned and scored whole. Positions
    are code points, ends exclusive. A null ``doc_id`` stays null. Repeated rows are judged each by itself;
    other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # states of at most 12,000 bounded samples

    def run(batches):
        m = shared.value
        for batch in batches:
            cols = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_added": []}
            for text in batch.column(1):
                t = text.as_py() or ""
                base = base_spans(t)
                added = added_spans(t, base, m)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    cols[name].append(sum(s[1] == k for s in base))
                cols["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols["spans"].append(_joined(sorted(base + added)))
                cols["n_added"].append(len(added))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols.values(), types, strict=True)]], names=["doc_id", *cols])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
