"""Secret scans: format rules, and automata inferred from the credentials that the rules found.

Labelled credentials become sequences of character classes in a prefix tree that carries counts.
States whose continuations are statistically compatible (Hoeffding's bound, checked down the tree)
are merged, red and blue, into a probabilistic automaton for credentials; another is inferred from
the tokens that no rule found. Every other candidate token is scored by the two: the log likelihood
ratio of its format, and it becomes a span where that is large enough.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, replaced, utf8, without

# The rules of the base scan.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "format")

#: A token that may be a credential: a whole run over the alphabet of what is assigned, less the marks that end a sentence.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_ASSIGN)
_HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
#: The bound of the labelled sample: so many distinct credentials, and as many other tokens, those of the least hash, and so many characters of either.
SAMPLE, SAMPLE_CHARS = 4_000, 1 << 19
#: Of Hoeffding's bound, when two states are compared.
ALPHA = 0.05
#: Least log likelihood ratio, per character, of a span.
THRESHOLD = 0.5
#: Class sequences whose ratio a task remembers.
_REMEMBERED = 1 << 16
_END = "$"
_CLASS = {ord(c): "d" if c.isdigit() else ("h" if c in "abcdef" else "l" if c.islower() else "H" if c in "ABCDEF" else "L") for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules' matches, leftmost and non-overlapping for each kind, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]  # a run is maximal from its leftmost character
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def classes(token: str) -> str:
    """The class of each character: h for a-f, l for other small letters, H and L for capitals, d for digits, others themselves."""
    return token.translate(_CLASS)


def credentials(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The secret strings of base spans: of an assignment, what is assigned."""
    out = []
    for kind, a, b in spans:
        piece = text[a:b]
        out.append(ASSIGN.match(piece).group(2) if kind == "assign" else piece)
    return out


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens that may be credentials and overlap no base span."""
    out, starts = [], [a for _, a, _ in spans]
    ends = list(accumulate((b for _, _, b in spans), max))
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.start() + len(m.group().rstrip("."))
        before = bisect_left(starts, end)  # so many spans start before the token ends
        if end - start >= MIN_ASSIGN and not (before and ends[before - 1] > start):
            out.append((start, end))
    return out


class Automaton:
    """A probabilistic automaton by state merging; score() is the log likelihood of a class sequence."""

    def __init__(self, sequences: list[str], alpha: float = ALPHA):
        self.alpha = alpha
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for s in sequences:
            at = 0
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][c]
            self.count[at][_END] = self.count[at].get(_END, 0) + 1
        self.alphabet = len({c for row in self.count for c in row} | {_END}) + 1
        self._merge_all()
        # What score() adds up: the log likelihoods of each state's classes, and that of any other.
        totals = [sum(row.values()) + 0.5 * self.alphabet for row in self.count]
        self.logs = [{c: math.log((n + 0.5) / t) for c, n in row.items()} for row, t in zip(self.count, totals, strict=True)]
        self.rest = [math.log(0.5 / t) for t in totals]

    def _differ(self, a: int, b: int) -> bool:
        x, y = self.count[a], self.count[b]
        n, m = sum(x.values()), sum(y.values())
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > bound for c in {*x, *y})

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two states and those that the same classes lead to from both agree; b is the root of a tree."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b):
                return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to what is below a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_all(self) -> None:
        red, parent = [0], {}
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            a, c = blue.pop(0)
            b = self.next[a][c]
            if b in parent:
                continue
            into = next((r for r in red if self._compatible(r, b)), None)
            if into is None:
                red.append(b)
                parent[b] = True
                blue += [(b, x) for x in sorted(self.next[b])]
            else:
                self.next[a][c] = into
                before = {r: set(self.next[r]) for r in red}
                self._fold(into, b)
                blue += [(r, x) for r in red for x in sorted(set(self.next[r]) - before[r])]
        keep = {r: i for i, r in enumerate(red)}
        self.next, self.count = [{c: keep[t] for c, t in self.next[r].items() if t in keep} for r in red], [self.count[r] for r in red]

    def score(self, sequence: str) -> float:
        at, total, lost = 0, 0.0, -math.log(self.alphabet)
        for c in sequence + _END:
            if at is None:
                total += lost
            else:
                total += self.logs[at].get(c, self.rest[at])
                at = self.next[at].get(c)
        return total


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs less the text, with base (array of kind, start, end), tokens (its credentials) and others (candidates as start, end, token)."""
    docs = without(docs, *{"base", "tokens", "others"} - {text})
    fields = [f for f in docs.schema.fields if f.name != text]
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    other_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tokens, others = [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                t = value.as_py().decode("utf-8", "replace")
                spans = base_spans(t)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                tokens.append(credentials(t, spans))
                others.append([{"start": a, "end": b, "token": t[a:b]} for a, b in candidates(t, spans)])
            out = replaced(batch, base=pa.array(base, base_type), tokens=pa.array(tokens, pa.list_(pa.string())), others=pa.array(others, other_type))
            yield out.select([n for n in out.schema.names if n != text])

    from pyspark.sql.pandas.types import from_arrow_type

    schema = T.StructType([*fields, T.StructField("base", from_arrow_type(base_type)), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("others", from_arrow_type(other_type))])
    return docs.withColumn(text, utf8(text)).mapInArrow(scan, schema)


def _least(tokens: DataFrame, sample: int, chars: int = SAMPLE_CHARS) -> list[str]:
    """The distinct tokens of the least hash, whole ones, so many and so many characters at most: a bounded sample that doesn't depend on how rows are dealt."""
    tokens = tokens.where(F.length("token") >= MIN_ASSIGN).withColumn("h", F.xxhash64("token"))
    # Lengths come first: no more characters reach the driver than are drawn.
    chosen, left = [], chars
    for h, n in tokens.select("h", F.length("token").alias("n")).distinct().orderBy("h", "n").limit(sample).collect():
        if n <= left:
            chosen.append((h, n))
            left -= n
    if not chosen:
        return []
    drawn = tokens.sparkSession.createDataFrame(chosen, "h long, n int")
    found = tokens.withColumn("n", F.length("token")).join(F.broadcast(drawn), ["h", "n"], "left_semi").select("h", "token").distinct()
    return [r["token"] for r in found.orderBy("h", "token").collect()]


def scan_secrets(docs: DataFrame, text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs less the text, with base and spans: arrays of (kind, start, end) in code points, by start and then kind.

    spans are those of base and the candidates that the automata score as credentials (kind format).
    Candidates are all whole runs of MIN_ASSIGN characters and more over the alphabet of assigned
    credentials. The automata are inferred from at most sample distinct credentials and as many other
    tokens, whole ones, of SAMPLE_CHARS characters at most; if there are no credentials, nothing is
    added. Null and empty texts have no spans; very long texts are scanned whole; spans that start
    together stand in the order of their kinds; a ratio that ties with the threshold makes a span;
    repeated rows are kept; an empty table gives an empty one; input columns named as results are
    replaced.
    """
    found = cut(extract(without(docs, *{"spans"} - {text}), text), "tokens")
    secret = _least(found.select(F.explode("tokens").alias("token")), sample)
    plain = _least(found.select(F.explode("others.token").alias("token")), sample)
    good, other = Automaton([classes(x) for x in secret]), Automaton([classes(x) for x in plain])
    # The other tokens hold unlabelled credentials too: their automaton is mixed with one that knows no format.
    flat = -math.log(max(2, other.alphabet))

    def ratio(c: str) -> float:
        a, b = good.score(c), max(other.score(c) + math.log(0.5), flat * (len(c) + 1) + math.log(0.5))
        return (a - b) / (len(c) + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(_REMEMBERED)(ratio)
        # Long sequences hardly come again.
        told = lambda token: (known if len(token) <= 64 else ratio)(classes(token))
        for batch in batches:
            spans = []
            for base, others in zip(batch.column(batch.schema.get_field_index("base")).to_pylist(), batch.column(batch.schema.get_field_index("others")).to_pylist(), strict=True):
                more = [{"kind": "format", "start": o["start"], "end": o["end"]} for o in others if secret and told(o["token"]) >= threshold]
                spans.append(sorted(base + more, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield replaced(batch, spans=pa.array(spans, batch.column(batch.schema.get_field_index("base")).type))

    out = found.mapInArrow(score, T.StructType([*found.schema.fields, T.StructField("spans", found.schema["base"].dataType)]))
    return out.drop("tokens", "others")
