"""Quality classifier: document evidence shrunk into host and path posteriors by empirical Bayes.

A document classifier (logistic regression over word and shape features, fitted on a bounded sample
of labelled rows) gives every document its log odds of being good. Word counts of the sample are
summed on the executors; the driver gets the chosen words' bits and the shapes of each row, never a
text. Grouped aggregation over all documents sums, by host and by path, each document's label where
it has one and else its probability. A path's rate is shrunk towards its host's and a host's towards
the global one, by strengths that are themselves estimated from the spread of the rates; sparse sites
so keep near their prior. A document meets the rates of its site less what it gave to them itself, so
that no evidence counts twice: its log odds and its path's shift against the global prior add up to
the posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import by_keys, cut, packed, raw_texts, unpacked, utf8, without

#: The bound of the labelled sample: so many rows of each class, those of the least hash of doc_id.
SAMPLE = 3_000
#: Words that the classifier knows, those that tell classes apart best.
WORDS = 512
#: A word must stand in so many sampled documents of a class.
MIN_DOCS = 4
#: A site's shift of a document's log odds stays within so much: sites inform, they don't overrule a clear text.
SITE_LIMIT = 1.0
#: Least and most pseudo-counts of a prior.
_STRENGTH = (1.0, 1_000.0)
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_SHAPES = 10


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def shapes(text: bytes, found: list[bytes]) -> list[float]:
    """Of a text: shares of capitals, digits, marks and spaces, word length, repeated words and lines, length."""
    n = max(1, len(text))
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=128)
    upper, lower, digits, spaces = raw[65:91].sum(), raw[97:123].sum(), raw[48:58].sum(), raw[32] + raw[10] + raw[9] + raw[13]
    high = raw[128:].sum()
    marks = n - upper - lower - digits - spaces - high
    lines = text.split(b"\n")
    w = max(1, len(found))
    distinct = len(set(found)) / w
    return [upper / max(1, upper + lower + high), digits / n, marks / n, spaces / n, len(text) / 10 / max(10, 10 * w), 1 - distinct, 1 - len(set(lines)) / len(lines), np.log1p(len(text)) / 10, float(np.log1p(raw[33:48].max() + raw[58:65].max()) / 10), raw.max() / n]


@dataclass(frozen=True)
class Model:
    """Log odds of a class: bias + word weights over the distinct words + shape weights."""

    vocabulary: dict[bytes, int]
    word_weights: np.ndarray
    shape_weights: np.ndarray
    shape_mean: np.ndarray
    shape_scale: np.ndarray
    bias: float

    def log_odds(self, text: bytes) -> float:
        found = words(text)
        known = {self.vocabulary[w] for w in set(found) if w in self.vocabulary}
        s = (np.array(shapes(text, found)) - self.shape_mean) / self.shape_scale
        return float(self.bias + self.word_weights[sorted(known)].sum() + np.clip(s, -6, 6) @ self.shape_weights)


def _fit(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the bias, which isn't penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None].astype(x.dtype)).T.astype(float) @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, signs: dict[str, int], key: str, text: str, size: int) -> DataFrame:
    """(k, c0, c1 ..., t): at most size rows of each class of each label, chosen by a hash of the key before any text is read; c is null where a row isn't in that label's sample.

    A document with several labels has the least; of repeated keys the least text counts. The table
    is bounded by its rows and stays on the executors, whatever the texts' lengths.
    """
    chosen = None
    for n, (label, good) in enumerate(signs.items()):
        each = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("_class"))
        each = each.select(F.col(key).alias("k"), (F.col("_class") == good).cast("int").alias(f"c{n}"), F.xxhash64(key).alias("_h"))
        some = [each.where(F.col(f"c{n}") == c).orderBy("_h", "k").limit(size).drop("_h") for c in (0, 1)]
        some = some[0].unionByName(some[1])
        chosen = some if chosen is None else chosen.join(some, "k", "full")
    chosen = cut(chosen, "chosen")
    # The sample is bounded by a parameter: it may be broadcast.
    rows = docs.select(F.col(key).alias("k"), utf8(text).alias("t")).join(F.broadcast(chosen), "k")
    return cut(rows.groupBy("k", *[f"c{n}" for n in range(len(signs))]).agg(F.min("t").alias("t")), "sample")


def train(sample: DataFrame, label: str, n_words: int = WORDS, penalty: float = 1.0) -> Model | None:
    """A model of the sample's rows (t, label 0 or 1 or null); None if a class is missing."""
    rows = sample.where(F.col(label).isNotNull()).select("t", F.col(label).alias("c"))
    n = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = sorted(set(words(t.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([c] * len(found), pa.int32())], names=["w", "c"])

    counted = rows.mapInArrow(distinct, "w binary, c int").groupBy("w").agg(F.sum(1 - F.col("c")).alias("bad"), F.sum("c").alias("good")).where(F.greatest("bad", "good") >= MIN_DOCS)
    share = lambda c, k: (F.col(c) + 0.5) / (n[k] + 1)
    spread = lambda c, k: share(c, k) * (1 - share(c, k)) / n[k]
    # A word tells classes apart by the difference of its shares over their standard error.
    best = counted.withColumn("told", F.abs(share("bad", 0) - share("good", 1)) / F.sqrt(spread("bad", 0) + spread("good", 1)))
    vocabulary = {bytes(r["w"]): i for i, r in enumerate(best.orderBy(F.desc("told"), "w").limit(n_words).collect())}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, shaped = [], []
            for t in batch.column(0):
                text = t.as_py()
                found, row = words(text), np.zeros(len(vocabulary), dtype=bool)
                row[[vocabulary[w] for w in set(found) if w in vocabulary]] = True
                bits.append(np.packbits(row).tobytes())
                shaped.append([float(x) for x in shapes(text, found)])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bits, pa.binary()), pa.array(shaped, pa.list_(pa.float64()))], names=["c", "bits", "shapes"])

    kept = sorted(((int(r["c"]), bytes(r["bits"]), tuple(r["shapes"])) for r in rows.mapInArrow(features, "c int, bits binary, shapes array<double>").collect()))
    x = np.zeros((len(kept), len(vocabulary) + _SHAPES + 1), dtype=np.float32)
    x[:, -1] = 1
    for i, (_, bits, shaped) in enumerate(kept):
        x[i, : len(vocabulary)] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(vocabulary))
        x[i, len(vocabulary) : -1] = shaped
    part = np.array([r[2] for r in kept])
    mean, scale = part.mean(axis=0), part.std(axis=0) + 1e-3
    x[:, len(vocabulary) : -1] = np.clip((part - mean) / scale, -6, 6)
    w = _fit(x, np.array([r[0] for r in kept], dtype=float), penalty)
    return Model(vocabulary, w[: len(vocabulary)], w[len(vocabulary) : -1], mean, scale, float(w[-1]))


def score(docs: DataFrame, models: list[Model | None], text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs, without the text if it isn't kept, with evidence: the log odds that the text is good by every model; 0 without a model."""
    docs = without(docs, "evidence")
    shared = docs.sparkSession.sparkContext.broadcast([m for m in models if m])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            evidence = pa.array([min((m.log_odds(t) for m in known), default=0.0) for t in raw_texts(batch.column(1))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + keep_text], evidence], names=["row", "text", "evidence"] if keep_text else ["row", "evidence"])

    both = packed(docs, text)
    scored = both.mapInArrow(run, T.StructType([*both.schema.fields[: 1 + keep_text], T.StructField("evidence", T.DoubleType())]))
    return unpacked(scored, docs if keep_text else docs.drop(text), text, "evidence")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_rates(scored: DataFrame, host: str, path: str, p: Column) -> tuple[DataFrame, float, float, float]:
    """(_host, _path, _n, _good, _hn, _hgood) of every path: its documents and their sum of p, and its host's; the global rate; the strengths of the global prior over hosts and of a host's over its paths.

    The strength of a prior comes from the spread of the groups' rates about it, by moments: what is
    left of the variance between groups when that within them is taken off.
    """
    paths = scored.select(F.col(host).alias("_host"), F.col(path).alias("_path"), p.alias("_p")).groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum("_p").alias("_good"))
    paths = cut(paths, "paths")
    total = paths.agg(F.sum("_n").alias("n"), F.sum("_good").alias("good")).first()
    mean = min(max(total["good"] / total["n"], 1e-3), 1 - 1e-3) if total["n"] else 0.5
    hosts = paths.groupBy(F.col("_host").alias("_same")).agg(F.sum("_n").alias("_hn"), F.sum("_good").alias("_hgood"))
    sites = cut(paths.join(hosts, F.col("_host").eqNullSafe(F.col("_same"))).drop("_same"), "sites")

    def strength(groups: DataFrame, n: str, good: str, prior: Column) -> float:
        rate = F.col(good) / F.col(n)
        row = groups.agg((F.sum(F.col(n) * (rate - prior) * (rate - prior)) / F.sum(n)).alias("v"), F.avg(1 / F.col(n)).alias("i")).first()
        between = max((row["v"] or 0.0) - mean * (1 - mean) * (row["i"] or 0.0), 0.0)
        return float(np.clip(mean * (1 - mean) / between - 1 if between > 0 else _STRENGTH[1], *_STRENGTH))

    by_host = strength(hosts, "_hn", "_hgood", F.lit(mean))
    by_path = strength(sites, "_n", "_good", (F.col("_hgood") + by_host * mean) / (F.col("_hn") + by_host))
    return sites, mean, by_host, by_path


def posteriors(sites: DataFrame, mean: float, by_host: float, by_path: float, p: Column | None = None) -> tuple[Column, Column]:
    """The rates of a host and of a path, shrunk, less the document that gave p to them, if any."""
    own, one = (F.lit(0.0), 0) if p is None else (p, 1)
    host = (F.greatest(F.col("_hgood") - own, F.lit(0.0)) + by_host * mean) / (F.col("_hn") - one + by_host)
    return host, (F.greatest(F.col("_good") - own, F.lit(0.0)) + by_path * host) / (F.col("_n") - one + by_path)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", good: str = "quality", bad: str = "toxic", sample: int = SAMPLE, threshold: float = 0.5, site_limit: float = SITE_LIMIT, columns: list[str] | None = None) -> DataFrame:
    """docs (the columns named, else all) with evidence, host_rate, path_rate, p_good and keep.

    The labels give two models, of good quality and of not being toxic; a document's evidence is
    the lesser log odds. It is kept if p_good, with its site's shift, is at least the threshold; the
    shift stays within site_limit either way, however many documents a site has. In the sums of its
    host and path a labelled document counts as its labels say (bad if any is bad), the others by the
    probability of their evidence; each document's rates leave itself out.

    A label counts if it is 0 or 1; without labels of both classes a model says nothing, and all
    documents are kept. Of several labels of one key the least counts. Null texts count as empty;
    very long texts are scored whole and may be drawn into the sample, of which no text leaves the
    executors; null hosts and paths are sites of their own; repeated rows are kept, each with a
    verdict, and texts that tie get the same evidence; an empty table gives an empty one; input
    columns named as results are replaced, others may have any name. Each text is scored once: docs
    with their evidence are written to the shared folder and read again.
    """
    docs = without(docs, "evidence", "host_rate", "path_rate", "p_good", "keep")
    columns = list(docs.columns if columns is None else columns)
    drawn = _sample(docs, labels, {good: 1, bad: 0}, key, text, sample)
    models = [train(drawn, c) for c in ("c0", "c1")]
    narrow = [c for c in columns if c != text]
    carried = docs.select((F.struct(*narrow) if narrow else F.struct(F.lit(0).alias("none"))).alias("_row"), F.col(key).alias("_key"), F.col(host).alias("_h"), F.col(path).alias("_q"), F.col(text).alias("_text"))
    scored = cut(score(carried, models, "_text", text in columns), "evidence")
    least = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*[F.min(F.when(F.col(c).isin(0, 1), F.when(F.col(c) == g, 1).otherwise(0))).alias(f"_{n}") for n, (c, g) in enumerate(((good, 1), (bad, 0)))])
    least = cut(least.select("_key", F.least("_0", "_1").cast("double").alias("_label")).where(F.col("_label").isNotNull()), "labelled")
    scored = by_keys(scored, least, "_key", "left").withColumn("_p", F.coalesce("_label", 1 / (1 + F.exp(-F.col("evidence")))))
    sites, mean, by_host, by_path = site_rates(scored, "_h", "_q", F.col("_p"))
    near = by_keys(scored, sites, (F.col("_h").eqNullSafe(F.col("_host"))) & (F.col("_q").eqNullSafe(F.col("_path"))), "left")
    host_rate, path_rate = posteriors(sites, mean, by_host, by_path, F.col("_p"))
    own = [F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in columns]
    rated = near.select(F.struct(*own).alias("_row"), "evidence", host_rate.alias("host_rate"), path_rate.alias("path_rate"))
    shift = F.least(F.greatest(_logit(F.col("path_rate")) - float(np.log(mean / (1 - mean))), F.lit(-site_limit)), F.lit(site_limit))
    judged = rated.withColumn("p_good", 1 / (1 + F.exp(-(F.col("evidence") + shift))))
    return judged.select("_row.*", "evidence", "host_rate", "path_rate", "p_good", (F.col("p_good") >= threshold).alias("keep"))
