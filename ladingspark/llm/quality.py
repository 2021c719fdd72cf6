"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence comes from two logistic heads (low quality, toxic) over its shape and
over word evidence; both are fitted on a bounded sample of labelled rows. Then each site (host)
gets a posterior rate from all of its documents, shrunk toward the global rate, and each section
of a site (path) one that is shrunk toward the site's; the strength of shrinking is estimated
from the spread between sites. The document's evidence is combined with its section's rate.

Defined results: a null or empty text has the features of an empty one; host or path null is a
site or section of its own; repeated rows get equal results; labels that are null are not used;
without usable labels every document is kept with probability 0; an empty table gives no row.
Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, checkpointed, stored, text_of, words_in

#: Labelled rows the classifier is fitted on (those with the least hash of their id).
LABELLED_ROWS = 20_000
#: Words in a head's table of evidence, documents a word must be in, and the deviations it must lie off.
LEXICON, LEAST_DOCS, LEAST_Z = 5_000, 5, 4.0
#: Marks taken off the ends of a word before it is looked up.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS, SMALL, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
ODD = MARKS.translate(None, b".,")
HEADS = ("low", "toxic")
N_FEATURES = 14


@dataclass
class Classifier:
    words: dict[bytes, tuple[float, float]] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    prior: dict[str, float] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> dict[str, np.ndarray]:
        z = (x - self.mean) / self.scale
        return {h: np.clip(z @ w[1:] + w[0], -30, 30) for h, w in self.weights.items()}


def looked_up(words) -> set[bytes]:
    return {w.strip(MARKS) for w in words} - {b""}


def features(text: str, lexicon: dict[bytes, tuple[float, float]]) -> list[float]:
    """Shares of odd words and characters, repetition, and word evidence of the two heads."""
    data = text.encode()
    words = words_in(data)
    n, size, counts = max(1, len(words)), max(1, len(data)), Counter(words)
    capitals = size - len(data.translate(None, CAPITALS))
    letters = capitals + size - len(data.translate(None, SMALL)) or 1
    digits = (len(data) - len(data.translate(None, DIGITS))) / size
    other = (len(data) - len(data.translate(None, ODD))) / size
    marked = sum(c for w, c in counts.items() if len(w) > 2 and w[-1] == w[-2] and w[-1] in MARKS) / n
    bare = sum(c for w, c in counts.items() if not w.strip(MARKS)) / n
    again = sum(map(eq, words, words[1:])) / n
    common = max(counts.values(), default=0) / n
    kinds = looked_up(counts)
    found = [lexicon[w] for w in kinds & lexicon.keys()]
    evidence = [v for k in range(len(HEADS)) for v in (max(-12.0, min(12.0, sum(e[k] for e in found))), max([0.0, *(e[k] for e in found)]))]
    return [capitals / letters, marked, bare, again, math.sqrt(digits), math.sqrt(other), common, len(kinds) / n, math.log1p(len(words)), float(len(words) < 5), *evidence]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, intercept first, by Newton's method with a ridge on all but the intercept."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, pull = np.zeros(a.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + pull, a.T @ (y - p) - pull @ w)
        w += step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def word_evidence(counts: DataFrame, n_docs: int, n_bad: dict[str, int]) -> dict[bytes, tuple[float, float]]:
    """Shrunk log odds of the words whose documents are off a head's global rate; LEXICON a head at most."""
    out: dict[bytes, list[float]] = {}
    for k, head in enumerate(HEADS):
        rate = n_bad[head] / n_docs
        if not 0 < rate < 1:
            continue
        shrunk = (F.col(head) + rate) / (F.col("n") + 1.0)
        z = (F.col(head) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        found = counts.filter(F.col("n") >= LEAST_DOCS).select("word", (F.log(shrunk / (1 - shrunk)) - math.log(rate / (1 - rate))).alias("e"), z.alias("z"))
        for r in found.filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(LEXICON).collect():
            out.setdefault(bytes(r["word"]), [0.0] * len(HEADS))[k] = r["e"]
    return {w: tuple(e) for w, e in out.items()}


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> Classifier | None:
    """A classifier from at most `most` labelled documents; None if there is no label of either kind."""
    marks = labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("low"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marks = marks.groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # `most` rows of three numbers are broadcast; the texts stay in the cluster. Of repeated ids one text is kept.
    taken = checkpointed(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("low").alias("low"), F.min("toxic").alias("toxic")))
    total = taken.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).alias(h) for h in HEADS]).first()
    if not total["n"]:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, *marks_ in zip(*(batch.column(c).to_pylist() for c in ("text", *HEADS)), strict=True):
                for w in looked_up(words_in(text.encode())):
                    row = seen.setdefault(w, [0, 0, 0])
                    row[0] += 1
                    row[1] += marks_[0]
                    row[2] += marks_[1]
                if len(seen) > 300_000:
                    yield flushed(seen)
        yield flushed(seen)

    def flushed(seen: dict[bytes, list[int]]) -> pa.RecordBatch:
        cols = [pa.array(list(seen), pa.binary()), *[pa.array([r[k] for r in seen.values()], pa.int64()) for k in range(3)]]
        seen.clear()
        return pa.RecordBatch.from_arrays(cols, names=["word", "n", *HEADS])

    counts = taken.mapInArrow(count, "word binary, n bigint, low bigint, toxic bigint").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)])
    model = Classifier(words=word_evidence(counts, total["n"], {h: total[h] for h in HEADS}))
    rows = described(taken, model, ["low", "toxic"]).toArrow()  # most x (features + 2) numbers
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    for head in HEADS:
        y = rows.column(head).to_numpy().astype(np.float64)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        model.prior[head] = math.log(rate / (1 - rate))
        model.weights[head] = logistic((x - model.mean) / model.scale, y)
    return model


def described(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The columns `keep` and x, the features."""
    sent = docs.sparkSession.sparkContext.broadcast(model.words)
    given = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                x = [features(t, sent.value) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return given.mapInArrow(run, T.StructType([*(given.schema[c] for c in keep), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def scored(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The columns `keep` and, for each head, the log odds `<head>_logit` that the document alone gives."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                z = m.logits(np.array([features(t, m.words) for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(z[h]) for h in HEADS)], names=[*keep, *(f"{h}_logit" for h in HEADS)])

    return given.mapInArrow(run, T.StructType([*(given.schema[c] for c in keep), *(T.StructField(f"{h}_logit", T.DoubleType()) for h in HEADS)]))


def strength(mean: float, spread: float, n: float) -> float:
    """Prior rows of a beta with this mean whose sites' rates spread so much, by moments; between 10 and 10,000."""
    between = max(spread - mean * (1 - mean) / max(n, 1.0), 1e-9)
    return float(min(10_000.0, max(10.0, mean * (1 - mean) / between - 1)))


def posteriors(evidence: DataFrame) -> DataFrame:
    """_host, _path, and for each head <head>_host_rate and <head>_path_rate; evidence: host, path, <head>_logit.

    Sums are taken by section first, then by site; only sums over all sites come to the driver.
    """
    p = lambda h: F.sum(1 / (1 + F.exp(-F.col(f"{h}_logit")))).alias(h)
    sections = checkpointed(evidence.groupBy("host", "path").agg(*map(p, HEADS), F.count("*").alias("n")))
    sites = checkpointed(sections.groupBy(F.col("host").alias("_h")).agg(*[F.sum(h).alias(f"{h}_sum") for h in HEADS], F.sum("n").alias("_n")))
    whole = sites.agg(*[F.sum(f"{h}_sum").alias(f"{h}_s") for h in HEADS], *[F.var_pop(F.col(f"{h}_sum") / F.col("_n")).alias(f"{h}_v") for h in HEADS], F.sum("_n").alias("n"), F.avg("_n").alias("each")).first()
    for h in HEADS:
        mean = min(1 - 1e-6, max(1e-6, whole[f"{h}_s"] / whole["n"])) if whole["n"] else 0.5
        k = strength(mean, whole[f"{h}_v"] or 0.0, whole["each"] or 1.0)
        sites = sites.withColumn(f"{h}_host_rate", (F.col(f"{h}_sum") + k * mean) / (F.col("_n") + k))
    both = checkpointed(beside(sections, checkpointed(sites), [("host", "_h")], ["path"]))
    inner = both.agg(*[F.avg(F.pow(F.col(h) / F.col("n") - F.col(f"{h}_host_rate"), 2)).alias(f"{h}_v") for h in HEADS], *[F.avg(f"{h}_host_rate").alias(f"{h}_m") for h in HEADS], F.avg("n").alias("each")).first()
    for h in HEADS:
        k = strength(inner[f"{h}_m"] or 0.5, inner[f"{h}_v"] or 0.0, inner["each"] or 1.0)
        both = both.withColumn(f"{h}_path_rate", (F.col(h) + k * F.col(f"{h}_host_rate")) / (F.col("n") + k))
    return checkpointed(both.select(F.col("host").alias("_host"), F.col("path").alias("_path"), *[f"{h}_{level}_rate" for h in HEADS for level in ("host", "path")]))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, most_labelled: int = LABELLED_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """row (struct of doc_id and the columns in `keep`), host, path, and for each head p_, host and path rate; rejected.

    A document's log odds are its own evidence (its logit less the prior it was fitted with) plus
    the log odds of its section's posterior rate. It is rejected if the chance that it is low or
    toxic exceeds the threshold. What the documents alone give is worked out once and stored beside `row`.
    """
    model = fit(docs, labels, most_labelled)
    named = docs.select(F.struct("doc_id", *[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), text_of().alias("text"))
    columns = [c for h in HEADS for c in (f"p_{h}", f"{h}_host_rate", f"{h}_path_rate")]
    if model is None:
        return named.select("row", "host", "path", *[F.lit(0.0).alias(c) for c in columns], F.lit(False).alias("rejected"))
    own = stored(scored(named, model, ["row", "host", "path"]))
    out = beside(own, posteriors(own.select("host", "path", *[f"{h}_logit" for h in HEADS])), [("host", "_host"), ("path", "_path")], ["row.doc_id"])
    for h in HEADS:
        rate = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(f"{h}_path_rate")))
        z = F.col(f"{h}_logit") - F.lit(model.prior[h]) + F.log(rate / (1 - rate))
        out = out.withColumn(f"p_{h}", 1 / (1 + F.exp(-z)))
    rejected = 1 - (1 - F.col("p_low")) * (1 - F.col("p_toxic")) > threshold
    return out.select("row", "host", "path", *columns, rejected.alias("rejected"))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    judged = classify(docs, labels, keep=tuple(c for c in docs.columns if c != "doc_id"), **options)
    return judged.filter(~F.col("rejected")).select(*[F.col(f"row.`{c}`") for c in docs.columns])
