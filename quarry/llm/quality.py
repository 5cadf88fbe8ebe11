"""Quality classifier by hierarchical empirical Bayes.

1. *Document evidence.*  A logistic regression over text features, fitted on
   at most ``MAX_LABELLED`` labelled documents (a documented bound; they are
   chosen by hash of the id, so the choice does not depend on row order),
   gives every document a log Bayes factor.
2. *Sites.*  Grouped sums of the documents' probabilities per (host, path)
   roll up to hosts and to the whole corpus.  A host's rate is shrunk toward
   the corpus rate and a path's toward its host's, with strengths estimated
   from the corpus itself (within-site over between-site variance), so a
   sparse site stays near its parent.
3. *Posterior.*  log-odds = evidence + log-odds of the document's path rate,
   taken without the document's own vote.  Documents under ``THRESHOLD``
   are rejected.

Sites are aggregated map-side; nothing per document reaches the driver
except the bounded training sample.  The site table is joined back by
broadcast only up to ``BROADCAST_SITES`` measured rows.

Edge cases: a null text is an empty one; null hosts and paths are sites of
their own; a label that is null or whose document is missing is ignored, as
are repeated labels; with fewer than two classes labelled there is no
evidence (0) and every document is kept; an empty table gives an empty
result; a site of one document gets its parent's rate; texts of any length
are read whole; a posterior equal to the threshold keeps the document; rows
are carried in a struct, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import find_words, prepare_python, stage_table

MAX_LABELLED = 20_000
BROADCAST_SITES = 200_000
THRESHOLD = 0.5
RIDGE = 1.0
MAX_EVIDENCE = 12.0
MAX_STRENGTH = 1e6

FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "distinct", "top_word", "adjacent", "repeat_lines")
_SYMBOLS = "#*$%&|<>@^~{}[]=+_\\/"
_MARKS = ".,;:!?"


def features(text: str | None) -> list[float]:
    """Bounded features of one text."""
    t = text or ""
    words = find_words(t)
    n, chars = len(words), len(t)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = [x for x in t.split("\n") if x.strip()]
    letters = sum(map(len, words))
    upper = chars - len(t.translate(_NO_UPPER)) if t.isascii() else sum(map(str.isupper, t))
    share = lambda charset: min(2.0, sum(map(t.count, charset)) / n)
    return [
        math.log1p(n), min(30.0, letters / n), share(_SYMBOLS), upper / letters, share("0123456789"), share(_MARKS),
        len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines),
    ]


_NO_UPPER = {c: None for c in range(ord("A"), ord("Z") + 1)}


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


class Model:
    """Standardised logistic regression; ``evidence`` is the log Bayes
    factor of good against bad (log-odds less the training log-odds)."""

    def __init__(self, mean, scale, weights, bias, prior):
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def evidence(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias - self.prior
        return np.clip(z, -MAX_EVIDENCE, MAX_EVIDENCE)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> Model | None:
    """Ridge logistic regression by Newton steps; None without two classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.append(np.full(a.shape[1] - 1, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T * (p * (1 - p)) @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    rate = y.mean()
    return Model(mean, scale, w[:-1], w[-1], math.log(rate / (1 - rate)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fit on at most ``max_labelled`` labelled documents."""
    picked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
              .groupBy("doc_id").agg(F.max(label).alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    picked = F.broadcast(picked.select(F.col("doc_id").alias("__id"), F.col("y").cast("int").alias("__y")))

    @F.arrow_udf("array<double>")
    def vector(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    # One text per picked id, so that repeated rows cannot outgrow the bound.
    sample = (docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("__id"))
              .groupBy("__id", "__y").agg(F.min("text").alias("text")).select("__y", vector("text").alias("x")))
    got = sample.toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("__y").to_pylist(), np.float64))


def evidence(text: Column, model: Model | None) -> Column:
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.evidence(feature_matrix(texts.to_pylist())))

    return score(text)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, n: str, s: str, parent: Column) -> tuple[Column, Column]:
    """Sums for the strength of shrinkage toward ``parent``: between-site
    sum of squares and the effective number of observations."""
    rate = F.col(s) / F.col(n)
    return F.sum(F.col(n) * (rate - parent) ** 2), F.sum(F.col(n).cast("double") ** 2)


def _shrinkage(total: float, squares: float, n_sites: int, between: float, within: float) -> float:
    """Documents' worth of the parent's rate: within over between variance
    (method of moments); no detectable spread means full shrinkage."""
    denominator = total - squares / total if total else 0.0
    spread = (between - (n_sites - 1) * within) / denominator if denominator > 0 else 0.0
    return min(MAX_STRENGTH, within / spread) if spread > 0 and within > 0 else (1.0 if within == 0 and spread > 0 else MAX_STRENGTH)


def site_rates(scored: DataFrame) -> DataFrame:
    """(host, path) -> ``n, s`` (documents, summed probability) and ``up``,
    ``strength``: the parent's rate and its weight.  ``scored`` has host,
    path and p."""
    paths = stage_table(scored.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    hosts = stage_table(hosts, "hosts")
    t = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("paths"),
                  F.sum(F.col("s2") - F.col("s") ** 2 / F.col("n")).alias("inner")).first()
    total, rate = float(t["n"] or 0), (t["s"] / t["n"] if t["n"] else 0.5)
    within = max(0.0, (t["inner"] or 0.0) / max(1.0, total - (t["paths"] or 0)))
    between, squares = _strength(hosts, "hn", "hs", F.lit(rate))
    h = hosts.agg(between.alias("b"), squares.alias("q"), F.count("*").alias("k")).first()
    host_strength = _shrinkage(total, h["q"] or 0.0, h["k"], h["b"] or 0.0, within)
    hosts = hosts.select(F.col("host").alias("__h"), "hn", "hs",
                         ((F.col("hs") + host_strength * rate) / (F.col("hn") + host_strength)).alias("up"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("__h")))
    joined = stage_table(joined.select("host", "path", "n", "s", "up"), "site-parents")
    between, squares = _strength(joined, "n", "s", F.col("up"))
    p = joined.agg(between.alias("b"), squares.alias("q"), F.count("*").alias("k")).first()
    path_strength = _shrinkage(total, p["q"] or 0.0, p["k"], p["b"] or 0.0, within)
    return joined.withColumn("strength", F.lit(path_strength))


def posteriors(scored: DataFrame) -> DataFrame:
    """``scored`` (host, path, evidence, p, ...) with ``site_rate`` and
    ``posterior``."""
    sites = site_rates(scored)
    right = sites.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("n").alias("__n"), F.col("s").alias("__s"),
                         F.col("up").alias("__up"), F.col("strength").alias("__k"))
    if sites.count() <= BROADCAST_SITES:
        right = F.broadcast(right)
    out = scored.join(right, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")), "left")
    others = F.col("__s") - F.col("p") + F.col("__k") * F.col("__up")
    rate = others / (F.col("__n") - 1 + F.col("__k"))
    out = out.withColumn("site_rate", rate)
    odds = F.col("evidence") + _logit(F.col("site_rate"))
    return out.withColumn("posterior", 1 / (1 + F.exp(-odds))).drop("__host", "__path", "__n", "__s", "__up", "__k")


def _scored(docs: DataFrame, labels: DataFrame, host: str, path: str, columns: list[Column], max_labelled: int) -> DataFrame:
    prepare_python(docs.sparkSession)
    model = train(docs, labels, max_labelled=max_labelled)
    rate = 0.5 if model is None else 1 / (1 + math.exp(-model.prior))
    scored = docs.select(*columns, F.col(host).alias("host"), F.col(path).alias("path"), evidence(F.col("text"), model).alias("evidence"))
    return stage_table(scored.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + math.log(rate / (1 - rate)))))), "quality")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
             max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, host, path, evidence, site_rate, posterior, kept``."""
    out = posteriors(_scored(docs, labels, host, path, [F.col("doc_id")], max_labelled))
    return out.select("doc_id", "host", "path", "evidence", "site_rate", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
              max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rejected documents."""
    out = posteriors(_scored(docs, labels, host, path, [F.struct("*").alias("__doc")], max_labelled))
    return out.where(F.col("posterior") >= threshold).select("__doc.*")
