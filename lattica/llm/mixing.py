"""Mixing documents to target weights by soft membership.

A classifier fitted on a labelled table gives every document posteriors over domains; a document
then adds its tokens to all domains in these shares.  Nonnegative rates (how often a document is
read) are fitted by projected-gradient least squares so that the domains' expected token totals
meet the targets.  An iteration is one small aggregate over (tokens, posteriors): the gap's gradient is
scaled by the curvature of the rates that can move, the step is added and rates go back into their
bounds.  The rates are never stored, they follow from the list of steps taken so far.

Only the classifier looks at a sample: at most ``per_domain`` labelled rows a domain (default
2,000), those with the smallest hash of their id.  Posteriors, totals and rates cover every row.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key

SHAPES = 8


@dataclass(frozen=True)
class DomainModel:
    domains: list[str]
    features: dict[str, int]
    weights: np.ndarray  # (features + 1) x domains, the last row is the intercept


def features_of(text: str) -> tuple[set[str], int]:
    """(lower-case words and a few marks of the text's shape, number of words)."""
    words = text.lower().split()
    found = {*words}
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    level = lambda x: int(SHAPES * min(max(x, 0.0), 1.0))
    shape = {
        f"\x1edistinct{level(len(found) / max(len(words), 1))}",
        f"\x1eupper{level(4 * ((raw >= 65) & (raw <= 90)).sum() / n)}",
        f"\x1emarks{level(4 * ((raw > 32) & (raw < 48)).sum() / n)}",
    }
    return found | shape, len(words)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    """Weighted multinomial logistic regression with a ridge, by Adam on the whole sample."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    target = np.eye(classes, dtype=x.dtype)[y]
    beta = np.zeros((x.shape[1], classes), x.dtype)
    m, v = np.zeros_like(beta), np.zeros_like(beta)
    for t in range(1, 401):
        grad = x.T @ (w[:, None] * (_softmax(x @ beta) - target)) / w.sum() + 1e-4 * beta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        beta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return beta


def fit_domains(docs: DataFrame, labelled: DataFrame, per_domain: int = 2000, features: int = 1000) -> DomainModel | None:
    """Fit on ``labelled`` (doc_id, domain) and the texts of ``docs``; None without a labelled text.

    Rows with a null id, domain or text take no part; of a document with several labels the
    alphabetically first counts, of an id with several texts the first in order.
    """
    labelled = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domain_of = {r["doc_id"]: d for d in sorted(share) for r in labelled.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain).collect()}
    if not domain_of:
        return None

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(features_of(t)[0]) for t in texts], dtype=object)

    texts = docs.where(F.col("doc_id").isin(sorted(domain_of)) & F.col("text").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text"))
    sample = texts.select("doc_id", words("text").alias("w"))
    sample = sample.join(F.broadcast(sample.sparkSession.createDataFrame([*domain_of.items()], "doc_id long, domain string")), "doc_id").persist()
    domains = sorted({r["domain"] for r in sample.select("domain").distinct().collect()})
    if not domains:
        return None
    total = sample.count()
    held = sample.select("domain", F.explode("w").alias("f"))
    by_word = held.groupBy("f").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)])
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    seen = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0))
    expect = [seen * sizes[d] / total for d in domains]
    chi = sum(((F.col(f"n{k}") - e) * (F.col(f"n{k}") - e) / e for k, e in enumerate(expect)), F.lit(0.0)) * total / (total - seen + 1)
    picked = by_word.where(seen >= 5).select("f", chi.alias("c")).orderBy(F.desc("c"), "f").limit(features).collect()
    index = {r["f"]: k for k, r in enumerate(picked)}
    rows = sample.select("domain", F.array_intersect("w", F.lit([*index])).alias("w")).collect()  # bounded: per_domain rows of at most `features` words
    sample.unpersist()
    x, y = np.zeros((len(rows), len(index)), np.float32), np.array([domains.index(r["domain"]) for r in rows])
    for i, r in enumerate(rows):
        x[i, [index[f] for f in r["w"]]] = 1
    w = np.array([share[domains[k]] / sizes[domains[k]] for k in y], np.float32)
    return DomainModel(domains, index, _fit(x, y, w, len(domains)).astype(np.float64))


def membership(text: str | Column, model: DomainModel) -> Column:
    """``tokens`` (words) and ``p`` (posterior of each domain) of each whole text; null texts are empty.

    An empty text has no tokens and the posteriors of no word at all; an empty table gives no rows.
    """
    known = model.features.keys()

    @F.pandas_udf("tokens long, p array<double>")
    def member(texts: pd.Series) -> pd.DataFrame:
        z, tokens = np.tile(model.weights[-1], (len(texts), 1)), []
        for i, t in enumerate(texts):
            found, n = features_of(t or "")
            tokens.append(n)
            z[i] += model.weights[[model.features[f] for f in known & found]].sum(axis=0)
        return pd.DataFrame({"tokens": np.array(tokens, np.int64), "p": list(_softmax(z)) if len(z) else []})

    return member(text)


def rate_after(steps: list[list[float]], p: str, low: str | Column = "", high: str | Column = "") -> Column:
    """A document's rate after ``steps``: from 1, each adds its product with the posteriors, never below ``low`` (default 0) or above ``high``."""
    at = lambda c, other: other if isinstance(c, str) and not c else F.col(c) if isinstance(c, str) else c
    low, high = at(low, F.lit(0.0)), at(high, F.lit(float("inf")))
    if not steps:
        return F.lit(1.0)
    dot = lambda s: F.aggregate(F.zip_with(F.col(p), s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(F.from_json(F.lit(str(steps)), "array<array<double>>"), F.lit(1.0), lambda r, s: F.least(F.greatest(r + dot(s), low), high))


def _totals(members: DataFrame, steps: list[list[float]], d: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(expected token totals of the domains, second moments of the rates above their lower bound and of all that can move): one aggregate."""
    r = rate_after(steps, "p", "low", "high")
    moves = F.when(F.col("low") < F.col("high"), F.col("tokens")).otherwise(0)
    weights = {"f": F.when(F.col("r") > F.col("low"), moves).otherwise(0), "a": moves}
    both = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col("tokens") * F.col("p")[i] * F.col("r")).alias(f"m{i}") for i in range(d)] + [F.sum(w * F.col("p")[i] * F.col("p")[j]).alias(f"{n}{i}_{j}") for n, w in weights.items() for i, j in both]
    got = members.select("tokens", "p", "low", "high", r.alias("r")).agg(*sums).first()
    grams = []
    for n in weights:
        gram = np.zeros((d, d))
        for i, j in both:
            gram[i, j] = gram[j, i] = got[f"{n}{i}_{j}"] or 0.0
        grams.append(gram + np.eye(d) * max(np.trace(gram), 1.0) * 1e-9)
    return np.array([got[f"m{i}"] or 0.0 for i in range(d)]), grams


def fit_rates(members: DataFrame, targets: np.ndarray, iterations: int = 60, tolerance: float = 0.01) -> tuple[list[list[float]], np.ndarray]:
    """(steps, expected totals) of projected gradient descent on ``sum_d ((total_d - target_d)^2 / scale_d)``.

    ``members`` has ``tokens``, ``p`` and the bounds ``low`` and ``high`` of a rate.  A step that does not lessen the loss is tried again with
    the curvature of all rates that can move, then shorter.  It ends when every total is within
    ``tolerance`` of its target, or when no step lessens the loss any more, which is warned of with the totals.
    """
    d, steps = len(targets), []
    now, grams = _totals(members, steps, d)
    scale = np.maximum(targets, max(targets.sum(), 1.0) * 1e-6)
    loss = lambda totals: float((((totals - targets) / scale) ** 2).sum())
    met, tries, k = lambda totals: bool((np.abs(totals - targets) <= tolerance * scale).all()), [(0, 1.0), (1, 1.0), (1, 0.25), (1, 0.05)], 0
    for _ in range(iterations):
        if met(now) or k == len(tries):
            break
        which, stride = tries[k]
        step = np.linalg.lstsq(grams[which] / scale[:, None], (targets - now) / scale, rcond=1e-3)[0]  # domains that the movable rates cannot tell apart share a step
        tried = [*steps, [float(x) for x in stride * step]]
        after, after_grams = _totals(members, tried, d)
        if loss(after) < loss(now) * (1 - 1e-6):
            steps, now, grams, k = tried, after, after_grams, 0
        else:
            k += 1
    if not met(now):
        warnings.warn(f"totals {now.round(1).tolist()} miss their targets {targets.round(1).tolist()}: no step of the rates within their bounds comes nearer", stacklevel=2)
    return steps, now


def domain_masses(members: DataFrame, d: int) -> np.ndarray:
    got = members.agg(*[F.sum(F.col("tokens") * F.col("p")[i]).alias(f"m{i}") for i in range(d)]).first()
    return np.array([got[f"m{i}"] or 0.0 for i in range(d)])


def targets_of(model: DomainModel, mass: np.ndarray, weights: dict[str, float], keep: str | None = None) -> np.ndarray:
    """Token totals in the shares ``weights`` (absent domains 0): of all tokens, or so that ``keep`` stays as large as it is."""
    w = np.array([weights.get(x, 0.0) for x in model.domains])
    w = w / w.sum() if w.sum() else np.full(len(w), 1 / len(w))
    at = model.domains.index(keep) if keep in model.domains else None
    return w * (mass[at] / w[at] if at is not None and w[at] else mass.sum())


def copies(rate: Column, *keys: str) -> Column:
    """Whole number of copies with mean ``rate``: the fraction is settled by a hash of the keys."""
    unit = F.shiftrightunsigned(F.xxhash64(row_key(*keys), F.lit("copies")), 11) / float(2**53)
    return F.floor(rate + unit).cast("int")


def mixed(docs: DataFrame, model: DomainModel | None, weights: dict[str, float], keep: str | None = None, id_col: str = "doc_id", thin: bool = False) -> DataFrame:
    """``docs`` (a written table with ``tokens`` and ``p``) plus ``rate`` and ``copies``, which replace columns of these names.

    With ``thin`` no rate exceeds 1, and documents whose largest posterior is that of ``keep`` have a rate of 1.
    Without a model every rate is 1.  Ties do not matter: equal rows get equal rates and copies.  An empty
    table gives no rows; documents without tokens have rates too, which no total depends on.
    """
    docs = docs.drop("rate", "copies")
    if model is None:
        return docs.withColumn("rate", F.lit(1.0)).withColumn("copies", F.lit(1))
    low, high = F.lit(0.0), F.lit(float("inf"))
    if thin:
        high = F.lit(1.0)
        if keep in model.domains:
            low = F.when(F.col("p")[model.domains.index(keep)] >= F.array_max("p"), 1.0).otherwise(0.0)
    members = docs.select("tokens", "p", low.alias("low"), high.alias("high"))
    steps, _ = fit_rates(members, targets_of(model, domain_masses(members, len(model.domains)), weights, keep))
    docs = docs.withColumn("rate", rate_after(steps, "p", low, high))
    return docs.withColumn("copies", copies(F.col("rate"), id_col))
