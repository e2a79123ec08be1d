"""Toxicity by non-negative positive-unlabelled learning on hashed words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import batches_of, give_back

BUCKETS = 1 << 18
#: Bounds of the training sample: confirmed toxic rows and unlabelled texts, smallest hash of the id first.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 8000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Texts in a batch between Spark and Python.
BATCH = 1000
PREFIXES = (4, 5, 6)
LEVELS = (2, 3, 5)
#: Words whose buckets a worker remembers at most.
MAX_KNOWN = 150_000
#: Standard errors by which a bucket's share of positives must exceed its share of unlabelled texts.
CLEARLY = 4.0
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the text's distinct buckets)))."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def stems(word: str) -> list[int]:
    """Hashes of the beginnings that inflected and compound forms of a word share."""
    return [bucket(f"^{word[:k]}") for k in PREFIXES if len(word) >= k]


def at_level(stem: int, level: int) -> int:
    """Bucket for at least ``level`` different words with one beginning."""
    return (stem * 0x9E3779B1 + level * 0x85EBCA6B) >> 7 & (BUCKETS - 1)


def text_buckets(text: str | None) -> list[int]:
    """Buckets of a text's distinct words and of the beginnings that several of them share."""
    words = set(_WORD.findall((text or "").lower()))
    shared = Counter(j for w in words for j in stems(w))
    return sorted({bucket(w) for w in words} | {at_level(j, n) for j, m in shared.items() for n in LEVELS if m >= n})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    try:
        for texts in batches:
            yield texts.map(text_buckets)
    finally:
        give_back()


def _rows(samples: list) -> tuple[np.ndarray, np.ndarray]:
    """Active columns of all rows, and the row of each."""
    sizes = np.fromiter((len(x) for x in samples), np.int64, len(samples))
    return np.concatenate([np.asarray(x, np.int64) for x in samples]), np.repeat(np.arange(len(samples)), sizes)


def fit(positive: list[list[int]], unlabelled: list[list[int]], prior: float, steps: int = 150, rate: float = 0.1, l1: float = 1e-3, support: int = 3) -> Model:
    """Linear model that minimises the non-negative PU risk with the logistic loss.

    risk = prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]); while the
    second term is negative it counts as zero and has no gradient, so that the
    model does not gain by calling every unlabelled text clean.  Only buckets
    that at least ``support`` positives have, clearly oftener than unlabelled
    texts, get weights.  Without positives, or
    with a prior of zero, every score is near zero.
    """
    if not positive or not unlabelled or prior <= 0:
        return Model(-20.0, np.empty(0, np.int64), np.empty(0))
    pc, pr = _rows(positive)
    uc, ur = _rows(unlabelled)
    seen = np.bincount(pc, minlength=BUCKETS)
    share, among = seen / len(positive), np.bincount(uc, minlength=BUCKETS) / len(unlabelled)
    noise = np.sqrt((among + 1 / len(unlabelled)) * (1 / len(positive) + 1 / len(unlabelled)))
    kept = np.nonzero((seen >= min(support, max(1, len(positive) // 4))) & (share - among > CLEARLY * noise))[0]
    place = np.full(BUCKETS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    pr, pc = pr[place[pc] >= 0], place[pc][place[pc] >= 0]
    ur, uc = ur[place[uc] >= 0], place[uc][place[uc] >= 0]
    n_p, n_u, l2 = len(positive), len(unlabelled), 1e-3 + 0.1 / len(positive)
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - min(prior, 0.99))))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        fp = b + np.bincount(pr, w[pc], n_p)
        fu = b + np.bincount(ur, w[uc], n_u)
        sp, su = sigmoid(fp), sigmoid(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp_pos, g_neg_p, g_neg_u = prior * (sp - 1) / n_p, -prior * sp / n_p, su / n_u
        gp, gu = (gp_pos + g_neg_p, g_neg_u) if negative >= 0 else (gp_pos, 0 * g_neg_u)
        g = np.bincount(pc, gp[pr], len(w)) + np.bincount(uc, gu[ur], len(w)) + l2 * w
        gb = float(gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        w = w - step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1)
        b -= rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-4)
    on = np.abs(w) > 1e-3
    return Model(float(b), kept[on], w[on])


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    known: dict[str, tuple[int, list[int]]] = {}
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        if len(known) > MAX_KNOWN:
            known.clear()
        hit, shared = set(), []
        for word in set(_WORD.findall((text or "").lower())):
            found = known.get(word)
            if found is None:  # most words have no weight
                j, roots = bucket(word), [x for x in stems(word) if any(at_level(x, n) in weight for n in LEVELS)]
                known[word] = found = (j if j in weight else -1, roots) if j in weight or roots else ()
            if found:
                hit.add(found[0])
                shared += found[1]
        hit.update(at_level(j, n) for j, m in Counter(shared).items() for n in LEVELS if m >= n)
        out[i] = model.bias + sum(weight.get(j, 0.0) for j in sorted(hit))
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model:
    """Model from the labels outside the held-out fold and a bounded sample of texts.

    The class prior is the share of toxic rows among all labelled ids outside
    that fold.  Ids are drawn from the narrow tables first; at most
    MAX_POSITIVE + MAX_UNLABELLED of them are broadcast to fetch the texts, and
    only hashed word sets reach the driver.  An id labelled twice is toxic if
    any of its labels says so; rows with null ids or labels are not used.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(fold() != HELD_OUT)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    n, n_toxic = marks.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = texts.select("doc_id").where("doc_id is not null").where(fold() != HELD_OUT)
    chosen_p = marks.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_POSITIVE).select("doc_id", F.lit(True).alias("positive"))
    chosen_u = ids.orderBy(order, "doc_id").limit(MAX_UNLABELLED).distinct().select("doc_id", F.lit(False).alias("positive"))
    chosen = F.broadcast(chosen_p.unionByName(chosen_u))
    got = batches_of(texts, BATCH).join(chosen, "doc_id").select("positive", "doc_id", _buckets("text").alias("x")).toArrow()
    marked, sets = got["positive"].to_numpy(), got["x"].combine_chunks()
    edges, values = (sets.offsets.to_numpy(), sets.values.to_numpy()) if len(sets) else (np.zeros(1, int), np.empty(0, int))
    order = np.lexsort((np.diff(edges), got["doc_id"].to_numpy()))
    rows = lambda wanted: [values[edges[i] : edges[i + 1]] for i in order if marked[i] == wanted]
    model = fit(rows(True), rows(False), (n_toxic or 0) / n if n else 0.0)
    del got, sets, edges, values
    give_back()
    return model


def toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1]; null and empty texts get the model's base score.

    Repeated rows get equal scores, an empty table none.  A column named like
    ``score`` is replaced: callers pass a name that is free (``stage.fresh``).
    """

    @F.pandas_udf(T.DoubleType())
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series(scores(list(texts), model))
        finally:
            give_back()

    return batches_of(docs, BATCH).withColumn(score, udf(F.col(text)))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts count as empty; a null doc_id is scored and never held out;
    repeated rows are scored alike.  Without labels every score is near zero.
    Further columns of either table are not read.
    """
    out = toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), train(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
