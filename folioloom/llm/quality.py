"""Quality rules: gradient-boosted trees over document statistics, scored as flat node arrays."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the labelled sample, smallest hash of the id first.
MAX_LABELLED = 20_000
KEEP_AT = 0.5
FOLDS, HELD_OUT = 4, 2
WINDOW = 5
SYMBOLS = "#*$%&|<>"
BREAKS = {c: " " for c in range(0x09, 0x0E)}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
#: Features and the direction in which the keep score may move with each (0: free).
FEATURES = {"words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": -1, "digit_share": 0, "mark_share": 0, "line_words": 0}
STATS = T.StructType([T.StructField(c, T.LongType()) for c in BASE + MORE])


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(BREAKS).split(" ") if w]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i : n + i] for i in range(window))))
    counts = Counter(grams)
    if len(counts) == n:
        return 0
    total, end = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + window - max(i, end)
            end = i + window
    return total


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = words_of(text)
    lines, seen, dup = text.split("\n"), set(), 0
    n_lines = 0
    for line in lines:
        if not line.translate(BREAKS).strip(" "):
            continue
        n_lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
    marks = sum(text.count(c) for c in "!?")
    upper = sum(len(w) for w in words if w.isupper())
    digits = sum(text.count(c) for c in "0123456789")
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words), n_lines, len(set(words)), upper, digits, marks)


@F.pandas_udf(STATS)
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=BASE + MORE, dtype="int64")


def features(s: pd.DataFrame) -> np.ndarray:
    x = {c: s[c].to_numpy(np.float64) for c in s}
    words, chars, lines = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1), np.maximum(x["n_lines"], 1)
    return np.column_stack([x["n_words"], x["word_chars"] / words, x["n_symbols"] / chars, x["n_dup_lines"] / lines, x["n_repeat_words"] / words, x["n_distinct"] / words, x["n_upper"] / chars, x["n_digits"] / chars, x["n_marks"] / chars, x["n_words"] / lines])


@dataclass(frozen=True)
class Trees:
    """All trees in one set of node arrays; roots has each tree's first node, a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> Trees:
    """Newton-boosted logistic trees on binned features.

    A split on a constrained feature is taken only if the children's values
    are in its direction, and their midpoint bounds all values below them, so
    that the whole sum is monotonic in that feature.  With no rows, or one
    class, the score is a constant.
    """
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 1.0 - 1e-6
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.empty(0) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]) if len(y) else np.empty((0, x.shape[1]), int)

    def node() -> int:
        for arr, v in ((feature, 0), (threshold, np.inf), (value, 0.0)):
            arr.append(v)
        left.append(len(left))
        right.append(len(right))
        return len(left) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, depth_left: int) -> int:
        me = node()
        gs, hs = g[rows].sum(), h[rows].sum()
        value[me] = rate * float(np.clip(-gs / (hs + l2), low, high))
        if not depth_left or len(rows) < 2 * least:
            return me
        best = (1e-6, None)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = binned[rows, j]
            size = len(cut) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, k, size))[:-1] for k in (g[rows], h[rows], None))
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
            ok = (nl >= least) & (len(rows) - nl >= least) & ((vr - vl) * directions[j] >= 0)
            k = int(np.argmax(np.where(ok, gain, -1)))
            if ok[k] and gain[k] > best[0]:
                best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        if best[1]:
            j, k, vl, vr = best[1]
            mid, d = (vl + vr) / 2, directions[j]
            inside = binned[rows, j] <= k
            feature[me], threshold[me] = j, float(cuts[j][k])
            left[me] = grow(rows[inside], g, h, mid if d < 0 else low, mid if d > 0 else high, depth_left - 1)
            right[me] = grow(rows[~inside], g, h, mid if d > 0 else low, mid if d < 0 else high, depth_left - 1)
        return me

    arrays = lambda: Trees(base, np.array(roots, int), np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(right, int), np.array(value, float), depth)
    if len(y) and 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            first = len(left)
            roots.append(first)
            grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, depth)
            t, at = arrays(), np.full(len(y), first)
            for _ in range(depth):
                at = np.where(x[np.arange(len(y)), t.feature[at]] <= t.threshold[at], t.left[at], t.right[at])
            total += t.value[at]
    return arrays()


def document_statistics(docs: DataFrame, text: str = "text", to: str = "stats") -> DataFrame:
    return docs.withColumn(to, _statistics(F.col(text)))


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees from a bounded sample of labelled rows outside the held-out fold; an id labelled twice has its lowest label."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where(held != HELD_OUT)
    chosen = marks.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    got = document_statistics(rows).select("doc_id", "quality", "stats.*").toPandas().sort_values(["doc_id", *BASE])
    return fit(features(got[BASE + MORE]), got["quality"].to_numpy(np.float64), list(FEATURES.values()))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five base counts, base_failed, kept and the trees' score of every row of ``docs``.

    kept is false where the base rules fail and otherwise says whether the
    trees' score reaches KEEP_AT.  A null text is an empty one (no words,
    base_failed); null ids are scored; repeated rows give repeated results;
    without labels the trees keep what passes the base rules.
    """
    trees = train(docs, labels)

    @F.pandas_udf(T.DoubleType())
    def score(s: pd.DataFrame) -> pd.Series:
        return pd.Series(trees.score(features(s)))

    out = document_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "stats")
    out = out.withColumn("score", score("stats")).select("doc_id", *[f"stats.{c}" for c in BASE], "score")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= KEEP_AT))
