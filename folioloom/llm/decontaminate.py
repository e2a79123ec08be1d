"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is a set of word shingles of which a document must hold a share of
CONTAINMENT or more.  Items are partitioned by size; a partition's sketch length k
follows from its largest size q: of an item's k = floor((1 - t) * q) + 1 smallest
shingle hashes at least one must be in any document with the share t.  So the
candidates are those with a sketch hash among their own shingles, whatever
the document's length, and none is missed; each is then verified on the
shingles themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import batches_of, give_back

SHINGLE, CONTAINMENT = 5, 0.8
#: Texts in a batch between Spark and Python.
BATCH = 1000
#: Largest test set, in characters, that is sent to all executors; a larger one is joined by shuffles.
MAX_BROADCAST_CHARS = 32_000_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
FOUND_FIELDS = ["item_id", "n_shared", "n_item"]
FOUND = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in FOUND_FIELDS]))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], size: int) -> list[str]:
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def item_shingles(text: str | None) -> tuple[int, set[str]]:
    """Words per shingle (fewer than SHINGLE only for shorter items) and the different shingles."""
    words = words_of(text)
    size = min(SHINGLE, len(words))
    return size, set(shingles(words, size)) if size else set()


class Hasher:
    """Shingle hashes from word hashes, vectorised; the word table is cleared when it grows large."""

    def __init__(self, bound: int = 100_000) -> None:
        self.known: dict[str, int] = {}
        self.bound = bound

    def words(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.known) > self.bound:
            self.known.clear()
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                known[w] = h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, np.uint64)

    def shingles(self, words: list[str], size: int) -> np.ndarray:
        if len(words) < size or not size:
            return np.empty(0, np.uint64)
        h = self.words(words)
        n = len(h) - size + 1
        total = np.full(n, size, np.uint64)
        for i in range(size):
            total = (total ^ h[i : i + n]) * _MIX
            total ^= total >> np.uint64(29)
        return total


def sketch_length(n_shingles: int, share: float = CONTAINMENT) -> int:
    """k of the size class (powers of two) of an item: enough for the largest item of the class."""
    top = (1 << n_shingles.bit_length()) - 1
    return min(n_shingles, int(np.floor((1 - share) * top + 1e-9)) + 1)


class Items:
    """Test items as sketches (sorted hashes with their items) and exact shingles."""

    def __init__(self, rows: list[tuple[int, str | None]], share: float = CONTAINMENT) -> None:
        self.share, self.exact = share, {}
        hasher, by_size = Hasher(), {}
        for at, (item, text) in enumerate(rows):
            size, found = item_shingles(text)
            if not found:
                continue
            self.exact[at] = (item, size, found)
            h = np.unique(hasher.shingles(words_of(text), size))
            k = sketch_length(len(found), share)
            by_size.setdefault(size, []).extend((int(x), at) for x in h[:k])
        self.sketches = {}
        for size, pairs in by_size.items():
            pairs.sort()
            self.sketches[size] = (np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64))

    def found_in(self, text: str | None, hasher: Hasher) -> list[tuple[int, int, int]]:
        """(item_id, shared, shingles of the item) of all items that the text contains to the share."""
        words = words_of(text)
        candidates: set[int] = set()
        for size, (hashes, items) in self.sketches.items():
            h = hasher.shingles(words, size)
            if len(h):
                at = np.searchsorted(hashes, h)
                hit = np.unique(h[hashes[np.minimum(at, len(hashes) - 1)] == h])
                for a, b in zip(np.searchsorted(hashes, hit), np.searchsorted(hashes, hit, side="right")):
                    candidates.update(items[a:b].tolist())
        out, sets = [], {}
        for at in sorted(candidates):
            item, size, wanted = self.exact[at]
            if size not in sets:
                sets[size] = set(shingles(words, size))
            shared = len(wanted & sets[size])
            if shared >= self.share * len(wanted) - 1e-9:
                out.append((item, shared, len(wanted)))
        return out


def _joined(texts: DataFrame, rows: DataFrame, share: float, told: str = "doc_id") -> DataFrame:
    """The same pairs by shuffles alone, for test sets of any size: sketch hashes pick candidates, shingles verify them."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("sketch", T.BooleanType())])))
    def of_item(t: pd.Series) -> pd.Series:
        hasher, out = Hasher(), []
        for x in t:
            size, found = item_shingles(x)
            order = sorted(found, key=lambda s: int(hasher.shingles(s.split(" "), size)[0]))
            out.append([{"s": s, "sketch": i < sketch_length(len(found), share)} for i, s in enumerate(order)])
        return pd.Series(out)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def of_doc(t: pd.Series) -> pd.Series:
        return pd.Series([sorted({s for k in range(1, SHINGLE + 1) for s in shingles(words_of(x), k)}) for x in t])

    docs = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    rows = rows.select("item_id", "text", F.xxhash64("item_id", "text").alias("item"))
    times = rows.groupBy("item").agg(F.count("*").alias("times"))
    items = rows.dropDuplicates(["item"]).select("item_id", "item", F.explode(of_item("text")).alias("x")).select("item_id", "item", "x.s", "x.sketch")
    sizes = items.groupBy("item").agg(F.count("*").alias("n_item"))
    held = docs.select("row", F.explode(of_doc("text")).alias("s")).distinct()
    cand = held.join(items.where("sketch"), "s").select("row", "item").distinct()
    shared = held.join(items.select("item", "item_id", "s"), "s").join(cand, ["row", "item"]).groupBy("row", "item", "item_id").agg(F.count("*").alias("n_shared"))
    good = shared.join(sizes, "item").where(F.col("n_shared") >= share * F.col("n_item") - 1e-9)
    good = good.join(times, "item").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    if told == "row":
        return good.select("row")
    return docs.select(told, "row").join(good, "row").select(told, "item_id", "n_shared", "n_item")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT, max_chars: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): the items of which a document holds ``share`` of the shingles or more.

    Words are runs of letters, digits and _ in lower case.  Null or wordless
    items and texts match nothing; items of fewer than five words are one
    shingle.  A repeated row of ``docs`` or an item_id that occurs twice gives
    its pairs again; null ids stay null.  The test set's size is checked: up
    to ``max_chars`` characters of it go to the executors, beyond that the
    same search is done by joins.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = _search(rows, share, max_chars)
    if found is None:
        return _joined(texts, rows, share)
    return batches_of(texts, BATCH).select("doc_id", F.explode(found("text")).alias("f")).select("doc_id", "f.*")


def _search(rows: DataFrame, share: float, max_chars: int):
    """A UDF from text to array<struct<item_id, n_shared, n_item>>; None if the test set is over ``max_chars``."""
    size = rows.agg(F.coalesce(F.sum(F.length("text") + 50), F.lit(0))).first()[0]
    if size > max_chars:
        return None
    items = rows.sparkSession.sparkContext.broadcast(Items(sorted(((r.item_id, r.text) for r in rows.collect()), key=lambda x: (x[0] is None, x[0], x[1] or "")), share))

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, held = Hasher(), items.value
        try:
            for texts in batches:
                yield pd.Series([[dict(zip(FOUND_FIELDS, x)) for x in held.found_in(t, hasher)] for t in texts])
        finally:
            hasher.known.clear()
            give_back()

    return found


def clean(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT, max_chars: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no test item; null texts stay.

    Each row is judged by its own text, whatever its id: rows may share an id
    or have none, and equal rows stay or go together.  An empty test set
    rejects nothing.  Other columns are carried along, whatever their names.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = _search(rows, share, max_chars)
    if found is not None:
        return batches_of(docs, BATCH).where(F.size(found("text")) == 0)
    bad = _joined(docs.select(F.lit(0).cast("long").alias("doc_id"), "text"), rows, share, "row").distinct()
    return docs.join(bad, F.xxhash64(F.lit(0).cast("long"), docs["text"]) == bad["row"], "left_anti")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, len(w) - 3)) AS r(i)),
q AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS r(i)),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM d JOIN q USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9
"""
