"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .stage import batches_of, cut

RADIUS = 3
#: Buckets of more distinct fingerprints are hashed again on the bits their key leaves free.
BUCKET = 1024
#: Texts in a batch between Spark and Python.
BATCH = 1000
#: What the hashes are mixed with for each word of a wide fingerprint.
_WORDS = np.random.default_rng(7).integers(0, 1 << 63, 64, np.uint64)
LINKS = T.ArrayType(T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BREAKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def fingerprint(text: str | None, seed: int = 42, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text; a bit is set if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(LOWER).translate(BREAKS).split(b" ") if w]
    if not words:
        return 0
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    starts = [0, *ends[: n - 1].tolist()]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):  # bounded memory for very long texts
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 8192], stops[at : at + 8192])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``words`` times 64 bits (as bytes) over distinct 64-bit hashes; each word mixes them anew, a bit is set if it is set in over half of them."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # counts of so many fit one byte
        x = hashes[at : at + 255, None] ^ _WORDS[:words]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """``docs`` with the signed form of each text's fingerprint; null and blank texts have zero."""
    return batches_of(docs, BATCH).withColumn(to, _fingerprints(F.col(text)))


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks on the bits of ``free`` such that any ``radius`` of them are all avoided by some mask.

    Bit i gets a non-zero vector m(i) over GF(2) of radius + 1 components; the
    mask of each non-zero vector v holds the bits with <v, m(i)> = 1.  For any
    ``radius`` bits, some v is orthogonal to all of their vectors.
    """
    top = 1 << (radius + 1)
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << b for j, b in enumerate(bits) if ((1 + j % (top - 1)) & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _levels() -> tuple[list[int], list[list[int]], list[list[list[int]]]]:
    full = (1 << 64) - 1
    one = covering_masks(full)
    two = [[a | b for b in covering_masks(full & ~a)] for a in one]
    three = [[[m | c for c in covering_masks(full & ~m)] for m in row] for row in two]
    return one, two, three


def near_links(fps: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one bucket: fewer edges than members."""
    m, out = len(fps), []
    if m == 2:
        return [(int(ids[0]), int(ids[1]))] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    left = np.ones(m, bool)
    for s in range(m):
        if not left[s]:
            continue
        left[s], todo = False, [s]
        while todo:
            i = todo.pop()
            new = np.nonzero(near[i] & left)[0]
            left[new] = False
            todo.extend(new.tolist())
            out += [(int(ids[i]), int(ids[j])) for j in new]
    return out


@F.pandas_udf(LINKS)
def _bucket_links(members: pd.Series) -> pd.Series:
    found = []
    for rows in members:
        fps = np.fromiter((r["fp"] for r in rows), np.int64, len(rows)).view(np.uint64)
        ids = np.fromiter((r["id"] for r in rows), np.int64, len(rows))
        found.append([{"u": u, "v": v} for u, v in near_links(fps, ids)])
    return pd.Series(found)


def _buckets(keyed: DataFrame, by: list[str]) -> DataFrame:
    sizes = keyed.groupBy(*by).agg(F.count("*").alias("members")).where("members > 1")
    return keyed.join(sizes, by)


def _linked(rows: DataFrame, by: list[str]) -> DataFrame:
    groups = rows.groupBy(*by).agg(F.collect_list(F.struct("fp", "id")).alias("members"))
    return groups.select(F.explode(_bucket_links("members")).alias("e")).select("e.u", "e.v")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that connect whatever differs in at most three bits.

    ``distinct`` has one row (fp, id) per fingerprint.  A bucket with more than
    ``bucket`` distinct fingerprints is dealt out again by covering masks over
    the bits its key leaves free, twice if need be; then at most some hundred
    values remain possible, so that no group grows with the corpus and no pair
    is lost.
    """
    one, two, three = _levels()
    arr = lambda masks: F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    keyed = distinct.select("fp", "id", F.posexplode(arr(one)).alias("t", "key"))
    first = _buckets(keyed, ["t", "key"])
    out = _linked(first.where(f"members <= {bucket}"), ["t", "key"])

    def deeper(hot: DataFrame, masks: list[list[int]], index) -> DataFrame:
        lit = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in masks])
        cols = hot.select("fp", "id", index.alias("t"), F.posexplode(lit[index]).alias("s", "mask"))
        return cols.select("fp", "id", F.expr("t * 15 + s").alias("t"), F.expr("fp & mask").alias("key"))

    second = _buckets(deeper(first.where(f"members > {bucket}"), two, F.col("t")), ["t", "key"])
    out = out.unionByName(_linked(second.where(f"members <= {bucket}"), ["t", "key"]))
    flat = [m for row in three for m in row]
    third = _buckets(deeper(second.where(f"members > {bucket}"), flat, F.col("t")), ["t", "key"])
    return out.unionByName(_linked(third, ["t", "key"]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hex digits) and component_id.

    Texts whose fingerprints differ in at most three bits are linked;
    component_id is the smallest id reachable.  Null or blank texts have
    fingerprint zero and link like any other; repeated rows each get a row; a
    null id gets its class's component but ties no other fingerprints
    together if its fingerprint has no id at all.  An empty table gives none.
    Other columns are not read, so their names do not matter.
    """
    fps = cut(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    edges = cut(links(distinct.where("id is not null").select("fp", "id")))
    roots = components(edges)
    classes = distinct.join(roots.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id.

    Of rows with one id, one stays.  Rows without an id stay, one for each
    fingerprint, where no row with an id has that fingerprint.
    """
    kept = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    out = docs.join(kept, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return out
    known = fingerprints(docs.where("doc_id is not null").select("text")).select(F.col("fp").alias("_fp")).distinct()
    rest = fingerprints(nameless, to="_fp").dropDuplicates(["_fp"]).join(known, "_fp", "left_anti")
    return out.unionByName(rest.select(*docs.columns))
