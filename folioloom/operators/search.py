"""Inverted index, BM25, vector scan, fusion and the evidence gate, all over a batch of queries.

Tables: ``entries`` (doc, pos, text, ...), ``postings`` (doc, term, pos, tf),
``stats`` (doc, pos, length).  ``doc`` is the document (thread) that an entry
belongs to; a query only meets entries of its own document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as D

from ..functions import text as T
from ..functions import vectors as V

K1, B, RRF = 1.2, 0.75, 60
MIN_COVERAGE, MIN_SIMILARITY = 0.5, 0.30
#: Numbers in a block of vectors or queries, query vectors multiplied at once, vectors of which only the best is looked at first, and pairs computed exactly at once.
BLOCK, ROWS, STRIP, PAIRS = 1 << 22, 64, 64, 1 << 17


def candidates(limit: int) -> int:
    """How many hits of each list are fused."""
    return max(4 * limit, 30)


def postings(entries: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc, term, pos, tf) of every entry; ``text`` defaults to section path, table header and text."""
    body = F.col("text") if text is None else text
    return entries.select("doc", "pos", F.explode(T.index_terms(body)).alias("term")).groupBy("doc", "term", "pos").agg(F.count("*").alias("tf"))


def entry_lengths(entries: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc, pos, length): indexed terms of an entry, at least one."""
    body = F.col("text") if text is None else text
    return entries.select("doc", "pos", F.greatest(F.lit(1), F.size(T.index_terms(body))).cast("long").alias("length"))


def query_term_rows(queries: DataFrame, text: str = "text") -> DataFrame:
    """(doc, query_id, n_terms, term), one row per different term of each query."""
    q = queries.select("doc", "query_id", T.query_terms(F.col(text)).alias("terms"))
    return q.select("doc", "query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def bm25(post: DataFrame, lengths: DataFrame, terms: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(doc, query_id, pos, score, matched): BM25 of every entry that has a query term.

    Document frequencies, the number of entries and their mean length always
    cover the whole document; ``scope`` (doc, query_id, pos) only restricts
    which entries are scored.  Only postings of asked terms are shuffled.
    """
    asked = post.join(terms.select("doc", "term").distinct(), ["doc", "term"], "left_semi")
    df = asked.groupBy("doc", "term").agg(F.count("*").alias("df"))
    whole = lengths.groupBy("doc").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = terms.join(df, ["doc", "term"]).join(asked, ["doc", "term"])
    if scope is not None:
        hits = hits.join(scope.select("doc", "query_id", "pos"), ["doc", "query_id", "pos"], "left_semi")
    hits = hits.join(lengths, ["doc", "pos"]).join(whole, "doc")
    idf = F.log(1 + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    tf = F.col("tf").cast("double")
    part = idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("mean")))
    return hits.groupBy("doc", "query_id", "pos").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


def ranked(hits: DataFrame, score: str, keep: int, to: str = "rank") -> DataFrame:
    """The best ``keep`` hits of each query with their rank from 0; equal scores by position."""
    w = Window.partitionBy("doc", "query_id").orderBy(F.round(score, 9).desc(), "pos")
    return hits.withColumn(to, F.row_number().over(w) - 1).where(F.col(to) < keep)


def vector_hits(vectors: DataFrame, queries: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(doc, query_id, pos, similarity): cosine of each query vector with the vectors of its document.

    A query is a stated set against all rows: it is joined by document, and
    sizes that differ give no hit.
    """
    normed = lambda df, key: df.select("doc", key, F.col("embedding").alias(key[0] + "_v"), V.norm(F.col("embedding")).alias(key[0] + "_n"))
    both = normed(vectors, "pos").join(normed(queries, "query_id"), "doc").where("size(p_v) = size(q_v)")
    if scope is not None:
        both = both.join(scope.select("doc", "query_id", "pos"), ["doc", "query_id", "pos"], "left_semi")
    return both.withColumn("similarity", F.try_divide(V.dot(F.col("p_v"), F.col("q_v")), F.col("p_n") * F.col("q_n"))).where("similarity IS NOT NULL").select("doc", "query_id", "pos", "similarity")


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of one size as a matrix of doubles."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat, np.float64).reshape(-1, size)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of the rows, left to right as in ``V.dot``."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


def _likely(q: np.ndarray, v: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows among which are the ``keep`` best of each row of ``q`` (unit vectors), and all that equal them.

    Products in single precision are off by less than ``slack``.  The best of
    each strip of vectors tell a value that ``keep`` of them reach; only strips whose best reaches it are looked into.
    """
    slack = np.float32(2 * (q.shape[1] + 8) * 2.0**-23 + 4e-9)
    strips = -(-len(v) // STRIP)
    wide = np.zeros((strips * STRIP, v.shape[1]), np.float32)
    wide[: len(v)] = v
    for at in range(0, len(q), ROWS):
        s = q[at : at + ROWS].astype(np.float32) @ wide.T
        s[:, len(v) :] = -2
        best = s.reshape(-1, STRIP, strips).max(axis=1)  # a strip has every so many-th vector
        floor = np.partition(best, strips - keep, axis=1)[:, strips - keep] if strips > keep else np.full(len(best), -2, np.float32)
        i, strip = np.nonzero(best >= (floor - slack)[:, None])
        for a in range(0, len(i), PAIRS // STRIP):
            x, y = i[a : a + PAIRS // STRIP], strip[a : a + PAIRS // STRIP]
            j = y[:, None] + strips * np.arange(STRIP)
            k, c = np.nonzero((s[x[:, None], j] >= (floor[x] - slack)[:, None]) & (j < len(v)))
            yield at + x[k], j[k, c]


def _best(q: np.ndarray, q_norm: np.ndarray, v: np.ndarray, v_norm: np.ndarray, pos: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity): the ``keep`` most similar vectors of each query and those that rounding may put among them; of equal vectors and values the first by ``pos``."""
    order = np.lexsort((pos, np.unique(v, axis=0, return_inverse=True)[1].ravel()))
    same = np.r_[False, (v[order[1:]] == v[order[:-1]]).all(axis=1)] if len(v) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(v))))
    heads = np.flatnonzero(~same)
    copies = np.minimum(np.diff(np.r_[heads, len(v)]), keep)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    held, n_held = [], 0

    def settled(parts: list) -> tuple:
        i, j, s = (np.concatenate(x) for x in zip(*parts))
        o = np.lexsort((pos[j], -s, i))
        i, j, s = i[o], j[o], s[o]
        new = np.r_[True, (i[1:] != i[:-1]) | (s[1:] != s[:-1])][: len(i)]
        few = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0)) < keep
        i, j, s = i[few], j[few], s[few]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
        sizes = np.diff(np.r_[starts, len(i)])
        last = np.where(sizes >= keep, s[np.minimum(starts + keep - 1, max(len(s) - 1, 0))], -2.0)
        good = s >= np.repeat(last, sizes) - 2e-9
        return i[good], j[good], s[good]

    ones, units = q / q_norm[:, None], v[order[heads]] / v_norm[order[heads], None]
    for i, h in _likely(ones, units, keep):
        j = order[heads[h]]
        s = _dots(v[j], q[i]) / (v_norm[j] * q_norm[i])
        n = copies[h]
        at = np.repeat(heads[h], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        held.append((np.repeat(i, n), order[at], np.repeat(s, n)))
        n_held += n.sum()
        if n_held > 8 * PAIRS:
            found, held, n_held = [settled([*found, *held])], [], 0
    return settled([*found, *held])


def nearest(vectors: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """(doc, query_id, pos, similarity): of ``vector_hits``, the best ``keep`` of each query, and no less.

    Blocks of vectors meet blocks of queries and are multiplied as matrices;
    what may be among the best is then computed as ``vector_hits`` does.
    Of each pair of blocks only its best are passed on, so rank them with ``ranked``.
    Vectors with components that are null, not finite or of extreme size take the way of ``vector_hits``.
    """
    normed = lambda df, key: df.select("doc", key, F.col("embedding").alias("e"), F.size("embedding").alias("size"), V.norm(F.col("embedding")).alias("norm"))
    plain = V.is_valid(F.col("e")) & F.col("norm").between(1e-100, 1e100)
    v, q = normed(vectors, "pos").withColumn("plain", F.coalesce(plain, F.lit(False))), normed(queries, "query_id").withColumn("plain", F.coalesce(plain, F.lit(False)))
    counts = lambda df, to: df.where("plain").groupBy("doc", "size").agg(F.ceil(F.count("*") * F.first("size") / BLOCK).cast("int").alias(to))
    blocks = counts(v, "vs").join(counts(q, "qs"), ["doc", "size"])
    block = lambda key, n: F.expr(f"cast(pmod(xxhash64({key}), {n}) AS int)")
    all_of = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    left = v.where("plain").join(F.broadcast(blocks), ["doc", "size"]).select("doc", "size", "pos", "e", "norm", block("pos", "vs").alias("v"), all_of("qs").alias("q"))
    right = q.where("plain").join(F.broadcast(blocks), ["doc", "size"]).select(F.col("doc").alias("to"), F.col("size").alias("of"), "query_id", "e", "norm", block("query_id", "qs").alias("r"), all_of("vs").alias("w"))
    kinds = {f.name: f.dataType for f in [*vectors.schema, *queries.schema]}
    schema = D.StructType([D.StructField("doc", kinds["doc"]), D.StructField("query_id", kinds["query_id"]), D.StructField("pos", kinds["pos"]), D.StructField("similarity", D.DoubleType())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            i = j = np.zeros(0, np.int64)
            s = np.zeros(0)
        else:
            size = a.column("size")[0].as_py()
            i, j, s = _best(_matrix(b.column("e"), size), np.asarray(b.column("norm")), _matrix(a.column("e"), size), np.asarray(a.column("norm")), np.asarray(a.column("pos")), keep)
        return pa.table({"doc": a.column("doc").take(pa.array(j)), "query_id": b.column("query_id").take(pa.array(i)), "pos": a.column("pos").take(pa.array(j)), "similarity": pa.array(s)})

    near = left.groupBy("doc", "size", "v", "q").cogroup(right.groupBy("to", "of", "w", "r")).applyInArrow(meet, schema)
    raw = lambda df, key, where: df.where(where).select("doc", key, F.col("e").alias("embedding"))
    odd = vector_hits(raw(v, "pos", "NOT plain"), raw(q, "query_id", "true")).unionByName(vector_hits(raw(v, "pos", "plain"), raw(q, "query_id", "NOT plain")))
    return near.unionByName(odd)


def fuse(vector_ranked: DataFrame, lexical_ranked: DataFrame, keep: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: (doc, query_id, pos, score, rank).

    Of equal sums, the one with the better vector rank comes first, then the
    better lexical rank.
    """
    one = vector_ranked.select("doc", "query_id", "pos", F.col("rank").alias("v"), F.lit(None).cast("int").alias("l"))
    two = lexical_ranked.select("doc", "query_id", "pos", F.lit(None).cast("int").alias("v"), F.col("rank").alias("l"))
    both = one.unionByName(two).groupBy("doc", "query_id", "pos").agg(F.min("v").alias("v"), F.min("l").alias("l"))
    share = lambda c: F.coalesce(1.0 / (RRF + 1.0 + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", share("v") + share("l"))
    w = Window.partitionBy("doc", "query_id").orderBy(F.round("score", 12).desc(), F.coalesce("v", F.lit(1 << 30)), F.coalesce("l", F.lit(1 << 30)), "pos")
    return both.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < keep).select("doc", "query_id", "pos", "score", "rank")


def coverage(hits: DataFrame, post: DataFrame, terms: DataFrame) -> DataFrame:
    """``hits`` with the share of the query's terms that the entry has (0 for a query without terms)."""
    wanted = hits.select("doc", "query_id", "pos").join(terms, ["doc", "query_id"])
    got = wanted.join(post.select("doc", "term", "pos"), ["doc", "term", "pos"]).groupBy("doc", "query_id", "pos").agg((F.count("*") / F.max("n_terms")).alias("coverage"))
    return hits.join(got, ["doc", "query_id", "pos"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def search(entries: DataFrame, queries: DataFrame, limit: int, vectors: DataFrame | None = None, scope: DataFrame | None = None, text: Column | None = None, rerank=None) -> DataFrame:
    """Hybrid search of a batch: (doc, query_id, rank, pos, score, similarity, coverage).

    ``queries`` is (doc, query_id, text[, embedding]); ``vectors`` (doc, pos,
    embedding); without them the search is lexical.  At most three times
    ``limit`` hits come back.  ``rerank`` is a Column function of the query and
    entry texts that orders the first 24 hits anew.
    """
    keep = candidates(limit)
    post, lengths, terms = postings(entries, text), entry_lengths(entries, text), query_term_rows(queries)
    lexical = ranked(bm25(post, lengths, terms, scope), "score", keep)
    if vectors is None:
        near = lexical.select("doc", "query_id", "pos", F.lit(None).cast("double").alias("similarity")).where("false")
    else:
        near = vector_hits(vectors, queries, scope)
    best = ranked(near, "similarity", keep)
    hits = coverage(fuse(best, lexical, keep), post, terms).join(near, ["doc", "query_id", "pos"], "left")
    if rerank is not None:
        texts = entries.select("doc", "pos", F.substring("text", 1, 1500).alias("_text"))
        hits = hits.join(texts, ["doc", "pos"]).join(queries.select("doc", "query_id", F.col("text").alias("_query")), ["doc", "query_id"])
        hits = hits.withColumn("rerank", F.when(F.col("rank") < 24, rerank(F.col("_query"), F.col("_text")).cast("double"))).drop("_text", "_query")
        w = Window.partitionBy("doc", "query_id").orderBy(F.col("rank") >= 24, F.col("rerank").desc_nulls_last(), "rank")
        hits = hits.withColumn("rank", F.row_number().over(w) - 1)
    return hits.where(F.col("rank") < 3 * max(limit, 1))


def has_evidence(hits: DataFrame, minimum: float = MIN_SIMILARITY) -> DataFrame:
    """(doc, query_id, evidence): whether a query's hits are good enough to answer from."""
    good = F.bool_or((F.col("coverage") >= MIN_COVERAGE) | (F.coalesce("similarity", F.lit(-1.0)) >= minimum))
    if "rerank" in hits.columns:
        good = good | F.bool_or(F.coalesce("rerank", F.lit(-1.0)) > 0)
    return hits.groupBy("doc", "query_id").agg(good.alias("evidence"))


def distinct_queries(queries: DataFrame) -> DataFrame:
    """Batch of different, non-blank queries; each keeps its first place (query_id)."""
    q = queries.where(F.trim("text") != "")
    return q.groupBy("doc", "text").agg(F.min("query_id").alias("query_id"))


def positions_in(entries: DataFrame, column: str, values: list[int]) -> DataFrame:
    """(doc, pos) of the entries whose section, unit or page is one of ``values``."""
    return entries.where(F.col(column).isin([int(v) for v in values])).select("doc", "pos").distinct()
