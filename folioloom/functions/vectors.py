"""Vector functions: normalisation, dot products, and an offline hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import index_terms

DIMENSIONS = 2048


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, null where the sizes differ or a vector is zero."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def is_valid(a: Column) -> Column:
    """Whether a vector is present, not empty and finite in all components."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return a.isNotNull() & (F.size(a) > 0) & ~bad


def hash_bucket(term: Column, dimensions: int = DIMENSIONS) -> Column:
    """Component of a term: its MD5 modulo a power of two up to 4096, which the last three digits tell."""
    return F.conv(F.right(F.md5(term.cast("binary")), F.lit(3)), 16, 10).cast("int") % dimensions


def hash_embeddings(rows: DataFrame, keys: list[str], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(keys, i, w): sparse unit vectors over hashed terms, without stop words; a text without terms has no rows."""
    terms = rows.select(*keys, F.explode(index_terms(F.col(text))).alias("t"))
    counts = terms.groupBy(*keys, hash_bucket(F.col("t"), dimensions).alias("i")).agg(F.count("*").cast("double").alias("n"))
    total = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*keys)))
    return counts.select(*keys, "i", (F.col("n") / total).alias("w"))


def dense(sparse: DataFrame, keys: list[str], dimensions: int = DIMENSIONS) -> DataFrame:
    """(keys, embedding) from sparse rows."""
    held = sparse.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    return held.select(*keys, F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))
