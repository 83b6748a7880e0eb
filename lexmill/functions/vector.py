"""Similarity of vectors and of texts to queries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle between vectors of one size; 0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def hits(content: Column, terms: Column) -> Column:
    """How many of the terms are somewhere in the content, repeated terms counting each time."""
    return F.aggregate(terms, F.lit(0), lambda n, t: n + F.when(content.contains(t), 1).otherwise(0))


def boosted(similarity: Column, content: Column, terms: Column, numbers: Column, references: Column) -> Column:
    """Similarity with boosts of 0.1 for each term, 0.5 for each number and 0.7 for each reference found."""
    c = F.lower(content)
    return similarity + 0.1 * hits(c, terms) + 0.5 * hits(c, numbers) + 0.7 * hits(c, references)
