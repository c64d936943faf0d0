"""Numeric scores of retrieval, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def normalized(a: Column) -> Column:
    """The vector over its length; unchanged when that is 0."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def similarity(distance: Column) -> Column:
    """1 - distance, at least 0."""
    return F.greatest(1 - distance, F.lit(0.0))


def display_similarity(distance: Column) -> Column:
    """1 - d up to distance 1, 1 / (1 + d) beyond."""
    return F.when(distance <= 1, 1 - distance).otherwise(1 / (1 + distance))


def half_cosine(cos: Column) -> Column:
    return (cos + 1) / 2


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def length_weights(query: Column) -> tuple[Column, Column]:
    """(vector, bm25) weights from the query's length: 0.3 up to 15 characters, 0.7 from 50."""
    w = 0.3 + 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.length(query) - 15) / 35.0))
    return w, 1 - w


#: Vector weight by query type; others 0.5.
TYPE_WEIGHTS = {"fact": 0.4, "process": 0.7, "comparison": 0.6, "simple": 0.4}


def type_weights(query_type: Column) -> tuple[Column, Column]:
    w = F.coalesce(*(F.when(query_type == k, F.lit(v)) for k, v in TYPE_WEIGHTS.items()), F.lit(0.5))
    return w, 1 - w


def rrf(weight: Column, rank: Column, k: int = 60) -> Column:
    """Reciprocal rank term for a rank from 1."""
    return weight / (k + rank)


def blended(rank: Column, sim: Column) -> Column:
    """Half reciprocal rank (from 1), half similarity."""
    return 0.5 / (60 + rank) + 0.5 * sim


def faq_boost(score: Column, is_faq: Column, boost: float = 0.1) -> Column:
    return F.when(is_faq, score + boost).otherwise(score)


def time_decay(score: Column, created: Column, now: Column) -> Column:
    """0.01 off for each month (30 days) past six, 0.1 at most."""
    months = F.datediff(now, created) / 30.0
    return F.when(months > 6, score - F.least(F.lit(0.1), 0.01 * (months - 6))).otherwise(score)


def faq_score(frequency: Column, rating: Column) -> Column:
    return 0.4 * F.least(F.lit(1.0), frequency / 20.0) + 0.6 * (rating + 1) / 2


def recommendation_score(sim: Column, tags_a: Column, tags_b: Column) -> Column:
    return 0.7 * sim + F.least(0.15 * F.size(F.array_intersect(tags_a, tags_b)), F.lit(0.3))
