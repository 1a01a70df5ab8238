"""Weights and similarity scores as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(df: Column, n: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 1; 1 without documents."""
    return F.when(n > 0, F.log((n + 1) / (df + 1)) + 1).otherwise(1.0)


def is_universal(df: Column, n: Column) -> Column:
    """M04."""
    return df >= n


def _weight(tokens: Column, weights: Column, unseen: float) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda a, t: a + F.coalesce(weights[t], F.lit(unseen)))


def weighted_jaccard(a: Column, b: Column, weights: Column, unseen: float = 1.0) -> Column:
    """Weights is a map of token to idf."""
    union = _weight(F.array_union(a, b), weights, unseen)
    return F.when(union > 0, _weight(F.array_intersect(a, b), weights, unseen) / union).otherwise(0.0)


def weighted_containment(a: Column, b: Column, weights: Column, unseen: float = 1.0) -> Column:
    """Mean of the shared weight's part of either side."""
    both = _weight(F.array_intersect(a, b), weights, unseen)
    x, y = _weight(F.array_distinct(a), weights, unseen), _weight(F.array_distinct(b), weights, unseen)
    return F.when((x > 0) & (y > 0), (both / x + both / y) / 2).otherwise(0.0)


def entity_score(a: Column, b: Column, weights: Column) -> Column:
    """M05."""
    return F.greatest(weighted_jaccard(a, b, weights), weighted_containment(a, b, weights))


def relatedness(containment: Column, span: Column) -> Column:
    """0.65 of the discriminative tokens' containment and 0.35 of the spans' compatibility."""
    return 0.65 * containment + 0.35 * span


def role_compatibility(a: Column, b: Column) -> Column:
    """M07."""
    pair = F.array_sort(F.array(a, b))
    return F.when(a == b, 1.0).when(pair == F.array(F.lit("END"), F.lit("START")), 0.0).when((a == "DURATION") | (b == "DURATION"), 0.0).otherwise(0.85)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def sliding_threshold(related: Column, low: float = 0.6, high: float = 0.6) -> Column:
    """From high for unrelated documents down to low for related ones; flat by default."""
    return high - (high - low) * related


def pair_score(entity: Column, sentence: Column, temporal: Column, role: Column) -> Column:
    """0.45 entity, 0.25 sentence, 0.30 temporal, renormalised if there is no temporal, times the role's."""
    plain = 0.45 * entity + 0.25 * sentence
    return role * F.when(temporal.isNull(), plain / 0.70).otherwise(plain + 0.30 * temporal)


def passage_score(shared_idf: Column, n_tokens: Column) -> Column:
    """M11."""
    return shared_idf / (1 + F.sqrt(n_tokens))
