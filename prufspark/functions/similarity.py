"""Similarities of two texts as Column expressions over simplified forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prufspark.functions.text import bigrams, bind, simple_tokens


def jaccard(a: Column, b: Column) -> Column:
    """Token sets as arrays: 1 for two empty ones, 0 for one empty."""
    both = F.size(F.array_intersect(a, b))
    any_ = F.size(F.array_union(a, b))
    return F.when(any_ == 0, 1.0).otherwise(both / any_)


def dice(a: Column, b: Column) -> Column:
    """Pair sets as arrays."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def span_features(simple: Column) -> Column:
    """What a span score needs, computed once per row before pairing."""
    return bind(simple, lambda s: F.struct(s.alias("s"), simple_tokens(s).alias("t"), bigrams(s).alias("b")))


def span_score(g: Column, p: Column) -> Column:
    """Score of two feature structs: equal 1, one in the other 0.95, else the better of token and pair
    overlap; for short spans tokens count half. Two empty spans score 1, one empty span 0."""
    gs, ps = g["s"], p["s"]
    j, d = jaccard(g["t"], p["t"]), dice(g["b"], p["b"])
    short = (F.length(gs) < 12) | (F.length(ps) < 12) | ((F.size(g["t"]) <= 2) & (F.size(p["t"]) <= 2))
    return (
        F.when(gs == ps, 1.0)
        .when((gs == "") | (ps == ""), 0.0)
        .when(F.contains(gs, ps) | F.contains(ps, gs), 0.95)
        .otherwise(F.when(short, F.greatest(0.5 * j, d)).otherwise(F.greatest(j, d)))
    )


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0 or the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0)))
