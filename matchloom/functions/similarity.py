"""Similarities of strings and token sets as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(x: Column) -> Column:
    """Sorted distinct tokens; an empty string has none."""
    return F.array_sort(F.array_distinct(F.filter(F.split(x, " "), lambda w: w != "")))


def compact(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit(""))


def grams(x: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the text between two spaces; an empty string has none."""
    padded = F.concat(F.lit(" "), x, F.lit(" "))
    many = F.length(padded) - (n - 1)
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substr(padded, i, F.lit(n)))
    return F.when((F.length(x) > 0) & (many > 0), F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(shared(a, b), F.size(a) + F.size(b) - shared(a, b))


def of_smaller(a: Column, b: Column) -> Column:
    return ratio(shared(a, b), F.least(F.size(a), F.size(b)))


def of_larger(a: Column, b: Column) -> Column:
    return ratio(shared(a, b), F.greatest(F.size(a), F.size(b)))


def dice(a: Column, b: Column) -> Column:
    return ratio(2 * shared(a, b), F.size(a) + F.size(b))


def length_ratio(a: Column, b: Column) -> Column:
    return ratio(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def edit(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 if either is empty; trigram Dice where even the shorter has 128 characters."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    return F.when(shorter == 0, 0.0).when(a == b, 1.0).when(shorter <= 127, 1 - F.levenshtein(a, b) / longer).otherwise(dice(grams(a), grams(b)))


def weighted_overlap(a: Column, b: Column, idf: Column) -> Column:
    """Summed idf (a map column) of shared tokens over the smaller of both sums; unknown tokens weigh 0."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(idf, w), F.lit(0.0)))
    return ratio(total(F.array_intersect(a, b)), F.least(total(a), total(b)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def scale_odds(p: Column, factor: Column | float) -> Column:
    """Probability whose odds are multiplied by a factor."""
    f = F.lit(factor) if isinstance(factor, (int, float)) else factor
    return p * f / (p * f + 1 - p)


def shift_logit(p: Column, delta: float) -> Column:
    return 1 / (1 + F.exp(-(logit(p) + delta)))
