"""Vector and trigram similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision; null where either vector is null."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of the angle; null for a null vector or one of length zero."""
    length = norm(a) * norm(b)
    return dot(a, b) / F.nullif(length, F.lit(0.0))


def l2_normalise(a: Column | str) -> Column:
    """The vector divided by its length; null for a null vector or one of length zero."""
    n = F.nullif(norm(a), F.lit(0.0))
    return F.when(n.isNotNull(), F.transform(_col(a), lambda x: x.cast("double") / n))


def trigrams(text: Column | str) -> Column:
    """The set of trigrams: lower case, words of letters and digits, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of_word(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets held as arrays; 0 for two empty sets."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def trigram_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - trigram_similarity(a, b)


def weighted_blend(semantic: Column, lexical: Column, alpha: float) -> Column:
    return alpha * semantic + (1 - alpha) * lexical

