"""Stand-ins for neural models: vectors and boundary probabilities that only a text's terms decide. Their scores say nothing
about the quality of real models, which come in as columns of the same types."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound, search_terms


def hashed_vector(text: Column, dim: int = 16) -> Column:
    """Counts of a text's terms by hash, at unit length; all zero for a text without terms."""
    if 16 % dim == 0:
        return vector_of_digits(hashed_digits(text), dim)
    number = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 6), 16, 10).cast("int") % dim
    counts = bound(F.transform(search_terms(text), number), lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    return bound(counts, _unit)


def hashed_digits(text: Column) -> Column:
    """What decides hashed_vector() for a dim that divides 16: a hex digit a term, in a string. Texts put together with blanks have theirs put together."""
    return F.array_join(F.transform(search_terms(text), lambda t: F.substring(F.md5(t.cast("binary")), 6, 1)), "")


def vector_of_digits(digits: Column, dim: int = 16) -> Column:
    times = lambda s, d: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(d), F.lit("")))
    counts = bound(digits, lambda s: F.array(*[reduce(add, (times(s, d) for d in "0123456789abcdef"[i::dim])).cast("double") for i in range(dim)]))
    return bound(counts, _unit)


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return bound(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def boundary_probs(sentences: Column, dim: int = 16) -> Column:
    """For each sentence but the last, how far the next one's vector is from its own (0 to 1)."""
    vectors = F.transform(sentences, lambda s: hashed_vector(s, dim))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return bound(vectors, lambda v: F.transform(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda x, i: F.round(F.lit(1.0) - dot(x, F.get(v, i + 1)), 6)))


def encoded(rows: DataFrame, text: str, encode) -> DataFrame:
    """rows with `vec`: encode(column) runs once for each distinct text, however often it occurs."""
    distinct = rows.select(text).distinct()
    return rows.join(distinct.withColumn("vec", encode(F.col(text))), text)
