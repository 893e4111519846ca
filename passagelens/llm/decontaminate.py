"""Benchmark decontamination by winnowing; DataFrame functions only.

A document is contaminated where it holds SPAN consecutive words of a benchmark item. Both sides hash their
K-word grams and keep, for every window of SPAN consecutive words, the least gram hash. Equal spans have equal
minima, so that every shared span meets in the join of fingerprints: the benchmark's side of that join is broadcast while it is
counted to be small, so that a document sends what it shares, not what it holds. The hits of a document are then extended: from each
place whose gram is shared, both ways to the windows of SPAN words that have it as their minimum; these are compared
with the items' windows word by word. An item of fewer words than SPAN is one window, found by the hash of
its whole word sequence and compared likewise.

Words are in lower case for A-Z only. The first pass hashes words after lower(), which maps words that are
equal by that rule to equal words, and so finds a superset cheaply.

Defined results: null, empty and wordless texts have n_words 0 and no hits; benchmark items without words are
ignored, repeated items count by item_id; rows that repeat a doc_id, or have none, are judged one by one; empty tables give
empty results or no hits; columns of docs named as the added ones are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound, hinted, kept_columns, n_words, row_key, settled, words_of

SPAN, K = 13, 8


def grams(hashes: Column, k: int) -> Column:
    """The hash of each k consecutive word hashes; hashes must be bound (common.bound)."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - k + 1, F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)]))


def minima(hashes: Column, k: int, width: int) -> Column:
    """The least of each `width` consecutive gram hashes."""

    def least(of: Column) -> Column:
        starts = F.slice(of, 1, F.greatest(F.size(of) - width + 1, F.lit(0)))
        return F.transform(starts, lambda x, i: F.least(x, *[F.get(of, i + j) for j in range(1, width)]))

    return bound(grams(hashes, k), least)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def fingerprints(words: Column, span: int, k: int, short: list[int]) -> Column:
    """The window minima of the words, and the whole-sequence hashes of each short length; each once."""
    return bound(word_hashes(words), lambda h: F.array_distinct(F.concat(minima(h, k, span - k + 1), *[grams(h, n) for n in short])))


def windows(words: Column, span: int, k: int, short: list[int]) -> Column:
    """start, length and fp (its minimum, or the hash of a short one) of each window of words."""

    def of_length(h: Column, n: int) -> Column:
        return F.transform(minima(h, k, span - k + 1) if n == span else grams(h, n), lambda fp, i: F.struct(i.alias("start"), F.lit(n).alias("length"), fp.alias("fp")))

    return bound(word_hashes(words), lambda h: F.concat(*[of_length(h, n) for n in (span, *short)]))


def said(words: Column, window: Column) -> Column:
    return F.array_join(F.slice(words, window["start"] + 1, window["length"]), " ")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, share: int = 20) -> DataFrame:
    """docs' columns with n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0, share x n_hit >= n_words)."""
    sized = settled(items.select("item_id", words_of(ascii_lower(F.col("text"))).alias("w"), words_of(F.lower(F.col("text"))).alias("rough")).where(F.size("w") > 0))
    short = sorted(r.n for r in sized.select(F.size("w").alias("n")).where(F.col("n") < span).distinct().collect())  # fewer than span values

    def posted(column: str) -> DataFrame:
        """The windows of items: all of span words, and whole items of fewer."""
        each = sized.select("item_id", column, F.explode(windows(F.col(column), span, k, short)).alias("x"))
        return each.where((F.col("x.length") == span) | (F.col("x.length") == F.size(column))).select("item_id", "x.*", said(F.col(column), F.col("x")).alias("words"))

    exact = settled(posted("w").select("item_id", "words").distinct())
    spans = settled(exact.select("words").distinct())
    # Both sides of the first pass hash lower(): only then are words that A-Z lower case makes equal sure to be equal.
    prints = settled(posted("rough").select("fp").distinct())

    key = row_key("doc_id", "text")
    held = docs.select(key.alias("key"), F.explode(fingerprints(words_of(F.lower(F.col("text"))), span, k, short)).alias("fp"))
    shared = settled(held.join(hinted(prints), "fp").groupBy("key").agg(F.collect_set("fp").alias("shared")))

    again = docs.select(key.alias("key"), "text").join(hinted(settled(shared.select("key"))), "key", "left_semi").dropDuplicates(["key"])
    again = again.join(shared, "key").select("key", words_of(ascii_lower(F.col("text"))).alias("w"), words_of(F.lower(F.col("text"))).alias("rough"), "shared")

    def extended(both: Column) -> Column:
        """The windows around the places of shared grams, with their words."""
        hits = F.filter(windows(both["rough"], span, k, short), lambda x: F.array_contains("shared", x["fp"]))
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), said(both["w"], x).alias("words")))

    found = again.select("key", F.explode(bound(F.struct("w", "rough"), extended)).alias("x")).select("key", "x.*")
    found = settled(found.join(hinted(spans), "words").distinct())

    # The union of the hit windows: walk their starts in order, adding what each reaches beyond the last.
    ends = found.groupBy("key", "start").agg((F.max("start") + F.max("length")).alias("end"))
    state = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("total"))
    walked = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "end"))),
        state,
        lambda s, x: F.struct(
            F.greatest(s["reach"], x["end"]).alias("reach"),
            (s["total"] + F.greatest(x["end"] - F.greatest(s["reach"], x["start"]), F.lit(0))).alias("total"),
        ),
    )
    hits = ends.groupBy("key").agg(walked["total"].alias("n_hit"))
    in_items = found.select("key", "words").distinct().join(hinted(exact), "words").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    in_items = in_items.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    judged = hinted(settled(hits.join(in_items, "key")))

    own = kept_columns(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    out = docs.select(own.alias("own"), key.alias("key"), n_words(F.col("text")).alias("n_words")).join(judged, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "own.*",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
