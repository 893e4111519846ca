"""Line dedup by winnowing.

A repeated run is a sequence of at least LEAST_WORDS words that stood earlier in the corpus, in the order of doc_id
and place, whatever line breaks and blanks are between the words; A-Z counts as a-z. Later copies are deleted.

Passages start and end inside lines (and a line may hold several), so hashes of the text's own lines can't guarantee to find
them. Lines are therefore cut from every word on: the hash of the LINE words from a word on is a line hash.

1. Select. Of every LEAST_WORDS words in sequence the least line hash is their fingerprint. Equal windows have equal
   minima, so that every repeated run shares a fingerprint at the same place; about one word in 12 is selected. Texts of the
   same words are told by a hash of all, and only the first of them goes on.
2. Join. Fingerprints are counted with map-side sums. Texts whose fingerprints all occur once need no further look.
3. Extend. From the places of fingerprints that occur again, matches are extended both ways to the windows whose minimum they are, and
   compared by 128 bits over all words of the window. Each later window meets the first one of its contents only, so that a passage
   of any number of copies costs a row a copy and word, never a row a pair.
4. Delete. Words of later windows go, but for those that lie in the first window itself where the two overlap. A line that loses all
   its words vanishes, one that loses some is joined from the others by single blanks, others stay byte for byte.

Defined results: null texts stay null; a text that loses all its words becomes empty, its row stays; blank lines stay
otherwise; rows that share a doc_id are ordered by their text's hash, and rows that share both are one place in the order: what
one loses, all lose; rows without a doc_id come last; an empty table gives an empty table; a column n_deleted of
docs is replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, in_order, kept_columns, number_of, row_key, settled, spread_join
from .shingles import batches, mixed, numbers, word_hashes

LEAST_WORDS, LINE = 50, 25
#: A place is the number of its text, shifted by so many bits, and the number of its word.
PLACE_BITS = 26

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASES = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F)


def _least(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or by pick) of each `width` consecutive values."""
    span = 1
    while 2 * span <= width:
        x, span = pick(x[:-span], x[span:]), 2 * span
    return pick(x[: len(x) - width + span], x[width - span :])


def winnowed(texts: list[str], least: int) -> tuple[np.ndarray, ...]:
    """Word hashes, their text, the first word of each text, line hashes, window minima, and the starts of whole windows."""
    words, n = word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(texts)), n)
    if len(words) < least:
        none = np.zeros(0, np.uint64)
        return words, owner, first, none, none, np.zeros(0, np.int64)
    line = min(LINE, least)
    factors = numbers(2, line)
    lines = np.zeros(len(words) - line + 1, np.uint64)
    for j in range(line):
        lines += words[j : len(words) - line + 1 + j] * factors[j]
    lines = mixed(lines)
    minima = _least(lines, least - line + 1)
    at = np.arange(len(minima))
    return words, owner, first, lines, minima, at[at + least <= first[owner[at] + 1]]


def _sums(words: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of words by falling powers up to each word, and what brings the sum from a word on back to the first power."""
    powers, back = np.full(len(words) + 1, base, np.uint64), np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64)
    powers[:1] = back[:1] = 1
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(powers)[:-1])]), np.cumprod(back)


def _both(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two hashes of words[begin:end] for each begin and end."""
    out = []
    for base, own in zip(_BASES, (words, mixed(words + np.uint64(1)))):
        sums, back = _sums(own, base)
        out.append(mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)).view(np.int64))
    return out


def selected(texts: list[str], least: int) -> pd.DataFrame:
    """Of each text: two hashes of all words, their number, and its fingerprints with how often each is selected."""
    words, owner, first, lines, minima, starts = winnowed(texts, least)
    whole = np.zeros(len(minima), np.uint64)
    whole[starts] = minima[starts]
    places = np.zeros(0, np.int64)
    if len(minima):
        width = len(lines) - len(minima) + 1
        edge = np.zeros(width - 1, np.uint64)
        places = np.flatnonzero((_least(np.concatenate([edge, whole, edge]), width, np.maximum) == lines) & (lines > 0))
    each = pd.DataFrame({"text": owner[places], "f": lines[places].view(np.int64)}).groupby(["text", "f"], sort=True).size()
    text, f, times = each.index.get_level_values(0).to_numpy(), each.index.get_level_values(1).to_numpy(), each.to_numpy()
    cut = np.searchsorted(text, np.arange(1, len(texts)))
    a, b = _both(words, first[:-1], first[1:])
    return pd.DataFrame({"wa": a, "wb": b, "n_words": np.diff(first), "prints": np.split(f, cut), "times": np.split(times, cut)})


def extended(texts: list[str], least: int, shared: np.ndarray) -> pd.DataFrame:
    """text, pos, a, b: the windows whose minimum is among `shared`, by their first word, with two hashes of all their words."""
    words, owner, first, _, minima, starts = winnowed(texts, least)
    starts = starts[np.isin(minima[starts].view(np.int64), shared)]
    a, b = _both(words, starts, starts + least)
    return pd.DataFrame({"text": owner[starts], "pos": starts - first[owner[starts]], "a": a, "b": b})


def without(text: str, begins: np.ndarray, ends: np.ndarray) -> tuple[str, int]:
    """text without the words in begins[i]:ends[i], and how many went."""
    lines = text.split("\n")
    words = [_WORD.findall(x) for x in lines]
    total = sum(map(len, words))
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, begins, 1)
    np.add.at(marks, ends, -1)
    gone = np.cumsum(marks)[:-1] > 0
    if gone.all():
        return "", total
    out, at = [], 0
    for line, own in zip(lines, words):
        lost = gone[at : at + len(own)]
        at += len(own)
        if not lost.any():
            out.append(line)
        elif not lost.all():
            out.append(" ".join(w for w, x in zip(own, lost) if not x))
    return "\n".join(out), int(gone.sum())


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs' columns, later copies of repeated runs deleted from text, with n_deleted, the number of words that went."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame.text.fillna("").tolist()
            yield from (frame.iloc[part].assign(text=texts[part]) for part in batches(texts))

    def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(frames):
            own = selected(part.text.tolist(), least_words)
            yield own.assign(id=part.id.to_numpy(), ka=part.ka.to_numpy(), kb=part.kb.to_numpy())

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(frames):
            own = extended(part.text.tolist(), least_words, np.unique(np.concatenate(part.shared.tolist())))
            yield pd.DataFrame({"a": own.a, "b": own.b, "place": (part.number.to_numpy()[own.text] << PLACE_BITS) + own.pos})

    keyed = docs.select(number_of(F.col("doc_id")).alias("id"), row_key("doc_id", "text").alias("key"), "text").select("id", F.col("key.a").alias("ka"), F.col("key.b").alias("kb"), "text")
    key = ["ka", "kb"]
    texts = settled(keyed.mapInPandas(select, "id long, ka long, kb long, wa long, wb long, n_words long, prints array<long>, times array<int>").where(F.col("n_words") >= least_words))
    numbered = in_order(texts.select("id", *key, "wa", "wb", "n_words").distinct(), ["id", *key], "number")
    firsts = settled(numbered.groupBy("wa", "wb", "n_words").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")))
    named = settled(spread_join(numbered, firsts, ["wa", "wb", "n_words"], "n").select(*key, "number", "first", "n_words"))
    originals = hinted(settled(named.where("number = first").select(*key, "number")))

    places = texts.join(originals, key).dropDuplicates(["number"]).select("number", F.explode(F.arrays_zip("prints", "times")).alias("x")).select("number", F.col("x.prints").alias("print"), F.col("x.times").alias("times"))
    places = settled(places)
    counts = settled(places.groupBy("print").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("n")).where("total > 1").drop("total"))
    again = settled(spread_join(places.select("number", "print"), counts, ["print"], "n").groupBy("number").agg(F.collect_list("print").alias("shared")))
    read = keyed.join(originals, key).join(hinted(settled(again.select("number"))), "number", "left_semi").select("number", "text")
    windows = settled(read.dropDuplicates(["number"]).join(again, "number").mapInPandas(extend, "a long, b long, place long"))
    groups = windows.groupBy("a", "b").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    later = spread_join(windows, settled(groups.where("n > 1")), ["a", "b"], "n").where(F.col("place") > F.col("first"))

    word = F.lit((1 << PLACE_BITS) - 1)
    of = lambda c: F.shiftright(c, PLACE_BITS)
    begin = F.when(of("place") == of("first"), F.greatest(F.col("place"), F.col("first") + least_words)).otherwise(F.col("place")).bitwiseAND(word)
    runs = later.select(of("place").alias("number"), begin.cast("int").alias("begin"), (F.col("place").bitwiseAND(word) + least_words).cast("int").alias("end"))
    runs = runs.groupBy("number").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    copies = named.where("number > first").select(*key, F.array(F.lit(0)).alias("begins"), F.array(F.col("n_words").cast("int")).alias("ends"))
    runs = settled(runs.join(originals, "number").select(*key, "begins", "ends").unionByName(copies))
    runs = runs.select(F.struct(F.col("ka").alias("a"), F.col("kb").alias("b")).alias("key"), "begins", "ends")

    def kept(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for whole, begins, ends in columns:
            yield pd.DataFrame([without(t, a, b) for t, a, b in zip(whole, begins, ends)], columns=["text", "n_deleted"])

    cut = F.pandas_udf(kept, "text string, n_deleted long")
    few = hinted(settled(runs.select("key")))
    base = docs.select(kept_columns(docs, "n_deleted").alias("own"), row_key("doc_id", "text").alias("key"))
    whole = base.join(few, "key", "left_anti").select("own", F.lit(0).cast("long").alias("n_deleted"))
    touched = base.join(few, "key", "left_semi").join(runs, "key").select("own", cut("own.text", "begins", "ends").alias("cut"))
    touched = touched.select(F.col("own").withField("text", F.col("cut.text")).alias("own"), F.col("cut.n_deleted").alias("n_deleted"))
    return whole.unionByName(touched).select("own.*", "n_deleted")
