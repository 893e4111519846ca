"""Groups of spelling variants: words one edit apart, and of each word the most frequent that is clearly more frequent.

Words are counted inside the tasks that read the texts, and added up by word. Two words are near if one inserted, deleted or replaced code
point makes one of the other. The shorter of the two (both, at one length) contributes two disjoint chunks, its halves; the other contributes
the positional grams that such chunks can be equal to: one edit leaves one of the halves as it is, at its place if it stands before the edit, moved by the
difference of the lengths if it stands behind it. So words meet on (length, difference, place, chunk), and what meets is compared.

A chunk that too many words share is split again, rather than compared pair by pair: one edit in the rest of the word leaves one half of that rest as
it is, too. A key is therefore the first a and the last b code points of a word; splitting goes on, for crowded keys alone, up to the edit itself, where all that
meet are near. Keys in use hold at most PARTNERS words for each word, or pairs that are near for certain, so that comparisons grow as the number of
words does. No key is dropped.

Defined results: null texts have no words; a row without a doc_id counts as one whose id is the empty text; rows that repeat a doc_id count each;
an empty table, or one without frequent words, gives an empty table; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Distinct words that a task holds before it hands them on; texts are read so many characters at a time.
HELD, STRETCH = 300_000, 1 << 20
#: Words that a key may bring together with each of its words, and words of a key, before it is split.
PARTNERS, CROWD = 8, 10_000
#: Bytes that a table's keys and words may have to be broadcast.
BROADCAST_BYTES = 16 << 20


def _stretches(text: str) -> Iterator[str]:
    """text in stretches that don't end inside a run of letters."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text) and (m := _RUN.match(text, end)) is not None:
            end = m.end()
        yield text[at:end]
        at = end


def run_counts(text: str) -> Counter:
    """How often each maximal run of letters stands in a text, A-Z in lower case."""
    out: Counter = Counter()
    for part in _stretches(text):
        low = part.lower() if part.isascii() else part.translate(_ASCII_LOWER)
        out.update(_RUN.findall(low))
    return out


def word_counts(docs: DataFrame, least_length: int = 5, least: int = 3, damaged: int = 97) -> DataFrame:
    """word, n of the words of at least least_length code points that occur least times. Of the runs of a document whose hash
    `damaged` divides, one code point is deleted first."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for frame in frames:
            for doc_id, text in zip(frame.doc_id, frame.text):
                start = zlib.crc32(f"{doc_id}:".encode())
                for run, n in run_counts(text).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % damaged == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) >= least_length:
                        held[run] = held.get(run, 0) + n
                if len(held) >= HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = {}
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _key() -> Column:
    """What words of one key share: the length of the shorter, the difference, and the code points before a and from b before the end."""
    return F.xxhash64("len", "diff", "a", "b", F.expr("left(word, a)"), F.expr("right(word, b)"))


def _split(rows: DataFrame) -> DataFrame:
    """Each row (word, n, len, diff, gram, a, b) once for each half of its open middle, of which len - a - b code points of the shorter word are left."""
    open_ = F.col("len") - F.col("a") - F.col("b")
    front = F.greatest(F.floor(open_ / 2).cast("int"), F.lit(1))
    back = F.greatest(open_ - front, F.lit(1))
    halves = F.array(F.struct((F.col("a") + front).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + back).alias("b")))
    return rows.withColumn("_half", F.explode(halves)).withColumns({"a": F.col("_half.a"), "b": F.col("_half.b")}).drop("_half").withColumn("key", _key())


def near_pairs(words: DataFrame, partners: int = PARTNERS, crowd: int = CROWD) -> DataFrame:
    """word, n, other, other_n: all ordered pairs of near words, each once. words: word (each once), n."""
    sized = words.withColumn("size", F.length("word"))
    roles = F.array(
        F.struct(F.col("size").alias("len"), F.lit(0).alias("diff"), F.lit(True).alias("chunk"), F.lit(True).alias("gram")),
        F.struct(F.col("size").alias("len"), F.lit(1).alias("diff"), F.lit(True).alias("chunk"), F.lit(False).alias("gram")),
        F.struct((F.col("size") - 1).alias("len"), F.lit(1).alias("diff"), F.lit(False).alias("chunk"), F.lit(True).alias("gram")),
    )
    rows = sized.select("word", "n", F.explode(roles).alias("role")).select("word", "n", "role.*", F.lit(0).alias("a"), F.lit(0).alias("b")).where("len > 0")
    found = []
    while True:
        rows = settled(_split(rows))
        pairs = F.col("chunks") * F.col("grams")
        allowed = F.greatest(F.lit(partners), F.lit(partners) * (F.col("chunks") + F.col("grams")))
        last = F.col("len") - F.col("a") - F.col("b") <= F.when(F.col("diff") == 0, 1).otherwise(0)
        sizes = rows.groupBy("key").agg(F.count_if("chunk").alias("chunks"), F.count_if("gram").alias("grams"), F.bool_and(last).alias("last"), F.count(F.lit(1)).alias("n_rows"))
        meeting = settled(sizes.where("chunks > 0 AND grams > 0 AND n_rows > 1").select("key", (~F.col("last") & ((pairs > allowed) | (F.greatest("chunks", "grams") > crowd))).alias("crowded")))
        kept = rows.join(meeting, "key")
        easy = kept.where("NOT crowded").drop("crowded")
        x = easy.where("chunk").select("key", "diff", F.col("word").alias("x"), F.col("n").alias("xn"))
        y = easy.where("gram").select("key", F.col("word").alias("y"), F.col("n").alias("yn"))
        both = x.join(y, "key").where(((F.col("diff") == 1) | (F.col("x") < F.col("y"))) & (F.levenshtein("x", "y", 1) == 1))
        found.append(settled(both.select("x", "xn", "y", "yn")))
        if meeting.where("crowded").isEmpty():
            break
        rows = kept.where("crowded").drop("crowded", "key")
    every = reduce(DataFrame.unionByName, found)
    ways = F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("xn").alias("n"), F.col("y").alias("other"), F.col("yn").alias("other_n")), F.struct(F.col("y").alias("word"), F.col("yn").alias("n"), F.col("x").alias("other"), F.col("xn").alias("other_n"))))
    return every.select(ways.alias("p")).select("p.*").repartition("word").dropDuplicates(["word", "other"])


def _small(df: DataFrame) -> DataFrame:
    """df, settled, marked for broadcasting where the bytes of its texts and numbers are counted to be few."""
    texts = [F.octet_length(name) for name, kind in df.dtypes if kind == "string"]
    return F.broadcast(df) if (df.agg(F.sum(sum(texts, F.lit(32)))).first()[0] or 0) <= BROADCAST_BYTES else df


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following the forms (word, form) ends. Forms have more occurrences than their words, so that there are no
    rings; each round follows twice as many. A form that many words share is a hot key of the left side only, which adaptive execution splits."""
    at = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = settled(at.select(F.col("word").alias("root"), F.col("root").alias("next")).join(at.select("root").distinct(), "root", "left_semi"))
        if onward.isEmpty():
            return at
        at = settled(at.join(_small(onward), "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, least_length: int = 5, least: int = 3, damaged: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of docs (doc_id, text)."""
    words = settled(word_counts(docs, least_length, least, damaged))
    better = F.when(F.col("other_n") >= 2 * F.col("n"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = settled(near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(better).alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
    ends = roots(near.where("form IS NOT NULL").select("word", "form"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
