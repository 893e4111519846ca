"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

1. Targets. Sources in the order of their names weigh 5, 2, 1, repeating, and share the words of the mix by weight; what a source
   may not take (`most` times its size) is dealt out again among the others until none is above.
2. Inclusion. Documents of a source have unequal odds: a document's expected copies are its source's level times its measure, a
   small whole number, at most `most`. The measure is the number of binary digits of its size unless a column is named, so that
   longer documents are likelier, though far less than in proportion. The level is where the expected words add up to the target.
3. Certain copies. The whole part of the expected copies is allocated; the rest is the inclusion probability of one more.
4. Order sample. Documents are ranked by the odds of a keyed random number over the odds of their inclusion, and the lowest ranks
   are taken until the words of the target are reached: a sample of fixed size in words with unequal probabilities.

A source's rank order is never gathered in one task: ranks fall into ranges whose words are summed with map-side aggregation, the range
in which the target is reached is cut finer until it has few rows, and only these are ordered row by row. Names of sources are
numbered by ranges, and their level is found by sums over all of them, so that sources may be many.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own,
ordered last; rows that repeat a doc_id are separate rows that share their random number, rows without one take it from their
text, and among rows alike in all of these any may be taken first; an empty table gives an empty table; columns besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_GAP, bound, hinted, in_order, n_pieces, pieces, settled

#: Ranks are numbers of BITS bits, cut by STEP bits at a time until a source's last range has FEW rows.
BITS, STEP, FEW = 40, 10, 10_000


def uniform(name: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that only name and seed decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sized: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """source, source_size, target: share of all words dealt by weight, at most `most` times a source's size."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = in_order(sources, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    dealt = settled(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)))
    total, open_ = dealt.agg(F.sum("source_size"), F.sum("weight")).first()
    whole = (total or 0) * share
    level, full = whole / (open_ or 1.0), -1
    while open_:  # each round only adds full sources
        is_full = F.col("cap") < F.col("weight") * F.lit(level)
        now, open_ = dealt.agg(F.sum(F.when(is_full, F.col("source_size")).otherwise(0)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if now == full or not open_:
            break
        full, level = now, (whole - now * most) / open_
    return dealt.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def expected_copies(sized: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """source, measure, source_size, target, certain, chance, left (the words to be drawn) of each class of documents.

    A source has as many classes as values of the measure. With the classes in falling order, those before the first whose
    level stays within `most` are full.
    """
    classes = sized.groupBy("source", "measure").agg(F.sum("size").alias("words"))
    classes = _with_source(classes, goals)
    own = Window.partitionBy("source")
    down = own.orderBy(F.col("measure").desc())
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * F.col("measure")).over(down.rowsBetween(0, Window.unboundedFollowing))
    level = F.try_divide(F.col("target") - full * F.lit(most), open_.cast("double"))
    found = classes.withColumn("level", level)
    found = found.withColumn("level", F.max(F.when(F.col("level") * F.col("measure") <= most, F.col("level"))).over(own))
    copies = F.when(F.col("measure") > 0, F.least(F.lit(most), F.coalesce(F.col("level") * F.col("measure"), F.lit(most)))).otherwise(F.lit(0.0))
    found = found.withColumn("copies", copies).withColumn("certain", F.floor("copies")).withColumn("chance", F.col("copies") - F.col("certain"))
    left = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(own)
    return found.withColumn("left", left).select("source", "measure", "source_size", "target", "certain", "chance", "left")


def _with_source(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
    """left with the columns of right, a row for each source (and each value of `also`)."""
    named = right.withColumnsRenamed({c: f"_{c}" for c in ("source", *also)})
    same = F.col("source").eqNullSafe(F.col("_source"))
    for c in also:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return left.join(hinted(named), same, "left").drop("_source", *[f"_{c}" for c in also])


def _cuts(drawn: DataFrame) -> tuple[DataFrame, int]:
    """source, bin, before: the range of each source's ranks in which its words are reached, with the words before; and the bits below a bin."""
    shift, cuts = BITS, None
    while True:
        shift -= STEP
        bin_ = F.shiftright("rank", shift)
        rows = drawn.withColumn("bin", bin_)
        if cuts is not None:
            rows = _with_source(rows, cuts.select("source", F.col("bin").alias("above"), F.col("before").alias("base"))).where(F.shiftright("bin", STEP) == F.col("above"))
        else:
            rows = rows.withColumn("base", F.lit(0).cast("long"))
        bins = rows.groupBy("source", "left", "base", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        reached = bins.withColumn("before", upto - F.col("words")).where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
        cuts = settled(reached.groupBy("source").agg(F.min(F.struct("bin", "before", "n")).alias("x")).select("source", "x.*"))
        if shift == 0 or (cuts.agg(F.max("n")).first()[0] or 0) <= FEW:
            return cuts.drop("n"), shift


def pareto_mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, seed: int = 20, measure: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, measure, copies and taken (copies x size) for each row of docs.

    measure: a column of whole numbers from 1 to some hundreds, by which documents are the likelier.
    """
    size = bound(pieces(F.col("text"), SPACE_GAP), n_pieces)
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sized = docs.select("doc_id", "source", size.alias("size"), uniform(name, seed).alias("u"), *([F.col(measure).cast("long").alias("own")] if measure else []))
    value = F.col("own") if measure else F.length(F.bin("size"))
    sized = settled(sized.withColumn("measure", F.when(F.col("size") > 0, value).otherwise(0).cast("long")).drop("own"))
    goals = settled(source_targets(sized, share, weights, most))
    classes = settled(expected_copies(sized, goals, most))

    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    ranked = _with_source(sized, classes, "measure").withColumn("rank", F.when(F.col("chance") > 0, F.floor(odds / (1 + odds) * float(1 << BITS))))
    cuts, shift = _cuts(ranked.where(F.col("rank").isNotNull()))
    cut = _with_source(ranked, cuts).withColumn("side", F.coalesce(F.signum(F.shiftright("rank", shift) - F.col("bin")), F.lit(1.0)))
    clear = cut.where(F.col("side") != 0).withColumn("extra", (F.col("side") < 0).cast("long"))
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("before") + F.sum("size").over(in_order) - F.col("size")
    edge = cut.where(F.col("side") == 0).withColumn("extra", (2 * reached + F.col("size") <= 2 * F.col("left")).cast("long"))
    copies = (F.col("certain") + F.col("extra")).cast("long")
    return clear.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", "measure", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
