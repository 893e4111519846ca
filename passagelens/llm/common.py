"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound
from ..sources.scratch import discard, mark, remove, settled, shared_folder, small_batches, spread  # noqa: F401

#: Fixed patterns of the contracts: what separates words, and what makes them up.
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A table of at most so many narrow rows (some 20 bytes each) may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hinted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcasting if it is counted to have few rows; df must be cheap to count (settled)."""
    return F.broadcast(df) if df.count() <= most else df


def row_key(*columns: str) -> Column:
    """128 bits that stand for the named columns' values: two hashes that start differently."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def kept_columns(df: DataFrame, *replaced: str) -> Column:
    """df's columns as one struct, but for those that an operator adds itself: so no name of its own can clash with theirs."""
    own = [df[c] for c in df.columns if c not in replaced]
    return F.struct(*own) if own else F.struct(F.lit(None).alias("_"))


def pieces(text: Column, gap: str) -> Column:
    """What stands between the gaps of a text; an empty piece may come first and last."""
    return F.split(F.coalesce(text, F.lit("")), gap)


def n_pieces(parts: Column) -> Column:
    """The number of words in pieces(); parts should be a column or bound."""
    ends = F.when(parts[0] == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return bound(pieces(text, WORD_GAP), n_pieces)


def words_of(text: Column) -> Column:
    """The words of a text that is in lower case already; null has none."""

    def trimmed(parts: Column) -> Column:
        return F.slice(parts, F.when(parts[0] == "", 2).otherwise(1), n_pieces(parts).cast("int"))

    return bound(pieces(text, WORD_GAP), trimmed)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Stands for a null doc_id where ids are compared: after all others.
NO_ID = (1 << 63) - 1


def number_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def train_row(doc_id: Column) -> Column:
    """Rows that models may learn labels from; a row without an id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning by their id; one without an id has no remainder and is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str, hot: int = 10_000) -> DataFrame:
    """left joined with right, which is settled, has one row a key and says in column n how many rows of left it meets.

    A key of more than `hot` rows is joined by a broadcast of such keys, of which there are at most len(left) / hot, so
    that its rows stay where they are; only the others are shuffled.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on)
    large = hinted(settled(right.where(F.col(n) > hot)))
    rest = left.join(large.select(*on), on, "left_anti").join(right.where(F.col(n) <= hot), on)
    return left.join(large, on).unionByName(rest)


def in_order(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df, settled, with consecutive numbers from 1 in the given order: ranges are sorted side by side and counted."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = settled(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    first, total = [], 0
    for part, n in sorted(ranged.groupBy("_part").count().collect()):  # a number a partition
        first += [F.lit(part), F.lit(total)]
        total += n
    before = F.create_map(*first)[F.col("_part")] if first else F.lit(0)
    return ranged.withColumn(name, (before + F.col("_at") + 1).cast("long")).drop("_part", "_at")
