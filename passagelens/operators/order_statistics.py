"""Exact order statistics of groups of any size: ranges are narrowed by counts, so that no task holds a group's values.

For each wanted place, a sketch of bounded size names two values between which the place is likely to be; exact counts below and up to these say where it is, and the
range shrinks to that part. When few values are left in a range, they are sorted. Each round reads the rows once, with sums made where they are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .retrieval import hinted

#: A range of so many values is sorted; how finely sketches place values.
FEW, ACCURACY = 10_000, 2_000


def _key(by: list[str]) -> Column:
    """Groups with nulls in their columns are groups, too."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")


def order_statistics(rows: DataFrame, by: list[str], value: str, wanted: list[Column], few: int = FEW) -> DataFrame:
    """by, n and values: the values at places `wanted` (from 0, whole-number expressions of the group's n) of each group's sorted values. Null values don't count."""
    rows = settled(rows.where(F.col(value).isNotNull()).select(*by, _key(by).alias("_g"), F.col(value).alias("_v")))
    groups = settled(rows.groupBy("_g").agg(*(F.any_value(c).alias(c) for c in by), F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")))
    places = groups.select("_g", "n", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.posexplode(F.array(*(w.cast("long") for w in wanted))).alias("w", "place"))
    # A range holds the values from low to high; `below` counts the smaller ones.
    ranges, done = settled(places), []
    while True:
        one = (F.col("low") == F.col("high")) | (F.col("place") < 0) | (F.col("place") >= F.col("n"))
        done.append(settled(ranges.where(one).select("_g", "w", F.when((F.col("place") >= 0) & (F.col("place") < F.col("n")), F.col("low")).alias("x"))))
        left = ranges.where(~one)
        small, large = left.where(F.col("inside") <= few), settled(left.where(F.col("inside") > few))
        held = rows.join(hinted(settled(small)), "_g").where(F.col("_v").between(F.col("low"), F.col("high")))
        listed = held.groupBy("_g", "w").agg(F.any_value("place").alias("place"), F.any_value("below").alias("below"), F.array_sort(F.collect_list("_v")).alias("vs"))
        done.append(settled(listed.select("_g", "w", F.get("vs", (F.col("place") - F.col("below")).cast("int")).alias("x"))))
        if large.isEmpty():
            break
        at = (F.col("place") - F.col("below")) / F.col("inside").cast("double")
        inside = rows.join(hinted(large), "_g").where(F.col("_v").between(F.col("low"), F.col("high")))
        # One sketch a range, asked for the two shares around the place: the shares of a grid of ACCURACY.
        sketch = inside.groupBy("_g", "w").agg(F.percentile_approx("_v", [i / 64 for i in range(65)], ACCURACY).alias("grid"))
        step = F.floor(at * 64).cast("int")
        cut = settled(large.join(sketch, ["_g", "w"]).withColumns({"a": F.get("grid", F.greatest(step - 1, F.lit(0))), "b": F.get("grid", F.least(step + 2, F.lit(64)))}).drop("grid"))
        v = F.col("_v")
        counted = rows.join(hinted(cut), "_g").where(v.between(F.col("low"), F.col("high"))).groupBy("_g", "w").agg(
            F.count_if(v < F.col("a")).alias("n_a"), F.count_if(v <= F.col("b")).alias("n_b"), F.max(F.when(v < F.col("a"), v)).alias("under"), F.min(F.when(v > F.col("b"), v)).alias("over")
        )
        both = cut.join(counted, ["_g", "w"])
        rank = F.col("place") - F.col("below")
        first, last = rank < F.col("n_a"), rank >= F.col("n_b")
        narrowed = both.select(
            "_g", "w", "n", "place",
            F.when(first, F.col("low")).when(last, F.col("over")).otherwise(F.col("a")).alias("low"),
            F.when(first, F.col("under")).when(last, F.col("high")).otherwise(F.col("b")).alias("high"),
            (F.col("below") + F.when(first, 0).when(last, F.col("n_b")).otherwise(F.col("n_a"))).alias("below"),
            F.when(first, F.col("n_a")).when(last, F.col("inside") - F.col("n_b")).otherwise(F.col("n_b") - F.col("n_a")).alias("inside"),
        )
        before = large.agg(F.sum("inside")).first()[0]
        ranges = settled(narrowed)
        if ranges.agg(F.sum("inside")).first()[0] == before:  # a sketch that only names the ends: halve what is there
            middle = (F.col("low") / 2 + F.col("high") / 2).cast(dict(rows.dtypes)["_v"])
            ranges = settled(_halved(rows, ranges, middle))
    every = reduce(DataFrame.unionByName, done)
    listed = every.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]).alias("values"))
    return groups.join(listed, "_g").select(*by, "n", "values")


def _halved(rows: DataFrame, ranges: DataFrame, middle: Column) -> DataFrame:
    v = F.col("_v")
    cut = settled(ranges.withColumn("m", middle))
    counted = rows.join(hinted(cut), "_g").where(v.between(F.col("low"), F.col("high"))).groupBy("_g", "w").agg(F.count_if(v <= F.col("m")).alias("n_m"), F.max(F.when(v <= F.col("m"), v)).alias("under"), F.min(F.when(v > F.col("m"), v)).alias("over"))
    left = (F.col("place") - F.col("below")) < F.col("n_m")
    return cut.join(counted, ["_g", "w"]).select("_g", "w", "n", "place", F.when(left, F.col("low")).otherwise(F.col("over")).alias("low"), F.when(left, F.col("under")).otherwise(F.col("high")).alias("high"), (F.col("below") + F.when(left, 0).otherwise(F.col("n_m"))).alias("below"), F.when(left, F.col("n_m")).otherwise(F.col("inside") - F.col("n_m")).alias("inside"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], few: int = FEW) -> DataFrame:
    """by, n and q: the percentiles at the shares, between neighbours in proportion; exact."""
    at = [share * (F.col("n") - 1) for share in shares]
    found = order_statistics(rows, by, value, [p for a in at for p in (F.floor(a), F.ceil(a))], few)
    between = [F.get("values", 2 * i) + (a - F.floor(a)) * (F.get("values", 2 * i + 1) - F.get("values", 2 * i)) for i, a in enumerate(at)]
    return found.select(*by, "n", F.array(*between).alias("q"))


def upper_medians(rows: DataFrame, by: list[str], value: str, few: int = FEW) -> DataFrame:
    """by, n and upper_median: the value in the middle of each group, the upper of two."""
    return order_statistics(rows, by, value, [F.floor(F.col("n") / 2)], few).select(*by, "n", F.get("values", 0).alias("upper_median"))
