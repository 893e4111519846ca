"""Tables over result rows: pivots, nearest matches, best rows, and checks against archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .windows import numbered


def arms_side_by_side(rows: DataFrame, key: list[str], arm: str, arms: list[str], value: str, all_arms: bool = False) -> DataFrame:
    """One row a key with a column for each arm; all_arms drops keys that lack one."""
    wide = rows.groupBy(*key).pivot(arm, arms).agg(F.max(value))
    return wide.dropna(subset=arms) if all_arms else wide


def nearest_match(left: DataFrame, right: DataFrame, equal: list[str], size: str, order: str) -> DataFrame:
    """For each left row the right row with the same `equal` columns whose size is nearest, the first by `order` of equals; left rows without one go.

    Both sides are sorted by size together, once: the nearest is the last right row before a left one, or the first behind it. No pairs are made.
    """
    row = F.struct(*[c for c in right.columns if c not in equal])
    firsts = right.groupBy(*equal, F.col(size).alias("_size")).agg(F.min_by(F.struct(F.col(order).alias("order"), row.alias("row")), order).alias("_r"))  # one a size
    own = F.struct(*left.columns)
    both = left.select(*equal, F.col(size).alias("_size"), own.alias("_l")).unionByName(firsts, allowMissingColumns=True)
    seen = F.when(F.col("_r").isNotNull(), F.struct("_size", F.col("_r.order").alias("order"), F.col("_r.row").alias("row")))
    along = Window.partitionBy(*equal).orderBy("_size")
    before = F.last(seen, ignorenulls=True).over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(seen, ignorenulls=True).over(along.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    gap = lambda x: F.struct(F.abs(F.col("_size") - x["_size"]).alias("gap"), x["order"].alias("order"), x["row"].alias("row"))
    met = both.withColumns({"_before": before, "_after": after}).where("_l IS NOT NULL AND (_before IS NOT NULL OR _after IS NOT NULL)")
    near = F.array_min(F.array_compact(F.array(F.when(F.col("_before").isNotNull(), gap(F.col("_before"))), F.when(F.col("_after").isNotNull(), gap(F.col("_after"))))))
    return met.withColumn("_near", near).select("_l.*", F.col("_near.row").alias("match"), F.col("_near.gap").alias("gap"))


def best_rows(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", first).where(F.col("_n") == 1).drop("_n")


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, spread: the largest less the smallest value of each cell, null for a single row."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.when(F.count(value) >= 2, F.max(value) - F.min(value)).alias("spread"))


def rounded(value: Column, places: int) -> Column:
    """A double at so many places by scaling it, half away from zero, as SQL engines do. F.round looks at the digits that a double is written with, and takes
    938.9437499999999, a mean of prices whose ten thousandfold is 9389437.5 as a double, for less than half."""
    scaled = F.abs(value) * 10.0**places
    whole = F.floor(scaled)
    up = F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole) / 10.0**places
    return F.when(scaled < float(1 << 52), F.when(value < 0, -up).otherwise(up)).otherwise(value)  # beyond that, and for NaN, there is nothing to round


def detection(p: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % detection floor and the effect that 80 % power finds, of two shares of n each."""
    se = F.sqrt(2 * p * (1 - p) / n)
    return 1.96 * se, (1.96 + 0.8416) * se


def reproduction(new: DataFrame, archive: DataFrame, key: list[str], values: list[str], tolerance: float = 0.005, counts: list[str] | None = None) -> DataFrame:
    """key, worst, status: `new` against `archive`, both rounded to 4 places; what `counts` names must be equal."""
    old = archive.select(*key, *[F.col(v).alias(f"_old_{v}") for v in (*values, *(counts or []))])
    gaps = [F.abs(F.round(v, 4) - F.round(f"_old_{v}", 4)) for v in values]
    worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    joined = new.join(old, key, "left").withColumn("worst", F.round(worst, 9))
    same = F.lit(True)
    for c in counts or []:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    status = F.when(F.col("worst").isNull(), "UNMATCHED").when(~same, "FAILED").when(F.col("worst") == 0, "OK exact").when(F.col("worst") <= tolerance, "OK within one question").otherwise("FAILED")
    return joined.select(*key, "worst", status.alias("status"))


def dummies(column: str, values: list[str]) -> dict[str, Column]:
    """0/1 columns for the named values of a category; those not named are the base."""
    return {f"{column}[{v}]": (F.col(column) == v).cast("double") for v in values}


def least_squares(rows: DataFrame, y: str, xs: dict[str, Column]) -> DataFrame:
    """term, coef, se, low, high, t, p, r2 and dof of y on named columns and a constant.

    One pass sums products on the executors; only the normal matrix, a number for each two terms, comes back. Columns are
    centred by their means first, so that large values don't drown the sums.
    """
    import numpy as np

    names = list(xs)
    plain = rows.select(F.col(y).cast("double").alias("y"), *[xs[c].cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    means = plain.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(names))]).first()
    n, k = means["n"], len(names)
    moved = {c: F.col(c) - F.lit(means[c]) for c in ("y", *[f"x{i}" for i in range(k)])}
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = plain.agg(
        *[F.sum(moved[f"x{i}"] * moved[f"x{j}"]).alias(f"s{i}_{j}") for i, j in pairs], *[F.sum(moved[f"x{i}"] * moved["y"]).alias(f"y{i}") for i in range(k)], F.sum(moved["y"] * moved["y"]).alias("yy")
    ).first()
    matrix = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float).reshape(k, k)
    inverse = np.linalg.inv(matrix)
    right = np.array([sums[f"y{i}"] for i in range(k)], float)
    beta = inverse @ right
    rest = float(sums["yy"] - beta @ right)
    dof = n - k - 1
    sigma = rest / dof
    at = np.array([means[f"x{i}"] for i in range(k)], float)
    coefs = [float(means["y"] - beta @ at), *map(float, beta)]
    errors = [float(np.sqrt(sigma * (1 / n + at @ inverse @ at))), *map(float, np.sqrt(sigma * np.diag(inverse)))]
    table = [(name, c, e, c - 1.96 * e, c + 1.96 * e, c / e, _two_sided(c / e, dof), 1 - rest / float(sums["yy"]), int(dof)) for name, c, e in zip(["intercept", *names], coefs, errors)]
    return rows.sparkSession.createDataFrame(table, "term string, coef double, se double, low double, high double, t double, p double, r2 double, dof long")


def _two_sided(t: float, dof: int) -> float:
    """The probability of a value of Student's t at least as far from 0: the incomplete beta function as a continued fraction."""
    from math import exp, lgamma, log

    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x in (0.0, 1.0):
        return x

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 500):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + step * d, 1 + step / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return out

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def largest_spread(rows: DataFrame, by: list[str], value: str, n: Column) -> DataFrame:
    """n, p_bar, floor, mde and the largest spread among cells of a grid of shares (value) of n questions each."""
    largest = spread(rows, by, value).agg(F.max("spread")).first()[0]
    one = rows.agg(F.max(n).alias("n"), F.avg(value).alias("p_bar"))
    floor, mde = detection(F.col("p_bar"), F.col("n"))
    return one.select("n", "p_bar", floor.alias("floor_95"), mde.alias("mde_80"), F.lit(largest).alias("max_spread"))


def direction_checks(grid: DataFrame, reranked: DataFrame, n_questions: int) -> DataFrame:
    """claim, value, replicates (yes, no, n/a) of five claims about a sweep, each by its rule.

    grid: method, size, overlap, recall_1, recall_5, avg_size; reranked: size, small (whether it is the small-chunk one), delta of recall at 1.
    """
    own = spread(grid, ["size", "overlap"], "recall_5").agg(F.avg("spread")).first()[0]
    lo, hi = grid.agg(F.min("size"), F.max("size")).first()
    small, mean, largest = reranked.agg(F.max(F.when(F.col("small"), F.col("delta"))), F.avg(F.when(~F.col("small"), F.col("delta"))), F.max(F.when(~F.col("small"), F.col("delta")))).first()
    number = lambda x: F.lit(x).cast("double")
    effect = F.avg(F.when(F.col("size") == hi, F.col("recall_5"))) - F.avg(F.when(F.col("size") == lo, F.col("recall_5"))) if lo != hi else number(None)
    r = F.coalesce(F.nanvl(F.corr("avg_size", "recall_5"), F.lit(0.0)), F.lit(0.0))
    one = grid.agg(F.count(F.lit(1)).alias("n"), r.alias("r"), effect.alias("effect"), F.max("recall_5").alias("best"), F.avg("recall_1").alias("p"))
    moved = {"spread": number(own), "d_small": number(small), "d_mean": number(mean), "d_max": number(largest)}
    all_ = one.withColumns(moved | {"two_se": 2 * F.sqrt(F.col("p") * (1 - F.col("p")) / n_questions)})

    def check(claim: str, value: Column, known: Column, holds: Column, unknown: str = "n/a") -> Column:
        return F.struct(F.lit(claim).alias("claim"), F.round(value, 4).alias("value"), F.when(~known, unknown).when(holds, "yes").otherwise("no").alias("replicates"))

    c = F.col
    tracked = F.when(c("n") >= 2, c("r"))
    rows = F.array(
        check("recall tracks chunk size", tracked, tracked.isNotNull(), c("r") >= 0.5),
        check("size effect above method spread", c("effect") - c("spread"), (c("effect") - c("spread")).isNotNull(), c("effect") > c("spread"), "no"),
        check("dense retrieval stays strong", c("best"), c("best").isNotNull(), c("best") >= 0.8),
        check("reranking helps small chunks", c("d_small"), c("d_small").isNotNull() & c("d_mean").isNotNull(), (c("d_small") >= c("two_se")) & (c("d_small") > c("d_mean"))),
        check("reranking leaves large chunks", c("d_max"), c("d_max").isNotNull(), c("d_max") < c("two_se")),
    )
    return all_.select(F.explode(rows).alias("x")).select("x.*")


def ordered_fingerprint(rows: DataFrame, value: str, order: str, block: int = 1000) -> DataFrame:
    """fingerprint, n_blocks: a digest of values in order. Runs of `block` values are digested side by side, then runs of their digests, until one is left.

    Values are numbered by ranges, so that no task holds more than a run, whatever the order values are.
    """
    level = numbered(rows.select(F.col(order).alias("o"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v")), ["o", "v"], "at")
    n_blocks, mark = None, "\n"
    while True:
        own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), mark)
        level = settled(level.groupBy(F.floor((F.col("at") - 1) / block).alias("run")).agg(F.sha2(own.cast("binary"), 256).alias("v")).select((F.col("run") + 1).alias("at"), "v"))
        n = level.count()
        n_blocks, mark = n if n_blocks is None else n_blocks, ""
        if n <= 1:
            return level.select(F.col("v").alias("fingerprint"), F.lit(n_blocks).cast("long").alias("n_blocks"))
