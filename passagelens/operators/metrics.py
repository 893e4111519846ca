"""Scores of retrieval, of boundaries, and of paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .order_statistics import percentiles


def recall_at_k(questions: DataFrame, hits: DataFrame, ks: list[int]) -> DataFrame:
    """k, n_questions, recall, recall_unconstrained. hits: qid, rank, in_gold, holds_answer. A question without candidates counts as a miss."""
    flags = [F.max(F.when((F.col("rank") <= k) & c, 1).otherwise(0)).alias(f"{name}{k}") for k in ks for name, c in (("c", F.col("in_gold") & F.col("holds_answer")), ("u", F.col("holds_answer")))]
    per_question = questions.select("qid").distinct().join(hits, "qid", "left").groupBy("qid").agg(*flags)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("c"), F.col(f"u{k}").alias("u")) for k in ks])
    each = per_question.select(F.explode(rows).alias("r")).select("r.*")
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("n_questions"), F.avg("c").alias("recall"), F.avg("u").alias("recall_unconstrained"))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def threshold_sweep(scores: DataFrame, steps: int = 99) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 of scores (p, label) that are above each threshold in single precision.

    Scores are counted by how many thresholds they pass, then summed downwards: rows are read once, not once a threshold.
    """
    thresholds = F.array(*[F.lit(round((i + 1) / (steps + 1), 10)).cast("float") for i in range(steps)])
    passed = F.size(F.filter(thresholds, lambda t: F.col("p").cast("float") > t))
    counts = scores.groupBy(passed.alias("passed")).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    every = counts.select("passed", "pos", "n", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("i"))
    above = F.col("passed") >= F.col("i")
    sums = every.groupBy("i").agg(F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"), F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select((F.col("i") / float(steps + 1)).alias("threshold"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the largest (f1, threshold)."""
    row = F.struct(*sweep.columns)
    return sweep.agg(F.max_by(row, F.struct("f1", "threshold")).alias("x")).select("x.*")


def score_diagnostics(scores: DataFrame) -> DataFrame:
    """Moments and percentiles of p for all rows (label null) and by label."""
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    both = scores.select("p", F.explode(F.array(F.lit(None).cast("string"), F.coalesce(F.col("label").cast("string"), F.lit("none")))).alias("_set"), "label")
    moments = both.groupBy("_set").agg(F.any_value("label").alias("label"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.count(F.lit(1)).alias("n"))
    spread = percentiles(both, ["_set"], "p", shares).drop("n")
    same = moments["_set"].eqNullSafe(spread["_set"])
    label = F.when(moments["_set"].isNotNull(), F.col("label"))
    return moments.join(spread, same).select(label.alias("label"), "n", "mean", "std", *[F.col("q")[i].alias(f"p{int(s * 100)}") for i, s in enumerate(shares)])


def histogram(scores: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n of p in 0..1; the last bin holds 1."""
    inside = scores.where(F.col("p").between(0.0, 1.0))
    return inside.groupBy(F.least(F.floor(F.col("p").cast("double") * bins) + 1, F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_balance(labels: DataFrame, by: list[str]) -> DataFrame:
    """pos, neg, pos_rate and pos_weight (negatives a positive; null without positives)."""
    pos, neg = F.sum(F.col("label")), F.sum(1 - F.col("label"))
    return labels.groupBy(*by).agg(pos.alias("pos"), neg.alias("neg"), F.avg("label").alias("pos_rate"), F.try_divide(neg.cast("double"), pos).alias("pos_weight"))


def mean_ci(rows: DataFrame, value: str, by: list[str], z: float = 1.96) -> DataFrame:
    """n, mean and the bounds mean -+ z s / sqrt(n); no bounds for fewer than two rows."""
    stats = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.when(F.col("n") > 1, z * F.col("sd") / F.sqrt("n"))
    return stats.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def paired(rows: DataFrame, key: list[str], arm: str, value: str, left: str, right: str) -> DataFrame:
    """key, diff: what `left` has more than `right`, for keys that both arms have."""
    sides = rows.where(F.col(arm).isin(left, right)).groupBy(*key).agg(F.max(F.when(F.col(arm) == left, F.col(value))).alias("l"), F.max(F.when(F.col(arm) == right, F.col(value))).alias("r"))
    return sides.where(F.col("l").isNotNull() & F.col("r").isNotNull()).select(*key, (F.col("l") - F.col("r")).alias("diff"))


def pearson(x: str, y: str) -> Column:
    """The correlation, 0 where there is none."""
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def two_se(p: Column, n: Column) -> Column:
    return 2 * F.sqrt(p * (1 - p) / n)


def one_se(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / n)


def reciprocal(rank: Column) -> Column:
    return F.when(rank > 0, 1.0 / rank).otherwise(0.0)


def group_loss(scores: Column, positive: Column) -> Column:
    """Listwise cross-entropy of a group: log of the summed exponentials less the positive's score."""
    top = F.array_max(scores)
    return top + F.log(F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))) - positive


def entropy(logits: Column) -> Column:
    """The entropy of the softmax of an array of logits."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.log(total) - F.aggregate(F.zip_with(weights, logits, lambda w, x: w * (x - top)), F.lit(0.0), lambda a, x: a + x) / total


def prefix_log_prob(scores: Column, k: int | Column) -> Column:
    """The Plackett-Luce log-probability of the first k of an ordered array of scores."""
    k = k if isinstance(k, Column) else F.lit(k)
    top = F.array_max(scores)

    def step(i: Column) -> Column:
        rest = F.slice(scores, i, F.size(scores))
        return F.get(scores, i - 1) - top - F.log(F.aggregate(rest, F.lit(0.0), lambda a, x: a + F.exp(x - top)))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.least(k, F.size(scores))), step), F.lit(0.0), lambda a, x: a + x)


def gumbel(name: Column) -> Column:
    """Gumbel noise that a name decides, so that a draw can be repeated anywhere."""
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return -F.log(-F.log(u))


def sampled_ranking(scores: Column, seed: Column, temperature: float = 1.0) -> Column:
    """The places (from 0) of an array of scores in an order drawn by Plackett-Luce: sorted by score over temperature plus noise."""
    keyed = F.transform(scores, lambda s, i: F.struct((-F.round(s / temperature + gumbel(F.concat_ws(":", seed.cast("string"), i.cast("string"))), 9)).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def policy_gradient(groups: DataFrame, n_samples: int, temperature: float = 1.0) -> DataFrame:
    """qid, reward, live, advantage (mean of its size) and loss of groups (qid, s: scores, the positive's first) over sampled rankings.

    The reward of a ranking is the positive's reciprocal rank, its advantage what it has more than the group's other samples, and the loss
    weighs by it the log-probability of the ranking as far as the positive. A group is live if its samples disagree.
    """
    z = F.transform("s", lambda x: x / temperature)

    def sample(order: Column) -> Column:
        rank = F.array_position(order, 0).cast("int")
        return F.struct((1.0 / rank).alias("reward"), prefix_log_prob(F.transform(order, lambda i: F.get(z, i)), rank).alias("log_prob"))

    drawn = lambda j: bound(sampled_ranking(F.col("s"), F.concat_ws(":", F.col("qid").cast("string"), j.cast("string")), temperature), sample)
    each = groups.select("qid", F.transform(F.sequence(F.lit(1), F.lit(n_samples)), drawn).alias("x"))  # a group's samples stay in its row
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["reward"])
    advantage = lambda x: x["reward"] - (total - x["reward"]) / (n_samples - 1)
    mean = lambda f: F.aggregate("x", F.lit(0.0), lambda a, x: a + f(x)) / n_samples
    rewards = F.transform("x", lambda x: x["reward"])
    return each.select("qid", (total / n_samples).alias("reward"), (F.array_max(rewards) > F.array_min(rewards)).alias("live"), mean(lambda x: F.abs(advantage(x))).alias("advantage"), mean(lambda x: -advantage(x) * x["log_prob"]).alias("loss"))


def choice_log_prob(logits: Column, choices: Column, temperature: float = 1.0) -> Column:
    """(log_prob, entropy): the summed log-probability of a rollout's choices (lo, hi, chosen) under the softmax of each window of logits, and the mean entropy
    of the windows; windows of one place decide nothing."""

    def window(c: Column) -> Column:
        own = F.transform(F.slice(logits, c["lo"] + 1, c["hi"] - c["lo"] + 1), lambda x: x / temperature)
        return F.struct((F.get(own, c["chosen"] - c["lo"]) - F.array_max(own) - F.log(F.aggregate(own, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(own))))).alias("p"), entropy(own).alias("h"))

    each = F.transform(F.filter(choices, lambda c: c["hi"] > c["lo"]), window)
    total = lambda name: F.aggregate(each, F.lit(0.0), lambda a, x: a + x[name])
    return F.struct(total("p").alias("log_prob"), F.coalesce(F.try_divide(total("h"), F.size(each)), F.lit(0.0)).alias("entropy"))


def answer_roll_up(rows: DataFrame, by: list[str], short: int = 5) -> DataFrame:
    """Scores of reader runs by arm. rows: accurate, exact, f1, hit (null where nothing was retrieved), n_answer (words of the answer), n_words,
    n_tokens, n_cut, in_prompt (null without passages), shown (whether the passages held the answer before they were cut).

    Means of accuracy, exact match and F1 over all, of accuracy where a hit was shown and where not, for short answers and for long ones, each with
    its n; means of lengths; how many passages were cut, and how many answers were lost by that.
    """
    number = lambda c: F.col(c).cast("double")
    accurate, is_short = number("accurate"), F.col("n_answer") <= short

    def part(name: str, condition: Column) -> list[Column]:
        return [F.avg(F.when(condition, accurate)).alias(f"accuracy_{name}"), F.count_if(condition).alias(f"n_{name}")]

    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(accurate).alias("accuracy"),
        F.avg(number("exact")).alias("exact"),
        F.avg("f1").alias("f1"),
        *part("hit", F.col("hit")),
        *part("miss", ~F.col("hit")),
        *part("short", is_short),
        *part("long", ~is_short),
        F.avg("n_words").alias("mean_words"),
        F.avg("n_tokens").alias("mean_tokens"),
        F.sum("n_cut").alias("n_cut"),
        F.count_if(~F.col("in_prompt") & F.col("shown")).alias("n_lost"),
    )


def scores_at(scores: DataFrame, threshold: float | Column, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of scores (p, label) above one threshold in single precision."""
    at = threshold if isinstance(threshold, Column) else F.lit(threshold)
    up, true = F.col("p").cast("float") > at.cast("float"), F.col("label") == 1
    counts = scores.groupBy(*by).agg(F.count_if(up & true).alias("tp"), F.count_if(up & ~true).alias("fp"), F.count_if(~up & true).alias("fn"))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f1})


def calibrated(scores: DataFrame, reference: float = 0.8, fallback: float = 0.5) -> DataFrame:
    """split, threshold, kind and scores: the threshold of best F1 on the rows of split `val`, and a fixed one, both on val and test.

    Without positives in val there is nothing to calibrate on, and the fallback stands. scores: split, p, label.
    """
    val = scores.where("split = 'val'")
    sweep = best_threshold(threshold_sweep(val)).first()
    chosen = float(sweep.threshold) if sweep and (sweep.tp or 0) + (sweep.fn or 0) > 0 else fallback
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("threshold")) for kind, t in (("calibrated", chosen), ("fixed", reference))])
    both = scores.where("split IN ('val', 'test')").select("*", F.explode(kinds).alias("x")).select("split", "p", "label", "x.*")
    return scores_at(both, F.col("threshold"), ["split", "kind", "threshold"])


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Counts of a boundary corpus (split, labels): documents and boundaries, in all and by split."""
    each = docs.select("split", F.size("labels").alias("n"), F.aggregate("labels", F.lit(0), lambda a, x: a + x).alias("pos"))
    sums = each.cube("split").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    return sums.withColumns({"pos_rate": F.coalesce(F.try_divide(F.col("pos").cast("double"), F.col("pos") + F.col("neg")), F.lit(0.0)), "pos_weight": F.try_divide(F.col("neg").cast("double"), F.col("pos"))})
