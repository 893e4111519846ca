"""Sentence ends learned from a corpus without labels, after Kiss and Strunk: a period ends a sentence unless its word is an abbreviation, an initial or an
ordinal number, which counts over the corpus tell; what follows these decides in a second pass.

learn() reads the corpus once: all counts follow from how often each word stands behind a word with an end mark, behind which one, or elsewhere, which is one
grouping with partial sums where texts are read; words are looked at once for each distinct one. break_sentences() looks up each distinct pair of a word with a
period and the word after it, once; texts get only the places that are no ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .retrieval import hinted

_WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}'’.&/\-]*[\p{L}\p{N}])?"
_TOKEN = rf"{_WORD}\.*|\.{{2,}}|\S"
_CLOSING, _OPENING = "[\"')\\]”’]*", "[\"'(\\[“‘]*"
NUMBER = "##number##"
#: Fixed values of the method: how sure an abbreviation, a pair and a starter have to be, and the share of periods that abbreviations have.
ABBREVIATION, COLLOCATION, STARTER, SHARE = 0.3, 7.88, 30.0, 0.99


@dataclass
class Breaks:
    """abbreviations (type), pairs (first, second), starters (type), and cases (type, upper, upper_inside, lower, lower_first): where a type was seen."""

    abbreviations: DataFrame
    pairs: DataFrame
    starters: DataFrame
    cases: DataFrame


def word_type(form: Column) -> Column:
    """A word's type: in lower case, without periods at its end; all numbers are one."""
    bare = F.lower(F.rtrim(form, F.lit(".")))
    return F.when(F.right(bare, F.lit(1)).between("0", "9") & F.regexp_like(bare, F.lit(r"^-?[\d.,]*\d$")), NUMBER).otherwise(bare)


def _ended(form: Column) -> Column:
    """Whether a word has a period, which an ellipsis is not."""
    return F.endswith(form, F.lit(".")) & F.regexp_like(form, F.lit(r"[\p{L}\p{N}]\.$"))


def _is_word(form: Column) -> Column:
    return F.regexp_like(form, F.lit(r"^[\p{L}\p{N}]"))


def _is_initial(type_: Column) -> Column:
    return F.regexp_like(type_, F.lit(r"^\p{L}$"))


def _log(x: Column) -> Column:
    """ln x, 0 where there is nothing to take it of: such terms are multiplied by 0."""
    return F.when(x > 0, F.ln(x)).otherwise(0.0)


def abbreviation_score(with_: Column, without: Column, type_: Column, periods: float, total: float) -> Column:
    """How sure it is that a type that stands with_ a period so often, and without one, is an abbreviation: the log-likelihood ratio, less for long types, more for
    inner periods, and less for each time that it stands without."""
    p = periods / total
    inner = F.length(type_) - F.length(F.replace(type_, F.lit("."), F.lit(""))) + 1
    letters = F.length(type_) - inner + 1
    null = with_ * _log(F.lit(p)) + without * _log(F.lit(1 - p))
    other = with_ * F.ln(F.lit(SHARE)) + without * F.ln(F.lit(1 - SHARE))
    return -2 * (null - other) * F.exp(-letters) * inner * F.pow(letters.cast("double"), -without)


def pair_likelihood(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Dunning's ratio for events of a and b occurrences among n that meet `both` times."""
    p, p1, p2 = b / n, both / a, F.try_divide((b - both).cast("double"), n - a)
    one = both * _log(p) + (a - both) * _log(1 - p)
    two = (b - both) * _log(p) + (n - a - b + both) * _log(1 - p)
    three = both * _log(p1) + (a - both) * _log(1 - p1)
    four = F.coalesce((b - both) * _log(p2) + (n - a - b + both) * _log(1 - p2), F.lit(0.0))
    return -2 * (one + two - three - four)


def learn(texts: DataFrame, text: str = "text") -> Breaks:
    """From the non-null texts of a column."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(0))
    # Each form with the one before it; "" stands before a text's first. Only forms with end marks are told apart there, so that there are few such pairs.
    pairs = texts.where(F.col(text).isNotNull()).select(tokens.alias("w")).select(F.inline(F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("first"), F.col("w").alias("form")))).where("form IS NOT NULL")
    marked = F.endswith("first", F.lit(".")) | F.col("first").isin("", "!", "?")
    seen = pairs.groupBy(F.when(marked, F.col("first")).alias("first"), "form").agg(F.count(F.lit(1)).alias("n"))
    seen = settled(seen.withColumns({"type": F.when(_is_word(F.col("form")), word_type(F.col("form"))), "with_": _ended(F.col("form"))}))
    times = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = settled(seen.groupBy("type").agg(times(F.col("with_")).alias("with_"), times(~F.col("with_")).alias("without")))
    periods, total = counts.agg(F.sum("with_"), F.sum(F.col("with_") + F.col("without"))).first()
    periods, total = float(periods or 0), float(total or 1)
    named = counts.where("type IS NOT NULL")
    score = abbreviation_score(F.col("with_"), F.col("without"), F.col("type"), periods, total)
    abbreviations = settled(named.where((F.col("with_") > 0) & F.regexp_like("type", F.lit(r"\p{L}")) & (score >= ABBREVIATION)).select("type"))

    known = abbreviations.withColumn("abbreviated", F.lit(True))
    rows = seen.where("type IS NOT NULL AND (first IS NULL OR first <> '')").withColumn("first", F.coalesce("first", F.lit("-")))  # "-" has no end mark and is no word
    before = F.when(_is_word(F.col("first")), word_type(F.col("first")))
    rows = rows.withColumns({"before": before, "ended": _ended(F.col("first"))}).join(hinted(known.withColumnRenamed("type", "before")), "before", "left")
    abbreviated, number_ = F.coalesce("abbreviated", F.lit(False)), (F.col("before") == NUMBER) | _is_initial(F.col("before"))
    is_end = F.col("first").isin("!", "?") | (F.col("ended") & ~abbreviated)
    open_ = (F.col("ended") & (abbreviated | number_)) | F.regexp_like("first", F.lit(r"\.{2,}$"))
    place = F.when(open_, "open").when(is_end, "first").otherwise("inside")
    # How often a pair of types meets, and how, is all that later steps need.
    upper, lower = F.regexp_like("form", F.lit(r"^\p{Lu}")), F.regexp_like("form", F.lit(r"^\p{Ll}"))
    met = settled(
        rows.withColumns({"place": place, "starts": F.col("ended") & ~abbreviated & ~F.coalesce(number_, F.lit(False)), "ties": F.col("ended") & F.coalesce(number_, F.lit(False))})
        .groupBy("type", F.when(F.col("ties"), F.col("before")).alias("first"))
        .agg(F.sum("n").alias("n"), times(F.col("starts")).alias("starts"), F.bool_or(upper).alias("upper"), F.bool_or(upper & (F.col("place") == "inside")).alias("upper_inside"), F.bool_or(lower).alias("lower"), F.bool_or(lower & (F.col("place") == "first")).alias("lower_first"))
    )
    cases = settled(met.groupBy("type").agg(F.sum("starts").alias("starts"), *(F.bool_or(c).alias(c) for c in ("upper", "upper_inside", "lower", "lower_first"))))
    ends = float(cases.agg(F.sum("starts")).first()[0] or 0)
    sizes = named.select("type", (F.col("with_") + F.col("without")).alias("n"))
    at_ends = cases.where((F.col("starts") > 0) & F.regexp_like("type", F.lit(r"\p{L}"))).join(sizes, "type")
    sure = (pair_likelihood(F.lit(ends), F.col("n"), F.col("starts"), F.lit(total)) >= STARTER) & (total / ends > F.col("n") / F.col("starts")) if ends else F.lit(False)
    starters = settled(at_ends.where(sure).select("type"))
    ties = met.where("first IS NOT NULL AND n > 1").select("first", F.col("type").alias("second"), F.col("n").alias("both"))
    ties = ties.join(sizes.select(F.col("type").alias("first"), F.col("n").alias("a")), "first").join(sizes.select(F.col("type").alias("second"), F.col("n").alias("b")), "second")
    likely = (pair_likelihood(F.col("a"), F.col("b"), F.col("both"), F.lit(total)) >= COLLOCATION) & (total / F.col("a") > F.col("b") / F.col("both"))
    return Breaks(abbreviations, settled(ties.where(likely).select("first", "second")), starters, cases.drop("starts"))


def _parts(text: Column) -> Column:
    """text behind each run of end marks that white space follows; put together again they are the text."""
    return F.split(F.regexp_replace(text, rf"([.!?]+{_CLOSING})(?=(?U:\s)+\S)", "$1\x01"), "\x01")


def no_breaks(pairs: DataFrame, model: Breaks) -> DataFrame:
    """Those of the pairs (before: a word with its end marks, after: the form that follows) where no sentence ends."""
    type_ = word_type(F.col("before"))
    rows = pairs.withColumns({"first": type_, "second": word_type(F.col("after")), "tail": F.substring_index(type_, "-", -1)})
    marked = lambda df, old, new, flag: hinted(df.select(F.col(old).alias(new)).withColumn(flag, F.lit(True)))
    rows = rows.join(marked(model.abbreviations, "type", "first", "whole"), "first", "left").join(marked(model.abbreviations, "type", "tail", "part"), "tail", "left")
    rows = rows.join(marked(model.starters, "type", "second", "starter"), "second", "left").join(hinted(model.pairs.withColumn("tied", F.lit(True))), ["first", "second"], "left")
    rows = rows.join(hinted(model.cases.withColumnRenamed("type", "second")), "second", "left")
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    ellipsis = F.regexp_like("before", F.lit(r"\.{2,}$"))
    abbreviated = (is_true("whole") | is_true("part")) & ~ellipsis
    upper, lower = F.regexp_like("after", F.lit(r"^\p{Lu}")), F.regexp_like("after", F.lit(r"^\p{Ll}"))
    by_case = F.when(~_is_word(F.col("after")), False).when(upper & is_true("lower") & ~is_true("upper_inside"), True).when(lower & (is_true("upper") | ~is_true("lower_first")), False)
    initial = _is_initial(F.col("first"))
    ordinal = F.col("first") == NUMBER
    by_next = F.coalesce(by_case, upper & is_true("starter"))
    loose = F.when(by_case.isNull() & initial & upper & ~is_true("lower"), True).otherwise(F.coalesce(~by_case, F.lit(False)))
    stays = F.when(is_true("tied"), True).when((abbreviated | ellipsis) & ~initial, ~by_next).when(initial | ordinal, loose | abbreviated).otherwise(abbreviated)
    return rows.where(F.coalesce(stays, F.lit(False))).select("before", "after")


def break_sentences(texts: DataFrame, model: Breaks, text: str = "text", out: str = "sentences") -> DataFrame:
    """texts with their sentences; null texts and blank ones have none. White space before the first sentence stays, that between sentences and at the end goes."""
    rows = settled(texts.withColumns({"_row": F.monotonically_increasing_id(), "_parts": _parts(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+$", ""))}))

    def seam(at: Column, ended: Column, begun: Column) -> Column:
        # Read from its end, a part's last word is matched at once; no blank stands in it.
        last = F.regexp_extract(F.reverse(F.substring_index(ended, " ", -1)), rf"^{_CLOSING}([.!?]+({_WORD})?)", 1)
        return F.struct(at.alias("at"), F.reverse(last).alias("before"), F.regexp_extract(begun, rf"^(?U:\s)+{_OPENING}({_WORD}\.*|\S)", 1).alias("after"))

    seams = rows.where(F.size("_parts") > 1).select("_row", F.posexplode(F.arrays_zip(F.col("_parts").alias("ended"), F.slice("_parts", F.lit(2), F.size("_parts") - 1).alias("begun"))).alias("at", "p")).where("p.begun IS NOT NULL")
    seams = seams.select("_row", F.inline(F.array(seam(F.col("at") + 1, F.col("p.ended"), F.col("p.begun")))))
    seams = settled(seams.where(F.regexp_like("before", F.lit(r"[\p{L}\p{N}]\.+$")) | F.regexp_like("before", F.lit(r"^\.{2,}$"))))  # other marks always end a sentence
    stays = settled(no_breaks(seams.select("before", "after").distinct(), model))
    skipped = seams.join(hinted(stays), ["before", "after"]).groupBy("_row").agg(F.collect_set("at").alias("_skipped"))
    joined = rows.join(hinted(settled(skipped)), "_row", "left")
    # Parts that begin a sentence get a mark before them, which no part holds; the whole is then cut at these.
    kept = lambda i: (i == 0) | F.coalesce(F.array_contains("_skipped", i), F.lit(False))
    one = F.array_join(F.transform("_parts", lambda x, i: F.when(kept(i), x).otherwise(F.concat(F.lit("\x01"), F.regexp_replace(x, r"^(?U)\s+", "")))), "")
    return joined.withColumn(out, F.filter(F.split(one, "\x01"), lambda s: s != "")).select(*texts.columns, out)
