"""Decision rules over measured differences, as column expressions. A rule's branches are tested in the order given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for condition, verdict in reversed(rules):
        out = F.when(condition, verdict).otherwise(out)
    return out


def gate(delta: Column, go: float = 0.02) -> Column:
    return _first([(delta.isNull(), "n/a"), (delta >= go, "GO"), (delta <= 0, "NO-GO")], "GRAY-ZONE")


def transfer(delta: Column, two_se: Column) -> Column:
    return _first([(delta >= two_se, "TRANSFERS"), (delta > 0, "DIRECTIONAL")], "NO-TRANSFER")


def depth(delta: Column, two_se: Column) -> Column:
    return _first([(delta > two_se, "DEEPER WINS"), (delta < -two_se, "DEEPER LOSES")], "NO DIFFERENCE")


def against_baseline(delta: Column, drift: Column, mde: float = 0.046, tolerance: float = 0.3) -> Column:
    """A policy against the best baseline of its size."""
    return _first([(drift.isNull(), "INCOMPLETE"), (drift > tolerance, "INVALID"), (delta.isNull(), "INCOMPLETE"), (delta >= mde, "OVERTURNS"), (delta > 0, "DIRECTIONAL")], "NULL")


def ceiling(mean: Column, high: Column, drift: Column, mde: float = 0.046, tolerance: float = 0.3) -> Column:
    return _first([(high < mde, "CLOSED"), (mean < mde, "INCONCLUSIVE"), (F.abs(drift) > tolerance, "SIZE-CONFOUNDED")], "HEADROOM")


def comparison(mean: Column, low: Column, high: Column, floor: float, better: str, worse: str, before: list[tuple[Column, str]] | None = None) -> Column:
    """better needs an interval above 0 and the floor; an interval below 0 is worse; the rest is a tie. `before`: what makes the comparison
    void, such as inputs that did not reproduce, a failed optimisation or too few groups."""
    return _first([*(before or []), ((low > 0) & (mean >= floor), better), (high < 0, worse)], "TIE")


def confirmation(mean: Column, low: Column, high: Column, n: Column, floor: float, least: int, valid: Column | None = None) -> Column:
    rules = [(~valid, "INVALID")] if valid is not None else []
    rules += [(n < least, "INCONCLUSIVE-SIZE"), ((low > 0) & (mean >= floor), "CONFIRMED"), (low > 0, "BELOW-FLOOR"), (high < 0, "LARGE-WORSE")]
    return _first(rules, "NOT-CONFIRMED")


def size_effect(mean: Column, low: Column, high: Column, floor: float) -> Column:
    return _first([((low > 0) & (mean >= floor), "SIZE-CARRIES"), (low > 0, "SIZE-SMALL"), (high < 0, "SIZE-REVERSED")], "SIZE-NOT-DETECTED")


def placement(low: Column, high: Column, low90: Column, high90: Column, margin: float = 0.03) -> Column:
    return _first([(low > 0, "BILSTM-BETTER"), (high < 0, "BILSTM-WORSE"), ((low90 >= -margin) & (high90 <= margin), "EQUIVALENT")], "INCONCLUSIVE")


def reader_works(low: Column) -> Column:
    return F.coalesce(low > 0, F.lit(False))


def dev_gate(mean: Column, live: Column, go: float = 0.0, least_live: float = 0.05) -> Column:
    """Whether an optimised ranker goes on to the final run: enough of its groups must have had a gradient."""
    return _first([(live < least_live, "NO-GO"), (mean >= go, "GO")], "NO-GO")


def optimised(mean: Column, low: Column, high: Column, valid: Column, live: Column, groups: Column, floor: float, least_live: float = 0.05, least_groups: int = 0) -> Column:
    """An optimised ranker against its control, at a matched budget where least_groups asks for one."""
    return comparison(mean, low, high, floor, "RL-BETTER", "CE-BETTER", [(~valid, "INVALID"), (live < least_live, "FAILED-OPTIMISATION"), (groups < least_groups, "INCONCLUSIVE-BUDGET")])


def more_training(mean: Column, low: Column, high: Column, valid: Column, floor: float) -> Column:
    return comparison(mean, low, high, floor, "CE-BETTER", "STAGE8-BETTER", [(~valid, "INVALID")])


def more_data(mean: Column, low: Column, high: Column, valid: Column, groups: Column, floor: float, least_groups: int) -> Column:
    return comparison(mean, low, high, floor, "MORE-DATA-BETTER", "MORE-DATA-WORSE", [(~valid, "INVALID"), (groups < least_groups, "INCONCLUSIVE-SIZE")])


def precheck(found: dict[str, Column], expected: dict[str, Column], reasons: dict[str, str]) -> Column:
    """The reasons why inputs are not those that a study was planned for, in the order given; an empty array if they are."""
    return F.array_compact(F.array(*[F.when(~found[name].eqNullSafe(expected[name]), why) for name, why in reasons.items()]))
