"""Built-in KPI formulas over merged states: each gives a Column from the names of the states that it reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stateroll.functions.exprs import safe_div
from stateroll.operators import states as S


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def engagement_rate(pos, neg) -> Column:
    return safe_div(_c(pos), _c(pos) + _c(neg))


def positive_outcomes(pos) -> Column:
    return _c(pos)


def unique_entities(sketch, kind: str = "hll") -> Column:
    return S.estimate(sketch, kind)


def median(sketch) -> Column:
    return S.quantile(sketch, 0.5)


def p95(sketch) -> Column:
    return S.quantile(sketch, 0.95)


latency_p95 = p95


def score_calibration(pos, n, score_sum) -> Column:
    """Observed rate over mean score."""
    return safe_div(safe_div(_c(pos), _c(n)), safe_div(_c(score_sum), _c(n)))


def material_upward_exploration(count, n) -> Column:
    return safe_div(_c(count), _c(n))


def implied_evidence_index(bernoulli_sum, delta_square_sum, n) -> Column:
    return safe_div(safe_div(_c(bernoulli_sum), _c(n)), safe_div(_c(delta_square_sum), _c(n))) - 1


def relative_exploration_variance(bernoulli_sum, delta_square_sum, n) -> Column:
    return safe_div(safe_div(_c(delta_square_sum), _c(n)), safe_div(_c(bernoulli_sum), _c(n)))


def funnel_conversion(start, end) -> Column:
    return safe_div(_c(end), _c(start))


def funnel_drop_off(start, end) -> Column:
    return F.when(_c(start) == 0, 0.0).otherwise(safe_div(_c(start) - _c(end), _c(start)))


def marginal_ctr(clicks, contacts) -> Column:
    return safe_div(_c(clicks), _c(contacts))


def comparable_ctr(clicks, comparable) -> Column:
    return safe_div(_c(clicks), _c(comparable))


def runner_up_expected_ctr(propensity_sum, comparable) -> Column:
    return safe_div(_c(propensity_sum), _c(comparable))


def runner_up_coverage(comparable, contacts) -> Column:
    return safe_div(_c(comparable), _c(contacts))


def response_opportunity_margin(clicks, propensity_sum, comparable) -> Column:
    return safe_div(_c(clicks) - _c(propensity_sum), _c(comparable))


def priority_opportunity_gap(focal_sum, runner_sum, comparable) -> Column:
    return safe_div(_c(focal_sum) - _c(runner_sum), _c(comparable))
