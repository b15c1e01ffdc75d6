"""Anomaly flags, the two score forms and the per-feature breakdown of a window row."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FLAGS, TERMS


def anomaly_flag() -> Column:
    """The first flag that applies, or null. Null measures fire nothing."""
    return F.coalesce(*[F.when(F.expr(cond), F.lit(name)) for name, cond in FLAGS])


def anomaly_flags() -> Column:
    """The flag as a list of one element, or null."""
    return F.when(anomaly_flag().isNotNull(), F.array(anomaly_flag()))


def _over(column: str, threshold: float, span: float) -> Column:
    return (F.col(column).cast("double") - F.lit(threshold)) / F.lit(span)


def stream_score(digits: int = 4) -> Column:
    """The stream form: voltage, thermal and leakage terms are not capped, the sum is."""
    terms = []
    for _, column, threshold, span, weight, capped in TERMS:
        over = _over(column, threshold, span)
        over = F.least(F.lit(1.0), over) if capped else over
        terms.append(F.when(F.col(column) > threshold, F.lit(weight) * over).otherwise(0.0))
    return F.round(F.least(F.lit(1.0), reduce(add, terms)), digits)


def breakdown() -> Column:
    """map<string,double>: each capped feature score, rounded to 3 places; features below their threshold are absent."""
    names = F.array(*[F.lit(t[0]) for t in TERMS])
    values = F.array(*[F.when(F.col(c) > threshold, F.round(F.least(F.lit(1.0), _over(c, threshold, span)), 3)) for _, c, threshold, span, _, _ in TERMS])
    return F.map_filter(F.map_from_arrays(names, values), lambda _, v: v.isNotNull())


def score_of_breakdown(features: Column) -> Column:
    """The explainable form: weighted sum of a breakdown, capped at 1, rounded to 3 places."""
    total = reduce(add, [F.coalesce(F.element_at(features, name), F.lit(0.0)) * F.lit(weight) for name, _, _, _, weight, _ in TERMS])
    return F.round(F.least(F.lit(1.0), total), 3)
