"""Ordered bucketing of numeric columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Range(NamedTuple):
    """A closed range; ``low_open`` excludes the lower end, ``high=None`` is unbounded."""

    label: str
    low: float
    high: float | None = None
    low_open: bool = False


# Bucket labels and bounds.
COUNT_RANGES = (
    Range("0", 0, 0),
    Range("1", 1, 1),
    Range("2-3", 2, 3),
    Range("4-10", 4, 10),
    Range("11-50", 11, 50),
    Range(">50", 50, None, True),
)
RECENCY_RANGES = (
    Range("0-7 days", 0, 7),
    Range("8-30 days", 8, 30),
    Range("31-60 days", 31, 60),
    Range(">60 days", 60, None, True),
)
RATIO_RANGES = (
    Range("0", 0, 0),
    Range("0-0.25", 0, 0.25, True),
    Range("0.25-0.5", 0.25, 0.5, True),
    Range("0.5-1.0", 0.5, 1.0, True),
    Range(">1.0", 1.0, None, True),
)
SEARCH_SEGMENTS = (
    Range("no_search", 0, 0),
    Range("low_search_1_3", 1, 3),
    Range("medium_search_4_10", 4, 10),
    Range("high_search_gt_10", 11, None),
)
TRANSITION_COUNT_RANGES = (
    Range("0", 0, 0),
    Range("1", 1, 1),
    Range("2-3", 2, 3),
    Range("4-10", 4, 10),
    Range(">10", 10, None, True),
)
TRANSITION_RATE_RANGES = (
    Range("0", 0, 0),
    Range("(0,0.25]", 0, 0.25, True),
    Range("(0.25,0.50]", 0.25, 0.50, True),
    Range("(0.50,0.75]", 0.50, 0.75, True),
    Range("(0.75,1.0]", 0.75, None, True),
)


def bucketize(
    value: Column, ranges: tuple[Range, ...], null_label: str = "null/no value", other: str = "unbucketed"
) -> Column:
    expr = F.when(value.isNull(), F.lit(null_label))
    for r in ranges:
        hit = value > r.low if r.low_open else value >= r.low
        if r.high is not None:
            hit = hit & (value <= r.high)
        expr = expr.when(hit, F.lit(r.label))
    return expr.otherwise(F.lit(other))


def feature_bucket(name: str) -> Column:
    """The bucketing that suits a feature, chosen by its kind."""
    value = F.col(name)
    if name == "search_before_cart_count":
        return bucketize(value, TRANSITION_COUNT_RANGES)
    if name == "search_to_cart_rate":
        return bucketize(value, TRANSITION_RATE_RANGES)
    if name.endswith(("_flag", "_bucket")):
        return value.cast("string")
    if name.startswith("days_since"):
        return bucketize(value, RECENCY_RANGES, "null/no event")
    return bucketize(value, RATIO_RANGES if "ratio" in name else COUNT_RANGES)


OUTSIDE_RANGE = "outside_range"


def score_bucket_labels(bins: int = 10) -> list[str]:
    return [f"{i / bins:.1f}-{(i + 1) / bins:.1f}" for i in range(bins)]


def score_bucket(score: Column, bins: int = 10) -> Column:
    """Tenths of [0, 1], the last one closed; compared with the literal bounds,
    because ``floor(score * bins)`` is off by one for some doubles."""
    expr = F.when(score.isNull() | (score < 0.0) | (score > 1.0), F.lit(OUTSIDE_RANGE))
    for i, label in enumerate(score_bucket_labels(bins)[:-1]):
        expr = expr.when(score < F.lit((i + 1) / bins), F.lit(label))
    return expr.otherwise(F.lit(score_bucket_labels(bins)[-1]))
