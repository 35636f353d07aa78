"""Customer-behaviour analytics on Spark: event preparation, leakage-safe
client features, target labels, propensity models and exact evaluation."""

from clientpulse.config import (
    BUY,
    CART,
    EVENT_SPECS,
    FEATURE_SETS,
    REMOVE,
    SEARCH,
    VISIT,
    EventSpec,
    FeatureSet,
    Snapshot,
)

__all__ = [
    "BUY",
    "CART",
    "EVENT_SPECS",
    "FEATURE_SETS",
    "REMOVE",
    "SEARCH",
    "VISIT",
    "EventSpec",
    "FeatureSet",
    "Snapshot",
]
