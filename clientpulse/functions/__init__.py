from clientpulse.functions.buckets import (
    COUNT_RANGES,
    RATIO_RANGES,
    RECENCY_RANGES,
    Range,
    bucketize,
    feature_bucket,
    score_bucket,
    score_bucket_labels,
)
from clientpulse.functions.predicates import in_history, in_target, safe_ratio, with_event_time
from clientpulse.functions.schema import (
    feature_columns,
    forbidden_columns,
    label_like,
    missing_columns,
    require_columns,
)

__all__ = [
    "COUNT_RANGES",
    "RATIO_RANGES",
    "RECENCY_RANGES",
    "Range",
    "bucketize",
    "feature_bucket",
    "feature_columns",
    "forbidden_columns",
    "in_history",
    "in_target",
    "label_like",
    "missing_columns",
    "require_columns",
    "safe_ratio",
    "score_bucket",
    "score_bucket_labels",
    "with_event_time",
]
