"""Schema rules: feature discovery and leakage guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Columns that can never be model inputs.
NOT_FEATURES = frozenset(
    {
        "client_id",
        "label",
        "target_window_start",
        "target_window_end",
        "target_event_count",
        "features",
        "rawPrediction",
        "probability",
        "prediction",
        "class_weight",
    }
)
LABEL_NAMES = frozenset({"label", "target", "y", "purchase_in_target"})
LABEL_PREFIXES = ("label_", "target_")
MODEL_OUTPUT_WORDS = ("prediction", "score", "model")
LABEL_METADATA = ("label", "target_window_start", "target_window_end", "target_event_count")


def label_like(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c.lower() in LABEL_NAMES or c.lower().startswith(LABEL_PREFIXES)]


def feature_columns(df: DataFrame, removed: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order, minus keys, labels and ``removed``."""
    blocked = NOT_FEATURES | set(removed) | set(label_like(df.columns))
    return [f.name for f in df.schema.fields if f.name not in blocked and isinstance(f.dataType, T.NumericType)]


def forbidden_columns(df: DataFrame, kind: str) -> list[str]:
    """Columns that would leak: model output in ``training`` data, label data in ``scores``."""
    if kind == "training":
        return [c for c in df.columns if any(word in c.lower() for word in MODEL_OUTPUT_WORDS)]
    if kind == "scores":
        return [c for c in df.columns if c in LABEL_METADATA]
    raise ValueError(f"kind must be 'training' or 'scores', not {kind!r}")


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return df
