"""Declarative description of the data model: event types, snapshots,
feature names, feature families and feature sets."""

from __future__ import annotations

from dataclasses import dataclass

# Event type tags, in the order in which features are listed.
CART = "add_to_cart"
REMOVE = "remove_from_cart"
BUY = "product_buy"
SEARCH = "search_query"
VISIT = "page_visit"

SKU_TYPES = (CART, REMOVE, BUY)
FEATURE_TYPES = (CART, REMOVE, BUY, SEARCH)
ELIGIBLE_TYPES = (CART, BUY)

# Default parameters.
FEATURE_WINDOWS = (30, 60, 90)
TARGET_WINDOWS = (14, 30, 45)
TOPK_PERCENTS = (1, 5, 10)
SCORE_THRESHOLD = 0.5
MAX_ITER = 20
SEED = 42
TRANSITION_DAYS = 7
RECENT_SEARCH_DAYS = 30

ELIGIBLE = "is_eligible_purchase_propensity"


@dataclass(frozen=True)
class EventSpec:
    """What one raw event table must look like."""

    event_type: str
    entity: str | None = None
    default_enabled: bool = True

    @property
    def required(self) -> tuple[str, ...]:
        return ("client_id", "timestamp") + self.entities

    @property
    def entities(self) -> tuple[str, ...]:
        return (self.entity,) if self.entity else ()

    @property
    def duplicate_key(self) -> tuple[str, ...]:
        return ("client_id", "event_ts") + self.entities


EVENT_SPECS = {
    spec.event_type: spec
    for spec in (
        EventSpec(CART, "sku"),
        EventSpec(REMOVE, "sku"),
        EventSpec(BUY, "sku"),
        EventSpec(SEARCH, default_enabled=False),
        EventSpec(VISIT, "url", default_enabled=False),
    )
}


@dataclass(frozen=True)
class Snapshot:
    """A cutoff and a target window. History is everything before ``cutoff``;
    the label window runs from ``cutoff`` to ``target_end``, both days included."""

    cutoff: str
    target_end: str
    name: str = "default"


@dataclass(frozen=True)
class Feature:
    name: str
    data_type: str
    group: str
    description: str


def feature_registry(windows: tuple[int, ...] = FEATURE_WINDOWS) -> list[Feature]:
    """All features of the feature table, in output order."""
    features: list[Feature] = []

    def add(name: str, data_type: str, group: str, description: str) -> None:
        features.append(Feature(name, data_type, group, description))

    def recency_and_windows(event_type: str) -> None:
        add(f"days_since_last_{event_type}", "int", "recency", f"Days from the last {event_type} to the cutoff.")
        for w in windows:
            add(f"{event_type}_count_{w}d", "bigint", "activity_count", f"{event_type} events in the last {w} days.")

    for t in SKU_TYPES:
        add(f"{t}_count", "bigint", "activity_count", f"{t} events before the cutoff.")
        add(f"distinct_{t}_sku_count", "bigint", "activity_count", f"Distinct SKUs in {t} events.")
        recency_and_windows(t)
    for prefix in ("cart", "bought"):
        add(f"distinct_{prefix}_category_count", "bigint", "product_metadata", f"Distinct categories of {prefix} SKUs.")
        add(f"avg_{prefix}_price", "double", "product_metadata", f"Mean price over {prefix} events.")
        add(f"max_{prefix}_price", "double", "product_metadata", f"Highest price over {prefix} events.")
    add(f"{SEARCH}_count", "bigint", "activity_count", "Searches before the cutoff.")
    add("distinct_search_days", "bigint", "activity_count", "Distinct days with a search.")
    recency_and_windows(SEARCH)
    add("active_days_count", "bigint", "activity_count", "Distinct days with any included event.")
    add(ELIGIBLE, "int", "cohort_indicator", "1 when the client has a cart or purchase event in history.")
    add("buy_to_cart_ratio", "double", "ratio", "Purchases per cart event.")
    add("remove_to_cart_ratio", "double", "ratio", "Removals per cart event.")
    add("cart_minus_remove_count", "bigint", "ratio", "Cart events minus removals.")
    add("search_to_cart_ratio", "double", "ratio", "Searches per cart event.")
    return features


def feature_names(windows: tuple[int, ...] = FEATURE_WINDOWS) -> list[str]:
    return [f.name for f in feature_registry(windows)]


RATIO_FEATURES = ("buy_to_cart_ratio", "remove_to_cart_ratio", "cart_minus_remove_count", "search_to_cart_ratio")


def feature_families(windows: tuple[int, ...] = FEATURE_WINDOWS) -> dict[str, tuple[str, ...]]:
    """Families partition the features; ablation removes them one at a time."""
    families: dict[str, tuple[str, ...]] = {}
    for family, t, second in (
        ("add_to_cart_activity", CART, f"distinct_{CART}_sku_count"),
        ("product_buy_activity", BUY, f"distinct_{BUY}_sku_count"),
        ("remove_from_cart_activity", REMOVE, f"distinct_{REMOVE}_sku_count"),
        ("search_activity", SEARCH, "distinct_search_days"),
    ):
        families[family] = (f"{t}_count", second, *(f"{t}_count_{w}d" for w in windows))
    families["recency_features"] = tuple(f"days_since_last_{t}" for t in FEATURE_TYPES)
    families["ratio_features"] = RATIO_FEATURES
    families["product_metadata_features"] = tuple(
        f.name for f in feature_registry(windows) if f.group == "product_metadata"
    )
    families["cohort_indicator"] = (ELIGIBLE,)
    families["overall_activity"] = ("active_days_count",)
    return families


# Families removed together in the combined ablation.
COMBINED_ABLATIONS = {
    "baseline": (),
    "remove_overall_activity": ("overall_activity",),
    "remove_overall_plus_add_to_cart": ("overall_activity", "add_to_cart_activity"),
    "remove_overall_plus_product_buy": ("overall_activity", "product_buy_activity"),
    "remove_overall_plus_add_to_cart_plus_product_buy": (
        "overall_activity",
        "add_to_cart_activity",
        "product_buy_activity",
    ),
    "remove_overall_plus_recency": ("overall_activity", "recency_features"),
    "remove_overall_plus_recency_plus_add_to_cart_plus_product_buy": (
        "overall_activity",
        "recency_features",
        "add_to_cart_activity",
        "product_buy_activity",
    ),
}

# Velocity features by group.
VELOCITY_GROUPS = {
    "cart_velocity": ("cart_velocity_30d_vs_90d", "cart_delta_30d_90d"),
    "buy_velocity": ("buy_velocity_30d_vs_90d", "buy_delta_30d_90d"),
    "search_velocity": ("search_velocity_30d_vs_90d",),
    "activity_acceleration": ("activity_intensity_ratio",),
}

# Groups kept by each pruning variant.
PRUNING_VARIANTS = {
    "full_e6": ("cart_velocity", "buy_velocity", "search_velocity", "activity_acceleration"),
    "without_activity_intensity_ratio": ("cart_velocity", "buy_velocity", "search_velocity"),
    "without_search_velocity": ("cart_velocity", "buy_velocity", "activity_acceleration"),
    "buy_plus_cart_velocity_only": ("buy_velocity", "cart_velocity"),
    "buy_velocity_only": ("buy_velocity",),
}

SEARCH_BUCKET_FEATURES = ("search_count_bucket", "search_recency_bucket", "recent_search_flag")
TRANSITION_FEATURES = ("search_before_cart_count", "search_to_cart_rate", "recent_search_then_cart_flag")


@dataclass(frozen=True)
class FeatureSet:
    """A model's inputs: base features minus ``removed`` plus ``engineered``."""

    name: str
    removed: tuple[str, ...] = ()
    engineered: tuple[str, ...] = ()

    def columns(self, base: list[str]) -> list[str]:
        gone = set(self.removed) | set(self.engineered)
        return [c for c in base if c not in gone] + list(self.engineered)


_DEFECTIVE = (ELIGIBLE,) + RATIO_FEATURES
_WITHOUT_60D = _DEFECTIVE + tuple(f"{t}_count_60d" for t in (CART, BUY, REMOVE, SEARCH))
_RAW_SEARCH = (
    f"{SEARCH}_count",
    "distinct_search_days",
    f"days_since_last_{SEARCH}",
    f"{SEARCH}_count_30d",
    f"{SEARCH}_count_90d",
)
_VELOCITY = tuple(name for group in VELOCITY_GROUPS.values() for name in group)

FEATURE_SETS = {
    fs.name: fs
    for fs in (
        FeatureSet("baseline"),
        FeatureSet("v2_1", _DEFECTIVE),
        FeatureSet("v2_2", _WITHOUT_60D),
        FeatureSet("v2_3a", _WITHOUT_60D + _RAW_SEARCH, SEARCH_BUCKET_FEATURES),
        FeatureSet("v2_3b", _WITHOUT_60D, TRANSITION_FEATURES),
        FeatureSet("v2_3c", _WITHOUT_60D, ("recent_search_then_cart_flag",)),
        FeatureSet("e6", _WITHOUT_60D, _VELOCITY),
        FeatureSet("v2_4", _WITHOUT_60D, _VELOCITY[:-1]),
    )
}
