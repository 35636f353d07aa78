"""Raw tables to clean tables: parsing, validity, duplicates, product dedup."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clientpulse.config import EVENT_SPECS, EventSpec
from clientpulse.functions import require_columns, with_event_time
from clientpulse.sources.readers import sample_rows


class Prepared(NamedTuple):
    """``clean`` rows, a one-row ``report`` and a one-row ``duplicates`` summary."""

    clean: DataFrame
    report: DataFrame
    duplicates: DataFrame


def typed_events(df: DataFrame, spec: EventSpec) -> DataFrame:
    """Ids and time in their clean types, and ``faults``: what keeps a row out of the
    clean table, empty for a valid row. An id that is no number is a fault of its own."""
    parsed = with_event_time(require_columns(df, spec.required))
    typed = {c: F.col(c).try_cast("bigint") for c in ("client_id", *spec.entities)}
    found = [
        F.when(F.col(c).isNull(), f"{c}_null").when(value.isNull(), f"{c}_parse_failure") for c, value in typed.items()
    ]
    no_time = F.when(F.col("timestamp").isNull(), "event_ts_missing").when(
        F.col("event_ts").isNull(), "event_ts_parse_failure"
    )
    return parsed.select(
        *(value.alias(c) for c, value in typed.items()),
        "event_ts",
        "event_date",
        F.array_compact(F.array(*found, no_time)).alias("faults"),
    )


def standardize_events(df: DataFrame, spec: EventSpec) -> DataFrame:
    """Valid rows in the clean event layout; query text is not carried over."""
    return (
        typed_events(df, spec)
        .where(F.size("faults") == 0)
        .select(*clean_columns(spec))
    )


def clean_columns(spec: EventSpec) -> list[Column]:
    names = ("client_id", "event_ts", "event_date")
    return [*map(F.col, names), F.lit(spec.event_type).alias("event_type"), *map(F.col, spec.entities)]


def validation_counts(df: DataFrame, spec: EventSpec) -> DataFrame:
    """One row of counters of a raw event table. Rows are counted once per set of
    faults, of which there are few; every counter is a sum over those sets."""
    sets = (
        typed_events(df, spec)
        .groupBy("faults")
        .agg(F.count("*").alias("n"), F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    )

    def rows(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    def with_fault(*faults: str) -> Column:
        return F.arrays_overlap("faults", F.array(*map(F.lit, faults)))

    counters = {
        "input_rows": rows(F.lit(True)),
        "valid_rows": rows(F.size("faults") == 0),
        "invalid_rows": rows(F.size("faults") > 0),
        "event_ts_null_count": rows(with_fault("event_ts_missing", "event_ts_parse_failure")),
        "event_ts_parse_failure_count": rows(with_fault("event_ts_parse_failure")),
        "event_date_min": F.min("first"),
        "event_date_max": F.max("last"),
    }
    for c in ("client_id", *spec.entities):
        counters[f"{c}_null_count"] = rows(with_fault(f"{c}_null"))
        counters[f"{c}_parse_failure_count"] = rows(with_fault(f"{c}_parse_failure"))
    return sets.agg(*(value.alias(name) for name, value in counters.items())).select(
        F.lit(spec.event_type).alias("event_type"), "*"
    )


def observed_events(df: DataFrame, spec: EventSpec) -> tuple[DataFrame, Observation]:
    """The clean rows, and the counters of ``validation_counts`` as an observation: they
    are collected by whatever job reads the rows, so writing the clean table counts the
    raw one in the same scan. Rows pass the counters before invalid ones are dropped. Read
    ``df`` in a session of its own (``session.side_session``)."""
    seen = Observation(f"validation_{spec.event_type}_{uuid.uuid4().hex}")

    def with_fault(*faults: str) -> Column:
        return F.count_if(F.arrays_overlap("faults", F.array(*map(F.lit, faults))))

    counters = {
        "input_rows": F.count(F.lit(1)),
        "valid_rows": F.count_if(F.size("faults") == 0),
        "invalid_rows": F.count_if(F.size("faults") > 0),
        "event_ts_null_count": with_fault("event_ts_missing", "event_ts_parse_failure"),
        "event_ts_parse_failure_count": with_fault("event_ts_parse_failure"),
        "event_date_min": F.min("event_date"),
        "event_date_max": F.max("event_date"),
    }
    for c in ("client_id", *spec.entities):
        counters[f"{c}_null_count"] = with_fault(f"{c}_null")
        counters[f"{c}_parse_failure_count"] = with_fault(f"{c}_parse_failure")
    rows = typed_events(df, spec).observe(seen, *(value.alias(name) for name, value in counters.items()))
    return rows.where(F.size("faults") == 0).select(*clean_columns(spec)), seen


def observed_report(spark: SparkSession, seen: Mapping[str, Observation]) -> DataFrame:
    """One row of counters per event type, once the job that read the rows has run."""
    rows = [{"event_type": t, **observation.get} for t, observation in seen.items()]
    names = list(dict.fromkeys(name for row in rows for name in row))
    types = {"event_type": "string", "event_date_min": "date", "event_date_max": "date"}
    schema = ", ".join(f"{name} {types.get(name, 'bigint')}" for name in names)
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], schema)


def duplicate_summary(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Key groups with more than one row, and the rows they have too many."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("valid_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_key_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_extra_rows"),
    ).withColumn(
        "duplicate_extra_row_rate",
        F.when(F.col("valid_rows") > 0, F.round(F.col("duplicate_extra_rows") / F.col("valid_rows"), 6)),
    )


def prepare_events(df: DataFrame, spec: EventSpec, sample: float | None = None) -> Prepared:
    df = sample_rows(df, sample)
    clean = standardize_events(df, spec)
    duplicates = duplicate_summary(clean, spec.duplicate_key).select(F.lit(spec.event_type).alias("event_type"), "*")
    return Prepared(clean, validation_counts(df, spec), duplicates)


def enabled_specs(raw: Mapping[str, DataFrame], include: Iterable[str] = ()) -> dict[str, EventSpec]:
    """The event types of ``raw`` that a run takes in. Search and page visits are off
    unless they are named in ``include``."""
    include = set(include)
    unknown = include - set(EVENT_SPECS)
    if unknown:
        raise ValueError("unknown event types: " + ", ".join(sorted(unknown)))
    found = {t: s for t, s in EVENT_SPECS.items() if t in raw and (s.default_enabled or t in include)}
    if not found:
        raise ValueError("no enabled event type has an input table")
    return found


def one_table(parts: Iterable[DataFrame]) -> DataFrame:
    """Clean rows of several event types as one table; what a type has not is null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.withColumns({c: F.lit(None).cast("bigint") for c in ("sku", "url") if c not in out.columns})


def prepare_all(raw: Mapping[str, DataFrame], include: Iterable[str] = (), sample: float | None = None) -> DataFrame:
    """All enabled event types as one clean event table."""
    return one_table(standardize_events(sample_rows(raw[t], sample), spec) for t, spec in enabled_specs(raw, include).items())


def prepare_observed(
    raw: Mapping[str, DataFrame], include: Iterable[str] = (), sample: float | None = None
) -> tuple[DataFrame, dict[str, Observation]]:
    """``prepare_all``, with the counters of each type as an observation."""
    parts = {t: observed_events(sample_rows(raw[t], sample), spec) for t, spec in enabled_specs(raw, include).items()}
    return one_table(clean for clean, _ in parts.values()), {t: seen for t, (_, seen) in parts.items()}


def pair_counts(products: DataFrame) -> DataFrame:
    return products.groupBy("sku", "category", "price").agg(F.count("*").alias("n"))


def dedup_products(products: DataFrame) -> DataFrame:
    """One row per SKU: the most frequent (category, price), ties by category
    and then price, nulls last.

    The choice is the minimum of an ordered struct, so it combines on the map
    side and needs neither a sort nor a SKU's rows in one place."""
    order = F.struct(
        (-F.col("n")).alias("n"),
        F.col("category").isNull().alias("no_category"),
        "category",
        F.col("price").isNull().alias("no_price"),
        "price",
    )
    best = pair_counts(products.where(F.col("sku").isNotNull())).groupBy("sku").agg(F.min(order).alias("best"))
    return best.select("sku", "best.category", "best.price")


def typed_products(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("sku").try_cast("bigint").alias("sku"), F.col("category").try_cast("bigint").alias("category"), "price"
    )


def product_validation(products: DataFrame) -> DataFrame:
    """One row of input, null, bad id, duplicate and output counters. SKUs are counted as
    the dedup sees them, after the cast; a SKU that is no number is a parse failure."""
    require_columns(products, ("sku", "category", "price", "name"))
    sku = F.col("sku").try_cast("bigint")
    per_sku = products.groupBy(sku.alias("id")).agg(
        F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("sku", "category", "price", "name"))
    )
    known = F.col("id").isNotNull()
    total = {c: F.coalesce(F.sum(f"no_{c}"), F.lit(0)) for c in ("sku", "category", "price", "name")}
    without = F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0))
    output = dedup_products(typed_products(products)).agg(F.count("*")).scalar()
    return per_sku.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.count("id").alias("distinct_sku_count"),
        *(total[c].alias(f"null_{c}_count") for c in total),
        (without - total["sku"]).alias("sku_parse_failure_count"),
        F.count_if(known & (F.col("n") > 1)).alias("duplicated_sku_count"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicate_extra_rows"),
    ).withColumn("output_rows", output)


def prepare_products(products: DataFrame, sample: float | None = None) -> tuple[DataFrame, DataFrame]:
    products = sample_rows(products, sample)
    return dedup_products(typed_products(products)), product_validation(products)


def metadata_profile(products: DataFrame, label: str) -> DataFrame:
    """How stable category and price are within a SKU, as one row. Only whether a
    SKU has several values matters, so extremes stand in for distinct counts."""

    def several(column: str) -> Column:
        return F.coalesce(F.min(column) < F.max(column), F.lit(False))

    per_sku = (
        pair_counts(products)
        .groupBy("sku")
        .agg(
            F.sum("n").alias("rows"),
            several("category").alias("categories"),
            several("price").alias("prices"),
            (F.count("*") > 1).alias("pairs"),
        )
    )
    return per_sku.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.count("sku").alias("distinct_sku_count"),
        F.count_if(F.col("rows") > 1).alias("sku_with_multiple_rows"),
        F.count_if("categories").alias("sku_with_multiple_category_values"),
        F.count_if("prices").alias("sku_with_multiple_price_values"),
        F.count_if("pairs").alias("sku_with_multiple_category_price_pairs"),
        F.coalesce(F.max("rows"), F.lit(0)).alias("max_rows_per_sku"),
    ).select(F.lit(label).alias("source"), "*")


def metadata_consistency(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw against clean products as (metric, value) rows, with the verdicts."""
    both = metadata_profile(raw, "raw").unionByName(metadata_profile(clean, "processed"))
    numbers = [c for c in both.columns if c != "source"]
    metrics = both.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.concat_ws("_", "source", F.lit(c)).alias("metric"), F.col(c).cast("string").alias("value")
                    )
                    for c in numbers
                )
            )
        )
    )

    def repeated(source: str):
        return F.max(F.when(F.col("source") == source, F.col("sku_with_multiple_rows"))) > 0

    verdicts = both.agg(repeated("raw").alias("raw"), repeated("processed").alias("processed")).select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("metadata_join_row_expansion_risk").alias("metric"),
                    F.when(F.col("raw"), "yes").otherwise("no").alias("value"),
                ),
                F.struct(
                    F.lit("recommended_handling").alias("metric"),
                    F.when(F.col("processed"), "review_or_deduplicate_before_join")
                    .otherwise("use_processed_product_properties_clean")
                    .alias("value"),
                ),
            )
        )
    )
    return metrics.unionByName(verdicts)
