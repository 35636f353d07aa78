"""Exact running totals, quantiles and top-k cutoffs without a global sort.

A window over a whole table would put it in one task. Here the rows are first
reduced to one per distinct value, which also folds any number of tied rows into
one. A sample of the keys, drawn by their hashes and so the same in every pass,
cuts them into ranges, each range is accumulated on its own, and the totals of the
preceding ranges are added. The sample decides only how the work is spread; every
result is exact. Keys may be of any ordered type, groups may be null, and nothing
runs before the result is asked for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clientpulse.config import TOPK_PERCENTS

ROWS_PER_RANGE = 50_000
# Over all groups together; more rows than this many ranges hold make longer ranges.
MOST_RANGES = 1024
# Halvings of a search among edges: enough for four times as many as there are about.
EDGE_STEPS = 12


def null_safe(groups: Sequence[str], other: str) -> Column:
    """Null-safe equality of group columns with those named after ``other``."""
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(other.format(g)))
    return on


def drawn_edges(rows: DataFrame, key: str, groups: Sequence[str], rows_per_range: int) -> DataFrame:
    """``__edges`` of each group, ascending: keys drawn by their hashes, about ``MOST_RANGES``
    in all at most, none for a small table."""
    share = F.least(F.col("n") / rows_per_range, F.lit(float(MOST_RANGES))) / F.col("n")
    total = rows.agg(F.count("*").alias("n")).select(F.when(F.col("n") > rows_per_range, share).otherwise(0.0))
    drawn = F.pmod(F.xxhash64(F.lit("range"), key), F.lit(1 << 31)) / float(1 << 31)
    sample = rows.where(F.col(key).isNotNull() & (drawn < total.scalar()))
    # bounded: as many as the search below tells apart
    edges = F.slice(F.sort_array(F.collect_set(key)), 1, (1 << EDGE_STEPS) - 1)
    return sample.groupBy(*groups).agg(edges.alias("__edges"))


def edges_below(edges: Column, key: str) -> Column:
    """The number of the ascending ``edges`` that are smaller than the key, found by halving:
    a row takes a dozen comparisons, not one with every edge. Without edges it is 0."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(EDGE_STEPS))))

    def search(value: Column) -> Column:
        return F.reduce(steps, F.lit(0), lambda n, step: F.when(F.get(edges, n + step - 1) < value, n + step).otherwise(n))

    # as a lambda's variable the key is made once a row, not once a step; never null, so that
    # no filter for nulls repeats the search
    return F.coalesce(F.get(F.transform(F.array(key), search), F.lit(0)), F.lit(0))


def with_range(rows: DataFrame, key: str, groups: Sequence[str], rows_per_range: int) -> DataFrame:
    """Add ``__range``: the number of edges of the group below the key."""
    edges = drawn_edges(rows, key, groups, rows_per_range)
    if groups:
        side = edges.select(*(F.col(g).alias(f"__{g}_of_edges") for g in groups), "__edges")
        # bounded: about MOST_RANGES keys in all
        met = rows.join(F.broadcast(side), null_safe(groups, "__{}_of_edges"), "left")
    else:
        met = rows.withColumn("__edges", edges.scalar())
    return met.select(*rows.columns, edges_below(F.col("__edges"), key).alias("__range"))


def running_totals(
    df: DataFrame, key: str, sums: Sequence[str], by: Sequence[str] = (), rows_per_range: int | None = None
) -> DataFrame:
    """For each row, add ``<sum>_before`` (over rows of the group with a smaller ``key``)
    and ``<sum>_total``. ``df`` holds one row per group and key."""
    groups = list(by)
    ranged = with_range(df, key, groups, rows_per_range or ROWS_PER_RANGE)
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    # one row per group and range
    offsets = (
        ranged.groupBy(*groups, "__range")
        .agg(*(F.sum(s).alias(f"__{s}") for s in sums))
        .select(
            *(F.col(g).alias(f"__{g}_of_offsets") for g in groups),
            F.col("__range").alias("__range_of_offsets"),
            *(F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}_offset") for s in sums),
            *(F.sum(f"__{s}").over(whole).alias(f"{s}_total") for s in sums),
        )
    )
    inside = Window.partitionBy(*groups, "__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.select(
        "*", *(F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__{s}_inside") for s in sums)
    )
    on = (F.col("__range") == F.col("__range_of_offsets")) & null_safe(groups, "__{}_of_offsets")
    return counted.join(offsets, on).select(
        *df.columns,
        *((F.col(f"__{s}_inside") + F.col(f"__{s}_offset")).alias(f"{s}_before") for s in sums),
        *(f"{s}_total" for s in sums),
    )


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(column_name, value) rows, values as doubles, nulls kept."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keep, F.inline(pairs))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) over the non-null, non-NaN values."""
    rows = long_form(df, columns).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def quantiles_of_counts(
    counts: DataFrame, quantiles: Mapping[str, float], by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """Interpolated quantiles of (``by``, value, n) rows: one row per group.
    ``extra`` aggregates over the same rows come along in the same pass."""
    n_before, n, total = F.col("n_before"), F.col("n"), F.col("n_total")

    def at(position: Column) -> Column:
        return F.max(F.when((n_before <= position) & (position < n_before + n), F.col("value")))

    aggregates = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (total - 1)
        aggregates += [
            at(F.floor(position)).alias(f"__{name}_low"),
            at(F.ceil(position)).alias(f"__{name}_high"),
            F.max(position - F.floor(position)).alias(f"__{name}_part"),
        ]
    values = [
        (F.col(f"__{n}_low") + F.col(f"__{n}_part") * (F.col(f"__{n}_high") - F.col(f"__{n}_low"))).alias(n)
        for n in quantiles
    ]
    wide = running_totals(counts, "value", ["n"], by).groupBy(*by).agg(
        F.count("*").alias("distinct_count"), *aggregates, *extra
    )
    more = [c for c in wide.columns if not c.startswith("__") and c not in (*by, "distinct_count")]
    return wide.select(*by, "distinct_count", *values, *more)


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    exact: bool = True,
    relative_error: float = 0.01,
) -> DataFrame:
    """One row per column with the named quantiles; nulls are ignored. The
    approximate form returns observed values instead of interpolated ones."""
    if exact:
        return quantiles_of_counts(value_counts(df, columns), probabilities, ["column_name"])
    accuracy = max(1, int(1 / relative_error))
    names = list(probabilities)
    rows = long_form(df, columns).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return (
        rows.groupBy("column_name")
        .agg(
            F.approx_count_distinct("value").alias("distinct_count"),
            F.percentile_approx("value", [float(probabilities[n]) for n in names], accuracy).alias("__q"),
        )
        .select("column_name", "distinct_count", *(F.col("__q")[i].alias(n) for i, n in enumerate(names)))
    )


def quantile(df: DataFrame, column: str, probability: float) -> Column:
    """One exact quantile as a scalar subquery."""
    return quantiles(df, [column], {"q": probability}).select("q").scalar()


def score_counts(scored: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, with ``key`` ascending from the best score."""
    return (
        scored.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
        .withColumn("key", -F.col("score"))
    )


def smallest_key_cutoff(df: DataFrame, key: str, k: int):
    """The largest of the ``k`` smallest values of an ordered key, duplicates counted.

    Rows are counted by range where they lie. Only the keys of the range with the ``k``-th
    row are grouped and ranked, as many as one task of ``running_totals`` ranks."""
    keys = df.select(key).where(F.col(key).isNotNull())

    def before(order: str) -> Column:
        preceding = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(preceding), F.lit(0)).alias("n_before")

    ranges = with_range(keys, key, [], ROWS_PER_RANGE).groupBy("__range").agg(F.count("*").alias("n"))
    edges = drawn_edges(keys, key, [], ROWS_PER_RANGE).scalar()
    at = F.col("last.__range")
    last = (
        ranges.select("__range", before("__range"))
        .where(F.col("n_before") < k)
        .agg(F.max(F.struct("__range", "n_before")).alias("last"))
        .select("last", edges.alias("edges"))
        .select("last.n_before", F.get("edges", at - 1).alias("above"), F.get("edges", at).alias("up_to"))
        .first()
    )
    if last.n_before is None:
        return None
    if last.above is not None:
        keys = keys.where(F.col(key) > F.lit(last.above))
    if last.up_to is not None:
        keys = keys.where(F.col(key) <= F.lit(last.up_to))
    ranked = keys.groupBy(key).agg(F.count("*").alias("n")).select(key, before(key))
    return ranked.where(F.col("n_before") < k - last.n_before).agg(F.max(key).alias("cutoff")).first().cutoff


def score_ranks(scored: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores of each group, best first, with the rows and positives
    before them. AUC and top-K metrics both read this table."""
    return running_totals(score_counts(scored, score, by), "key", ["n", "pos"], by)


def topk_cutoffs(
    scored: DataFrame,
    score: str = "prediction_score",
    percents: Iterable[int] = TOPK_PERCENTS,
    by: Sequence[str] = (),
    tie_break: str = "client_id",
    ranks: DataFrame | None = None,
    population: Column | None = None,
) -> DataFrame:
    """Where the top K% of each group ends and what it holds: the order is score
    descending, then ``tie_break`` ascending, and K = max(1, ceil(n * percent / 100))
    of the group's scored rows, or of ``population`` rows.

    The cutoff score comes from ``score_ranks``. Where only part of the rows with
    that score fit, their ids are ranked the same way. Rows of ``scored`` are never
    sorted or collected."""
    if ranks is None:
        ranks = score_ranks(scored, score, by)
    by, keys = list(by), [*by, "top_percent"]
    n_before, n, total = F.col("n_before"), F.col("n"), F.col("n_total")
    rows = total if population is None else population
    # ceil by whole numbers: n * percent / 100 is not exact in doubles
    wanted = F.array(
        *(
            F.struct(
                F.lit(p).alias("top_percent"),
                F.greatest(F.lit(1), F.floor((rows * p + 99) / 100)).cast("long").alias("k"),
            )
            for p in sorted(set(percents))
        )
    )
    last = F.least(F.col("k"), total)
    ends = (
        ranks.select("*", F.inline(wanted))
        .where((n_before < last) & (last <= n_before + n))
        .select(
            *keys,
            "k",
            F.col("score").alias("cutoff_score"),
            (last - n_before).alias("take"),
            "n",
            "n_before",
            "pos",
            "pos_before",
            total.alias("row_count"),
            F.col("pos_total").alias("positive_count"),
        )
    )
    cut = _cut_inside_ties(scored, score, by, tie_break, ends)
    inside = F.col("take") < F.col("n")
    return ends.join(cut, null_safe(keys, "__{}"), "left").select(
        *keys,
        "k",
        "cutoff_score",
        F.when(inside, F.col("cutoff_id")).alias("cutoff_id"),
        (n_before + F.when(inside, F.col("taken")).otherwise(n)).alias("top_k_count"),
        (F.col("pos_before") + F.when(inside, F.col("hits")).otherwise(F.col("pos"))).alias("positives_in_top"),
        "row_count",
        "positive_count",
    )


def _cut_inside_ties(scored: DataFrame, score: str, by: Sequence[str], tie_break: str, ends: DataFrame) -> DataFrame:
    """For cutoffs that split rows of equal score: last id taken, rows and positives taken."""
    keys = [*by, "top_percent"]
    split = ends.where(F.col("take") < F.col("n")).select(
        *(F.col(c).alias(f"__{c}") for c in keys), F.col("cutoff_score").alias("__cutoff"), "take"
    )
    on = (F.col(score) == F.col("__cutoff")) & null_safe(by, "__{}")
    ids = scored.select(*by, score, F.col(tie_break).alias("__id"), F.col("label").cast("long").alias("__label"))
    tied = (
        ids.join(split, on)
        .groupBy(*(f"__{c}" for c in keys), "take", "__id")
        .agg(F.count("*").alias("m"), F.sum("__label").alias("h"))
    )
    taken = running_totals(tied, "__id", ["m"], [f"__{c}" for c in keys]).where(F.col("m_before") < F.col("take"))
    return taken.groupBy(*(f"__{c}" for c in keys)).agg(
        F.max("__id").alias("cutoff_id"), F.sum("m").alias("taken"), F.sum("h").alias("hits")
    )


def in_top(score: Column, tie_break: Column, cutoff_score: Column, cutoff_id: Column) -> Column:
    """Does a row rank at or above the cutoff?"""
    return (score > cutoff_score) | ((score == cutoff_score) & (cutoff_id.isNull() | (tie_break <= cutoff_id)))
