"""The queries of ``catalog.py`` as plain SQL over the driver's tables.

Written from the definitions, not from the DataFrame plans: joins, distinct
counts and sorts over whole tables, so that agreement means something."""

from __future__ import annotations

from clientpulse.config import (
    FEATURE_SETS,
    FEATURE_TYPES,
    FEATURE_WINDOWS,
    SKU_TYPES,
    VELOCITY_GROUPS,
    feature_families,
    feature_names,
)
from clientpulse.plans.catalog import BUCKETED, CARD, EXPORT_LIMIT, LOOKUP_IDS, SCORED_AT, SEARCH_LIMITS
from clientpulse.sources.fixtures import ORDERS_SNAPSHOT, ORDERS_TRAIN

CUTOFF, AFTER_END = "DATE '2001-07-02'", "DATE '2001-08-01'"
STREAM_CUTOFF = "DATE '2024-01-21'"

ORDER_EVENTS = """
ev AS (
  SELECT o_custkey AS client_id, CAST(o_orderdate AS TIMESTAMP) AS event_ts, CAST(o_orderdate AS DATE) AS event_date,
         'add_to_cart' AS event_type, l_partkey AS sku FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT o_custkey, CAST(l_shipdate AS TIMESTAMP), CAST(l_shipdate AS DATE), 'product_buy', l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT o_custkey, CAST(l_shipdate AS TIMESTAMP), CAST(l_shipdate AS DATE), 'remove_from_cart', l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
  UNION ALL
  SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP), CAST(o_orderdate AS DATE), 'search_query', NULL FROM orders
)"""

STREAM_EVENTS = """
ev AS (
  SELECT user_id AS client_id, ts AS event_ts, CAST(ts AS DATE) AS event_date,
         CASE event_type WHEN 'click' THEN 'add_to_cart' WHEN 'error' THEN 'remove_from_cart'
              WHEN 'purchase' THEN 'product_buy' WHEN 'view' THEN 'search_query' ELSE 'page_visit' END AS event_type,
         CASE WHEN event_type IN ('click', 'error', 'purchase')
              THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS sku,
         CASE WHEN event_type = 'signup' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS url
  FROM events
)"""

PRODUCTS = """
products AS (
  SELECT p_partkey AS sku, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS category,
         CAST(round(p_retailprice * 10) AS BIGINT) AS price, p_name AS name FROM part
)"""

REPEATED = """
raw AS (
  SELECT l_partkey AS sku, CASE WHEN l_linenumber <= 6 THEN CAST(l_linenumber AS BIGINT) END AS category,
         CAST(l_quantity AS BIGINT) AS price, l_returnflag AS name FROM lineitem
)"""

CLEAN_PRODUCTS = """
pairs AS (SELECT sku, category, price, count(*) AS n FROM raw WHERE sku IS NOT NULL GROUP BY ALL),
clean AS (
  SELECT sku, category, price FROM (
    SELECT *, row_number() OVER (PARTITION BY sku ORDER BY n DESC, category ASC NULLS LAST, price ASC NULLS LAST) AS rn
    FROM pairs) WHERE rn = 1
)"""

SCORED = """
scored AS (
  SELECT o_orderkey AS client_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label,
         floor(o_totalprice / CAST(500 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS prediction_score,
         floor((o_totalprice + CAST(20000 AS DOUBLE) * (o_custkey % 5)) / CAST(600 AS DOUBLE)) / CAST(1000 AS DOUBLE)
           AS other_score,
         o_orderstatus AS segment
  FROM orders
)"""


def with_(*parts: str) -> str:
    *ctes, select = parts
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def r6(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"


def num(name: str) -> str:
    return f"CAST({name} AS DOUBLE)"


# --- features -----------------------------------------------------------------


def count_columns(types, windows, cutoff: str) -> list[str]:
    out = []
    for t in types:
        hit = f"event_type = '{t}'"
        out.append(f"count(*) FILTER ({hit}) AS {t}_count")
        if t in SKU_TYPES:
            out.append(f"count(DISTINCT sku) FILTER ({hit}) AS distinct_{t}_sku_count")
        out.append(f"date_diff('day', max(event_date) FILTER ({hit}), {cutoff}) AS days_since_last_{t}")
        for w in windows:
            out.append(f"count(*) FILTER ({hit} AND event_date >= {cutoff} - {w}) AS {t}_count_{w}d")
    return out


def product_columns() -> list[str]:
    out = []
    for prefix, t in (("cart", "add_to_cart"), ("bought", "product_buy")):
        hit = f"event_type = '{t}'"
        out += [
            f"count(DISTINCT category) FILTER ({hit}) AS distinct_{prefix}_category_count",
            f"avg(CAST(price AS DOUBLE)) FILTER ({hit}) AS avg_{prefix}_price",
            f"max(price) FILTER ({hit}) AS max_{prefix}_price",
        ]
    return out


RATIOS = (
    ("buy_to_cart_ratio", "product_buy_count"),
    ("remove_to_cart_ratio", "remove_from_cart_count"),
    ("search_to_cart_ratio", "search_query_count"),
)


def feature_ctes(extra: tuple[str, ...] = ()) -> list[str]:
    columns = count_columns(FEATURE_TYPES, FEATURE_WINDOWS, CUTOFF) + product_columns()
    columns += [
        "count(DISTINCT event_date) FILTER (event_type = 'search_query') AS distinct_search_days",
        "count(DISTINCT event_date) AS active_days_count",
        "CAST(max(CASE WHEN event_type IN ('add_to_cart', 'product_buy') THEN 1 ELSE 0 END) AS INTEGER)"
        " AS is_eligible_purchase_propensity",
        *extra,
    ]
    ratios = [f"CASE WHEN add_to_cart_count > 0 THEN {n} / CAST(add_to_cart_count AS DOUBLE) END AS {r}" for r, n in RATIOS]
    return [
        ORDER_EVENTS,
        PRODUCTS,
        f"hist AS (SELECT ev.*, category, price FROM ev LEFT JOIN products USING (sku) WHERE event_date < {CUTOFF})",
        "counted AS (SELECT client_id, " + ",\n  ".join(columns) + " FROM hist GROUP BY client_id)",
        "features AS (SELECT *, "
        + ", ".join(ratios)
        + ", add_to_cart_count - remove_from_cart_count AS cart_minus_remove_count FROM counted)",
    ]


def label_ctes() -> list[str]:
    return [
        f"""cohort AS (SELECT DISTINCT client_id FROM ev
            WHERE event_type IN ('add_to_cart', 'product_buy') AND event_date < {CUTOFF})""",
        f"""bought AS (SELECT client_id, count(*) AS n FROM ev
            WHERE event_type = 'product_buy' AND event_ts >= {CUTOFF} AND event_ts < {AFTER_END} GROUP BY client_id)""",
        """label_rows AS (SELECT client_id, CASE WHEN n > 0 THEN 1 ELSE 0 END AS label,
            CAST(coalesce(n, 0) AS BIGINT) AS target_event_count FROM cohort LEFT JOIN bought USING (client_id))""",
    ]


def training_ctes() -> list[str]:
    return [
        *feature_ctes(),
        *label_ctes(),
        """training AS (SELECT f.*, label FROM features f JOIN label_rows USING (client_id)
            WHERE is_eligible_purchase_propensity = 1)""",
    ]


DOUBLES = frozenset({"avg_cart_price", "avg_bought_price", *(r for r, _ in RATIOS)})


def typed(columns) -> str:
    return ", ".join(r6(c, c) if c in DOUBLES else big(c, c) for c in columns)


def long_cte(source: str, columns, extra: str = "") -> str:
    """(column_name, value) rows of a wide table."""
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value{extra} FROM {source}" for c in columns]
    return "long_rows AS (" + "\n UNION ALL ".join(parts) + ")"


# --- evaluation ---------------------------------------------------------------

RATES = """
  tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(tp + fn, 1)::DOUBLE AS recall
"""
SWEEP = f"""
steps AS (SELECT CAST(range AS DOUBLE) / CAST(100 AS DOUBLE) AS threshold FROM range(1, 100)),
swept AS (
  SELECT threshold, count(*) FILTER (prediction_score >= threshold AND label = 1) AS tp,
         count(*) FILTER (prediction_score >= threshold AND label = 0) AS fp,
         count(*) FILTER (prediction_score < threshold AND label = 0) AS tn,
         count(*) FILTER (prediction_score < threshold AND label = 1) AS fn
  FROM steps CROSS JOIN scored GROUP BY threshold
),
rated AS (SELECT *, {RATES} FROM swept),
sweep AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
         (tp + fp) / (tp + fp + tn + fn)::DOUBLE AS positive_prediction_rate,
         precision / ((tp + fn) / (tp + fp + tn + fn)::DOUBLE) AS lift
  FROM rated
)"""


def points_cte() -> str:
    fields = "threshold, tp, fp, precision, recall, f1, positive_prediction_rate, lift"

    def pick(name: str, where: str, order: str) -> str:
        return f"(SELECT '{name}' AS operating_point, {fields} FROM sweep WHERE {where} ORDER BY {order} LIMIT 1)"

    rows = [pick("max_f1", "true", "f1 DESC, precision DESC, positive_prediction_rate ASC, threshold ASC")]
    rows += [pick(f"precision_ge_{p}_lowest_threshold", f"precision >= {p / 100}::DOUBLE", "threshold") for p in (20, 30, 40)]
    rows += [pick(f"recall_ge_{r}_highest_threshold", f"recall >= {r / 100}::DOUBLE", "threshold DESC") for r in (50, 70)]
    rows += [
        pick(f"population_closest_{p}pct", "true", f"abs(positive_prediction_rate - {p / 100}::DOUBLE), threshold")
        for p in (1, 5, 10, 20)
    ]
    return "points AS (" + "\n UNION ALL ".join(rows) + ")"


def topk_ctes(source: str = "scored", by: str = "", score: str = "prediction_score") -> list[str]:
    part = f"PARTITION BY {by}" if by else ""
    group = f"{by}, " if by else ""
    return [
        f"""ranked AS (SELECT *, row_number() OVER ({part} ORDER BY {score} DESC, client_id ASC) AS rn,
            count(*) OVER ({part}) AS n, sum(label) OVER ({part}) AS pos FROM {source})""",
        "percents AS (SELECT unnest([1, 5, 10]) AS top_percent)",
        f"""top AS (
            SELECT {group}top_percent, count(*) AS top_k_count, sum(label) AS positive_count, max(n) AS n, max(pos) AS pos
            FROM ranked CROSS JOIN percents WHERE rn <= greatest(1, (n * top_percent + 99) // 100)
            GROUP BY {group}top_percent)""",
        f"""topk AS (
            SELECT {group}top_percent, top_k_count, positive_count,
              positive_count / top_k_count::DOUBLE AS precision_at_k,
              CASE WHEN pos > 0 THEN positive_count / pos::DOUBLE ELSE 0 END AS recall_at_k,
              CASE WHEN pos > 0 THEN (positive_count / top_k_count::DOUBLE) / (pos / n::DOUBLE) ELSE 0 END AS lift_at_k
            FROM top)""",
    ]


def auc_ctes(source: str = "scored", by: str = "", score: str = "prediction_score") -> list[str]:
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return [
        f"""steps_ AS (SELECT {group}{score} AS s, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS pos
            FROM {source} GROUP BY {group}{score})""",
        f"""cum AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER ({part}) AS tn, sum(pos) OVER ({part}) AS tp
            FROM steps_ WINDOW w AS ({part} ORDER BY s DESC))""",
        f"""auc AS (SELECT {group}CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(pos) AS BIGINT) AS positive_count,
            CASE WHEN max(tp) > 0 AND max(tn - tp) > 0
                 THEN sum((n - pos) * ((cp - pos) + pos / 2)) / (max(tp) * max(tn - tp)) END AS roc_auc,
            CASE WHEN max(tp) > 0 AND max(tn - tp) > 0
                 THEN sum(pos * (cp / cn + CASE WHEN cn > n THEN (cp - pos) / (cn - n) ELSE cp / cn END) / 2) / max(tp) END
              AS pr_auc
            FROM cum {tail})""",
    ]


def calibration_cte() -> str:
    return """
curve AS (
  SELECT CAST(b / 10.0 AS DECIMAL(3,1))::VARCHAR || '-' || CAST((b + 1) / 10.0 AS DECIMAL(3,1))::VARCHAR AS score_bucket,
         count(client_id) AS sample_count, coalesce(avg(prediction_score), 0) AS predicted_probability_avg,
         coalesce(avg(CAST(label AS DOUBLE)), 0) AS actual_positive_rate,
         coalesce(abs(avg(prediction_score) - avg(CAST(label AS DOUBLE))), 0) AS absolute_gap
  FROM (SELECT range AS b FROM range(0, 10))
  LEFT JOIN scored ON least(floor(prediction_score * 10), 9) = b GROUP BY b
)"""


def case_buckets(value: str, cases: list[tuple[str, str]], null_label: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL THEN '{null_label}' "
        + " ".join(f"WHEN {cond.format(v=value)} THEN '{label}'" for label, cond in cases)
        + " ELSE 'unbucketed' END"
    )


COUNT_CASES = [
    ("0", "{v} = 0"),
    ("1", "{v} = 1"),
    ("2-3", "{v} IN (2, 3)"),
    ("4-10", "{v} BETWEEN 4 AND 10"),
    ("11-50", "{v} BETWEEN 11 AND 50"),
    (">50", "{v} > 50"),
]
RECENCY_CASES = [
    ("0-7 days", "{v} BETWEEN 0 AND 7"),
    ("8-30 days", "{v} BETWEEN 8 AND 30"),
    ("31-60 days", "{v} BETWEEN 31 AND 60"),
    (">60 days", "{v} > 60"),
]
RATIO_CASES = [
    ("0", "{v} = 0"),
    ("0-0.25", "{v} > 0 AND {v} <= 0.25"),
    ("0.25-0.5", "{v} > 0.25 AND {v} <= 0.5"),
    ("0.5-1.0", "{v} > 0.5 AND {v} <= 1"),
    (">1.0", "{v} > 1"),
]
DIRECTION = """CASE WHEN positive_rate > base * 1.2::DOUBLE THEN 'higher than baseline'
  WHEN positive_rate < base * 0.8::DOUBLE THEN 'lower than baseline' ELSE 'near baseline' END AS direction"""


def bucket_of(feature: str) -> str:
    if feature.startswith("days_since"):
        return case_buckets(feature, RECENCY_CASES, "null/no event")
    return case_buckets(feature, RATIO_CASES if "ratio" in feature else COUNT_CASES, "null/no value")


# --- targets and cohorts ------------------------------------------------------

WINDOWS = """
bounds AS (SELECT min(event_date) AS history_start, max(event_date) AS target_end FROM ev WHERE event_type = 'product_buy'),
days AS (SELECT unnest({days}) AS target_days),
windows AS (
  SELECT target_days, history_start, target_end, CAST(target_end - (target_days - 1) AS DATE) AS cutoff_date
  FROM bounds CROSS JOIN days
),
member AS (
  SELECT DISTINCT target_days, client_id, k FROM (
    SELECT target_days, client_id, unnest(CASE event_type
             WHEN 'product_buy' THEN ['buy', 'active', 'any'] WHEN 'add_to_cart' THEN ['cart', 'active', 'any']
             ELSE ['any'] END) AS k
    FROM ev JOIN windows ON event_date < cutoff_date)
),
buyers AS (
  SELECT DISTINCT target_days, client_id FROM ev JOIN windows ON event_date BETWEEN cutoff_date AND target_end
  WHERE event_type = 'product_buy'
),
sizes AS (
  SELECT m.target_days, k, count(*) AS eligible, count(b.client_id) AS bought
  FROM member m LEFT JOIN buyers b USING (target_days, client_id) GROUP BY ALL
)"""


def windows(days: str = "[14, 30, 45]") -> str:
    return WINDOWS.format(days=days)


COMPARISON = """
candidates AS (
  SELECT * FROM (VALUES (0, 'purchase_propensity', 'active', true, 'medium', 3, 'high', 1),
    (1, 'cart_conversion', 'cart', true, 'low_to_medium', 2, 'high', 1),
    (2, 'purchase_based_churn', 'buy', false, 'low', 1, 'medium', 2))
    AS t(o, target_name, k, buys, implementation_complexity, complexity_rank, business_value, business_value_rank)
),
cells AS (
  SELECT *, CASE WHEN buys THEN bought ELSE eligible - bought END AS positive_clients
  FROM candidates JOIN sizes USING (k)
),
rated AS (SELECT *, round(positive_clients / eligible::DOUBLE, 6) AS positive_rate,
                 round((eligible - positive_clients) / eligible::DOUBLE, 6) AS negative_rate FROM cells),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY eligible DESC) AS coverage_rank,
                  dense_rank() OVER (ORDER BY abs(positive_rate - 0.25::DOUBLE)) AS balance_rank FROM rated),
summed AS (SELECT *, coverage_rank + balance_rank + complexity_rank + business_value_rank AS score FROM ranked),
comparison AS (SELECT *, dense_rank() OVER (ORDER BY score) AS score_rank,
                      row_number() OVER (ORDER BY score, target_days, o) = 1 AS recommended FROM summed)"""

BALANCE = """
balance AS (
  SELECT w.*, eligible, bought, eligible - bought AS gone, round((eligible - bought) / eligible::DOUBLE, 6) AS churn_rate,
         round(bought / eligible::DOUBLE, 6) AS non_churn_rate,
         date_diff('day', history_start, cutoff_date) AS history_days
  FROM windows w JOIN sizes USING (target_days) WHERE k = 'buy'
)"""

FLAGS = """
flags AS (
  SELECT client_id, bool_or(event_type = 'add_to_cart' AND event_ts < {start}) AS in_cart,
         bool_or(event_type = 'product_buy' AND event_ts < {start}) AS in_buy,
         bool_or(event_type = 'search_query' AND event_ts < {start}) AS in_search,
         bool_or(event_type = 'product_buy' AND event_ts >= {start} AND event_ts < {stop}) AS bought_in_target
  FROM ev WHERE event_type IN ('add_to_cart', 'product_buy', 'search_query')
    AND (event_ts < {start} OR (event_type = 'product_buy' AND event_ts >= {start} AND event_ts < {stop}))
  GROUP BY client_id
)"""

COHORTS = """
cohort AS (
  SELECT client_id, bought_in_target, candidate, in_cart OR in_buy AS in_current, in_cart FROM (
    SELECT *, unnest([
      CASE WHEN in_cart OR in_buy THEN 'current_prior_cart_or_purchase' END,
      CASE WHEN in_cart THEN 'cart_only' END,
      CASE WHEN in_search OR in_cart OR in_buy THEN 'search_cart_buy' END,
      CASE WHEN in_buy THEN 'buy_only' END,
      CASE WHEN in_search AND NOT in_cart AND NOT in_buy THEN 'search_only' END]) AS candidate
    FROM flags) WHERE candidate IS NOT NULL
),
names AS (SELECT unnest(['current_prior_cart_or_purchase', 'cart_only', 'search_cart_buy', 'buy_only', 'search_only'])
          AS candidate)"""


def order_flags() -> str:
    return FLAGS.format(start=CUTOFF, stop=AFTER_END)


PATHS = f"""
carts AS (SELECT client_id, sku, event_ts FROM ev WHERE event_type = 'add_to_cart' AND event_ts < {CUTOFF}),
purchases AS (SELECT client_id, sku, event_ts, row_number() OVER () AS id FROM ev
              WHERE event_type = 'product_buy' AND event_ts >= {CUTOFF} AND event_ts < {AFTER_END}),
firsts AS (SELECT client_id, sku, min(event_ts) AS first_ts FROM purchases GROUP BY ALL),
matched AS (SELECT f.client_id, f.sku, f.first_ts, max(c.event_ts) AS cart_ts
            FROM firsts f JOIN carts c ON c.client_id = f.client_id AND c.sku = f.sku AND c.event_ts < f.first_ts
            GROUP BY ALL)"""


def check_rows(rows: list[tuple[str, str, str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS check_name, CASE WHEN {ok} THEN 'pass' ELSE 'fail' END AS status, "
        f"CAST({observed} AS VARCHAR) AS observed_value, CAST({expected} AS VARCHAR) AS expected_value FROM s"
        for name, ok, observed, expected in rows
    )


def zero(name: str, column: str) -> tuple[str, str, str, str]:
    return name, f"{column} = 0", column, "0"


DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
RAW_OF = {"add_to_cart": "click", "remove_from_cart": "error", "product_buy": "purchase"}


def overview_part(name: str, source: str, columns: str, n_columns: int) -> str:
    has = {c: c in columns.split() for c in ("client_id", "timestamp", "sku", "url", "query", "category", "price")}
    flags = ", ".join(f"{str(v).lower()} AS has_{c}" for c, v in has.items())
    return f"""SELECT '{name}' AS table_name, count(*) AS row_count, 'counted' AS row_count_status,
      CAST({n_columns} AS BIGINT) AS column_count, CAST(min(ts) AS VARCHAR) AS timestamp_min,
      CAST(max(ts) AS VARCHAR) AS timestamp_max, {flags} FROM events WHERE event_type = '{source}'"""


def card_sql() -> str:
    terms = [repr(CARD["intercept"]) + "::DOUBLE"]
    filled = []
    for name, c in zip(CARD["feature_order"], CARD["coefficients"]):
        default = CARD["imputation_values"][name]
        terms.append(f"coalesce(CAST({name} AS DOUBLE), {default!r}::DOUBLE) * {c!r}::DOUBLE")
        filled.append(f"CASE WHEN {name} IS NULL THEN '{name}' END")
    return f"""carded AS (
      SELECT *, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END AS raw_score,
             concat_ws(',', {', '.join(filled)}) AS missing_features_filled
      FROM (SELECT *, {' + '.join(terms)} AS z FROM features))"""


def stats_select(source: str, columns, quantiles: dict[str, float]) -> list[str]:
    qs = ", ".join(f"quantile_cont(value, {q}) AS {n}" for n, q in quantiles.items())
    return [
        long_cte(source, columns),
        f"""stats AS (SELECT column_name, count(*) AS row_count, count(value) AS non_null_count,
            count(DISTINCT value) AS distinct_count, avg(value) AS mean, stddev_samp(value) AS stddev,
            var_samp(value) AS variance, min(value) AS min, max(value) AS max, {qs},
            count(*) FILTER (value = 0) AS zero_count FROM long_rows GROUP BY column_name)""",
    ]


SCORE_QS = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
FEATURE_QS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def score_stats_select() -> str:
    names = ["mean", "variance", "stddev", "min", *SCORE_QS, "max"]
    return (
        "SELECT column_name AS score_name, CAST(non_null_count AS BIGINT) AS count, "
        + ", ".join(r6(n, n) for n in names)
        + " FROM stats"
    )


def family_rows_sql(families=None) -> str:
    rows = [
        f"('{f}', '{family}', {i})"
        for i, (f, family) in enumerate((f, family) for family, fs in (families or feature_families()).items() for f in fs)
    ]
    return "fam AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(feature, family, pos))"


def audit_ctes() -> list[str]:
    return [
        *training_ctes(),
        long_cte("training", [f for fs in feature_families().values() for f in fs]),
        family_rows_sql(),
        """moments AS (SELECT column_name AS feature, count(*) AS row_count, count(value) AS non_null_count,
            count(DISTINCT value) AS distinct_count, stddev_samp(value) AS stddev, var_samp(value) AS variance,
            min(value) AS lo, max(value) AS hi FROM long_rows GROUP BY column_name)""",
        """audited AS (SELECT *, distinct_count <= 1 OR stddev IS NULL OR stddev = 0 AS is_constant
            FROM moments JOIN fam USING (feature))""",
    ]


def matrix_ctes(source: str, families=None, zero_nulls: bool = True) -> list[str]:
    """Long values with a row id, joined with themselves per pair of features."""
    columns = [f for fs in (families or feature_families()).values() for f in fs]
    value = "coalesce(CAST({c} AS DOUBLE), 0)" if zero_nulls else "CAST({c} AS DOUBLE)"
    parts = [f"corr({value.format(c=a)}, {value.format(c=b)}) AS p{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    if not zero_nulls:
        parts = [
            f"corr({value.format(c=a)}, {value.format(c=b)}) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS p{i}_{j}"
            for i, a in enumerate(columns)
            for j, b in enumerate(columns)
            if i < j
        ]
    wide = f"wide AS (SELECT {', '.join(parts)} FROM {source})"
    cells = [
        f"SELECT '{a}' AS l, '{b}' AS r, p{i}_{j} AS c FROM wide" for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j
    ]
    return [
        wide,
        "pairs AS (" + " UNION ALL ".join(cells) + ")",
        """matrix AS (
            SELECT l, a.family AS fl, r, b.family AS fr,
              CASE WHEN a.is_constant OR b.is_constant OR isnan(c) THEN NULL ELSE c END AS c,
              CASE WHEN a.is_constant OR b.is_constant THEN 'skipped_constant_feature'
                   WHEN c IS NULL OR isnan(c) THEN 'not_computable' ELSE 'ok' END AS status
            FROM pairs JOIN audited a ON a.feature = l JOIN audited b ON b.feature = r)""",
    ]


MATRIX_SELECT = f"""SELECT l AS feature_left, fl AS family_left, r AS feature_right, fr AS family_right,
  {r6('c', 'correlation')}, {r6('abs(c)', 'absolute_correlation')}, status AS correlation_status FROM matrix"""

FAMILY_CORRELATION = """
sides AS (
  SELECT fl AS family, abs(c) AS c, r = 'active_days_count' AS anchored, fl = fr AS inner_pair FROM matrix
  UNION ALL SELECT fr, abs(c), l = 'active_days_count', fl = fr FROM matrix
),
famcorr AS (
  SELECT family, avg(c) FILTER (inner_pair) AS within_avg, avg(c) FILTER (anchored) AS anchor_avg,
         max(c) FILTER (anchored) AS anchor_max FROM sides GROUP BY family
)"""
FAMILY_COLUMNS = ", ".join(
    (
        r6("within_avg", "average_pairwise_correlation"),
        r6("anchor_avg", "average_correlation_with_active_days_count"),
        r6("anchor_max", "max_correlation_with_active_days_count"),
    )
)


def window_review_sql() -> str:
    rows = []
    for t in FEATURE_TYPES:
        total = f"{t}_count"
        steps = [f"{total}_{w}d" for w in FEATURE_WINDOWS]
        for name in (total, *steps):
            i = steps.index(name) if name in steps else None
            before = steps[i - 1] if i else None
            after = steps[i + 1] if i is not None and i + 1 < len(steps) else None

            def r(other: str | None) -> str:
                if other is None:
                    return "NULL"
                return "1" if other == name else f"corr({num(name)}, {num(other)})"

            kind = "total_count" if i is None else name.removeprefix(total + "_")
            advice = "KEEP_EVALUATE_SEPARATELY" if i == len(steps) - 1 else "KEEP"
            rows.append(
                f"SELECT '{name}' AS feature_name, '{t}_activity' AS family, '{kind}' AS window_type, "
                f"{r6(f'var_samp({num(name)})', 'variance')}, {r6(r(total), 'correlation_with_total_count')}, "
                f"{r6(r(steps[0]), 'correlation_with_shortest')}, {r6(r(before), 'correlation_with_previous_window')}, "
                f"{r6(r(after), 'correlation_with_next_window')}, '{advice}' AS recommendation FROM training"
            )
    return "\nUNION ALL ".join(rows)


SCORES = f"""
scores AS (SELECT client_id, prediction_score, CASE WHEN prediction_score >= 0.5::DOUBLE THEN 1 ELSE 0 END AS prediction_label,
                  'fixed_v1' AS model_version, '{SCORED_AT}' AS scored_at FROM scored)"""
SCORE_SELECT = f"""{r6('prediction_score', 'prediction_score')}, {big('prediction_label', 'prediction_label')},
  model_version, scored_at"""


def segment_metrics_sql() -> str:
    segment_rows = """
long_segments AS (
  SELECT client_id, label, s, 'activity_segment' AS segment_type, activity_segment AS segment_name FROM segmented
  UNION ALL SELECT client_id, label, s, 'lifecycle_segment', lifecycle_segment FROM segmented
)"""
    by = "segment_type, segment_name"
    tops = ", ".join(
        r6(f"max({m}_at_k) FILTER (top_percent = {p})", f"{m}_at_{p}pct") for p in (1, 5, 10) for m in ("precision", "recall", "lift")
    )
    return with_(
        *training_ctes(),
        card_sql().replace("FROM features", "FROM training"),
        """segmented AS (SELECT client_id, label, round(raw_score, 6) AS s,
            CASE WHEN active_days_count > (SELECT quantile_cont(active_days_count, 0.5) FROM training)
                 THEN 'high_activity' ELSE 'low_activity' END AS activity_segment,
            CASE WHEN product_buy_count > 0 THEN 'returning_users' ELSE 'new_users' END AS lifecycle_segment FROM carded)""",
        segment_rows,
        *topk_ctes("long_segments", by, "s"),
        *auc_ctes("long_segments", by, "s"),
        f"""SELECT {by}, row_count, positive_count, row_count - positive_count AS negative_count,
          {r6('positive_count / row_count::DOUBLE', 'positive_rate')}, {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')},
          tops.* EXCLUDE (segment_type, segment_name)
        FROM auc JOIN (SELECT {by}, {tops} FROM topk GROUP BY {by}) tops USING ({by})""",
    )


def velocity_sql() -> str:
    def v(short: str, long: str) -> str:
        return f"({short} + 1)::DOUBLE / ({long} + 1)"

    exprs = {
        "cart_velocity_30d_vs_90d": v("add_to_cart_count_30d", "add_to_cart_count_90d"),
        "cart_delta_30d_90d": "add_to_cart_count_30d - add_to_cart_count_90d / 3::DOUBLE",
        "buy_velocity_30d_vs_90d": v("product_buy_count_30d", "product_buy_count_90d"),
        "buy_delta_30d_90d": "product_buy_count_30d - product_buy_count_90d / 3::DOUBLE",
        "search_velocity_30d_vs_90d": v("search_query_count_30d", "search_query_count_90d"),
        "activity_intensity_ratio": v("active_30", "active_days_count"),
    }
    active = f"count(DISTINCT event_date) FILTER (event_date >= {CUTOFF} - 30) AS active_30"
    columns = ", ".join(r6(exprs[n], n) for n in FEATURE_SETS["e6"].engineered)
    return with_(*feature_ctes((active,)), f"SELECT client_id, {columns} FROM features")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # profiles and preparation
    q["profile_events"] = """
SELECT 'add_to_cart' AS table_name, count(*) AS row_count, count(*) FILTER (user_id IS NULL) AS client_id_null_count,
  count(*) FILTER (props IS NULL) AS sku_null_count, count(*) FILTER (ts IS NULL) AS timestamp_null_count,
  count(DISTINCT user_id) AS client_id_distinct_count,
  count(DISTINCT regexp_extract(props, '([0-9]+)', 1)) AS sku_distinct_count,
  CAST(min(ts) AS VARCHAR) AS timestamp_min, CAST(max(ts) AS VARCHAR) AS timestamp_max,
  count(ts) AS timestamp_parse_success_count, CAST(0 AS BIGINT) AS timestamp_parse_failure_count
FROM events WHERE event_type = 'click'"""
    none, key = "CAST(NULL AS BIGINT)", "count(DISTINCT regexp_extract(props, '([0-9]+)', 1))"
    q["profile_all_events"] = "\nUNION ALL ".join(
        f"""
SELECT '{name}' AS table_name, count(*) AS row_count, count(*) FILTER (user_id IS NULL) AS client_id_null_count,
  {nulls if entity == 'sku' else none} AS sku_null_count, count(*) FILTER (ts IS NULL) AS timestamp_null_count,
  count(DISTINCT user_id) AS client_id_distinct_count, {key if entity == 'sku' else none} AS sku_distinct_count,
  CAST(min(ts) AS VARCHAR) AS timestamp_min, CAST(max(ts) AS VARCHAR) AS timestamp_max,
  count(ts) AS timestamp_parse_success_count, CAST(0 AS BIGINT) AS timestamp_parse_failure_count,
  {nulls if entity == 'query' else none} AS query_null_count, {nulls if entity == 'url' else none} AS url_null_count,
  {key if entity == 'url' else none} AS url_distinct_count
FROM events WHERE event_type = '{source}'"""
        for nulls in ("count(*) FILTER (props IS NULL)",)
        for name, source, entity in (
            ("add_to_cart", "click", "sku"),
            ("remove_from_cart", "error", "sku"),
            ("product_buy", "purchase", "sku"),
            ("search_query", "view", "query"),
            ("page_visit", "signup", "url"),
        )
    )
    q["table_overview"] = "\nUNION ALL ".join(
        overview_part(name, source, columns, n)
        for name, source, columns, n in (
            ("add_to_cart", "click", "client_id timestamp sku", 3),
            ("remove_from_cart", "error", "client_id timestamp sku", 3),
            ("product_buy", "purchase", "client_id timestamp sku", 3),
            ("search_query", "view", "client_id timestamp query", 3),
            ("page_visit", "signup", "client_id timestamp url", 3),
        )
    )
    q["event_overview"] = with_(
        STREAM_EVENTS,
        """SELECT event_type, count(*) AS row_count, count(DISTINCT client_id) AS distinct_client_id_count,
  count(*) FILTER (client_id IS NULL) AS null_client_id_count,
  strftime(min(event_ts), '%Y-%m-%d %H:%M:%S') AS timestamp_min,
  strftime(max(event_ts), '%Y-%m-%d %H:%M:%S') AS timestamp_max,
  count(*) FILTER (event_ts IS NULL) AS null_timestamp_count,
  CASE event_type WHEN 'search_query' THEN 'query' WHEN 'page_visit' THEN 'url' ELSE 'sku' END AS entity_column,
  count(DISTINCT coalesce(sku, url)) AS distinct_entity_count,
  count(*) FILTER (coalesce(sku, url) IS NULL) AS null_entity_count
FROM ev GROUP BY event_type""",
    )
    q["product_overview"] = with_(
        PRODUCTS,
        f"""SELECT count(*) AS row_count, count(DISTINCT sku) AS distinct_sku_count,
  count(*) FILTER (sku IS NULL) AS null_sku_count, count(DISTINCT category) AS distinct_category_count,
  count(*) FILTER (category IS NULL) AS null_category_count, count(*) FILTER (price IS NULL) AS null_price_count,
  min(price) AS price_min, max(price) AS price_max, {r6('avg(CAST(price AS DOUBLE))', 'price_avg')},
  count(*) FILTER (name IS NULL) AS null_name_count, {r6('quantile_cont(CAST(price AS DOUBLE), 0.25)', 'price_q25')},
  {r6('quantile_cont(CAST(price AS DOUBLE), 0.5)', 'price_median')},
  {r6('quantile_cont(CAST(price AS DOUBLE), 0.75)', 'price_q75')} FROM products""",
    )
    q["price_quantiles"] = with_(
        REPEATED,
        long_cte("raw", ["price", "category"]),
        f"""SELECT column_name, count(DISTINCT value) AS distinct_count, {r6('quantile_cont(value, 0.25)', 'price_q25')},
  {r6('quantile_cont(value, 0.5)', 'price_median')}, {r6('quantile_cont(value, 0.75)', 'price_q75')}
FROM long_rows GROUP BY column_name""",
    )
    every_type = {**RAW_OF, "search_query": "view", "page_visit": "signup"}
    entity_of = {"search_query": None, "page_visit": "url"}

    def entity_counts(event_type: str) -> str:
        entity = entity_of.get(event_type, "sku")
        return ", ".join(
            f"""{'count(*) FILTER (props IS NULL)' if e == entity else 'CAST(NULL AS BIGINT)'} AS {e}_null_count,
  {'CAST(0 AS BIGINT)' if e == entity else 'CAST(NULL AS BIGINT)'} AS {e}_parse_failure_count"""
            for e in ("sku", "url")
        )

    q["validation_counts"] = "\nUNION ALL ".join(
        f"""SELECT '{t}' AS event_type, count(*) AS input_rows, count(*) AS valid_rows, CAST(0 AS BIGINT) AS invalid_rows,
  count(*) FILTER (ts IS NULL) AS event_ts_null_count, CAST(0 AS BIGINT) AS event_ts_parse_failure_count,
  min(CAST(ts AS DATE)) AS event_date_min, max(CAST(ts AS DATE)) AS event_date_max,
  count(*) FILTER (user_id IS NULL) AS client_id_null_count, CAST(0 AS BIGINT) AS client_id_parse_failure_count,
  {entity_counts(t)}
FROM events WHERE event_type = '{source}'"""
        for t, source in every_type.items()
    )
    q["validation_of_text_ids"] = "\nUNION ALL ".join(
        f"""SELECT '{t}' AS event_type, count(*) AS input_rows, count(*) FILTER (client AND item) AS valid_rows,
  count(*) FILTER (NOT (client AND item)) AS invalid_rows, CAST(0 AS BIGINT) AS event_ts_null_count,
  CAST(0 AS BIGINT) AS event_ts_parse_failure_count, min(CAST(ts AS DATE)) AS event_date_min,
  max(CAST(ts AS DATE)) AS event_date_max, CAST(0 AS BIGINT) AS client_id_null_count,
  count(*) FILTER (NOT client) AS client_id_parse_failure_count, count(*) FILTER (k LIKE '%7') AS sku_null_count,
  count(*) FILTER (k LIKE '%3') AS sku_parse_failure_count, count(*) FILTER (client AND item) AS clean_rows,
  CAST(sum(user_id) FILTER (client AND item) AS BIGINT) AS client_id_sum,
  CAST(sum(CAST(k AS BIGINT)) FILTER (client AND item) AS BIGINT) AS sku_sum
FROM (SELECT *, CAST(user_id AS VARCHAR) NOT LIKE '%5' AS client, k NOT LIKE '%7' AND k NOT LIKE '%3' AS item
      FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k FROM events) WHERE event_type = '{source}')"""
        for t, source in RAW_OF.items()
    )
    q["inventory"] = "\nUNION ALL ".join(
        f"""SELECT '{t}' AS dataset, 'parquet' AS inferred_format, true AS readable_by_spark,
  (SELECT count(*) FROM {t}) AS row_count, 'counted' AS row_count_status,
  (SELECT count(*) FROM (DESCRIBE {t})) AS column_count"""
        for t in DRIVER_TABLES
    )
    duplicates = f"""CAST(coalesce(sum(n), 0) AS BIGINT) AS valid_rows, count(*) FILTER (n > 1) AS duplicate_key_groups,
  {big('coalesce(sum(n - 1), 0)', 'duplicate_extra_rows')}, {r6('sum(n - 1) / sum(n)::DOUBLE', 'duplicate_extra_row_rate')}"""
    q["duplicate_summary"] = with_(
        STREAM_EVENTS,
        "g AS (SELECT client_id, event_date, event_type, count(*) AS n FROM ev GROUP BY ALL)",
        f"SELECT {duplicates} FROM g",
    )
    q["duplicate_events"] = with_(
        STREAM_EVENTS,
        "g AS (SELECT event_type, client_id, event_ts, sku, url, count(*) AS n FROM ev GROUP BY ALL)",
        f"SELECT event_type, {duplicates} FROM g GROUP BY event_type",
    )
    q["clean_events"] = with_(STREAM_EVENTS, "SELECT client_id, event_ts, event_date, event_type, sku, url FROM ev")
    q["clean_products"] = with_(REPEATED, CLEAN_PRODUCTS, "SELECT sku, category, price FROM clean")
    q["product_validation"] = with_(
        REPEATED,
        "g AS (SELECT sku, count(*) AS n FROM raw WHERE sku IS NOT NULL GROUP BY sku)",
        """SELECT count(*) AS input_rows, count(DISTINCT sku) AS distinct_sku_count,
  count(*) FILTER (sku IS NULL) AS null_sku_count, CAST(0 AS BIGINT) AS sku_parse_failure_count,
  count(*) FILTER (category IS NULL) AS null_category_count,
  count(*) FILTER (price IS NULL) AS null_price_count, count(*) FILTER (name IS NULL) AS null_name_count,
  (SELECT count(*) FROM g WHERE n > 1) AS duplicated_sku_count,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM g) AS duplicate_extra_rows,
  count(DISTINCT sku) AS output_rows FROM raw""",
    )

    def per_sku(source: str) -> str:
        return f"""{source}_sku AS (SELECT sku, count(*) AS n, count(DISTINCT category) AS c, count(DISTINCT price) AS p,
            count(DISTINCT coalesce(CAST(category AS VARCHAR), '?') || '/' || coalesce(CAST(price AS VARCHAR), '?')) AS cp
            FROM {source} GROUP BY sku)"""

    profile_columns = {
        "row_count": "sum(n)",
        "distinct_sku_count": "count(sku)",
        "sku_with_multiple_rows": "count(*) FILTER (n > 1)",
        "sku_with_multiple_category_values": "count(*) FILTER (c > 1)",
        "sku_with_multiple_price_values": "count(*) FILTER (p > 1)",
        "sku_with_multiple_category_price_pairs": "count(*) FILTER (cp > 1)",
        "max_rows_per_sku": "max(n)",
    }
    q["metadata_profile"] = with_(
        REPEATED,
        per_sku("raw"),
        "SELECT 'raw' AS source, " + ", ".join(big(e, c) for c, e in profile_columns.items()) + " FROM raw_sku",
    )
    consistency = [
        f"SELECT '{label}_{c}' AS metric, CAST(CAST({e} AS BIGINT) AS VARCHAR) AS value FROM {source}_sku"
        for label, source in (("raw", "raw"), ("processed", "clean"))
        for c, e in profile_columns.items()
    ]
    consistency.append(
        "SELECT 'metadata_join_row_expansion_risk', CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'yes' ELSE 'no' END FROM raw_sku"
    )
    consistency.append(
        "SELECT 'recommended_handling', CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'review_or_deduplicate_before_join' "
        "ELSE 'use_processed_product_properties_clean' END FROM clean_sku"
    )
    q["metadata_consistency"] = with_(REPEATED, CLEAN_PRODUCTS, per_sku("raw"), per_sku("clean"), " UNION ALL ".join(consistency))
    frequency = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
    thresholds = {"exactly_1": "n = 1", "2_plus": "n >= 2", "3_plus": "n >= 3", "5_plus": "n >= 5"}

    def frequency_name(k: str) -> str:
        return f"clients_with_{k}_purchase" + ("" if k == "exactly_1" else "s")

    q["purchase_frequency"] = with_(
        ORDER_EVENTS,
        "c AS (SELECT client_id, count(*) AS n FROM ev WHERE event_type = 'product_buy' GROUP BY client_id)",
        f"""SELECT count(*) AS total_purchasing_clients, {big('sum(n)', 'total_purchase_events')},
  {r6('sum(n) / count(*)::DOUBLE', 'average_purchases_per_purchasing_client')}, """
        + ", ".join(f"count(*) FILTER ({w}) AS {frequency_name(k)}" for k, w in thresholds.items())
        + ", "
        + ", ".join(
            f"round(count(*) FILTER ({w}) / count(*)::DOUBLE * 100, 4) AS {frequency_name(k)}_pct" for k, w in thresholds.items()
        )
        + ", "
        + ", ".join(r6(f"quantile_cont(CAST(n AS DOUBLE), {v})", f"purchase_count_{n}") for n, v in frequency.items())
        + " FROM c",
    )

    # targets and cohorts
    q["target_windows"] = with_(
        ORDER_EVENTS,
        windows(),
        """SELECT CAST(target_days AS BIGINT) AS target_days, history_start, cutoff_date, target_end,
  CAST(date_diff('day', history_start, cutoff_date) AS BIGINT) AS history_days FROM windows""",
    )
    q["churn_balance"] = with_(
        ORDER_EVENTS,
        windows(),
        BALANCE,
        """SELECT CAST(target_days AS BIGINT) AS target_days, history_start, cutoff_date, target_end, history_days,
  eligible AS eligible_clients, gone AS churn_clients, bought AS non_churn_clients, churn_rate, non_churn_rate FROM balance""",
    )
    q["target_comparison"] = with_(
        ORDER_EVENTS,
        windows(),
        COMPARISON,
        """SELECT target_name, CAST(target_days AS BIGINT) AS target_days, history_start, cutoff_date, target_end,
  eligible AS eligible_clients, positive_clients, eligible - positive_clients AS negative_clients, positive_rate, negative_rate,
  CASE WHEN positive_rate < 0.1 THEN 'positive_class_low' WHEN positive_rate > 0.4 THEN 'positive_class_high'
       ELSE 'moderate_for_baseline' END AS label_imbalance_note,
  implementation_complexity, business_value, coverage_rank, balance_rank, CAST(complexity_rank AS BIGINT) AS complexity_rank,
  CAST(business_value_rank AS BIGINT) AS business_value_rank, CAST(score AS BIGINT) AS overall_recommendation_score,
  score_rank AS overall_recommendation_rank, recommended FROM comparison JOIN windows USING (target_days)""",
    )
    q["recommend_target"] = with_(
        ORDER_EVENTS,
        windows(),
        COMPARISON,
        """SELECT target_name, CAST(target_days AS BIGINT) AS target_days, eligible AS eligible_clients, positive_rate,
  CAST(score AS BIGINT) AS overall_recommendation_score FROM comparison WHERE recommended""",
    )
    q["recommend_window"] = with_(
        ORDER_EVENTS,
        windows(),
        BALANCE,
        """SELECT CAST(target_days AS BIGINT) AS target_days, cutoff_date, target_end, eligible AS eligible_clients, churn_rate,
  non_churn_rate FROM balance
ORDER BY CASE WHEN target_days = 30 AND non_churn_rate >= 0.03 THEN 0 ELSE 1 END, non_churn_rate DESC, balance.target_days LIMIT 1""",
    )
    cohort_select = """SELECT CAST(target_days AS BIGINT) AS target_days, cutoff_date, target_end, cohort_option,
  eligible AS eligible_clients, bought AS clients_with_purchase_in_target,
  round(bought / eligible::DOUBLE, 6) AS target_positive_rate, 'computed' AS status
FROM windows JOIN (SELECT *, CASE k WHEN 'buy' THEN 'A' WHEN 'active' THEN 'B' ELSE 'C' END AS cohort_option FROM sizes
                   WHERE k IN ({kinds})) USING (target_days)"""
    q["active_cohorts"] = with_(
        ORDER_EVENTS,
        windows(),
        cohort_select.format(kinds="'buy', 'active'")
        + """ UNION ALL SELECT CAST(target_days AS BIGINT), cutoff_date, target_end, 'C', NULL, NULL, NULL, 'skipped' FROM windows""",
    )
    q["active_cohorts_broad"] = with_(STREAM_EVENTS, windows("[3, 7, 14]"), cohort_select.format(kinds="'buy', 'active', 'any'"))
    q["cohort_flags"] = with_(
        STREAM_EVENTS,
        FLAGS.format(start="DATE '2024-01-30'", stop="DATE '2024-01-31'"),
        "SELECT client_id, in_cart, in_buy, in_search, bought_in_target FROM flags",
    )
    overlap = {
        "add_to_cart_before_cutoff": "cart",
        "product_buy_before_cutoff": "buy",
        "search_query_before_cutoff": "srch",
        "current_add_to_cart_or_product_buy_before_cutoff": "cur",
        "cart_conversion_cohort": "cart",
        "buyers_without_cart_before_cutoff": "buy_no_cart",
        "search_only_before_cutoff": "search_only",
        "add_to_cart_product_buy_jaccard_overlap": "both_ / cur::DOUBLE",
        "buyers_without_cart_rate": "buy_no_cart / cur::DOUBLE",
        "current_vs_cart_cohort_extra_clients": "cur - cart",
        "current_vs_cart_cohort_extra_rate": "(cur - cart) / cur::DOUBLE",
    }
    q["cohort_overlap"] = with_(
        ORDER_EVENTS,
        order_flags(),
        """s AS (SELECT count(*) FILTER (in_cart) AS cart, count(*) FILTER (in_buy) AS buy, count(*) FILTER (in_search) AS srch,
            count(*) FILTER (in_cart OR in_buy) AS cur, count(*) FILTER (in_buy AND NOT in_cart) AS buy_no_cart,
            count(*) FILTER (in_search AND NOT in_cart AND NOT in_buy) AS search_only,
            count(*) FILTER (in_cart AND in_buy) AS both_ FROM flags)""",
        " UNION ALL ".join(f"SELECT '{n}' AS cohort_name, {r6(e, 'value')} FROM s" for n, e in overlap.items()),
    )
    q["candidate_cohorts"] = with_(
        ORDER_EVENTS,
        order_flags(),
        COHORTS,
        f"""SELECT candidate, count(client_id) AS cohort_client_count,
  count(*) FILTER (in_current) AS overlap_with_current_count,
  {r6('CASE WHEN count(client_id) > 0 THEN count(*) FILTER (in_current) / count(client_id)::DOUBLE END', 'overlap_with_current_rate')},
  count(*) FILTER (NOT in_current) AS extra_clients_vs_current, count(*) FILTER (NOT in_cart) AS extra_clients_vs_cart_only,
  count(*) FILTER (bought_in_target) AS positive_client_count,
  count(client_id) - count(*) FILTER (bought_in_target) AS negative_client_count,
  {r6('CASE WHEN count(client_id) > 0 THEN count(*) FILTER (bought_in_target) / count(client_id)::DOUBLE END', 'positive_rate')},
  CASE WHEN count(client_id) > 0 AND count(*) FILTER (bought_in_target) / count(client_id)::DOUBLE < 0.05 THEN 'high'
       ELSE 'moderate' END AS class_imbalance_risk
FROM names LEFT JOIN cohort USING (candidate) GROUP BY candidate""",
    )
    q["overlap_matrix"] = with_(
        ORDER_EVENTS,
        order_flags(),
        COHORTS,
        "counts AS (SELECT candidate, count(client_id) AS n FROM names LEFT JOIN cohort USING (candidate) GROUP BY candidate)",
        """both_ AS (SELECT a.candidate AS l, b.candidate AS r, count(*) AS i FROM cohort a JOIN cohort b USING (client_id)
            GROUP BY ALL)""",
        f"""SELECT a.candidate AS left_candidate, b.candidate AS right_candidate, a.n AS left_count, b.n AS right_count,
  coalesce(i, 0) AS intersection_count,
  {r6('CASE WHEN a.n > 0 THEN coalesce(i, 0) / a.n::DOUBLE END', 'intersection_over_left_rate')},
  {r6('CASE WHEN a.n + b.n - coalesce(i, 0) > 0 THEN coalesce(i, 0) / (a.n + b.n - coalesce(i, 0))::DOUBLE END', 'jaccard_rate')}
FROM counts a CROSS JOIN counts b LEFT JOIN both_ ON l = a.candidate AND r = b.candidate""",
    )

    # paths
    buyers = "SELECT count(DISTINCT client_id) FROM purchases"
    path_rows = {
        "target_window_buyers": (f"({buyers})", f"({buyers})"),
        "target_window_buyers_with_add_to_cart_before_cutoff": (
            "(SELECT count(DISTINCT client_id) FROM purchases WHERE client_id IN (SELECT client_id FROM carts))",
            f"({buyers})",
        ),
        "target_window_buyers_without_add_to_cart_before_cutoff": (
            "(SELECT count(DISTINCT client_id) FROM purchases WHERE client_id NOT IN (SELECT client_id FROM carts))",
            f"({buyers})",
        ),
        "target_window_buyers_with_prior_same_sku_cart_before_first_purchase": (
            "(SELECT count(DISTINCT client_id) FROM matched)",
            f"({buyers})",
        ),
        "target_purchase_events": ("(SELECT count(*) FROM purchases)", "(SELECT count(*) FROM purchases)"),
        "target_purchase_events_with_prior_same_sku_add_to_cart": (
            """(SELECT count(DISTINCT id) FROM purchases p JOIN carts c ON c.client_id = p.client_id AND c.sku = p.sku
                AND c.event_ts < p.event_ts)""",
            "(SELECT count(*) FROM purchases)",
        ),
    }
    q["purchase_path"] = with_(
        ORDER_EVENTS,
        PATHS,
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, {v} AS value, {d} AS denominator, "
            + r6(f"CASE WHEN {d} > 0 THEN {v} / CAST({d} AS DOUBLE) END", "rate")
            for m, (v, d) in path_rows.items()
        ),
    )
    q["cart_delay_quantiles"] = with_(
        ORDER_EVENTS,
        PATHS,
        "d AS (SELECT date_diff('day', CAST(cart_ts AS DATE), CAST(first_ts AS DATE)) AS x FROM matched)",
        f"""SELECT count(*) AS path_count, min(x) AS min_delay_days, {r6('quantile_cont(CAST(x AS DOUBLE), 0.5)', 'p50_delay_days')},
  {r6('quantile_cont(CAST(x AS DOUBLE), 0.75)', 'p75_delay_days')}, {r6('quantile_cont(CAST(x AS DOUBLE), 0.9)', 'p90_delay_days')},
  max(x) AS max_delay_days FROM d""",
    )
    q["latest_prior_cart"] = with_(
        STREAM_EVENTS,
        """SELECT p.client_id, p.sku, p.event_ts AS purchase_ts, (SELECT max(c.event_ts) FROM ev c
  WHERE c.event_type = 'add_to_cart' AND c.client_id = p.client_id AND c.sku = p.sku AND c.event_ts < p.event_ts)
  AS latest_cart_ts FROM ev p WHERE p.event_type = 'product_buy'""",
    )
    near = """s.event_type = 'search_query' AND s.client_id = c.client_id AND s.event_ts <= c.event_ts
  AND s.event_ts >= c.event_ts - INTERVAL 1 DAY"""
    q["carts_after_search"] = with_(
        STREAM_EVENTS,
        f"""SELECT c.client_id, c.sku, c.event_ts AS cart_ts FROM ev c WHERE c.event_type = 'add_to_cart'
  AND EXISTS (SELECT 1 FROM ev s WHERE {near})""",
    )
    recent = f"""s.event_type = 'search_query' AND s.client_id = c.client_id AND s.event_ts <= c.event_ts
  AND s.event_date >= {STREAM_CUTOFF} - 3 AND s.event_date < {STREAM_CUTOFF}"""
    q["transition_features"] = with_(
        STREAM_EVENTS,
        f"""carts AS (SELECT c.client_id, EXISTS (SELECT 1 FROM ev s WHERE {near} AND s.event_date < {STREAM_CUTOFF}) AS assisted,
            EXISTS (SELECT 1 FROM ev s WHERE {recent}) AS recent
            FROM ev c WHERE c.event_type = 'add_to_cart' AND c.event_date < {STREAM_CUTOFF})""",
        f"""SELECT client_id, count(*) FILTER (assisted) AS search_before_cart_count,
  {r6('(count(*) FILTER (assisted) + 1) / (count(*) + 2)::DOUBLE', 'search_to_cart_rate')},
  {big('max(CASE WHEN recent THEN 1 ELSE 0 END)', 'recent_search_then_cart_flag')} FROM carts GROUP BY client_id""",
    )
    q["recent_search_then_cart"] = with_(
        STREAM_EVENTS,
        f"""SELECT DISTINCT c.client_id, CAST(1 AS BIGINT) AS recent_search_then_cart_flag FROM ev c
  WHERE c.event_type = 'add_to_cart' AND c.event_date < {STREAM_CUTOFF} AND EXISTS (SELECT 1 FROM ev s WHERE {recent})""",
    )

    # features and labels
    q["activity_features"] = with_(
        STREAM_EVENTS,
        "SELECT client_id, "
        + ", ".join(count_columns(FEATURE_TYPES, (3, 7, 14), STREAM_CUTOFF))
        + f" FROM ev WHERE event_date < {STREAM_CUTOFF} AND event_type <> 'page_visit' GROUP BY client_id",
    )
    products_only = [c.rsplit(" AS ", 1)[1] for c in product_columns()]
    q["product_features"] = with_(
        ORDER_EVENTS,
        PRODUCTS,
        "p AS (SELECT client_id, "
        + ", ".join(product_columns())
        + f""" FROM ev LEFT JOIN products USING (sku) WHERE event_date < {CUTOFF}
            AND event_type IN ('add_to_cart', 'product_buy') GROUP BY client_id)""",
        f"SELECT client_id, {typed(products_only)} FROM p",
    )
    active = """SELECT client_id, count(DISTINCT event_date) AS {name} FROM ev
  WHERE event_type <> 'page_visit' AND event_date < {cut} {more} GROUP BY client_id"""
    q["active_days"] = with_(STREAM_EVENTS, active.format(name="active_days_count", cut=STREAM_CUTOFF, more=""))
    q["active_days_recent"] = with_(
        STREAM_EVENTS,
        active.format(name="active_days_count_7d", cut=STREAM_CUTOFF, more=f"AND event_date >= {STREAM_CUTOFF} - 7"),
    )
    q["feature_table"] = with_(*feature_ctes(), f"SELECT client_id, {typed(feature_names())} FROM features")
    ratio_names = [c for c in feature_names() if "ratio" in c or "minus" in c]
    q["ratio_features"] = with_(*feature_ctes(), f"SELECT client_id, {typed(ratio_names)} FROM features")
    q["feature_validation"] = with_(
        *feature_ctes(),
        long_cte("features", feature_names()),
        f"""SELECT column_name AS feature_name, count(*) AS total_rows, count(*) FILTER (value IS NULL) AS null_count,
  {r6('min(value)', 'min_value')}, {r6('max(value)', 'max_value')}, {r6('avg(value)', 'avg_value')},
  {r6('count(*) FILTER (value IS NULL) / count(*)::DOUBLE', 'null_rate')} FROM long_rows GROUP BY column_name""",
    )
    a, b, c = SEARCH_LIMITS
    q["search_buckets"] = with_(
        *feature_ctes(),
        f"""SELECT client_id, {big('''CASE WHEN search_query_count <= 0 THEN 0 WHEN search_query_count = 1 THEN 1
    WHEN search_query_count <= 5 THEN 2 WHEN search_query_count <= 20 THEN 3 ELSE 4 END''', 'search_count_bucket')},
  {big(f'''CASE WHEN search_query_count <= 0 OR days_since_last_search_query IS NULL THEN 0
    WHEN days_since_last_search_query <= {a} THEN 1 WHEN days_since_last_search_query <= {b} THEN 2
    WHEN days_since_last_search_query <= {c} THEN 3 ELSE 4 END''', 'search_recency_bucket')},
  {big('CASE WHEN search_query_count > 0 AND days_since_last_search_query <= 30 THEN 1 ELSE 0 END', 'recent_search_flag')}
FROM features""",
    )
    q["velocity_features"] = velocity_sql()
    q["labels"] = with_(
        ORDER_EVENTS,
        *label_ctes(),
        f"""SELECT client_id, {big('label', 'label')}, '2001-07-02' AS target_window_start, '2001-07-31' AS target_window_end,
  target_event_count FROM label_rows""",
    )
    q["labels_joined"] = q["labels"]
    q["positive_rate"] = with_(
        ORDER_EVENTS,
        *label_ctes(),
        f"""SELECT count(*) AS row_count, {big('sum(label)', 'positive_count')}, {big('count(*) - sum(label)', 'negative_count')},
  {r6('avg(CAST(label AS DOUBLE))', 'positive_rate')} FROM label_rows""",
    )
    q["training_set"] = with_(*training_ctes(), f"SELECT client_id, {typed([*feature_names(), 'label'])} FROM training")
    rule = "'event_ts >= cutoff_date and event_ts < date_add(target_end, 1)'"
    q["label_checks"] = with_(
        *training_ctes(),
        """s AS (SELECT (SELECT count(*) FROM features WHERE is_eligible_purchase_propensity = 1) AS el,
            (SELECT count(*) FROM label_rows) AS lr, (SELECT count(*) FROM label_rows WHERE label = 1) AS pos,
            (SELECT count(*) FROM label_rows WHERE label IS NULL) AS ln,
            (SELECT count(*) FROM label_rows WHERE label IS NULL OR label NOT IN (0, 1)) AS li,
            (SELECT count(*) FROM (SELECT client_id FROM label_rows GROUP BY 1 HAVING count(*) > 1)) AS ld,
            (SELECT count(*) FROM training) AS tr, (SELECT count(*) FROM training WHERE label IS NULL) AS tn,
            (SELECT count(*) FROM (SELECT client_id FROM training GROUP BY 1 HAVING count(*) > 1)) AS td)""",
        check_rows(
            [
                ("label_row_count_equals_eligible_cohort_count", "lr = el", "lr", "''"),
                ("positive_count_matches_expected", "true", "pos", "''"),
                zero("label_values_only_0_or_1", "li"),
                zero("no_null_labels", "ln"),
                zero("no_duplicate_client_id_in_label_table", "ld"),
                ("target_window_boundary_rule_documented", "true", rule, rule),
                ("training_row_count_equals_label_row_count", "tr = lr", "tr", "lr"),
                ("feature_count_used", "true", "36", "36"),
                zero("no_duplicate_client_id_in_training_dataset", "td"),
                zero("no_null_labels_in_training_dataset", "tn"),
                ("no_prediction_or_model_columns", "true", "''", "''"),
            ]
        ),
    )
    q["modeling_summary"] = with_(
        *training_ctes(),
        f"""SELECT count(*) AS row_count, count(*) FILTER (label = 1) AS positive_count,
  count(*) FILTER (label = 0) AS negative_count, {r6('avg(CAST(label AS DOUBLE))', 'positive_rate')},
  count(*) FILTER (label IS NULL) AS label_null_count, count(*) FILTER (label NOT IN (0, 1)) AS invalid_label_count,
  count(*) - count(DISTINCT client_id) AS duplicate_client_id_count FROM training""",
    )
    q["class_weights"] = with_(
        *training_ctes(),
        f"""SELECT client_id, {big('label', 'label')},
  {r6('count(*) OVER () / (2 * count(*) OVER (PARTITION BY label))::DOUBLE', 'class_weight')} FROM training""",
    )
    buckets = " UNION ALL ".join(
        f"SELECT '{f}' AS feature_name, {bucket_of(f)} AS bucket, label FROM training" for f in BUCKETED
    )
    q["bucket_lift"] = with_(
        *training_ctes(),
        f"b AS ({buckets})",
        """g AS (SELECT feature_name, bucket, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positive_count,
            sum(label) / count(*)::DOUBLE AS positive_rate, (SELECT sum(label) / count(*)::DOUBLE FROM training) AS base
            FROM b GROUP BY ALL)""",
        f"""SELECT feature_name, bucket, row_count, positive_count, {r6('positive_rate', 'positive_rate')},
  {r6('base', 'baseline_positive_rate')}, {r6('positive_rate / base', 'lift_vs_baseline')}, {DIRECTION} FROM g""",
    )
    q["search_segments"] = with_(
        *training_ctes(),
        """g AS (SELECT CASE WHEN search_query_count = 0 THEN 'no_search' WHEN search_query_count <= 3 THEN 'low_search_1_3'
            WHEN search_query_count <= 10 THEN 'medium_search_4_10' ELSE 'high_search_gt_10' END AS segment,
            count(*) AS client_count, CAST(sum(label) AS BIGINT) AS positive_count, sum(label) / count(*)::DOUBLE AS positive_rate,
            (SELECT sum(label) / count(*)::DOUBLE FROM training) AS base FROM training GROUP BY 1)""",
        f"""SELECT segment, client_count, positive_count, {r6('positive_rate', 'positive_rate')},
  {r6('positive_rate / base', 'lift_vs_baseline')}, {DIRECTION} FROM g""",
    )
    q["feature_stats"] = with_(
        *training_ctes(),
        *stats_select("training", feature_names(), FEATURE_QS),
        "SELECT column_name AS feature_name, row_count, non_null_count, row_count - non_null_count AS missing_count, "
        + r6("(row_count - non_null_count) / row_count::DOUBLE", "missing_rate")
        + ", distinct_count, "
        + ", ".join(r6(n, n) for n in ("mean", "stddev", "variance", "min", *FEATURE_QS, "max"))
        + f", zero_count, {r6('zero_count / row_count::DOUBLE', 'zero_rate')} FROM stats",
    )
    q["null_counts"] = with_(
        *training_ctes(),
        long_cte("training", feature_names()),
        """SELECT column_name AS feature_name, count(*) FILTER (value IS NULL) AS null_count_before_imputation,
  'median' AS imputation_strategy FROM long_rows GROUP BY column_name""",
    )

    # evaluation
    q["confusion"] = with_(
        SCORED,
        """c AS (SELECT count(*) FILTER (prediction_score >= 0.5 AND label = 1) AS tp,
            count(*) FILTER (prediction_score >= 0.5 AND label = 0) AS fp,
            count(*) FILTER (prediction_score < 0.5 AND label = 0) AS tn,
            count(*) FILTER (prediction_score < 0.5 AND label = 1) AS fn FROM scored)""",
        f"r AS (SELECT *, {RATES} FROM c)",
        f"""SELECT 0.5::DOUBLE AS threshold, tp, fp, tn, fn, {r6('precision', 'precision')}, {r6('recall', 'recall')},
  {r6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END', 'f1')} FROM r""",
    )
    doubles = ("threshold", "precision", "recall", "f1", "positive_prediction_rate", "lift")
    sweep_columns = ", ".join(r6(f"s.{n}", n) for n in doubles)
    q["threshold_sweep"] = with_(SCORED, SWEEP, f"SELECT tp, fp, tn, fn, {sweep_columns} FROM sweep s")
    q["operating_points"] = with_(
        SCORED, SWEEP, points_cte(), f"SELECT operating_point, tp, fp, {sweep_columns} FROM points s"
    )
    policy = {
        "max_f1": "Best-F1 threshold",
        "precision_ge_20_lowest_threshold": "Precision >= 20% threshold",
        "precision_ge_30_lowest_threshold": "Precision >= 30% threshold",
    }
    policy_case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in policy.items())
    policy_in = ", ".join(f"'{k}'" for k in policy)
    policy_columns = ", ".join(r6(f"s.{n}", n) for n in ("threshold", "population_targeted", "precision", "recall", "lift"))
    q["policy_table"] = with_(
        SCORED,
        SWEEP,
        points_cte(),
        *topk_ctes(),
        f"""policies AS (
            SELECT CASE operating_point {policy_case} END AS policy, threshold, positive_prediction_rate AS population_targeted,
              precision, recall, lift, tp AS positive_count_captured FROM points WHERE operating_point IN ({policy_in})
            UNION ALL SELECT 'Top ' || top_percent || '%', NULL, top_percent / 100::DOUBLE, precision_at_k, recall_at_k, lift_at_k,
              positive_count FROM topk)""",
        f"SELECT policy, {policy_columns}, {big('positive_count_captured', 'positive_count_captured')} FROM policies s",
    )
    curve_columns = ("predicted_probability_avg", "actual_positive_rate", "absolute_gap")
    q["calibration"] = with_(
        SCORED,
        calibration_cte(),
        "SELECT score_bucket, sample_count, " + ", ".join(r6(f"s.{n}", n) for n in curve_columns) + " FROM curve s",
    )
    q["calibration_summary"] = with_(
        SCORED,
        calibration_cte(),
        "used AS (SELECT *, lag(actual_positive_rate) OVER (ORDER BY score_bucket) AS prev FROM curve WHERE sample_count > 0)",
        """t AS (SELECT count(*) AS n, sum(sample_count * absolute_gap) / sum(sample_count) AS ece, max(absolute_gap) AS mx,
            avg(absolute_gap) AS av, count(*) FILTER (absolute_gap < 0.05) AS under,
            count(*) FILTER (score_bucket IN ('0.8-0.9', '0.9-1.0')
              AND predicted_probability_avg - actual_positive_rate > 0.1) AS hot,
            count(*) FILTER (prev > actual_positive_rate) = 0 AS mono FROM used)""",
        f"""SELECT n AS non_empty_bucket_count, {r6('ece', 'expected_calibration_error')}, {r6('mx', 'maximum_calibration_gap')},
  {r6('av', 'average_calibration_gap')}, under AS bucket_gaps_under_0_05, hot AS high_score_overconfidence_bucket_count,
  mono AS monotonic_actual_positive_rate, under > n / 2::DOUBLE AS most_bucket_gaps_under_0_05, hot > 0 AS high_score_overconfident,
  CASE WHEN ece < 0.05 AND under > n / 2::DOUBLE THEN 'PASS' WHEN ece <= 0.1 AND hot = 0 THEN 'PARTIAL PASS' ELSE 'FAIL' END
    AS calibration_quality FROM t""",
    )
    tenths = " UNION ALL ".join(
        f"""SELECT '{i / 10}-{(i + 1) / 10}' AS bucket, min(prediction_score) AS lo, max(prediction_score) AS hi, count(*) AS n
            FROM scored WHERE prediction_score >= {i / 10}::DOUBLE AND prediction_score {'<=' if i == 9 else '<'} {(i + 1) / 10}::DOUBLE"""
        for i in range(10)
    )
    q["score_distribution"] = with_(
        SCORED,
        f"b AS ({tenths})",
        f"""SELECT bucket, {r6('lo', 'min_score')}, {r6('hi', 'max_score')}, n AS row_count,
  {r6('n / (SELECT count(*) FROM scored)::DOUBLE', 'row_rate')} FROM b""",
    )
    q["prediction_summary"] = with_(
        SCORED,
        f"""SELECT count(*) AS row_count, {big('sum(label)', 'positive_count')},
  count(*) FILTER (prediction_score IS NULL) AS null_score_count, {r6('min(prediction_score)', 'min_score')},
  {r6('max(prediction_score)', 'max_score')}, {r6('avg(prediction_score)', 'avg_score')},
  {big('count(*) - sum(label)', 'negative_count')}, {r6('avg(CAST(label AS DOUBLE))', 'positive_rate')} FROM scored""",
    )
    topk_columns = f"""{big('top_percent', 'top_percent')}, top_k_count, {big('positive_count', 'positive_count')},
  {r6('precision_at_k', 'precision_at_k')}, {r6('recall_at_k', 'recall_at_k')}, {r6('lift_at_k', 'lift_at_k')}"""
    q["topk_metrics"] = with_(SCORED, *topk_ctes(), f"SELECT {topk_columns} FROM topk")
    q["topk_by_segment"] = with_(SCORED, *topk_ctes(by="segment"), f"SELECT segment, {topk_columns} FROM topk")
    q["topk_overlap"] = with_(
        SCORED,
        """ranks AS (SELECT row_number() OVER (ORDER BY prediction_score DESC, client_id) AS a,
            row_number() OVER (ORDER BY other_score DESC, client_id) AS b, count(*) OVER () AS n FROM scored)""",
        """o AS (SELECT p, max(greatest(1, (n * p + 99) // 100)) AS k,
            count(*) FILTER (greatest(a, b) <= greatest(1, (n * p + 99) // 100)) AS c
            FROM ranks CROSS JOIN (SELECT unnest([1, 5, 10]) AS p) GROUP BY p)""",
        f"""SELECT {big('p', 'top_percent')}, {big('k', 'top_k_count')}, c AS overlap_count, {r6('c / k::DOUBLE', 'overlap_rate')},
  {big('k - c', 'first_only_count')}, {big('k - c', 'second_only_count')} FROM o""",
    )
    q["auc_exact"] = with_(
        SCORED, *auc_ctes(), f"SELECT row_count, positive_count, {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')} FROM auc"
    )
    q["auc_by_segment"] = with_(
        SCORED,
        *auc_ctes(by="segment"),
        f"SELECT segment, row_count, positive_count, {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')} FROM auc",
    )
    q["score_index_ranges"] = with_(
        SCORED,
        f"""SELECT segment, count(*) AS row_count, {big('sum(label)', 'positive_count')}, true AS is_whole
  FROM scored WHERE prediction_score IS NOT NULL GROUP BY segment""",
    )
    q["score_stats"] = with_(SCORED, *stats_select("scored", ["prediction_score", "other_score"], SCORE_QS), score_stats_select())
    q["score_delta"] = with_(
        SCORED,
        "deltas AS (SELECT other_score - prediction_score AS score_delta FROM scored)",
        *stats_select("deltas", ["score_delta"], SCORE_QS),
        score_stats_select(),
    )
    q["segments"] = with_(
        *training_ctes(),
        """SELECT client_id, CASE WHEN active_days_count > (SELECT quantile_cont(active_days_count, 0.5) FROM training)
    THEN 'high_activity' ELSE 'low_activity' END AS activity_segment,
  CASE WHEN product_buy_count > 0 THEN 'returning_users' ELSE 'new_users' END AS lifecycle_segment FROM training""",
    )
    q["segment_metrics"] = segment_metrics_sql()

    # audits
    q["variance_audit"] = with_(
        *audit_ctes(),
        f"""SELECT feature AS feature_name, family AS feature_family, row_count, non_null_count, distinct_count,
  {r6('stddev', 'stddev')}, {r6('variance', 'variance')}, {r6('lo', 'min')}, {r6('hi', 'max')}, is_constant FROM audited""",
    )
    q["correlation_matrix"] = with_(*audit_ctes(), *matrix_ctes("training"), MATRIX_SELECT)
    skip = feature_families()
    q["correlation_matrix_skip"] = with_(
        *feature_ctes(),
        long_cte("features", [f for fs in skip.values() for f in fs]),
        family_rows_sql(skip),
        """audited AS (SELECT feature, family, count(DISTINCT value) <= 1 OR stddev_samp(value) = 0 AS is_constant
            FROM long_rows JOIN fam ON feature = column_name GROUP BY feature, family)""",
        *matrix_ctes("features", skip, zero_nulls=False),
        MATRIX_SELECT,
    )
    q["family_correlation"] = with_(
        *audit_ctes(),
        *matrix_ctes("training"),
        FAMILY_CORRELATION,
        f"SELECT family AS feature_family, {FAMILY_COLUMNS} FROM famcorr",
    )
    missing = "(row_count - non_null_count) / row_count::DOUBLE"
    q["redundancy_audit"] = with_(
        *audit_ctes(),
        *matrix_ctes("training"),
        FAMILY_CORRELATION,
        f"""r AS (SELECT family, count(*) AS feature_count, count(*) FILTER (is_constant) AS constant_feature_count,
            coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (is_constant), '') AS constant_features,
            {r6(f'avg({missing})', 'average_null_rate')}, {r6(f'max({missing})', 'max_null_rate')},
            {r6('avg(variance)', 'average_variance')}, {r6('max(variance)', 'max_variance')} FROM audited GROUP BY family)""",
        f"""SELECT family AS feature_family, r.* EXCLUDE (family), {FAMILY_COLUMNS} FROM r LEFT JOIN famcorr USING (family)""",
    )
    q["window_review"] = with_(*training_ctes(), window_review_sql())

    # scoring and serving
    q["score_with_card"] = with_(
        *feature_ctes(),
        card_sql(),
        f"""SELECT client_id, {r6('raw_score', 'prediction_score')},
  {big('CASE WHEN raw_score >= 0.5 THEN 1 ELSE 0 END', 'prediction_label')},
  CASE WHEN raw_score >= 0.5 THEN 'likely_to_buy' ELSE 'not_likely_to_buy' END AS decision, missing_features_filled,
  '{CARD['model_version']}' AS model_version FROM carded""",
    )
    q["score_checks"] = with_(
        SCORED,
        SCORES,
        """s AS (SELECT count(*) AS n, (SELECT count(*) FROM scored) AS el, count(*) FILTER (prediction_score IS NULL) AS a,
            count(*) FILTER (prediction_score < 0 OR prediction_score > 1) AS b,
            count(*) FILTER (prediction_label NOT IN (0, 1)) AS c, count(*) - count(DISTINCT client_id) AS d,
            count(*) FILTER (model_version IS NULL) AS e, count(*) FILTER (scored_at IS NULL) AS f FROM scores)""",
        check_rows(
            [
                ("output_row_count_equals_eligible_input_row_count", "n = el", "n", "el"),
                zero("no_null_prediction_score", "a"),
                zero("prediction_score_in_0_1", "b"),
                zero("prediction_label_values_only_0_or_1", "c"),
                zero("no_duplicate_client_id", "d"),
                zero("model_version_non_null", "e"),
                zero("scored_at_non_null", "f"),
                ("no_label_column_in_score_output", "true", "'false'", "'false'"),
                ("no_target_window_metadata_in_score_output", "true", "''", "''"),
                ("model_loaded_successfully", "true", "'true'", "'true'"),
                ("score_table_written_successfully", "true", "'true'", "'true'"),
            ]
        ),
    )
    export = f"SELECT CAST(client_id AS VARCHAR) AS client_id, {SCORE_SELECT} FROM "
    q["serving_export"] = with_(
        SCORED, SCORES, export + f"(SELECT * FROM scores ORDER BY scores.client_id LIMIT {EXPORT_LIMIT})"
    )
    q["serving_export_all"] = with_(SCORED, SCORES, export + "scores")
    ids = ", ".join(str(i) for i in LOOKUP_IDS)
    q["lookup"] = with_(SCORED, SCORES, f"SELECT client_id, {SCORE_SELECT} FROM scores WHERE client_id IN ({ids})")
    q["lookup_batch"] = with_(
        SCORED, SCORES, f"SELECT client_id, {SCORE_SELECT} FROM scores WHERE client_id IN (SELECT c_custkey FROM customer)"
    )
    base = SCORED.replace("scored AS", "base AS", 1)
    q["topk_null_segment"] = with_(
        base,
        "scored AS (SELECT * REPLACE (nullif(segment, 'F') AS segment) FROM base)",
        *topk_ctes(by="segment"),
        f"SELECT segment, {topk_columns} FROM topk",
    )
    text_ids = "scored AS (SELECT * REPLACE ('c' || CAST(client_id AS VARCHAR) AS client_id) FROM base)"
    q["topk_text_ids"] = with_(base, text_ids, *topk_ctes(), f"SELECT {topk_columns} FROM topk")
    q["serving_export_text_limit"] = with_(
        base, text_ids, SCORES, export + f"(SELECT * FROM scores ORDER BY scores.client_id LIMIT {EXPORT_LIMIT})"
    )
    q["topk_overlap_null_scores"] = with_(
        base,
        "scored AS (SELECT * REPLACE (CASE WHEN segment = 'P' THEN other_score END AS other_score) FROM base)",
        """ranks AS (SELECT row_number() OVER (ORDER BY prediction_score DESC, client_id) AS a,
            CASE WHEN other_score IS NOT NULL
                 THEN row_number() OVER (PARTITION BY other_score IS NULL ORDER BY other_score DESC, client_id) END AS b,
            count(*) OVER () AS n FROM scored)""",
        """o AS (SELECT p, max(greatest(1, (n * p + 99) // 100)) AS k,
            count(*) FILTER (a <= greatest(1, (n * p + 99) // 100)) AS x,
            count(*) FILTER (b <= greatest(1, (n * p + 99) // 100)) AS y,
            count(*) FILTER (a <= greatest(1, (n * p + 99) // 100) AND b <= greatest(1, (n * p + 99) // 100)) AS c
            FROM ranks CROSS JOIN (SELECT unnest([1, 5, 10]) AS p) GROUP BY p)""",
        f"""SELECT {big('p', 'top_percent')}, {big('k', 'top_k_count')}, c AS overlap_count, {r6('c / k::DOUBLE', 'overlap_rate')},
  {big('x - c', 'first_only_count')}, {big('y - c', 'second_only_count')} FROM o""",
    )
    q["calibration_outside_range"] = with_(
        base,
        """every AS (SELECT * REPLACE (prediction_score * CAST(2 AS DOUBLE) - CAST(0.25 AS DOUBLE) AS prediction_score)
            FROM base)""",
        "scored AS (SELECT * FROM every WHERE prediction_score BETWEEN 0 AND 1)",
        calibration_cte(),
        "SELECT score_bucket, sample_count, " + ", ".join(r6(f"s.{n}", n) for n in curve_columns) + f""" FROM curve s
  UNION ALL SELECT 'outside_range', count(*), {r6('avg(prediction_score)', 'a')}, {r6('avg(label)', 'b')},
    {r6('abs(avg(prediction_score) - avg(label))', 'c')}
  FROM every WHERE NOT prediction_score BETWEEN 0 AND 1 HAVING count(*) > 0""",
    )
    wanted = [c for c in feature_names() if c.endswith("_count") or c.startswith("days_since")]
    filled = ", ".join(big(c if c.startswith("days_since") else f"coalesce({c}, 0)", c) for c in wanted)
    q["filled_counts"] = with_(
        *feature_ctes(), f"SELECT c_custkey AS client_id, {filled} FROM customer LEFT JOIN features ON client_id = c_custkey"
    )
    q["recency_limits"] = with_(
        *training_ctes(),
        """cuts AS (SELECT list_sort(list_distinct([
              greatest(1, round_even(quantile_cont(days_since_last_search_query, 0.25), 0)),
              greatest(1, round_even(quantile_cont(days_since_last_search_query, 0.5), 0)),
              greatest(1, round_even(quantile_cont(days_since_last_search_query, 0.75), 0))])) AS l FROM training)""",
        f"""SELECT {big('CASE WHEN len(l) = 3 THEN l[1] ELSE 7 END', 'low')},
  {big('CASE WHEN len(l) = 3 THEN l[2] ELSE 30 END', 'middle')}, {big('CASE WHEN len(l) = 3 THEN l[3] ELSE 60 END', 'high')} FROM cuts""",
    )
    q["random_split"] = with_(
        *training_ctes(),
        """SELECT count(*) AS row_count, count(DISTINCT client_id) AS client_count, true AS share_near_80_percent
           FROM training""",
    )
    brands = """brands AS (SELECT p_brand AS variant, round(avg(p_retailprice) / CAST(3000 AS DOUBLE), 4) AS pr_auc,
        round(avg(CAST(p_size AS DOUBLE)) / CAST(10 AS DOUBLE), 4) AS lift_at_5pct, count(*) AS added_feature_count
        FROM part GROUP BY p_brand)"""
    q["pruning_decisions"] = with_(
        brands,
        """known AS (SELECT *, variant = min(variant) OVER () AS is_ref, max(lift_at_5pct) OVER () AS best,
            first(pr_auc) OVER (ORDER BY variant) AS rp, first(lift_at_5pct) OVER (ORDER BY variant) AS rl FROM brands)""",
        """judged AS (SELECT *, CASE WHEN is_ref THEN 'REFERENCE'
            WHEN (rp - pr_auc) / pr_auc <= CAST(0.002 AS DOUBLE) AND (lift_at_5pct - best) / best >= CAST(-0.002 AS DOUBLE)
              OR lift_at_5pct >= rl THEN 'KEEP_AS_CANDIDATE' ELSE 'DROP_FROM_MINIMAL_SET' END AS decision FROM known)""",
        f"""SELECT variant, {r6('pr_auc', 'pr_auc')}, {r6('lift_at_5pct', 'lift_at_5pct')}, added_feature_count, decision,
  CASE WHEN row_number() OVER (ORDER BY decision = 'DROP_FROM_MINIMAL_SET', s.lift_at_5pct DESC, s.pr_auc DESC,
    added_feature_count, variant) = 1 THEN 'yes' ELSE 'no' END AS recommended FROM judged s""",
    )
    q["decision_rules"] = with_(
        brands,
        """base AS (SELECT round(avg(p_retailprice) / CAST(3000 AS DOUBLE), 4) AS bp,
            round(avg(CAST(p_size AS DOUBLE)) / CAST(10 AS DOUBLE), 4) AS bl FROM part)""",
        """c AS (SELECT variant, pr_auc > bp AS pu, lift_at_5pct > bl AS lu, least((pr_auc - bp) / bp, (lift_at_5pct - bl) / bl) AS lo,
            greatest((pr_auc - bp) / bp, (lift_at_5pct - bl) / bl) AS hi FROM brands, base)""",
        """SELECT variant,
  CASE WHEN lo >= CAST(-0.005 AS DOUBLE) THEN 'ADOPT' WHEN lo < CAST(-0.01 AS DOUBLE) THEN 'KEEP' ELSE 'INVESTIGATE' END AS not_worse,
  CASE WHEN hi >= CAST(0.005 AS DOUBLE) THEN 'ADOPT' WHEN lo < CAST(-0.005 AS DOUBLE) THEN 'KEEP' ELSE 'INVESTIGATE' END AS gain,
  CASE WHEN hi >= CAST(0.005 AS DOUBLE) THEN 'ADOPT_FOR_REVIEW' ELSE 'INVESTIGATE' END AS review,
  CASE WHEN pu OR lu THEN 'CANDIDATE' ELSE 'KEEP' END AS any_gain,
  CASE WHEN pu AND lu THEN 'PROMOTE' ELSE 'KEEP' END AS both_gain,
  CASE WHEN -lo > CAST(0.03 AS DOUBLE) THEN 'KEEP' WHEN -lo >= CAST(0.01 AS DOUBLE) THEN 'KEEP_LOWER_PRIORITY'
       ELSE 'REMOVE_CANDIDATE' END AS ablation FROM c""",
    )
    q["fit_and_score_checks"] = with_(
        *training_ctes(),
        f"SELECT client_id, {big('label', 'label')}, true AS is_probability, true AS card_agrees FROM training",
    )
    q["batch_score_checks"] = with_(
        *feature_ctes(),
        f"""SELECT client_id, 'baseline_lr_v1' AS model_version, '{SCORED_AT}' AS scored_at, true AS label_follows_threshold
  FROM features WHERE is_eligible_purchase_propensity = 1""",
    )
    features_list = "[" + ", ".join(f"'{c}'" for c in feature_names()) + "]"
    q["coefficient_checks"] = f"SELECT unnest({features_list}) AS feature_name, true AS card_agrees, true AS ranked_by_size"
    q["model_card_checks"] = f"""SELECT unnest({features_list}) AS feature_name,
  CAST(unnest(range({len(feature_names())})) AS BIGINT) AS position, true AS is_median"""
    q["velocity_ablation"] = "\nUNION ALL ".join(
        f"""SELECT '{name}' AS scenario, '{','.join(group)}' AS removed_features, CAST({len(group)} AS BIGINT) AS removed_count,
  true AS is_share, true AS rule_holds"""
        for name, group in VELOCITY_GROUPS.items()
    )
    # other ways to the same results
    q["validation_observed"] = q["validation_counts"]
    q["overlap_matrix_sketched"] = q["overlap_matrix"]
    q["candidate_cohorts_sketched"] = f"""SELECT candidate, cohort_client_count, positive_client_count, positive_rate
FROM ({q['candidate_cohorts']})"""
    q["event_overview_sketched"] = f"""SELECT event_type, row_count, null_client_id_count, null_entity_count, timestamp_min, timestamp_max,
  true AS clients_in_bound, true AS entities_in_bound FROM ({q['event_overview']})"""
    q["feature_stats_sketched"] = f"""SELECT feature_name, row_count, non_null_count, mean, variance, min, max, zero_count,
  true AS quantiles_in_bound, true AS distinct_in_bound FROM ({q['feature_stats']})"""
    earlier = q["feature_table"].replace(CUTOFF, f"DATE '{ORDERS_TRAIN.cutoff}'")
    q["features_of_two_cutoffs"] = f"""SELECT *, '{ORDERS_SNAPSHOT.name}' AS snapshot FROM ({q['feature_table']})
UNION ALL SELECT *, '{ORDERS_TRAIN.name}' AS snapshot FROM ({earlier})"""
    q["round_trips"] = """SELECT format, count(*) AS row_count, CAST(sum(c_custkey) AS BIGINT) AS key_sum, count(DISTINCT c_name) AS name_count,
  CAST(sum(c_nationkey) AS BIGINT) AS nation_sum, CAST(sum(CAST(c_acctbal AS DECIMAL(20, 2))) AS DOUBLE) AS balance
FROM customer, (VALUES ('parquet'), ('csv'), ('json')) AS formats(format) GROUP BY format"""
    return q
