from __future__ import annotations

from data import SNAP, by, events

from clientpulse import BUY, CART, SEARCH, VISIT
from clientpulse.operators import cohorts, targets

ROWS = [
    (1, "2024-01-01 00:00:00", BUY, 1),
    (1, "2024-02-29 23:59:59", BUY, 1),
    (2, "2024-01-05 00:00:00", CART, 1),
    (2, "2024-02-20 00:00:00", BUY, 1),
    (3, "2024-01-05 00:00:00", BUY, 1),
    (4, "2024-01-05 00:00:00", SEARCH, None),
    (5, "2024-01-05 00:00:00", VISIT, None),
]


def test_windows_end_with_the_last_purchase(spark):
    found = by(targets.target_windows(events(spark, ROWS)), "target_days")
    assert {d: str(r["cutoff_date"]) for d, r in found.items()} == {14: "2024-02-16", 30: "2024-01-31", 45: "2024-01-16"}
    assert {str(r["target_end"]) for r in found.values()} == {"2024-02-29"}
    assert found[30]["history_days"] == 30


def test_churn_is_the_absence_of_a_purchase(spark):
    found = by(targets.churn_balance(events(spark, ROWS)), "target_days")
    assert (found[14]["eligible_clients"], found[14]["churn_clients"], found[14]["non_churn_clients"]) == (2, 1, 1)
    assert found[14]["churn_rate"] == 0.5


def test_targets_and_polarity(spark):
    found = by(targets.target_comparison(events(spark, ROWS)), "target_name", "target_days")
    assert len(found) == 9 and sum(r["recommended"] for r in found.values()) == 1
    active, cart, churn = (found[t, 14] for t in ("purchase_propensity", "cart_conversion", "purchase_based_churn"))
    assert (active["eligible_clients"], active["positive_clients"]) == (3, 2)
    assert (cart["eligible_clients"], cart["positive_clients"]) == (1, 1)
    assert (churn["eligible_clients"], churn["positive_clients"]) == (2, 1)
    best = targets.recommend_target(targets.target_comparison(events(spark, ROWS))).first()
    assert found[best.target_name, best.target_days]["overall_recommendation_rank"] == 1


def test_recommended_window(spark):
    def choose(rates):
        rows = [(d, "c", "e", 10, 1 - r if r is not None else None, r) for d, r in rates.items()]
        schema = "target_days int, cutoff_date string, target_end string, eligible_clients long, churn_rate double, non_churn_rate double"
        return targets.recommend_window(spark.createDataFrame(rows, schema)).first().target_days

    assert choose({14: 0.5, 30: 0.03, 45: 0.9}) == 30
    assert choose({14: 0.5, 30: 0.029, 45: 0.9}) == 45
    assert choose({14: 0.5, 30: None, 45: 0.5}) == 14


def test_broad_cohort(spark):
    narrow = by(targets.active_cohorts(events(spark, ROWS)), "target_days", "cohort_option")
    assert narrow[14, "C"]["status"] == "skipped" and narrow[14, "C"]["eligible_clients"] is None
    broad = by(targets.active_cohorts(events(spark, ROWS), broad=True), "target_days", "cohort_option")
    assert broad[14, "C"]["eligible_clients"] == 5 and broad[14, "B"]["eligible_clients"] == 3


def test_no_events(spark):
    assert targets.target_comparison(events(spark, [])).where("recommended").count() == 1
    assert {r.eligible_clients for r in targets.churn_balance(events(spark, [])).collect()} == {0}


def test_cohorts(spark):
    flags = cohorts.cohort_flags(events(spark), SNAP)
    found = by(flags, "client_id")
    assert found[1] == {"client_id": 1, "in_cart": True, "in_buy": True, "in_search": False, "bought_in_target": True}
    assert found[5] == {"client_id": 5, "in_cart": False, "in_buy": False, "in_search": False, "bought_in_target": True}
    assert 3 not in found
    sizes = {r.cohort_name: r.value for r in cohorts.cohort_overlap(flags).collect()}
    assert len(sizes) == 11
    assert sizes["search_only_before_cutoff"] == 1 and sizes["buyers_without_cart_before_cutoff"] == 1
    assert sizes["add_to_cart_product_buy_jaccard_overlap"] == 0.5
    candidates = by(cohorts.candidate_cohorts(flags), "candidate")
    assert candidates["search_only"]["cohort_client_count"] == 1 and candidates["search_only"]["extra_clients_vs_current"] == 1
    assert candidates["search_only"]["class_imbalance_risk"] == "high"
    assert candidates["current_prior_cart_or_purchase"]["positive_rate"] == 1.0
    cells = by(cohorts.overlap_matrix(flags), "left_candidate", "right_candidate")
    assert len(cells) == 25 and cells["cart_only", "buy_only"]["jaccard_rate"] == 0.5
    assert cells["search_only", "current_prior_cart_or_purchase"]["intersection_count"] == 0
