from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basketry.operators import dictionary
from basketry.plans import features, preview, quality
from fixtures import by_key, customer, item, order, product, review, shop, tables

ANA, BOB, DAN = "ana", "bob", "dan"


@pytest.fixture(scope="module")
def t(spark):
    return quality.clean(shop(spark))


def test_basic_features(t):
    rows = by_key(features.basic_features(t), "customer_unique_id")
    assert set(rows) == {ANA, BOB, DAN}
    ana = rows[ANA]
    assert ana.order_count == 3
    assert ana.total_value == Decimal("93.85")
    assert ana.avg_item_value == 93.85 / 5
    assert ana.first_purchase == datetime(2018, 1, 1, 23)
    assert ana.last_purchase == datetime(2018, 3, 1, 10)


def test_null_line_value_is_skipped_by_sum_and_mean(t):
    dan = by_key(features.basic_features(t), "customer_unique_id")[DAN]
    assert (dan.order_count, dan.total_value, dan.avg_item_value) == (2, Decimal("9.00"), 9.0)


def test_orders_without_items_or_status_are_no_baskets(t):
    bob = by_key(features.rfm_base(t), "customer_unique_id")[BOB]
    assert (bob.order_count, bob.total_value) == (1, Decimal("110.00"))


def test_recency_counts_day_boundaries_from_newest_order_of_any_status(t):
    # The newest order is canceled and half an hour past midnight.
    ana = by_key(features.rfm_base(t), "customer_unique_id")[ANA]
    assert ana.recency_days == 1


def test_changes_follow_the_person_over_customer_ids(t):
    rows = by_key(features.basket_changes(t), "order_id")
    assert rows["o1"].previous_value is None
    assert rows["o2"].previous_value == Decimal("33.35")
    assert rows["o2"].basket_change == Decimal("21.65")
    assert rows["o3"].basket_change == Decimal("-49.50")


def test_equal_timestamps_are_ordered_by_order_id(t):
    rows = by_key(features.basket_changes(t), "order_id")
    assert rows["o6"].previous_value is None and rows["o6"].order_value is None
    assert rows["o7"].previous_value is None and rows["o7"].order_value == Decimal("9.00")


def test_trend_is_null_in_the_block_and_zero_in_the_view(t):
    block = by_key(features.basket_trend(t), "customer_unique_id")
    assert block[BOB].basket_trend is None
    assert block[ANA].basket_trend == float(Decimal("5.50") - Decimal("33.35")) / 2
    assert by_key(features.customer_features(t), "customer_unique_id")[BOB].basket_trend == 0.0


def test_satisfaction_ignores_status_and_keeps_null_scores_in_the_denominator(t):
    rows = by_key(features.satisfaction(t), "customer_unique_id")
    assert rows[ANA].avg_review_score == 3.5
    assert rows[ANA].negative_review_pct == 100.0 / 3
    assert rows["eva"].avg_review_score == 3.0


def test_diversity_counts_unknown_and_skips_missing_products(t):
    rows = by_key(features.diversity(t), "customer_unique_id")
    assert rows[ANA].category_count == 3
    assert rows[DAN].category_count == 1


def _blocks(t):
    return (
        features.rfm_base(t)
        .join(features.basket_trend(t), "customer_unique_id", "left")
        .join(features.satisfaction(t), "customer_unique_id", "left")
        .join(features.diversity(t), "customer_unique_id", "left")
        .fillna(0, ["basket_trend", "avg_review_score", "negative_review_pct", "category_count"])
    )


def _assert_view_equals_blocks(t):
    view, blocks = features.customer_features(t), _blocks(t)
    assert view.columns == blocks.columns
    assert by_key(view, "customer_unique_id") == by_key(blocks, "customer_unique_id")


def test_view_equals_its_blocks(t):
    _assert_view_equals_blocks(t)


def test_missing_measures_are_zero_in_the_view(t):
    view = features.customer_features(t)
    assert dict(view.dtypes)["total_value"] == "decimal(38,2)"
    no_review = by_key(view, "customer_unique_id")[DAN]
    assert (no_review.avg_review_score, no_review.negative_review_pct) == (0.0, 0.0)


def test_registered_view(spark, t):
    features.register_feature_view(t)
    ours = spark.table("customer_features").select(*features.VIEW_COLUMNS).collect()
    named = spark.sql(
        f"select {', '.join(features.VIEW_COLUMNS.values())} from {features.VIEW_NAME}"
    ).collect()
    assert sorted(map(tuple, ours)) == sorted(map(tuple, named)) and len(ours) == 3


def _random_shop(spark, seed, orders=400, hot=True):
    """One person holds about a third of all orders; values and times may be NULL or tie."""
    rng = random.Random(seed)
    people = [f"u{i}" for i in range(40)]
    ids = [(f"c{i}", rng.choice(people)) for i in range(90)]
    start = datetime(2017, 1, 1)
    order_rows, item_rows, review_rows = [], [], []
    for n in range(orders):
        cid = "c0" if hot and rng.random() < 0.33 else rng.choice(ids)[0]
        when = start + timedelta(hours=rng.choice([6, 12, 24]) * rng.randrange(40))
        order_rows.append(
            order(
                f"o{n:04}",
                cid,
                None if rng.random() < 0.02 else when,
                rng.choice(["delivered", "delivered", "delivered", "shipped", None]),
            )
        )
        for _ in range(rng.randrange(4)):
            price = None if rng.random() < 0.15 else f"{rng.randrange(1, 20000) / 100:.2f}"
            item_rows.append(item(f"o{n:04}", price, "1.10", f"p{rng.randrange(25)}"))
        for _ in range(rng.choice([0, 0, 1, 3])):
            review_rows.append(review(f"o{n:04}", rng.choice([None, 1, 2, 3, 4, 5])))
    return tables(
        spark,
        customers=[customer(c, p) for c, p in ids],
        orders=order_rows,
        order_items=item_rows,
        order_reviews=review_rows,
        products=[product(f"p{i}", None if i == 3 else f"cat{i % 7}") for i in range(20)],
    )


def _brute_force_changes(t):
    person = {r.customer_id: r.customer_unique_id for r in t["customers"].collect()}
    lines = defaultdict(list)
    for r in t["order_items"].collect():
        lines[r.order_id].append(None if r.price is None else r.price + r.freight_value)
    chains = defaultdict(list)
    for o in t["orders"].collect():
        if o.order_status == "delivered" and o.order_id in lines:
            values = [v for v in lines[o.order_id] if v is not None]
            when = o.order_purchase_timestamp
            chains[person[o.customer_id]].append(
                (when is None, when, o.order_id, sum(values) if values else None)
            )
    changes = {}
    for who, chain in chains.items():
        chain.sort(key=lambda x: (x[0], x[1] or datetime.min, x[2]))
        previous = None
        for _, _, oid, value in chain:
            both = value is not None and previous is not None
            changes[oid] = (who, previous, value - previous if both else None)
            previous = value
    return changes


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_and_trend_against_brute_force(spark, seed):
    t = _random_shop(spark, seed)
    expected = _brute_force_changes(t)
    got = {
        r.order_id: (r.customer_unique_id, r.previous_value, r.basket_change)
        for r in features.basket_changes(t).collect()
    }
    assert got == expected
    steps = defaultdict(list)
    for who, _, change in expected.values():
        steps[who] += [change] if change is not None else []
    want = {
        who: float(sum(steps[who])) / len(steps[who]) if steps[who] else None
        for who in {who for who, _, _ in expected.values()}
    }
    got = {r[0]: r[1] for r in features.basket_trend(t).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [4, 5])
def test_view_equals_its_blocks_on_random_tables(spark, seed):
    _assert_view_equals_blocks(quality.clean(_random_shop(spark, seed)))


def test_partitioning_of_the_input_changes_nothing(spark):
    t = quality.clean(_random_shop(spark, 6))
    shuffled = {name: df.orderBy(F.rand(7)).repartition(5) for name, df in t.items()}
    for plan in (features.customer_features, features.basket_changes, features.customer_rank):
        assert sorted(map(str, plan(t).collect())) == sorted(map(str, plan(shuffled).collect()))


def test_rank_leaves_gaps_after_ties_and_puts_null_last(spark):
    values = ["5.00", "7.00", "7.00", "1.00", None]
    t = tables(
        spark,
        customers=[customer(f"c{i}", f"u{i}") for i in range(5)],
        orders=[order(f"o{i}", f"c{i}", "2018-01-01") for i in range(5)],
        order_items=[item(f"o{i}", v) for i, v in enumerate(values)],
    )
    ranks = {r.customer_unique_id: r.customer_rank for r in features.customer_rank(t).collect()}
    assert ranks == {"u1": 1, "u2": 1, "u0": 3, "u3": 4, "u4": 5}


def test_preview_is_bounded(t):
    assert [r[0] for r in features.basic_features_preview(t, 2).collect()] == [ANA, BOB]


def test_empty_tables_give_no_rows(spark):
    t = tables(spark)
    for plan in (features.customer_features, features.basket_changes, features.customer_rank):
        assert plan(t).collect() == []


def _valued(t):
    """The same tables without lines that lack a value: the trend then needs first and last orders only."""
    return t | {"order_items": t["order_items"].where("price is not null and freight_value is not null")}


@pytest.mark.parametrize("seed", [7, 8])
def test_trend_by_ends_equals_the_changes(spark, seed):
    t = _valued(_random_shop(spark, seed))
    assert not features._has_null_values(t["order_items"])
    by_changes = features._trend_by_changes(features._person_baskets(t))
    ours = features.basket_trend(t)
    assert by_key(ours, "customer_unique_id") == by_key(by_changes, "customer_unique_id")
    _assert_view_equals_blocks(quality.clean(t))


def test_trend_of_a_person_with_a_third_of_all_orders_on_one_date(spark):
    n = 300
    t = tables(
        spark,
        customers=[customer(f"c{i}", f"u{i}") for i in range(20)],
        orders=[order(f"same{i:04}", "c0" if i % 3 == 0 else f"c{1 + i % 19}", "2018-05-01") for i in range(n)],
        order_items=[item(f"same{i:04}", f"{i + 1}.25") for i in range(n)],
        products=[product("p1", "a")],
    )
    rows = by_key(features.customer_features(t), "customer_unique_id")
    assert rows["u0"].order_count == 100 and rows["u0"].basket_trend == 3.0


def test_sets_of_any_size_are_counted_exactly(spark, monkeypatch):
    """Two lanes, and more values than all lanes hold (then sets are counted by their rows)."""
    categories = [product(f"p{i}", f"cat{i % 150}") for i in range(200)]
    t = quality.clean(_random_shop(spark, 9)) | {"products": tables(spark, products=categories)["products"]}
    t["order_items"] = t["order_items"].withColumn("product_id", F.concat(F.lit("p"), F.abs(F.xxhash64("order_id", "price")) % 210))
    assert len(dictionary.lanes_of(dictionary.codes(t["products"], "product_category_name"))) == 3
    _assert_view_equals_blocks(t)
    monkeypatch.setattr(dictionary, "MAX_LANES", 2)
    assert dictionary.codes(t["products"], "product_category_name") is None
    _assert_view_equals_blocks(t)


@pytest.mark.parametrize("seed, most", [(4, 10_000), (5, 10_000), (4, 40), (5, 3)])
def test_first_rows_equal_the_views(spark, seed, most):
    """By keys, and by semi joins where there are more keys than may travel."""
    t = quality.clean(_random_shop(spark, seed))
    view = features.customer_features(t).orderBy("customer_unique_id").collect()
    for n in (1, 7, 60):
        assert preview.customer_features_first(t, n, most).collect() == view[:n]


def test_first_rows_skip_persons_without_a_basket(spark):
    people = [customer(f"c{i:03}", f"u{i:03}") for i in range(300)]
    orders = [order(f"o{i}", f"c{i:03}", "2018-01-01", "delivered" if i >= 250 else "shipped") for i in range(300)]
    t = tables(
        spark, customers=people, orders=orders,
        order_items=[item(f"o{i}", "1.00") for i in range(300) if i != 251], products=[product("p1", "a")],
    )
    found = [r[0] for r in preview.customer_features_first(t, 3).collect()]
    assert found == ["u250", "u252", "u253"]
    assert preview.customer_features_first(tables(spark), 3).collect() == []
