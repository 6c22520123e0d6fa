"""Per-customer features: the four blocks, the combined view and the exploratory queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import days_between, is_delivered, percent, ratio
from basketry.operators import dictionary
from basketry.operators.chains import with_previous
from basketry.operators.orders import (
    PERSON,
    PURCHASED,
    delivered_baskets,
    delivered_orders,
    lacks_value,
    order_contents,
    order_values,
    reference_date,
    review_totals,
    spend_per_person,
    sums,
    with_person,
)
from basketry.operators.ranks import with_rank
from basketry.schema import MONEY_TOTAL, Tables


def _total(column: str) -> Column:
    return F.col(column).cast(MONEY_TOTAL)


def basic_features(t: Tables) -> DataFrame:
    """Orders, value, mean line value, first and last purchase per person."""
    return spend_per_person(t).select(
        PERSON,
        "order_count",
        _total("order_value").alias("total_value"),
        ratio(F.col("order_value"), F.col("valued_lines")).alias("avg_item_value"),
        "first_purchase",
        "last_purchase",
    )


def basic_features_preview(t: Tables, n: int = 10) -> DataFrame:
    """The first ``n`` persons by id."""
    return basic_features(t).orderBy(PERSON).limit(n)


def _person_baskets(t: Tables) -> DataFrame:
    return with_person(delivered_baskets(t), t).select(
        PERSON, "order_id", PURCHASED, _total("order_value").alias("order_value")
    )


def basket_changes(t: Tables) -> DataFrame:
    """Each delivered order with the value of the person's previous one and the change.

    Orders at the same instant are taken in ``order_id`` order.
    """
    chained = with_previous(
        _person_baskets(t), PERSON, PURCHASED, "order_id", "order_value", "previous_value"
    )
    return chained.withColumn("basket_change", F.col("order_value") - F.col("previous_value"))


def customer_rank(t: Tables) -> DataFrame:
    """RANK of every person by total value."""
    totals = spend_per_person(t).select(PERSON, _total("order_value").alias("total_value"))
    return with_rank(totals, "total_value", "customer_rank")


def rfm_base(t: Tables) -> DataFrame:
    """Order count, recency against the latest purchase of all, total and mean line value."""
    newest = reference_date(t["orders"]).scalar()
    return spend_per_person(t).select(
        PERSON,
        "order_count",
        days_between(F.col("last_purchase"), newest).alias("recency_days"),
        _total("order_value").alias("total_value"),
        ratio(F.col("order_value"), F.col("valued_lines")).alias("avg_item_value"),
    )


def basket_trend(t: Tables) -> DataFrame:
    """Mean change between successive orders; NULL for a person with one order.

    Changes between orders that all have a value add up to the last value less the first, which
    needs no order of the rows at all. Only where a value can be NULL are changes formed one by one.
    """
    if _has_null_values(t["order_items"]):
        return _trend_by_changes(_person_baskets(t))
    baskets = with_person(delivered_baskets(t), t)
    person = baskets.groupBy(PERSON).agg(*_ends(F.lit(True)), F.count(F.lit(1)).alias("order_count"))
    return person.select(PERSON, _trend_by_ends().alias("basket_trend"))


def _has_null_values(items: DataFrame) -> bool:
    """Whether a line lacks a value: one small job, which skips stored row groups without NULLs."""
    return not items.where(lacks_value(items)).isEmpty()


def _trend_by_changes(baskets: DataFrame) -> DataFrame:
    """The trend from every change; ``baskets`` has a row for each order of a person."""
    chained = with_previous(baskets, PERSON, PURCHASED, "order_id", "order_value", "previous_value")
    change = F.col("order_value") - F.col("previous_value")
    return chained.groupBy(PERSON).agg(ratio(F.sum(change), F.count(change)).alias("basket_trend"))


def _ends(is_basket: Column) -> list[Column]:
    """The first and the last basket in time order, as structs that compare like it."""
    place = F.struct(
        F.col(PURCHASED).isNull().alias("untimed"),
        F.col(PURCHASED).alias("at"),
        F.col("order_id").alias("id"),
        _total("order_value").alias("value"),
    )
    basket = F.when(is_basket, place)
    return [F.min(basket).alias("first_basket"), F.max(basket).alias("last_basket")]


def _trend_by_ends() -> Column:
    return ratio(F.col("last_basket.value") - F.col("first_basket.value"), F.col("order_count") - 1)


def satisfaction(t: Tables) -> DataFrame:
    """Mean score and share of scores of two or less, over orders of every status.

    Reviews without a score count in the denominator of the share.
    """
    columns = ("reviews", "scored_reviews", "score_sum", "negative_reviews")
    per_customer_id = (
        review_totals(t["order_reviews"])
        .join(t["orders"].select("order_id", "customer_id"), "order_id")
        .groupBy("customer_id")
        .agg(*sums(*columns))
    )
    per_person = with_person(per_customer_id, t).groupBy(PERSON).agg(*sums(*columns))
    return per_person.select(
        PERSON, _mean_score().alias("avg_review_score"), _negative().alias("negative_review_pct")
    )


def _mean_score() -> Column:
    return ratio(F.col("score_sum"), F.col("scored_reviews"))


def _negative() -> Column:
    return percent(F.col("negative_reviews"), F.col("reviews"))


def diversity(t: Tables) -> DataFrame:
    """Distinct categories per person over delivered lines whose product is known."""
    bought = t["order_items"].select("order_id", "product_id").distinct()
    orders = delivered_orders(t["orders"]).select("order_id", "customer_id")
    # Reduced to (person, product) before the products are read.
    products = with_person(bought.join(orders, "order_id"), t).select(PERSON, "product_id").distinct()
    category = t["products"].select("product_id", "product_category_name")
    known = products.join(category, "product_id").where(F.col("product_category_name").isNotNull())
    known = known.select(PERSON, "product_category_name").distinct()
    return known.groupBy(PERSON).agg(F.count(F.lit(1)).alias("category_count"))


def customer_features(t: Tables) -> DataFrame:
    """The feature view: one row per person with a delivered order that has items.

    All four blocks come from one pass over the tables, reduced in two steps: order -> person.
    Each is a sum, a minimum, a maximum or a union of bits, so it is combined before its
    shuffle and no person's orders have to meet in one task.
    Stitching separately computed blocks would read orders and customers four times.

    Two small jobs look at the tables first: whether a line lacks a value (see ``basket_trend``) and
    which categories there are. Like the list of files, what they find belongs to the tables
    as they are when the frame is made.
    """
    return view_of(
        t,
        reference_date(t["orders"]).scalar(),
        category_masks(t["products"], dictionary.codes(t["products"], "product_category_name")),
        _has_null_values(t["order_items"]),
    )


def category_masks(products: DataFrame, coded: DataFrame | None) -> DataFrame | None:
    """The category bit of each product that has a category."""
    if coded is None:
        return None
    named = products.select("product_id", "product_category_name")
    # The dictionary is bounded, see ``codes``.
    return named.join(F.broadcast(coded), "product_category_name").drop("product_category_name")


def view_of(t: Tables, newest: Column, masks: DataFrame | None, null_values: bool) -> DataFrame:
    """The view with what ``customer_features`` finds out about the tables given."""
    facts = _order_facts(t, masks)
    lanes = dictionary.lanes_of(masks) if masks is not None else []
    is_basket = F.col("is_basket")
    person = (
        with_person(facts, t)
        .groupBy(PERSON)
        .agg(
            F.count_if(is_basket).alias("order_count"),
            F.max(F.when(is_basket, F.col(PURCHASED))).alias("last_purchase"),
            *_ends(is_basket),
            *[F.sum(F.when(is_basket, F.col(name))).alias(name) for name in ("order_value", "valued_lines")],
            *[F.bit_or(F.when(is_basket, F.col(lane))).alias(lane) for lane in lanes],
            *sums(*_REVIEW_MEASURES),
        )
        .where("order_count > 0")
    )
    if null_values:
        # Only persons with such an order need their changes one by one.
        baskets = with_person(facts.where(is_basket), t).select(
            PERSON, "order_id", PURCHASED, _total("order_value").alias("order_value")
        )
        touched = baskets.where(F.col("order_value").isNull()).select(F.col(PERSON).alias("_touched"))
        baskets = baskets.join(touched, F.col(PERSON) == F.col("_touched"), "left_semi")
        exact = _trend_by_changes(baskets).select(
            F.col(PERSON).alias("_touched"), F.col("basket_trend").alias("_exact")
        )
        person = person.join(exact, F.col(PERSON) == F.col("_touched"), "left")
        trend = F.when(F.col("_touched").isNull(), _trend_by_ends()).otherwise(F.col("_exact"))
    else:
        trend = _trend_by_ends()
    if masks is None:
        known = diversity(t).select(F.col(PERSON).alias("_varied"), F.col("category_count").alias("_categories"))
        person = person.join(known, F.col(PERSON) == F.col("_varied"), "left")
        categories = F.coalesce(F.col("_categories"), F.lit(0))
    else:
        categories = dictionary.size(lanes)
    zero = F.lit(0.0)
    return person.select(
        PERSON,
        "order_count",
        days_between(F.col("last_purchase"), newest).alias("recency_days"),
        _total("order_value").alias("total_value"),
        ratio(F.col("order_value"), F.col("valued_lines")).alias("avg_item_value"),
        F.coalesce(trend, zero).alias("basket_trend"),
        F.coalesce(_mean_score(), zero).alias("avg_review_score"),
        F.coalesce(_negative(), zero).alias("negative_review_pct"),
        categories.alias("category_count"),
    )


_REVIEW_MEASURES = ("reviews", "scored_reviews", "score_sum", "negative_reviews")


def _order_facts(t: Tables, masks: DataFrame | None) -> DataFrame:
    """One row per order that is a basket, has a review, or both.

    A basket is a delivered order with items; other orders matter only for their reviews.
    """
    orders = t["orders"].select(
        "order_id", "customer_id", PURCHASED, is_delivered().alias("delivered")
    )
    if masks is None:
        contents = order_values(t["order_items"])
    else:
        contents = order_contents(t["order_items"], masks, dictionary.lanes_of(masks))
    facts = orders.join(contents, "order_id", "left")
    facts = facts.join(review_totals(t["order_reviews"]), "order_id", "left")
    basket = F.coalesce(F.col("delivered") & F.col("lines").isNotNull(), F.lit(False))
    return facts.withColumn("is_basket", basket).where(
        F.col("is_basket") | F.col("reviews").isNotNull()
    )


# View and column names existing SQL on the feature view uses.
VIEW_NAME = "v_customer_features"
VIEW_COLUMNS: dict[str, str] = {
    "customer_unique_id": "customer_unique_id",
    "order_count": "nb_commandes",
    "recency_days": "recence_jours",
    "total_value": "montant_total",
    "avg_item_value": "panier_moyen",
    "basket_trend": "tendance_panier_moyen",
    "avg_review_score": "score_moyen",
    "negative_review_pct": "pct_reviews_negatives",
    "category_count": "nb_categories",
}


def register_feature_view(t: Tables) -> None:
    """Publish the feature view to SQL, under our column names and under the French ones."""
    features = customer_features(t)
    features.createOrReplaceTempView("customer_features")
    features.withColumnsRenamed(VIEW_COLUMNS).createOrReplaceTempView(VIEW_NAME)
