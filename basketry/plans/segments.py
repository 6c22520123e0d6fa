"""RFM segments, churn and customer rankings over the feature view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import percent, shortened
from basketry.operators.orders import PERSON

CHURN_DAYS = 180

# Segment labels with their criteria and recommended action.
SEGMENT_ACTIONS: list[tuple[str, str, str]] = [
    ("Champion", "Récent + fréquent + valeur élevée", "Fidéliser, programme VIP"),
    ("Fidele", "Récent + fréquent ou valeur élevée", "Upsell, cross-sell"),
    ("Nouveau", "Récent, 1 commande", "Onboarding, 2ème achat"),
    ("En danger", "Pas récent mais fréquent", "Campagne de rétention urgente"),
    ("A risque", "Inactif, historique moyen", "Email de réactivation"),
    ("Perdu", "Inactif > 300 jours", "Campagne win-back ou abandon"),
]


def segment(recent: int = 90, orders: int = 1, value: float = 200, lost: int = 300) -> Column:
    """The segment label of a feature row; a NULL measure fails its test."""

    def holds(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    is_recent = holds(F.col("recency_days") < recent)
    is_frequent = holds(F.col("order_count") > orders)
    is_valuable = holds(F.col("total_value") > F.lit(value))
    active = (
        F.when(is_frequent & is_valuable, "Champion")
        .when(is_frequent | is_valuable, "Fidele")
        .otherwise("Nouveau")
    )
    inactive = (
        F.when(is_frequent, "En danger")
        .when(holds(F.col("recency_days") > lost), "Perdu")
        .otherwise("A risque")
    )
    return F.when(is_recent, active).otherwise(inactive)


def rfm_segment(
    features: DataFrame, recent: int = 90, orders: int = 1, value: float = 200, lost: int = 300
) -> DataFrame:
    return features.withColumn("segment", segment(recent, orders, value, lost))


def segment_actions(segmented: DataFrame) -> DataFrame:
    """Each segmented person with the recommended action."""
    actions = segmented.sparkSession.createDataFrame(
        SEGMENT_ACTIONS, "segment string, criteria string, action string"
    )
    return segmented.select(PERSON, "segment").join(F.broadcast(actions), "segment")


def is_churned(days: int = CHURN_DAYS) -> Column:
    return F.col("recency_days") > days


def churn_flag(features: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    return features.withColumn("churned", is_churned(days))


def churn_rate(features: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """One row: persons, churned persons and their share in percent."""
    counts = features.agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.count_if(is_churned(days)).alias("churned_count"),
    )
    return counts.withColumn("churn_pct", percent(F.col("churned_count"), F.col("customer_count")))


def top_customers(segmented: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` persons with the highest total value, as displayed."""
    order = [F.col("total_value").desc_nulls_last(), F.col(PERSON)]
    best = segmented.orderBy(*order).limit(n)
    return best.select(
        F.row_number().over(Window.orderBy(*order)),
        shortened(F.col(PERSON), 12),
        "segment",
        "order_count",
        "total_value",
        "recency_days",
    ).toDF("position", "customer", "segment", "orders", "revenue", "recency_days")


def rfm_sample(segmented: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """Recency and value of at most ``n`` persons, the same ones for the same seed.

    Persons are taken in the order of a hash of id and seed, so the choice does not depend
    on how the input is partitioned.
    """
    draw = F.md5(F.concat(F.col(PERSON), F.lit(str(seed))))
    return (
        segmented.orderBy(draw, PERSON)
        .limit(n)
        .select(PERSON, "recency_days", "total_value", "segment")
    )
