"""Declared schemas, keys and relations of the eight marketplace tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

Tables = dict[str, DataFrame]

MONEY = DecimalType(10, 2)
MONEY_TOTAL = DecimalType(38, 2)


def _table(not_null: tuple[str, ...] = (), **columns) -> StructType:
    return StructType(
        [StructField(name, kind, name not in not_null) for name, kind in columns.items()]
    )


_text, _int, _time = StringType(), IntegerType(), TimestampNTZType()

# Table and column names and types of the source files
# ("lenght" is how the source spells it; zip prefixes keep leading zeros).
SCHEMAS: dict[str, StructType] = {
    "customers": _table(
        customer_id=_text,
        customer_unique_id=_text,
        customer_zip_code_prefix=_text,
        customer_city=_text,
        customer_state=_text,
        not_null=("customer_id", "customer_unique_id"),
    ),
    "orders": _table(
        order_id=_text,
        customer_id=_text,
        order_status=_text,
        order_purchase_timestamp=_time,
        order_approved_at=_time,
        order_delivered_carrier_date=_time,
        order_delivered_customer_date=_time,
        order_estimated_delivery_date=_time,
        not_null=("order_id",),
    ),
    "order_items": _table(
        order_id=_text,
        order_item_id=_int,
        product_id=_text,
        seller_id=_text,
        shipping_limit_date=_time,
        price=MONEY,
        freight_value=MONEY,
    ),
    "order_payments": _table(
        order_id=_text,
        payment_sequential=_int,
        payment_type=_text,
        payment_installments=_int,
        payment_value=MONEY,
    ),
    "order_reviews": _table(
        review_id=_text,
        order_id=_text,
        review_score=_int,
        review_comment_title=_text,
        review_comment_message=_text,
        review_creation_date=_time,
        review_answer_timestamp=_time,
    ),
    "products": _table(
        product_id=_text,
        product_category_name=_text,
        product_name_lenght=_int,
        product_description_lenght=_int,
        product_photos_qty=_int,
        product_weight_g=_int,
        product_length_cm=_int,
        product_height_cm=_int,
        product_width_cm=_int,
        not_null=("product_id",),
    ),
    "sellers": _table(
        seller_id=_text,
        seller_zip_code_prefix=_text,
        seller_city=_text,
        seller_state=_text,
        not_null=("seller_id",),
    ),
    "product_category_translation": _table(
        product_category_name=_text,
        product_category_name_english=_text,
        not_null=("product_category_name",),
    ),
}

PRIMARY_KEYS: dict[str, str] = {
    "customers": "customer_id",
    "orders": "order_id",
    "products": "product_id",
    "sellers": "seller_id",
    "product_category_translation": "product_category_name",
}

NOT_NULL: dict[str, list[str]] = {
    table: [field.name for field in schema if not field.nullable]
    for table, schema in SCHEMAS.items()
    if any(not field.nullable for field in schema)
}


class Relation(NamedTuple):
    child: str
    parent: str
    key: str

    @property
    def label(self) -> str:
        return f"{self.child}.{self.key} -> {self.parent}"


FOREIGN_KEYS: list[Relation] = [
    Relation("orders", "customers", "customer_id"),
    Relation("order_items", "orders", "order_id"),
    Relation("order_items", "products", "product_id"),
    Relation("order_items", "sellers", "seller_id"),
    Relation("order_payments", "orders", "order_id"),
    Relation("order_reviews", "orders", "order_id"),
    Relation("products", "product_category_translation", "product_category_name"),
]
