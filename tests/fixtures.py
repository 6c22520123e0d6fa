"""Small hand-made tables in the declared schemas."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from basketry.schema import SCHEMAS


def frame(spark, table, *rows):
    """Rows as dicts; columns not given are NULL, numbers become the declared decimals."""
    schema = SCHEMAS[table]
    unknown = {key for row in rows for key in row} - set(schema.names)
    assert not unknown, unknown

    def value(row, field):
        v = row.get(field.name)
        if v is not None and field.dataType.typeName() == "decimal":
            v = Decimal(str(v))
        if isinstance(v, str) and field.dataType.typeName() == "timestamp_ntz":
            v = datetime.fromisoformat(v)
        return v

    return spark.createDataFrame([tuple(value(r, f) for f in schema) for r in rows], schema)


def customer(cid, person, state="SP"):
    return {"customer_id": cid, "customer_unique_id": person, "customer_state": state}


def order(oid, cid, when, status="delivered", delivered=None):
    return {
        "order_id": oid,
        "customer_id": cid,
        "order_status": status,
        "order_purchase_timestamp": when,
        "order_delivered_customer_date": delivered,
    }


def item(oid, price, freight=0, product="p1", seller="s1"):
    return {
        "order_id": oid,
        "price": price,
        "freight_value": freight,
        "product_id": product,
        "seller_id": seller,
    }


def review(oid, score):
    return {"order_id": oid, "review_score": score}


def payment(oid, kind, value=1):
    return {"order_id": oid, "payment_type": kind, "payment_value": value}


def product(pid, category):
    return {"product_id": pid, "product_category_name": category}


def tables(spark, **rows):
    return {name: frame(spark, name, *rows.get(name, ())) for name in SCHEMAS}


def shop(spark):
    """Two persons with several orders, one with a single order, one never delivered."""
    return tables(
        spark,
        customers=[
            customer("c1", "ana"),
            customer("c2", "ana", "RJ"),
            customer("c3", "bob"),
            customer("c4", "eva", "RJ"),
            customer("c5", "dan", None),
        ],
        orders=[
            order("o1", "c1", "2018-01-01 23:00:00", delivered="2018-01-05"),
            order("o2", "c2", "2018-01-02 01:00:00"),
            order("o3", "c1", "2018-03-01 10:00:00", delivered="2018-03-03"),
            order("o4", "c3", "2018-02-01 12:00:00", delivered="2018-02-03"),
            order("o5", "c4", "2018-03-02 00:30:00", "canceled", "2018-03-04"),
            order("o6", "c5", "2018-02-15 08:00:00", delivered="2018-02-16"),
            order("o7", "c5", "2018-02-15 08:00:00", delivered="2018-02-16"),
            order("o8", "c3", "2017-12-31 08:00:00", delivered="2018-01-02"),
            order("o9", "c3", "2018-01-10 08:00:00", None, "2018-01-12"),
        ],
        order_items=[
            item("o1", "10.00", "0.01"),
            item("o1", "20.00", "0.01", "p2"),
            item("o1", "3.33", "0.00", "p3", "s2"),
            item("o2", "50.00", "5.00", "p2"),
            item("o3", "5.00", "0.50", "p4"),
            item("o4", "100.00", "10.00", "p1", "s2"),
            item("o5", "999.00", "1.00"),
            item("o6", "7.00", None),
            item("o7", "8.00", "1.00", "missing"),
            item("o9", "70.00", "1.00"),
        ],
        order_payments=[
            payment("o1", "credit_card", "20.00"),
            payment("o1", "voucher", "13.35"),
            payment("o2", "credit_card", "55.00"),
            payment("o4", "boleto", "110.00"),
        ],
        order_reviews=[
            review("o1", 5),
            review("o1", 2),
            review("o2", None),
            review("o4", 1),
            review("o5", 3),
        ],
        products=[
            product("p1", "beleza"),
            product("p2", None),
            product("p3", "beleza"),
            product("p4", "sem_nome"),
        ],
        sellers=[
            {"seller_id": "s1", "seller_state": "SP"},
            {"seller_id": "s2", "seller_state": "PR"},
        ],
        product_category_translation=[
            {"product_category_name": "beleza", "product_category_name_english": "beauty"}
        ],
    )


def by_key(df, key):
    return {row[key]: row for row in df.collect()}
