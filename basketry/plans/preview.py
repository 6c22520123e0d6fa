"""The first rows of the feature view, computed from the keys of their persons.

A limit on the whole view would compute every person first. Here the first persons by id are looked
up with their customer ids, then their orders, lines, reviews and products, each by the keys found
before. The keys are few, so they travel as literals: the scans' filters are pushed down, and
stored row groups without any of them are skipped. The view then runs on the rows found, in
one task and without an exchange. More than ``LOOKUP`` rows of a kind are not looked up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import DELIVERED, is_delivered
from basketry.functions.local import local_rows
from basketry.operators import dictionary
from basketry.operators.orders import PERSON, PURCHASED, lacks_value, reference_date, with_person
from basketry.plans.features import category_masks, view_of
from basketry.schema import Tables

#: Rows of one kind that are looked up, at most.
LOOKUP = 10_000


class TooMany(Exception):
    """A lookup found more than ``LOOKUP`` rows."""


def _rows(df: DataFrame, most: int) -> list:
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise TooMany
    return found


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _among(column: str, values: Iterable[str]) -> Column:
    """``column IN (values)`` as one expression; a column for each literal would be slow to build."""
    listed = ", ".join(map(_text, sorted(values)))
    return F.expr(f"{column} IN ({listed})") if listed else F.lit(False)


def _customers_in_order(customers: DataFrame, n: int, most: int) -> Iterator[dict[str, str]]:
    """Batches of customer_id -> person, persons ascending, each with all of its customer ids."""
    ids = customers.select(PERSON, "customer_id").where(F.col(PERSON).isNotNull())
    after, size = None, min(4 * n + 1, most)
    while True:
        rest = ids if after is None else ids.where(F.col(PERSON) > after)
        rows = rest.orderBy(PERSON).limit(size).collect()
        last = len(rows) < size
        if not last:
            # The limit may have cut the last person short, who comes again with the next batch.
            cut = rows[-1][PERSON]
            rows = [r for r in rows if r[PERSON] != cut]
            if not rows and size == most:
                raise TooMany
        if rows:
            yield {r["customer_id"]: r[PERSON] for r in rows}
            after = rows[-1][PERSON]
        if last:
            return
        size = min(4 * size, most)


def _local(rows: list, like: DataFrame) -> DataFrame:
    """Rows of ``like`` in one partition, so that joins and sums of such frames need no exchange."""
    return local_rows(like.sparkSession, rows, like.schema).coalesce(1).hint("shuffle_hash")


def _looked_up(t: Tables, n: int, most: int) -> DataFrame:
    people: dict[str, str] = {}
    kept: dict[str, list] = {"orders": [], "order_items": [], "order_reviews": []}
    orders = t["orders"].select("order_id", "customer_id", "order_status", PURCHASED)
    lines = t["order_items"]
    lines = lines.select(*[c for c in lines.columns if c in _LINE_COLUMNS], lacks_value(lines).alias("no_value"))
    reviews = t["order_reviews"].select("order_id", "review_score")
    with ThreadPoolExecutor(3) as at_once:
        newest = at_once.submit(lambda: reference_date(t["orders"]).collect()[0][0])
        for ids in _customers_in_order(t["customers"], n, most):
            found = _rows(orders.where(_among("customer_id", ids)), most)
            owner = {r["order_id"]: ids[r["customer_id"]] for r in found}
            delivered = [r["order_id"] for r in found if r["order_status"] == DELIVERED]
            later = at_once.submit(_rows, reviews.where(_among("order_id", owner)), most)
            bought = _rows(lines.where(_among("order_id", delivered)), most)
            buyers = set(sorted({owner[r["order_id"]] for r in bought})[: n - len(set(people.values()))])
            people |= {customer: person for customer, person in ids.items() if person in buyers}
            for name, rows in (("orders", found), ("order_items", bought), ("order_reviews", later.result())):
                kept[name] += [r for r in rows if owner[r["order_id"]] in buyers]
            if len(set(people.values())) == n:
                break
        products = t["products"].select("product_id", "product_category_name")
        wanted = {r["product_id"] for r in kept["order_items"]} - {None}
        named = [r for r in _rows(products.where(_among("product_id", wanted)), most) if r["product_category_name"] is not None]
        bits = dictionary.numbered(r["product_category_name"] for r in named)
        masks = [(r["product_id"], bits[r["product_category_name"]]) for r in named]
        reduced = {
            "customers": _local(list(people.items()), t["customers"].select("customer_id", PERSON)),
            "orders": _local(kept["orders"], orders),
            "order_items": _local(kept["order_items"], lines),
            "order_reviews": _local(kept["order_reviews"], reviews),
        }
        coded = dictionary.coded(orders.sparkSession, masks, products.schema["product_id"])
        null_values = any(r["no_value"] for r in kept["order_items"])
        return view_of(reduced, F.lit(newest.result()), coded.coalesce(1).hint("shuffle_hash"), null_values)


_LINE_COLUMNS = ("order_id", "product_id", "price", "freight_value", "value_sum", "valued_lines", "line_count")


def _joined(t: Tables, n: int) -> DataFrame:
    """The same without a bound on the persons' rows: the tables are reduced by semi joins."""
    sold = t["orders"].where(is_delivered()).join(t["order_items"].select("order_id"), "order_id", "left_semi")
    buyers = with_person(sold.select("customer_id").distinct(), t).select(PERSON).where(F.col(PERSON).isNotNull())
    persons = buyers.distinct().orderBy(PERSON).limit(n)
    customers = t["customers"].join(F.broadcast(persons), PERSON, "left_semi")  # n rows
    orders = t["orders"].join(customers.select("customer_id"), "customer_id", "left_semi")
    kept = orders.select("order_id")
    reduced = t | {
        "customers": customers,
        "orders": orders,
        "order_items": t["order_items"].join(kept, "order_id", "left_semi"),
        "order_reviews": t["order_reviews"].join(kept, "order_id", "left_semi"),
    }
    coded = dictionary.codes(t["products"], "product_category_name")
    return view_of(reduced, reference_date(t["orders"]).scalar(), category_masks(t["products"], coded), True)


def customer_features_first(t: Tables, n: int = 10, most: int = LOOKUP) -> DataFrame:
    """The view's rows of the first ``n`` persons by id.

    If there are more than ``most`` customer ids, orders, lines or reviews to look up, the
    tables are reduced by semi joins instead, with the same result.
    """
    try:
        found = _looked_up(t, n, most)
    except TooMany:
        found = _joined(t, n)
    return found.orderBy(PERSON).limit(n)
