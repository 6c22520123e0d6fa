"""Customer analytics for marketplace data, written as Spark DataFrame transforms.

A set of tables is a plain ``dict[str, DataFrame]`` keyed by the names in
``basketry.schema.SCHEMAS``; every plan takes that dict and returns a lazy DataFrame.
"""

from basketry.schema import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS

__all__ = ["FOREIGN_KEYS", "PRIMARY_KEYS", "SCHEMAS"]
