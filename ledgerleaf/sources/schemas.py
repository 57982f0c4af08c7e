"""Declared table schemas (never inferred).

The shop's ledger has eight tables. Integer keys are declared ``long`` so the
same schema holds at any scale; money is ``decimal(10,2)`` as declared, and
the password column of ``users`` is deliberately absent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
# Spark's sum of decimal(10,2) widens to decimal(20,2); results are typed so.
MONEY_SUM = T.DecimalType(20, 2)


@dataclass(frozen=True)
class TableSpec:
    """A table's schema plus the rules its DDL enforces."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)      # column -> SQL literal text
    enums: dict = field(default_factory=dict)         # column -> allowed values
    unique: tuple[tuple[str, ...], ...] = ()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


ADDONS = TableSpec(
    "addons",
    T.StructType([_f("addon_id", T.LongType(), False), _f("addon_name", T.StringType(), False),
                  _f("price", MONEY, False), _f("status", T.StringType())]),
    key=("addon_id",), not_null=("addon_id", "addon_name", "price"),
    defaults={"price": "0.00", "status": "'Available'"},
    # The enum domain of addons.status.
    enums={"status": ("Available", "Unavailable")},
)

INGREDIENTS = TableSpec(
    "ingredients",
    T.StructType([_f("ingredient_id", T.LongType(), False), _f("ingredient_name", T.StringType()),
                  _f("stock", T.IntegerType()), _f("low_stock_threshold", T.IntegerType()),
                  _f("unit", T.StringType()), _f("image", T.StringType())]),
    key=("ingredient_id",), not_null=("ingredient_id",), defaults={"unit": "'pcs'"},
)

PRODUCTS = TableSpec(
    "products",
    T.StructType([_f("product_id", T.LongType(), False), _f("product_name", T.StringType()),
                  _f("category", T.StringType()), _f("price", MONEY), _f("status", T.StringType()),
                  _f("image", T.StringType())]),
    key=("product_id",), not_null=("product_id",),
)

SALES = TableSpec(
    "sales",
    T.StructType([_f("sales_id", T.LongType(), False), _f("product_id", T.LongType()),
                  _f("product_name", T.StringType()), _f("quantity", T.IntegerType()),
                  _f("total", MONEY), _f("created_at", T.TimestampNTZType()),
                  _f("status", T.StringType()), _f("product_image", T.StringType())]),
    key=("sales_id",), not_null=("sales_id",),
    defaults={"created_at": "current_timestamp", "status": "'Completed'"},
)

SALES_VOID = TableSpec(
    "sales_void",
    T.StructType([_f("void_id", T.LongType(), False), _f("sale_id", T.LongType()),
                  _f("reason", T.StringType()), _f("voided_at", T.TimestampNTZType())]),
    key=("void_id",), not_null=("void_id",), defaults={"voided_at": "current_timestamp"},
)

SALE_ADDONS = TableSpec(
    "sale_addons",
    T.StructType([_f("id", T.LongType(), False), _f("sale_id", T.LongType(), False), _f("addon_id", T.LongType()),
                  _f("addon_name", T.StringType()), _f("price", MONEY)]),
    key=("id",), not_null=("id", "sale_id"),
)

AUDIT_LOGS = TableSpec(
    "audit_logs",
    T.StructType([_f("log_id", T.LongType(), False), _f("user_name", T.StringType()),
                  _f("action", T.StringType()), _f("details", T.StringType()),
                  _f("created_at", T.TimestampNTZType())]),
    key=("log_id",), not_null=("log_id",), defaults={"created_at": "current_timestamp"},
)

USERS = TableSpec(
    "users",
    T.StructType([_f("user_id", T.LongType(), False), _f("username", T.StringType(), False),
                  _f("role", T.StringType()), _f("fullname", T.StringType()),
                  _f("status", T.StringType()), _f("avatar", T.StringType())]),
    key=("user_id",), not_null=("user_id", "username"),
    defaults={"fullname": "''", "status": "'active'", "avatar": "''"},
    unique=(("username",),),
)

TABLES: dict[str, TableSpec] = {t.name: t for t in
                                (ADDONS, INGREDIENTS, PRODUCTS, SALES, SALES_VOID, SALE_ADDONS, AUDIT_LOGS, USERS)}

# Store layout: the ledger's event-time column and the month partition column
# (first day of the month of that time) the parquet store is partitioned by.
# Readers see the partition column appended to the declared schema; time-range
# filters on the event time add the matching month predicate (partition pruning).
TIME_PARTITIONS = {"created_at": "sale_month", "day": "sale_month"}   # "day": the daily rollup

# The audit log's month partition column in the store.
LOG_PARTITION = "log_month"

# Foreign keys declared in the DDL: (child table, child column, parent table, parent column, on delete).
FOREIGN_KEYS = (
    ("sales", "product_id", "products", "product_id", "set null"),
    ("sales_void", "sale_id", "sales", "sales_id", "cascade"),
    ("sale_addons", "sale_id", "sales", "sales_id", "restrict"),
)

# What a change of the referred-to key does to the child: (child table, child column) -> action.
UPDATE_ACTIONS = {("sales", "product_id"): "cascade", ("sales_void", "sale_id"): "cascade",
                  ("sale_addons", "sale_id"): "restrict"}

# Change feeds (batch forms of the web forms).
SALE_REQUESTS = T.StructType([_f("request_id", T.LongType(), False), _f("product_id", T.LongType()),
                              _f("quantity", T.IntegerType()), _f("requested_at", T.TimestampNTZType())])
REQUEST_ADDONS = T.StructType([_f("request_id", T.LongType(), False), _f("addon_id", T.LongType())])
CANCEL_REQUESTS = T.StructType([_f("request_id", T.LongType(), False), _f("sales_id", T.LongType())])
VOID_REQUESTS = T.StructType([_f("request_id", T.LongType(), False), _f("sales_id", T.LongType()),
                              _f("reason", T.StringType()), _f("requested_at", T.TimestampNTZType())])
ACCOUNT_REQUESTS = T.StructType([_f("seq", T.LongType(), False), _f("fullname", T.StringType()),
                                 _f("username", T.StringType())])
