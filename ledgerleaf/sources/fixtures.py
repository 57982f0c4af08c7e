"""Stand-in ledger tables derived from the driver's TPC-H-like parquet files.

These builders only give rows in the ledger's schema (the ``x_*`` shapes in
FIXTURES.md section 3); they do none of an operator's work. Every operator is
written against the schema alone and never relies on how these rows are made.

Every order line becomes a row of the ledger: of an order's lines in rank order
the first of each three is a sale, the other two are its add-ons. A sale's id is
``order key * 100 + rank`` (an order has at most 17 lines in this data).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import MONEY

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class FixtureTables:
    """Lazily built ledger tables over one scale-factor directory."""

    # Frames several tables derive from; ``materialize`` persists them while writing.
    shared_inputs = ("ranked_lines", "sale_addons")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ ledger tables
    @cached_property
    def products(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            F.when(k % 8 == 0, "Unavailable").otherwise("Available").alias("status"),
            F.when(k % 10 == 0, F.lit(""))
             .when(k % 10 == 1, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("img_"), k.cast("string"), F.lit(".webp"))).alias("image"),
        )

    @cached_property
    def ranked_lines(self) -> DataFrame:
        # Lines equal in all five columns are interchangeable, so the rank is a total order.
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        rn = F.row_number().over(w).cast("long")
        return (self.raw("lineitem")
                .select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_suppkey")
                .withColumn("rn", rn)
                .select("l_orderkey", "l_partkey", "l_quantity", (F.col("l_orderkey") * 100 + F.col("rn")).alias("line_id"),
                        (F.col("l_orderkey") * 100 + F.col("rn") - (F.col("rn") - 1) % 3).alias("sale_id")))

    @cached_property
    def sale_lines(self) -> DataFrame:
        return self.ranked_lines.filter(F.col("line_id") == F.col("sale_id"))

    @cached_property
    def addon_lines(self) -> DataFrame:
        return self.ranked_lines.filter(F.col("line_id") != F.col("sale_id"))

    @cached_property
    def addons(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("addon_id"),
            F.col("p_name").alias("addon_name"),
            (F.lit(10) + k % 90).cast(MONEY).alias("price"),
            F.when(k % 4 == 3, "Unavailable").otherwise("Available").alias("status"),
        )

    @cached_property
    def sale_addons(self) -> DataFrame:
        menu = self.addons.select("addon_id", "addon_name", "price")
        return (self.addon_lines.select(F.col("line_id").alias("id"), "sale_id", F.col("l_partkey").alias("addon_id"))
                .join(menu, "addon_id").select("id", "sale_id", "addon_id", "addon_name", "price"))

    @cached_property
    def sales(self) -> DataFrame:
        addon_total = (self.sale_addons.groupBy(F.col("sale_id").alias("_sale"))
                       .agg(F.sum("price").alias("addon_total")))
        orders = self.raw("orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
        prod = self.products.select("product_id", "product_name", "price", "image")
        base = (self.sale_lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
                .join(addon_total, F.col("sale_id") == F.col("_sale"), "left")
                .join(prod, F.col("product_id") == F.col("l_partkey")))
        qty = F.col("l_quantity").cast("int")
        return base.select(
            F.col("sale_id").alias("sales_id"),
            F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("long"))
             .otherwise(F.col("product_id")).alias("product_id"),
            F.col("product_name"),
            qty.alias("quantity"),
            (qty * (F.col("price") + F.coalesce(F.col("addon_total"), F.lit(0)))).cast(MONEY).alias("total"),
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderstatus") == "F", "Completed")
             .when(F.col("o_orderstatus") == "O", "Cancelled").otherwise("VOID").alias("status"),
            F.col("image").alias("product_image"),
        )

    @cached_property
    def ingredients(self) -> DataFrame:
        k = F.col("p_partkey")
        m6 = k % 6
        return self.raw("part").select(
            k.alias("ingredient_id"),
            F.concat(F.col("p_name"), F.lit(" "), k.cast("string")).alias("ingredient_name"),
            F.col("p_size").alias("stock"),
            F.when(k % 37 == 0, F.lit(None).cast("int")).otherwise((F.lit(5) + k % 10).cast("int"))
             .alias("low_stock_threshold"),
            F.when(m6 == 0, "Can-based").when(m6 == 1, "Bottle-based").when(m6 == 2, "Box-based")
             .when(m6 == 3, "Plastic-based").when(m6 == 4, "Pack-based")
             .otherwise(F.lit(None).cast("string")).alias("unit"),
            F.lit(None).cast("string").alias("image"),
        )

    @cached_property
    def users(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("user_id"),
            F.when(k % 7 == 0, F.col("c_name")).otherwise(F.regexp_replace("c_name", "#", "")).alias("username"),
            F.col("c_mktsegment").alias("role"),
            F.when(k % 11 == 0, F.lit("ab")).otherwise(F.col("c_name")).alias("fullname"),
            F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"),
            F.lit("").alias("avatar"),
        )

    @cached_property
    def audit_logs(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("log_id"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
            F.col("event_type").alias("action"),
            F.col("props").alias("details"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def sales_void(self) -> DataFrame:
        # The seed ledger has no voids; start from an empty table of the declared shape.
        from .schemas import SALES_VOID
        return self.spark.createDataFrame([], SALES_VOID.schema)

    # ------------------------------------------------------------------ change feeds
    @cached_property
    def sale_requests(self) -> DataFrame:
        """Requests as the form sends them: text, with ids and quantities that are no numbers or none at all,
        and quantities whose total no money column holds."""
        k = F.col("l_orderkey")
        qty = F.col("l_quantity").cast("int").cast("string")
        return self.sale_lines.select(
            F.col("sale_id").alias("request_id"),
            F.when(k % 40 == 0, F.lit("999999999")).when(k % 77 == 0, F.lit("0")).when(k % 83 == 0, F.lit("none"))
             .otherwise(F.col("l_partkey").cast("string")).alias("product_id"),
            F.when(k % 60 == 1, F.lit("0")).when(k % 60 == 2, F.lit("1e6")).when(k % 60 == 3, F.lit("99999999999"))
             .when(k % 60 == 4, F.concat(F.lit(" "), qty, F.lit("pcs"))).otherwise(qty).alias("quantity"),
        )

    @cached_property
    def request_addons(self) -> DataFrame:
        k = F.col("l_orderkey")
        return self.addon_lines.select(
            F.col("sale_id").alias("request_id"),
            F.when(k % 6 == 1, F.col("l_partkey") + 10000000).otherwise(F.col("l_partkey")).alias("addon_id"))

    @cached_property
    def cancel_requests(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").filter(k % 9 == 0).select(k.alias("request_id"), (k * 100 + 1).alias("sales_id"))

    @cached_property
    def void_requests(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").filter(k % 13 == 0).select(
            k.alias("request_id"),
            F.when(k % 130 == 0, F.lit(-1) - k).when(k % 130 == 65, F.lit(10000000000000) + k)
             .otherwise(k * 100 + 1).alias("sales_id"),
            F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("reason"),
        )

    @cached_property
    def product_changes(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").filter((k % 4 == 0) | (k % 25 == 7)).select(
            k.alias("seq"),
            F.when(k % 20 == 0, "delete").when(k % 25 == 7, "add").otherwise("edit").alias("op"),
            F.when((k % 20 != 0) & (k % 25 == 7), k + 1000000).otherwise(k).alias("product_id"),
            F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("product_name"),
            (F.col("p_retailprice") + 1).cast(MONEY).alias("price"),
            F.col("p_type").alias("category"),
            F.lit("Available").alias("status"),
            F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("new_"), k.cast("string"), F.lit(".webp")))
             .alias("image"),
        )

    @cached_property
    def ingredient_changes(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").filter((k % 3 == 0) | (k % 25 == 7)).select(
            k.alias("seq"),
            F.when(k % 30 == 0, "delete").when(k % 25 == 7, "add").otherwise("edit").alias("op"),
            F.when((k % 30 != 0) & (k % 25 == 7), k + 1000000).otherwise(k).alias("ingredient_id"),
            F.col("p_name").alias("ingredient_name"),
            (F.col("p_size") - 5).alias("stock"),
            ((k % 12).cast("int") - 1).alias("low_stock_threshold"),
            F.lit("Box-based").alias("unit"),
            F.lit(None).cast("string").alias("image"),
        )

    @cached_property
    def account_requests(self) -> DataFrame:
        u = self.users
        return u.filter(F.col("user_id") % 2 == 1).select(
            F.col("user_id").alias("seq"), "fullname",
            F.when(F.col("user_id") % 10 == 3, F.regexp_replace("username", "3", "1"))
             .otherwise(F.col("username")).alias("username"))

    @cached_property
    def existing_users(self) -> DataFrame:
        """Account table the intake feed is checked against (even ids)."""
        return self.users.filter(F.col("user_id") % 2 == 0)

    @cached_property
    def price_changes(self) -> DataFrame:
        """Price edits as text: units behind the number, exponents, no number, more than the column holds."""
        k = F.col("p_partkey")
        price = (F.when(k % 12 == 0, "123456789012.50").when(k % 12 == 1, "1e3").when(k % 12 == 2, "none")
                 .when(k % 12 == 3, "1.00495").when(k % 12 == 4, F.concat((k % 90).cast("string"), F.lit(".5 pesos")))
                 .otherwise((k % 900).cast("string")))
        return self.raw("part").select(
            k.alias("seq"), F.lit("edit").alias("op"), k.alias("product_id"), F.col("p_name").alias("product_name"),
            price.alias("price"), F.col("p_type").alias("category"), F.lit("Available").alias("status"),
            F.concat(F.lit("new image "), k.cast("string"), F.lit("+1.webp")).alias("image"))

    @cached_property
    def staff_requests(self) -> DataFrame:
        """Staff batches with adds (a name twice in one batch, with equal seq, and taken names) and edits that
        carry a username."""
        u, k = self.users, F.col("user_id")
        name = (F.when(k % 3 == 0, F.concat(F.lit("New"), (k % 60).cast("string")))
                .when(k % 3 == 1, F.upper("username")).otherwise(F.concat(F.lit("solo"), k.cast("string"))))
        return u.filter(k % 4 == 0).select(
            F.lit(1).cast("long").alias("seq"), F.when(k % 8 == 0, "edit").otherwise("add").alias("op"),
            F.when(k % 8 == 0, k).otherwise(k + 1000000).alias("user_id"), name.alias("username"), "fullname", "role",
            F.lit("active").alias("status"), F.lit(None).cast("string").alias("avatar"))

    @cached_property
    def user_changes(self) -> DataFrame:
        """Staff edits (every 5th user made inactive) and deletes (every 50th, +1)."""
        u = self.users
        k = F.col("user_id")
        return u.filter((k % 5 == 0) | (k % 50 == 1)).select(
            k.alias("seq"),
            F.when(k % 5 == 0, "edit").otherwise("delete").alias("op"),
            k.alias("user_id"), "fullname", "role",
            F.lit("inactive").alias("status"),
            F.lit(None).cast("string").alias("avatar"),
        )

    # ------------------------------------------------------------------ tables that break their rules
    @cached_property
    def dirty_addons(self) -> DataFrame:
        """Add-ons as text: ids and prices that are no numbers, missing names, an unknown status."""
        a, k = self.addons, F.col("addon_id")
        return a.select(
            F.when(k % 15 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("addon_id"),
            F.when(k % 21 != 0, F.col("addon_name")).alias("addon_name"),
            F.when(k % 22 == 0, "free").otherwise(F.col("price").cast("string")).alias("price"),
            F.when(k % 17 == 0, "Sold out").otherwise(F.col("status")).alias("status"))

    @cached_property
    def dirty_tables(self) -> dict[str, DataFrame]:
        """Tables with repeated and missing keys, rows without a parent, names that differ in case, wrong enums."""
        sid, aid, uid, pid = (F.col(c) for c in ("sales_id", "id", "user_id", "product_id"))
        sales = self.sales.withColumn("product_id", F.when(sid % 19 == 0, pid + 10000000).otherwise(pid))
        lines = self.sale_addons.withColumn("sale_id", F.when(aid % 23 == 0, F.col("sale_id") + 10**12)
                                            .otherwise(F.col("sale_id")))
        twins = (self.users.filter(uid % 12 == 0).withColumn("user_id", uid + 1000000)
                 .withColumn("username", F.upper("username")))
        voids = self.void_requests.select(F.col("request_id").alias("void_id"), F.col("sales_id").alias("sale_id"),
                                          "reason", F.lit(None).cast("timestamp_ntz").alias("voided_at"))
        return {
            "addons": self.addons.withColumn("status", F.when(F.col("addon_id") % 17 == 0, "Sold out")
                                             .otherwise(F.col("status"))),
            "products": self.products.withColumn("product_id", F.when(pid % 41 != 0, pid)),
            "sales": sales.unionByName(sales.filter(sid % 33 == 0)),
            "sales_void": voids,
            "sale_addons": lines.unionByName(lines.filter(aid % 29 == 0)),
            "users": self.users.unionByName(twins),
        }

    @cached_property
    def purchase_events(self) -> DataFrame:
        """``events`` rows of type purchase seen as completed sales (stream T1)."""
        return self.raw("events").filter(F.col("event_type") == "purchase")
