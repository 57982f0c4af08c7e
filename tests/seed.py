"""Seed-shaped ledger rows for unit tests (the shop's shipped sample data).

Product images are placeholders: only "has an image" matters to the rules.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

# (product_id, product_name, category, price, status)
PRODUCTS = [
    (17, "Americano", "Hot Coffee", "59.00", "Available"), (19, "Caramel Macchiato", "Hot Coffee", "89.00", "Unavailable"),
    (20, "Cocoa Latte", "Hot Coffee", "85.00", "Available"), (21, "Latte", "Hot Coffee", "75.00", "Available"),
    (22, "Matcha Latte", "Hot Coffee", "85.00", "Available"), (23, "Mocha", "Hot Coffee", "85.00", "Available"),
    (24, "Salted Caramel", "Hot Coffee", "85.00", "Available"), (25, "Spanish Latte", "Hot Coffee", "85.00", "Available"),
    (26, "Vietnamese", "Hot Coffee", "69.00", "Available"), (27, "White Mocha Latte", "Hot Coffee", "85.00", "Available"),
    (28, "Strawberry Oreo", "Non-Coffee", "89.00", "Available"), (29, "Strawberry Milk", "Non-Coffee", "89.00", "Available"),
    (30, "Strawberry Cocoa", "Non-Coffee", "89.00", "Unavailable"), (31, "Oreo Milk", "Non-Coffee", "89.00", "Available"),
    (32, "Milo Dino", "Non-Coffee", "89.00", "Available"), (33, "Cocoa Latte", "Non-Coffee", "89.00", "Available"),
    (34, "Chocolate Milk", "Non-Coffee", "89.00", "Available"), (35, "Choco Oreo Milk", "Non-Coffee", "89.00", "Available"),
    (36, "Caramel Milk", "Non-Coffee", "89.00", "Available"), (37, "Blueberry Milk", "Non-Coffee", "89.00", "Available"),
    (38, "Biscoff Oreo", "Non-Coffee", "89.00", "Available"), (39, "Biscoff Milk", "Non-Coffee", "89.00", "Available"),
    (40, "Vanilla Matcha", "Matcha Series", "99.00", "Unavailable"), (41, "Strawberry Matcha", "Matcha Series", "109.00", "Available"),
    (42, "Sea Salt Matcha", "Matcha Series", "89.00", "Available"), (43, "Matcha Oreo", "Matcha Series", "89.00", "Available"),
    (44, "Matcha Latte", "Matcha Series", "89.00", "Available"), (45, "Blueberry Matcha", "Matcha Series", "89.00", "Available"),
    (46, "White Mocha Latte", "Iced Coffee", "89.00", "Available"), (47, "Vietnamese", "Iced Coffee", "75.00", "Available"),
    (48, "Spanish Latte", "Iced Coffee", "89.00", "Available"), (49, "Sea Salt Latte", "Iced Coffee", "109.00", "Available"),
    (50, "Salted Caramel", "Iced Coffee", "89.00", "Available"), (51, "Oreo Latte", "Iced Coffee", "95.00", "Available"),
    (52, "Mocha", "Iced Coffee", "89.00", "Available"), (53, "Latte", "Iced Coffee", "79.00", "Available"),
    (54, "Matcha Latte", "Iced Coffee", "1.00", "Available"), (55, "Cocoa Latte", "Iced Coffee", "89.00", "Available"),
    (56, "Caramel Mocha Latte", "Iced Coffee", "99.00", "Available"), (57, "Caramel Macchiato", "Iced Coffee", "99.00", "Available"),
    (58, "Biscoff Latte", "Iced Coffee", "119.00", "Available"), (59, "Americano", "Iced Coffee", "65.00", "Available"),
    (60, "Dirty Matcha", "Iced Coffee", "99.00", "Available"), (63, "White Macha Sub Oat", "Matcha Series", "109.00", "Available"),
    (64, "Plain Fries", "Snacks", "50.00", "Available"), (65, "Chicken Pops", "Snacks", "85.00", "Available"),
    (66, "Chicken Pops w/ Fries", "Snacks", "110.00", "Available"), (67, "Cheese Fries", "Snacks", "60.00", "Available"),
    (68, "Barbecue Fries", "Snacks", "60.00", "Available"), (69, "Extra Shot", "Add Ons", "20.00", "Available"),
    (70, "Sea Salt Cream", "Add Ons", "20.00", "Available"), (71, "Cold Foam", "Add Ons", "10.00", "Available"),
]

# (sales_id, product_id, product_name, quantity, total, created_at, status)
SALES = [
    (25, 17, "Americano", 1, "59.00", "2026-04-30 16:15:26", "Cancelled"),
    (26, 22, "Matcha Latte", 2, "170.00", "2026-04-30 16:22:57", "Completed"),
    (27, 60, "Dirty Matcha", 1, "99.00", "2026-04-30 16:46:34", "Completed"),
    (28, 17, "Americano", 1, "59.00", "2026-04-30 23:54:16", "Completed"),
    (29, 21, "Latte", 1, "95.00", "2026-04-30 23:58:43", "Completed"),
    (30, 25, "Spanish Latte", 1, "105.00", "2026-05-01 14:15:23", "Completed"),
    (31, 39, "Biscoff Milk", 3, "297.00", "2026-05-01 14:16:32", "Completed"),
    (32, 29, "Strawberry Milk", 2, "178.00", "2026-05-01 14:23:49", "Completed"),
    (33, 42, "Sea Salt Matcha", 1, "89.00", "2026-05-01 16:00:09", "Completed"),
    (34, 26, "Vietnamese", 1, "89.00", "2026-05-13 11:54:36", "Completed"),
    (35, 22, "Matcha Latte", 10, "1050.00", "2026-05-13 11:54:43", "Completed"),
    (37, 26, "Vietnamese", 2, "178.00", "2026-05-13 12:00:05", "Completed"),
    (38, 25, "Spanish Latte", 1, "105.00", "2026-05-14 08:55:34", "Completed"),
    (39, 27, "White Mocha Latte", 2, "210.00", "2026-05-14 12:23:16", "Completed"),
    (40, 59, "Americano", 1, "65.00", "2026-05-14 12:23:39", "Completed"),
    (41, 26, "Vietnamese", 2, "138.00", "2026-05-14 12:23:59", "Cancelled"),
    (42, 24, "Salted Caramel", 1, "95.00", "2026-05-16 02:36:11", "Cancelled"),
    (43, 22, "Matcha Latte", 3, "315.00", "2026-05-16 03:26:23", "Completed"),
]

# (addon_id, addon_name, price, status)
ADDONS = [(1, "Extra Shot", "20.00", "Available"), (2, "Sea Salt Cream", "20.00", "Available"),
          (3, "Cold Foam", "10.00", "Available")]

# (sale_id, addon_id, addon_name, price)
SALE_ADDONS = [(29, 1, "Extra Shot", "20.00"), (30, 2, "Sea Salt Cream", "20.00"), (31, 3, "Cold Foam", "10.00"),
               (34, 1, "Extra Shot", "20.00"), (35, 2, "Sea Salt Cream", "20.00"), (37, 1, "Extra Shot", "20.00"),
               (38, 1, "Extra Shot", "20.00"), (39, 1, "Extra Shot", "20.00"), (42, 3, "Cold Foam", "10.00"),
               (43, 1, "Extra Shot", "20.00")]

# (ingredient_id, ingredient_name, stock, low_stock_threshold, unit)
INGREDIENTS = [
    (3, "Caramel Syrup", 20, 5, "Bottle-based"), (4, "Salted Caramel Syrup", 15, 5, "Bottle-based"),
    (5, "Caramel Sauce", 15, 5, "Bottle-based"), (6, "Chocolate Syrup", 20, 5, "Bottle-based"),
    (7, "Chocolate Sauce", 20, 5, "Bottle-based"), (8, "White Chocolate Sauce", 20, 5, "Bottle-based"),
    (9, "Strawberry Syrup", 20, 5, "Bottle-based"), (10, "Strawberry Puree", 20, 5, "Bottle-based"),
    (11, "Blueberry Syrup", 20, 5, "Bottle-based"), (12, "Blueberry Puree", 15, 5, "Bottle-based"),
    (13, "Vanilla Syrup", 20, 5, "Bottle-based"), (14, "Milk", 20, 5, "Box-based"),
    (15, "All Purpose Cream", 5, 5, "Box-based"), (16, "Cups", 30, 5, "Box-based"),
    (17, "Straws", 100, 10, "Pack-based"), (18, "Biscoff Biscuits", 20, 5, "Pack-based"),
    (19, "Biscoff Sauce", 10, 3, "Bottle-based"), (20, "Crushed Oreo", 20, 5, "Pack-based"),
    (21, "Matcha Powder", 20, 5, "Pack-based"), (22, "Condensed Milk", 15, 5, "Can-based"),
    (23, " Coffee Beans", 15, 5, "Plastic-based"), (24, "Caramel Sauce", 20, 10, "Bottle-based"),
]


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def products_df(spark):
    from ledgerleaf.sources.schemas import PRODUCTS as SPEC
    rows = [(pid, n, c, D(p), s, f"p{pid}.webp") for pid, n, c, p, s in PRODUCTS]
    return spark.createDataFrame(rows, SPEC.schema)


def sales_df(spark, rows=None):
    from ledgerleaf.sources.schemas import SALES as SPEC
    rows = rows or SALES
    data = [(sid, pid, n, q, D(t), ts(c), st, f"p{pid}.webp") for sid, pid, n, q, t, c, st in rows]
    return spark.createDataFrame(data, SPEC.schema)


def addons_df(spark):
    from ledgerleaf.sources.schemas import ADDONS as SPEC
    return spark.createDataFrame([(i, n, D(p), s) for i, n, p, s in ADDONS], SPEC.schema)


def sale_addons_df(spark):
    from ledgerleaf.sources.schemas import SALE_ADDONS as SPEC
    return spark.createDataFrame([(i, s, a, n, D(p)) for i, (s, a, n, p) in enumerate(SALE_ADDONS, 1)], SPEC.schema)


def ingredients_df(spark, rows=None):
    from ledgerleaf.sources.schemas import INGREDIENTS as SPEC
    rows = rows if rows is not None else INGREDIENTS
    return spark.createDataFrame([(i, n, s, t, u, "") for i, n, s, t, u in rows], SPEC.schema)
