"""Table changes as batch jobs (M1-M9): ``state + changes -> new state, rejects``.

Parquet has no MERGE, so each operator returns the new table(s) and a
``rejects`` frame (request key + reason); callers write them to fresh paths.

Skew: change feeds may pile many requests on one key. Nothing here gathers a
key's requests into one task: per-key results come from partial aggregates
(``max`` over structs ordered by the request sequence), and the joins that
bring them back are equi-joins that AQE's skew handling can split.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import global_row_number
from ..functions.sizing import broadcast_if_small, keys_present
from ..functions.text import php_floatval_money, php_intval, trim_col
from ..sources.schemas import INGREDIENTS, MONEY, PRODUCTS, SALES_VOID, USERS
from .filters import COMPLETED, is_available, is_completed

# Messages, statuses and rules of the sales, inventory and account forms.
MSG_INVALID_SALE_REQUEST = "Invalid product or quantity."
MSG_PRODUCT_NOT_FOUND = "Product not found."
MSG_INVALID_SALE = "Invalid sale."
MSG_NEGATIVE_STOCK = "Stock and threshold values must not be negative."
MSG_FIELDS_REQUIRED = "All fields are required."
MSG_FULLNAME_SHORT = "Full name must be 3+ characters."
MSG_USERNAME_INVALID = "Username must be 3-20 characters (letters, numbers only)."
MSG_USERNAME_TAKEN = "Username already exists."
STATUS_CANCELLED = "Cancelled"
STATUS_VOID = "VOID"
USERNAME_PATTERN = r"^[a-zA-Z0-9]{3,20}$"
MIN_FULLNAME = 3
# The user table's collation: case and accents do not make a different name.
NAME_COLLATION = "UNICODE_CI_AI"

# Our own message: the forms have none for a void of a sale that does not
# exist (the database refuses the ledger row).
MSG_UNKNOWN_SALE = "Unknown sale."
# Our own messages: the database refuses a value its column cannot hold, or a second user of a name.
MSG_TOTAL_RANGE = "Total out of range."
MSG_PRICE_RANGE = "Price out of range."
MSG_STOCK_RANGE = "Stock or threshold out of range."


def _ts(value) -> Column:
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast(T.TimestampNTZType())
    return F.localtimestamp()


def parsed_once(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with computed columns that later steps only refer to.

    The values pass through an array of one struct that is taken apart again: a step the optimiser does not fold
    into what follows, so a costly expression appears once in the plan however often its column is used.
    """
    names = [c for c in df.columns if c not in values]
    each = F.array(F.struct(*[v.alias(c) for c, v in values.items()]))
    return df.select(*names, F.inline(each)).select(*df.columns)


def _php_empty(c: Column) -> Column:
    return c.isNull() | (c == "") | (c == "0")


# =========================================================================== M1
def record_sales(requests: DataFrame, request_addons: DataFrame | None, products: DataFrame, addons: DataFrame,
                 run_ts: dt.datetime | None = None) -> dict[str, DataFrame]:
    """Price a batch of sale requests.

    Ids and quantities may be text and are read as the form reads them. Rules
    per request: product id and quantity must be > 0 (a quantity no int holds
    is none); the product must exist with a non-empty name (availability is not checked); selected add-on
    ids count once each and only if the add-on is Available; the total is
    ``quantity * (price + add-on total)`` in exact decimal. The sale id is the
    request id, so reruns give the same ids.

    Selected add-ons come either as a long frame ``request_addons``
    (request_id, addon_id) or, when that is None, as an ``addon_ids`` array
    column of ``requests`` (exploded here).
    """
    judged, lines = priced_requests(requests, request_addons, products, addons, run_ts)
    held = judged.filter(F.col("reason").isNull())
    sales = held.select(
        F.col("request_id").alias("sales_id"), "product_id", "product_name", "quantity", "total", "created_at",
        F.lit(COMPLETED).alias("status"), F.col("image").alias("product_image"))
    sale_addons = (lines.join(held.select("request_id"), "request_id", "left_semi")
                   .select(F.col("request_id").alias("sale_id"), "addon_id", "addon_name", "price"))
    rejects = judged.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    return {"sales": sales, "sale_addons": sale_addons, "rejects": rejects}


def priced_requests(requests: DataFrame, request_addons: DataFrame | None, products: DataFrame, addons: DataFrame,
                    run_ts: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Every request once, priced, with ``reason`` (NULL where it is accepted), and the add-on lines.

    The requests are read and their numbers parsed in one pass; sales and rejects are filters of the result.
    """
    req = requests
    if request_addons is None:
        request_addons = req.select("request_id", F.explode_outer("addon_ids").alias("addon_id")) \
            .filter(F.col("addon_id").isNotNull())
        req = req.drop("addon_ids")
    created = (F.coalesce(F.col("requested_at"), _ts(run_ts)) if "requested_at" in req.columns else _ts(run_ts))
    req = parsed_once(req.withColumn("created_at", created), {
        "product_id": _long("product_id", req), "quantity": _long("quantity", req).try_cast("int")})
    request_addons = request_addons.select("request_id", _long("addon_id", request_addons).alias("addon_id"))

    # Add-on lines: IN (...) semantics: duplicates collapse, unknown or unavailable ids drop.
    avail = addons.filter(is_available()).select("addon_id", "addon_name", "price")
    lines = request_addons.select("request_id", "addon_id").distinct().join(avail, "addon_id")
    addon_total = lines.groupBy("request_id").agg(F.sum("price").alias("addon_total"))

    prod = products.select("product_id", "product_name", F.col("price").alias("unit_price"), "image")
    priced = req.join(prod, "product_id", "left").join(addon_total, "request_id", "left")
    money = [F.coalesce(F.col(c), F.lit(0)).cast("decimal(14,2)") for c in ("unit_price", "addon_total")]
    total = (F.col("quantity").cast("decimal(10,0)") * (money[0] + money[1])).try_cast(MONEY)
    bad = ~F.coalesce((F.col("product_id") > 0) & (F.col("quantity") > 0), F.lit(False))
    reason = (F.when(bad, MSG_INVALID_SALE_REQUEST).when(_php_empty(F.col("product_name")), MSG_PRODUCT_NOT_FOUND)
              .when(F.col("total").isNull(), MSG_TOTAL_RANGE))
    return priced.withColumn("total", total).withColumn("reason", reason), lines


# =========================================================================== M2
def cancel_sales(sales: DataFrame, requests: DataFrame) -> DataFrame:
    """Completed sales named in ``requests`` become Cancelled; others are unchanged.

    Idempotent: cancelling twice gives the same table.
    """
    ids = (requests.select(_long("sales_id", requests).alias("sales_id")).where(F.col("sales_id").isNotNull())
           .distinct().withColumn("_hit", F.lit(True)))
    # A request list far smaller than the ledger is broadcast (size checked), so
    # the ledger is scanned once and never shuffled.
    joined = sales.join(broadcast_if_small(ids), "sales_id", "left")
    status = F.when(F.col("_hit") & (is_completed()), F.lit(STATUS_CANCELLED)).otherwise(F.col("status"))
    return joined.select(*[status.alias("status") if c == "status" else F.col(c) for c in sales.columns])


# =========================================================================== M3
def resolve_voids(sales: DataFrame, requests: DataFrame, sales_void: DataFrame | None = None,
                  run_ts: dt.datetime | None = None) -> dict[str, DataFrame]:
    """Check void requests against the ledger: ledger rows and rejects.

    Rejects: id <= 0 (invalid) and ids with no sale (the ledger's foreign key
    refuses them). One ledger row per accepted request, reason trimmed.
    """
    requests = requests.withColumn("sales_id", _long("sales_id", requests))
    ok_id = F.col("sales_id").isNotNull() & (F.col("sales_id") > 0)
    cand = requests.filter(ok_id)
    # The ledger is streamed once against the distinct request ids; the requests then meet the hits.
    hits = keys_present(sales, cand, "sales_id").withColumn("_known", F.lit(True))
    checked = cand.join(hits, "sales_id", "left")
    known = checked.filter(F.col("_known"))
    voided_at = (F.coalesce(F.col("requested_at"), _ts(run_ts)) if "requested_at" in requests.columns
                 else _ts(run_ts))
    ledger_new = known.select(F.col("request_id").alias("void_id"), F.col("sales_id").alias("sale_id"),
                              trim_col(F.coalesce(F.col("reason"), F.lit(""))).alias("reason"),
                              voided_at.alias("voided_at"))
    ledger = ledger_new if sales_void is None else sales_void.select(*SALES_VOID.schema.names).unionByName(ledger_new)
    rejects = (requests.filter(~ok_id).select("request_id", F.lit(MSG_INVALID_SALE).alias("reason"))
               .unionByName(checked.filter(F.col("_known").isNull())
                            .select("request_id", F.lit(MSG_UNKNOWN_SALE).alias("reason"))))
    return {"sales_void": ledger, "rejects": rejects}


def apply_voids(sales: DataFrame, requests: DataFrame) -> DataFrame:
    """Set status VOID (whatever it was) on the sales that ``requests`` name: one scan of the ledger, as ids
    without a sale meet nothing."""
    sale = _long("sales_id", requests)
    ids = requests.select(sale.alias("sales_id")).where("sales_id > 0").distinct().withColumn("_hit", F.lit(True))
    joined = sales.join(broadcast_if_small(ids), "sales_id", "left")
    status = F.when(F.col("_hit"), F.lit(STATUS_VOID)).otherwise(F.col("status"))
    return joined.select(*[status.alias("status") if c == "status" else F.col(c) for c in sales.columns])


def void_sales(sales: DataFrame, requests: DataFrame, sales_void: DataFrame | None = None,
               run_ts: dt.datetime | None = None) -> dict[str, DataFrame]:
    """Void sales of any status; one ledger row per accepted request (see ``resolve_voids``)."""
    out = resolve_voids(sales, requests, sales_void, run_ts)
    return {"sales": apply_voids(sales, requests), **out}


# =========================================================================== M4/M5/M8 generic
def apply_changes(current: DataFrame, changes: DataFrame, key: str, fields: list[str],
                  keep_if_empty: tuple[str, ...] = (), add_defaults: dict | None = None,
                  seq: str = "seq", op: str = "op") -> DataFrame:
    """Apply add / edit / delete requests in ``seq`` order; return the new table.

    Semantics, per key, as if the requests ran one after another:
    ``add`` writes the row with the request's values (an add on a live key
    replaces it); ``edit`` replaces ``fields`` of a live row (no row: no-op),
    except that an empty value of a ``keep_if_empty`` column keeps the old
    one; ``delete`` removes the row.

    Computed with one partial aggregate per key: the last add/delete event,
    the last edit, and the last non-empty value of each keep-if-empty column,
    each as ``max(struct(seq, ...))``. An edit counts only if it comes after
    the last add/delete event. The summary meets the table through a left join
    plus an anti join of new keys (a full outer join in effect); with a small
    batch the summary is broadcast and the table is never shuffled.
    """
    add_defaults = add_defaults or {}
    s, o = F.col(seq), F.col(op)
    is_ad = o.isin("add", "delete")
    aggs = [
        F.max(F.when(is_ad, F.struct(s.alias("s"), (o == "delete").alias("del"),
                                     *[F.col(f).alias(f) for f in fields]))).alias("_ad"),
        F.max(F.when(o == "edit", F.struct(s.alias("s"), *[F.col(f).alias(f) for f in fields]))).alias("_ed"),
    ]
    for f in keep_if_empty:
        aggs.append(F.max(F.when((o == "edit") & ~_php_empty(F.col(f)),
                                 F.struct(s.alias("s"), F.col(f).alias("v")))).alias(f"_k_{f}"))
    per_key = changes.groupBy(key).agg(*aggs)
    change_cols = [c for c in per_key.columns if c != key]

    # Equivalent of current FULL JOIN per_key, written so a small batch never
    # shuffles the table: every current row LEFT JOIN the (size-checked,
    # broadcast when small) per-key summary, plus the summary rows whose key is
    # not in the table yet (found by streaming the table against the keys).
    cur = current.select(key, *fields).withColumn("_exists", F.lit(True))
    on_table = cur.join(broadcast_if_small(per_key), key, "left")
    fresh = per_key.join(keys_present(cur, per_key, key), key, "left_anti").select(
        key, *[F.lit(None).cast(cur.schema[f].dataType).alias(f) for f in fields],
        F.lit(None).cast("boolean").alias("_exists"), *change_cols)
    j = on_table.select(key, *fields, "_exists", *change_cols).unionByName(fresh)

    ad_s = F.col("_ad.s")
    added = F.col("_ad").isNotNull() & ~F.col("_ad.del")
    deleted = F.col("_ad").isNotNull() & F.col("_ad.del")
    alive = ~F.coalesce(deleted, F.lit(False)) & (added | F.coalesce(F.col("_exists"), F.lit(False)))
    base_s = F.when(added, ad_s)  # NULL: the pre-existing row is the base
    edit_applies = F.col("_ed").isNotNull() & (base_s.isNull() | (F.col("_ed.s") > base_s))

    out = []
    for f in fields:
        base_v = F.when(added, F.coalesce(F.col(f"_ad.{f}"), F.lit(add_defaults[f])) if f in add_defaults
                        else F.col(f"_ad.{f}")).otherwise(F.col(f))
        if f in keep_if_empty:
            kv = F.col(f"_k_{f}")
            k_applies = kv.isNotNull() & (base_s.isNull() | (F.col(f"_k_{f}.s") > base_s))
            v = F.when(k_applies, F.col(f"_k_{f}.v")).otherwise(base_v)
        else:
            v = F.when(edit_applies, F.col(f"_ed.{f}")).otherwise(base_v)
        out.append(v.alias(f))
    return j.filter(alive).select(F.col(key), *out)


def _validated(changes: DataFrame, checks: list[tuple[Column, str]], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    reason = None
    for cond, msg in checks:
        reason = F.when(cond, F.lit(msg)) if reason is None else reason.when(cond, F.lit(msg))
    tagged = changes.withColumn("_reason", reason if reason is not None else F.lit(None).cast("string"))
    ok = tagged.filter(F.col("_reason").isNull()).drop("_reason")
    rej = tagged.filter(F.col("_reason").isNotNull()).select(F.col(seq).alias("request_id"),
                                                             F.col("_reason").alias("reason"))
    return ok, rej


# =========================================================================== M4
def _money(c: str, df: DataFrame) -> Column:
    """0 for a missing value or text without a number; NULL where decimal(10,2) cannot hold it."""
    if isinstance(df.schema[c].dataType, T.StringType):
        return php_floatval_money(c)
    return F.coalesce(F.col(c), F.lit(0)).try_cast(MONEY)


def _long(c: str, df: DataFrame) -> Column:
    """0 for text without a number; NULL for a missing value, or where a long cannot hold it."""
    if isinstance(df.schema[c].dataType, T.StringType):
        return F.when(F.col(c).isNotNull(), php_intval(c))
    return F.col(c).try_cast("long")


def _int(c: str, df: DataFrame) -> Column:
    """0 for a missing value or text without a number; NULL where an int cannot hold it."""
    return F.when(F.col(c).isNull(), F.lit(0)).otherwise(_long(c, df).try_cast("int"))


def clean_file_name(c: Column | str) -> Column:
    """Fixed rule: characters of an upload's name other than letters, digits, dot, dash and underscore become _."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^a-zA-Z0-9.\-_]", "_")


def upsert_products(products: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Products form batch: names trimmed, price read as a number, empty image keeps the old one.

    A request whose price the column cannot hold is rejected alone.
    """
    norm = changes.select("seq", "op", F.col("product_id").cast("long").alias("product_id"),
                          trim_col("product_name").alias("product_name"), "category",
                          _money("price", changes).alias("price"), "status", clean_file_name("image").alias("image"))
    ok, rejects = _validated(norm, [((F.col("op") != "delete") & F.col("price").isNull(), MSG_PRICE_RANGE)])
    fields = ["product_name", "category", "price", "status", "image"]
    new = apply_changes(products, ok, "product_id", fields, keep_if_empty=("image",), add_defaults={"image": ""})
    return {"products": new.select(*PRODUCTS.schema.names), "rejects": rejects}


def deleted_keys(changes: DataFrame, key: str) -> DataFrame:
    """Keys with a delete request in the batch (each referenced row existed at that time)."""
    return changes.filter(F.col("op") == "delete").select(F.col(key)).distinct()


def delete_products_cascade(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """ON DELETE SET NULL: sales of deleted products keep their row, name and image; product_id becomes NULL."""
    gone = deleted_keys(changes, "product_id").withColumn("_gone", F.lit(True))
    j = sales.join(broadcast_if_small(gone), "product_id", "left")
    pid = F.when(F.col("_gone"), F.lit(None).cast("long")).otherwise(F.col("product_id"))
    return j.select(*[pid.alias("product_id") if c == "product_id" else F.col(c) for c in sales.columns])


# =========================================================================== M5
def ingredient_requests(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inventory requests with their numbers read as the form reads them: (accepted, rejects). Also for streams."""
    norm = changes.select("seq", "op", F.col("ingredient_id").cast("long").alias("ingredient_id"),
                          trim_col("ingredient_name").alias("ingredient_name"),
                          _int("stock", changes).alias("stock"),
                          _int("low_stock_threshold", changes).alias("low_stock_threshold"),
                          "unit", clean_file_name("image").alias("image"))
    wide = (F.col("op") != "delete") & (F.col("stock").isNull() | F.col("low_stock_threshold").isNull())
    neg = (F.col("op") != "delete") & ((F.col("stock") < 0) | (F.col("low_stock_threshold") < 0))
    return _validated(norm, [(wide, MSG_STOCK_RANGE), (neg, MSG_NEGATIVE_STOCK)])


def upsert_ingredients(ingredients: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Inventory form batch: add/edit with stock or threshold < 0 are rejected whole."""
    ok, rejects = ingredient_requests(changes)
    fields = ["ingredient_name", "stock", "low_stock_threshold", "unit", "image"]
    new = apply_changes(ingredients, ok, "ingredient_id", fields, keep_if_empty=("image",),
                        add_defaults={"image": ""})
    return {"ingredients": new.select(*INGREDIENTS.schema.names), "rejects": rejects}


# =========================================================================== M8
def upsert_users(users: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Staff adds, edits (full name, role, status; avatar kept unless a new one is given) and deletes by id.

    An edit never renames. An added username must be new: names of users before the batch, and of the
    first add of that name within it, are taken (``winning_names``).
    """
    fields = ["username", "fullname", "role", "status", "avatar"]
    uname = F.col("username") if "username" in changes.columns else F.lit(None).cast("string")
    norm = changes.select("seq", "op", "user_id", uname.alias("username"), "fullname", "role", "status", "avatar")
    adds = norm.filter(F.col("op") == "add")
    ok_adds, taken = winning_names(adds, users)
    rest = norm.filter(F.col("op") != "add").withColumn("username", F.lit(None).cast("string"))
    new = apply_changes(users, ok_adds.unionByName(rest), "user_id", fields, keep_if_empty=("avatar", "username"),
                        add_defaults={"avatar": ""})
    rejects = taken.select(F.col("seq").alias("request_id"), F.lit(MSG_USERNAME_TAKEN).alias("reason"))
    return {"users": new.select(*USERS.schema.names), "rejects": rejects}


# =========================================================================== M6
def audit_entries(changes: DataFrame, kind: str = "user") -> DataFrame:
    """Audit rows (seq, action, details) for admin requests."""
    if kind != "user":
        raise ValueError("only staff changes are logged by the admin page")
    o = F.col("op")
    uid = F.col("user_id").cast("string")
    # Actions and detail texts of the admin page's audit trail.
    action = (F.when(o == "edit", "Edit User").when(o == "delete", "Delete User")
              .when(o == "add", "Add User").when(o == "settings", "Update Settings")
              .when(o == "reset", "Reset Logs"))
    details = (F.when(o == "edit", F.concat(F.lit("Edited user ID: "), uid))
               .when(o == "delete", F.concat(F.lit("Deleted user ID: "), uid))
               .when(o == "add", F.concat(F.lit("Added user: "), F.coalesce(F.col("username"), F.lit(""))
                                          if "username" in changes.columns else F.lit("")))
               .when(o == "settings", F.lit("System settings updated"))
               .when(o == "reset", F.lit("All audit logs cleared")))
    return changes.select("seq", action.alias("action"), details.alias("details"))


def _next_ids(df: DataFrame, existing: DataFrame, id_col: str, order: list[Column], name: str) -> DataFrame:
    """Auto-increment: max existing id (one scalar) + 1-based position of each row in ``order``."""
    top = existing.agg(F.max(id_col).alias("m")).first()["m"] or 0
    ranked = global_row_number(df, order, name="_pos")
    return ranked.withColumn(name, F.lit(int(top)) + F.col("_pos")).drop("_pos")


def audit_append(audit_logs: DataFrame, entries: DataFrame, actor: str,
                 at: dt.datetime | None = None) -> DataFrame:
    """Append audit rows in request order with new consecutive log ids."""
    new = _next_ids(entries, audit_logs, "log_id", [F.col("seq").asc()], "log_id").select(
        "log_id", F.lit(actor).alias("user_name"), "action", "details", _ts(at).alias("created_at"))
    return audit_logs.unionByName(new)


# =========================================================================== M7
def account_checks(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registration rules without id assignment: (accepted requests, rejects).

    Checks, first failing wins: all fields present (after trim); full name at
    least 3 characters; username 3-20 letters or digits; username not already
    taken, compared without case as the table's collation does. Within the
    batch the earliest request for a username wins; later ones find it taken.
    """
    fn, un = trim_col("fullname"), trim_col("username")
    req = requests.select("seq", fn.alias("fullname"), un.alias("username"))
    f, u = F.col("fullname"), F.col("username")
    ok, rejects = _validated(req, [
        (f.isNull() | (f == "") | u.isNull() | (u == ""), MSG_FIELDS_REQUIRED),
        (F.length(f) < MIN_FULLNAME, MSG_FULLNAME_SHORT),
        (~u.rlike(USERNAME_PATTERN), MSG_USERNAME_INVALID),
    ])
    winners, taken = winning_names(ok, users)
    losers = taken.select(F.col("seq").alias("request_id"), F.lit(MSG_USERNAME_TAKEN).alias("reason"))
    return winners, rejects.unionByName(losers)


def winning_names(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that get their username, requests that find it taken), compared as the table's collation does.

    A name that a user has is taken. Of the requests for a free name the smallest row wins: by ``seq``, then
    by the other columns, so equal ``seq`` values leave one winner; of equal rows one wins. Per name one
    partial aggregate; no name's requests are gathered.
    """
    cols = ["seq", *[c for c in requests.columns if c != "seq"]]
    name = F.collate(F.col("username"), NAME_COLLATION)
    counted = requests.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_u", name)
    first = counted.groupBy("_u").agg(F.min(F.struct(*cols)).alias("_w"))
    has = keys_present(users.select(name.alias("_u")), first, "_u").withColumn("_has", F.lit(True))
    judged = counted.join(first.join(has, "_u", "left"), "_u")
    wins = F.col("_has").isNull() & reduce(and_, [F.col(c).eqNullSafe(F.col(f"_w.{c}")) for c in cols])
    judged = judged.withColumn("_wins", wins)
    winners = judged.filter("_wins").select(*cols)
    lost = judged.withColumn("_left", F.col("_n") - F.when(F.col("_wins"), 1).otherwise(0)).filter("_left > 0")
    losers = lost.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_left").cast("int")))).select(*cols)
    return winners.select(*requests.columns), losers.select(*requests.columns)


def account_intake(requests: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """Registration batch (no passwords): new user rows with consecutive ids, and rejects."""
    winners, rejects = account_checks(requests, users)
    accepted = _next_ids(winners, users, "user_id", [F.col("seq").asc()], "user_id").select(
        "user_id", "username", F.lit("user").alias("role"), "fullname",
        F.lit("active").alias("status"), F.lit("").alias("avatar"))
    return {"users": accepted, "rejects": rejects}


# =========================================================================== M9
def reset_tables(tables: dict[str, DataFrame], actor: str, at: dt.datetime | None = None) -> dict[str, DataFrame]:
    """Empty the sales history (children first) and restart the audit trail with one row."""
    out = {}
    for name in ("sale_addons", "sales_void", "sales"):
        out[name] = tables[name].limit(0)
    audit = tables["audit_logs"]
    top = audit.agg(F.max("log_id").alias("m")).first()["m"] or 0
    spark = audit.sparkSession
    row = spark.range(1).select(F.lit(int(top) + 1).cast("long").alias("log_id"), F.lit(actor).alias("user_name"),
                                F.lit("Reset Logs").alias("action"), F.lit("All audit logs cleared").alias("details"),
                                _ts(at).alias("created_at"))
    out["audit_logs"] = row
    return out

