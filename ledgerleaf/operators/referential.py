"""What a delete or a key change does to the tables that refer to it (the actions that the DDL declares).

A foreign key either refuses the change of a row that others refer to, or hands it on (the children are deleted, or
get the new key), or clears the children's reference. The walk goes over the foreign-key graph, children first:
a request is refused if any table below it refuses, and then nothing of it is applied.

Request lists are distinct keys; the big tables are streamed against their (size-checked) broadcast and never shuffled
for a small batch. The lists that several tables meet are checkpointed: finding them takes a pass over the big tables, which
would else be made again for each size check and each table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small, keys_present
from ..session import ensure_checkpoint_dir
from ..sources.schemas import FOREIGN_KEYS, TABLES, UPDATE_ACTIONS

MSG_REFERENCED = "Row is referred to."
MSG_UNKNOWN_KEY = "Unknown key."
MSG_KEY_TAKEN = "Key already exists."


def _kept(keys: DataFrame) -> DataFrame:
    """``keys``, computed once."""
    ensure_checkpoint_dir(keys.sparkSession)
    return keys.checkpoint(eager=True)


def children_of(table: str, tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(child table, its column, action on delete) of the foreign keys to ``table``'s key."""
    return [(child, col, action) for child, col, parent, _, action in FOREIGN_KEYS if parent == table and child in tables]


def _without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is none of ``keys``; rows without a value stay."""
    gone = broadcast_if_small(keys.select(F.col("k").alias(column)))
    return df.join(gone, column, "left_anti").select(*df.columns)


def _child_keys(tables: dict[str, DataFrame], child: str, col: str, keys: DataFrame) -> DataFrame:
    """(k, parent): the child rows' own keys that refer to ``keys``, with the key at the top that they hang from."""
    own = TABLES[child].key[0]
    wanted = broadcast_if_small(keys.select(F.col("k").alias("_ref"), "top"))
    rows = tables[child].select(F.col(own).alias("k"), F.col(col).alias("_ref")).join(wanted, "_ref")
    return rows.select("k", "top").distinct()


def refused(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> DataFrame | None:
    """Top keys (column ``top``) of ``keys`` (k, top) that some table below refuses to let go; None if none can."""
    found = None
    for child, col, action in children_of(table, tables):
        if action == "restrict":
            held = keys_present(tables[child].select(F.col(col).alias("k")), keys, "k")
            stop = keys.join(held, "k", "left_semi").select("top")
        elif action == "cascade" and children_of(child, tables):
            stop = refused(tables, child, _kept(_child_keys(tables, child, col, keys)))
        else:
            continue
        if stop is not None:
            found = stop if found is None else found.unionByName(stop)
    return None if found is None else found.distinct()


def _apply_delete(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    out = dict(tables)
    for child, col, action in children_of(table, tables):
        if action == "cascade":
            if children_of(child, tables):
                below = _child_keys(tables, child, col, keys.withColumn("top", F.col("k")))
                out |= _apply_delete(out, child, _kept(below.select("k").distinct()))
            else:
                out[child] = _without(out[child], col, keys)
        elif action == "set null":
            hit = broadcast_if_small(keys.select(F.col("k").alias(col), F.lit(True).alias("_hit")))
            joined = out[child].join(hit, col, "left")
            cleared = F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(col)).alias(col)
            out[child] = joined.select(*[cleared if c == col else F.col(c) for c in out[child].columns])
    out[table] = _without(out[table], TABLES[table].key[0], keys)
    return out


def delete_rows(tables: dict[str, DataFrame], table: str, requests: DataFrame, key: str) -> dict:
    """Delete the rows of ``table`` that ``requests`` (request_id and ``key``) name.

    Returns the new ``tables`` and ``rejects`` (request_id, reason): requests for keys that are not there, and those
    that a row without a handed-on reference still refers to.
    """
    own = TABLES[table].key[0]
    asked = requests.select("request_id", F.col(key).alias("k"))
    here = _kept(keys_present(tables[table].select(F.col(own).alias("k")), asked, "k")).select("k", F.col("k").alias("top"))
    stop = refused(tables, table, here)
    judged = asked.join(here.select("k", F.lit(True).alias("_here")), "k", "left")
    if stop is None:
        judged, gone = judged.withColumn("_held", F.lit(None).cast("boolean")), here.select("k")
    else:
        held = _kept(stop).select(F.col("top").alias("k"), F.lit(True).alias("_held"))
        judged, gone = judged.join(held, "k", "left"), _kept(here.join(held, "k", "left_anti").select("k"))
    reason = F.when(F.col("_here").isNull(), MSG_UNKNOWN_KEY).when(F.col("_held"), MSG_REFERENCED)
    rejects = judged.withColumn("reason", reason).filter("reason is not null").select("request_id", "reason")
    return {"tables": _apply_delete(tables, table, gone), "rejects": rejects}


def _renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``column`` with the new keys of ``names`` (k, new)."""
    joined = df.join(broadcast_if_small(names.select(F.col("k").alias(column), F.col("new").alias("_new"))), column, "left")
    value = F.coalesce("_new", column).alias(column)
    return joined.select(*[value if c == column else F.col(c) for c in df.columns])


def change_keys(tables: dict[str, DataFrame], table: str, requests: DataFrame, key: str, new_key: str) -> dict:
    """Give rows of ``table`` new keys; rows that refer to them follow, or refuse, as declared.

    Returns the new ``tables`` and ``rejects`` (request_id, reason). A key must be there, its new one must be neither in
    the table nor wanted by a smaller request, and of several requests for one key the smallest counts (the others find
    it gone). A change to the same key changes nothing.
    """
    own = TABLES[table].key[0]
    asked = requests.select("request_id", F.col(key).alias("k"), F.col(new_key).alias("new"))
    there = tables[table].select(F.col(own).alias("k"))
    first = asked.groupBy("k").agg(F.min("request_id").alias("_first_k"))
    here = keys_present(there, asked, "k").withColumn("_here", F.lit(True))
    taken = keys_present(there, asked.select(F.col("new").alias("k")), "k").select(F.col("k").alias("new"), F.lit(True).alias("_taken"))
    judged = asked.join(first, "k", "left").join(here, "k", "left").join(taken, "new", "left")
    held = None
    for child, col, _ in children_of(table, tables):
        if UPDATE_ACTIONS.get((child, col)) != "cascade":
            stop = keys_present(tables[child].select(F.col(col).alias("k")), asked, "k")
            held = stop if held is None else held.unionByName(stop)
    judged = (judged.withColumn("_held", F.lit(None).cast("boolean")) if held is None
              else judged.join(held.distinct().withColumn("_held", F.lit(True)), "k", "left"))
    reason = (F.when(F.col("_here").isNull() | (F.col("request_id") > F.col("_first_k")), MSG_UNKNOWN_KEY)
              .when(F.col("new") == F.col("k"), None).when(F.col("_taken") | F.col("new").isNull(), MSG_KEY_TAKEN)
              .when(F.col("_held"), MSG_REFERENCED))
    judged = judged.withColumn("reason", reason)
    # Of the requests for one new key the smallest wins.
    free = judged.filter("reason is null").groupBy("new").agg(F.min("request_id").alias("_first_new"))
    judged = judged.join(free, "new", "left").withColumn(
        "reason", F.when(F.col("reason").isNull() & (F.col("request_id") > F.col("_first_new")), MSG_KEY_TAKEN)
        .otherwise(F.col("reason")))
    names = _kept(judged.filter("reason is null").select("k", "new").distinct())
    out = dict(tables)
    for child, col, _ in children_of(table, tables):
        if UPDATE_ACTIONS.get((child, col)) == "cascade":
            out[child] = _renamed(tables[child], col, names)
    out[table] = _renamed(tables[table], own, names)
    return {"tables": out, "rejects": judged.filter("reason is not null").select("request_id", "reason")}
