"""Schema conformance (S2) and the integrity rules the DDL enforces (S3).

The conformance check is an aggregate over a scan per table; the constraint audit reads every
table once and shuffles at most one row per key.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import FOREIGN_KEYS, TABLES, TableSpec


def _default(spec: TableSpec, name: str, dtype, now: dt.datetime | None) -> Column:
    text = spec.defaults.get(name)
    if text is None:
        return F.lit(None).cast(dtype)
    if text == "current_timestamp":
        ts = F.lit(now.isoformat(sep=" ")) if now else F.localtimestamp().cast("string")
        return ts.cast(dtype)
    if text.startswith("'"):
        return F.lit(text.strip("'")).cast(dtype)
    return F.lit(Decimal(text)).cast(dtype)


def tag_violations(df: DataFrame, spec: TableSpec, now: dt.datetime | None = None) -> DataFrame:
    """Declared columns of ``spec`` plus ``_reason`` (NULL when the row conforms).

    Missing columns take the column default (or NULL); present ones are cast
    with ``try_cast`` so a bad value becomes a counted type failure instead of
    an error. ``_reason`` names the first broken rule: TYPE, NOT NULL or ENUM
    and the column.
    """
    cols, cast_cols = [], []
    for f in spec.schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
            # A cast to the same type cannot fail: no rule, and the column is only
            # read if a rule or the caller needs it.
            if df.schema[f.name].dataType != f.dataType:
                cast_cols.append(f.name)
        else:
            cols.append(_default(spec, f.name, f.dataType, now).alias(f.name))
    shaped = df.select(*cols, *[F.col(c).alias(f"_src_{c}") for c in cast_cols])
    rules = [(F.col(f"_src_{c}").isNotNull() & F.col(c).isNull(), f"TYPE {c}") for c in cast_cols]
    rules += [(F.col(c).isNull(), f"NOT NULL {c}") for c in spec.not_null]
    rules += [(F.col(c).isNotNull() & ~F.col(c).isin(*vals), f"ENUM {c}") for c, vals in spec.enums.items()]
    reason = None
    for cond, msg in rules:
        reason = F.when(cond, F.lit(msg)) if reason is None else reason.when(cond, F.lit(msg))
    keep = [f.name for f in spec.schema.fields]
    return shaped.select(*keep, (reason if reason is not None else F.lit(None).cast("string")).alias("_reason"))


def conform(df: DataFrame, spec: TableSpec, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Shape ``df`` to the declared table; split off rows that break it (see ``tag_violations``)."""
    tagged = tag_violations(df, spec, now)
    keep = [f.name for f in spec.schema.fields]
    ok = tagged.filter(F.col("_reason").isNull()).select(*keep)
    bad = tagged.filter(F.col("_reason").isNotNull()).select(*keep, "_reason")
    return ok, bad


def schema_check(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows read, rows that conform, and rejects by kind."""
    parts = []
    for name, df in tables.items():
        spec = TABLES[name]
        r = F.col("_reason")
        counts = (tag_violations(df, spec)
                  .agg(F.count(F.lit(1)).alias("rows_read"),
                       F.count(F.when(r.isNull(), 1)).alias("rows_ok"),
                       F.count(F.when(r.startswith("NOT NULL"), 1)).alias("not_null_violations"),
                       F.count(F.when(r.startswith("ENUM"), 1)).alias("enum_violations"),
                       F.count(F.when(r.startswith("TYPE"), 1)).alias("type_failures")))
        parts.append(counts.select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


def _tagged_keys(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """The key rows of one table from one scan: (domain, role, key, name_key).

    A domain is a key column of a table; its own rows have the role ``pk``, rows that refer to it the name of their foreign
    key. A unique text goes by ``name_key`` under the tables' collation. Enum violations are rows without a key.
    """
    spec = TABLES[name]
    text = [F.col(k).cast("string") for k in spec.key]
    whole = text[0] if len(text) == 1 else F.when(reduce(lambda a, b: a & b, [t.isNotNull() for t in text]),
                                                  F.to_json(F.array(*text)))
    none = F.lit(None).cast("string")

    def row(domain, role, key, name_key=none, wanted=F.lit(True)):
        return F.when(wanted, F.struct(F.lit(domain).alias("domain"), F.lit(role).alias("role"), key.alias("key"),
                                       F.collate(name_key, "UNICODE_CI_AI").alias("name_key")))

    rows = [row(f"{name}.{','.join(spec.key)}", "pk", whole)]
    for cols in spec.unique:
        rows += [row(f"{name}.{','.join(cols)}", "uq", none, F.col(cols[0]) if len(cols) == 1 else F.to_json(F.array(*cols)))]
    for col, vals in spec.enums.items():
        rows.append(row(f"{name}.{col}", "enum", none, wanted=F.col(col).isNotNull() & ~F.col(col).isin(*vals)))
    for child, col, parent, pcol, _ in FOREIGN_KEYS:
        if child == name and parent in tables:
            rows.append(row(f"{parent}.{pcol}", f"fk_{child}_{col}", F.col(col).cast("string"), wanted=F.col(col).isNotNull()))
    return tables[name].select(F.explode(F.array(*rows)).alias("r")).filter("r is not null").select("r.*")


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per declared constraint: (constraint_name, table_name, columns, violations).

    Every table is read once; one grouped aggregate over the tagged keys of all tables counts repeated and missing keys and
    both sides of each foreign key (partial aggregates first, so a hot key is one row of each task).
    """
    present = [n for n in TABLES if n in tables]
    keys = reduce(DataFrame.unionByName, [_tagged_keys(tables, n) for n in present])
    links = [(c, col, p, pcol) for c, col, p, pcol, _ in FOREIGN_KEYS if c in tables and p in tables]
    roles = ["pk", "uq", "enum", *[f"fk_{c}_{col}" for c, col, _, _ in links]]
    groups = keys.groupBy("domain", "key", "name_key").agg(
        *[F.count(F.when(F.col("role") == r, 1)).alias(r) for r in roles])

    def violations(domain: str, role: str, cond: Column) -> Column:
        found = F.sum(F.when((F.col("domain") == domain) & cond, F.col(role)))
        return F.coalesce(found, F.lit(0)).cast("long")

    out = []
    for name in present:
        spec = TABLES[name]
        cols = ",".join(spec.key)
        out.append((f"pk_{name}", name, cols,
                    violations(f"{name}.{cols}", "pk", F.col("key").isNull() | (F.col("pk") > 1))))
        for u in spec.unique:
            out.append((f"uq_{name}_{'_'.join(u)}", name, ",".join(u),
                        violations(f"{name}.{','.join(u)}", "uq", F.col("name_key").isNull() | (F.col("uq") > 1))))
        out += [(f"enum_{name}_{col}", name, col, violations(f"{name}.{col}", "enum", F.lit(True))) for col in spec.enums]
    out += [(f"fk_{c}_{col}", c, col, violations(f"{p}.{pcol}", f"fk_{c}_{col}", F.col("pk") == 0)) for c, col, p, pcol in links]
    counts = groups.agg(*[v.alias(f"v{i}") for i, (_, _, _, v) in enumerate(out)])
    lines = [F.struct(F.lit(n).alias("constraint_name"), F.lit(t).alias("table_name"), F.lit(c).alias("columns"),
                      F.col(f"v{i}").alias("violations")) for i, (n, t, c, _) in enumerate(out)]
    return counts.select(F.inline(F.array(*lines)))
