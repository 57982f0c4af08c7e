"""Registry of named queries: the library's operators bound to fixed parameters.

Each entry takes a tables object (fixture views over a scale-factor directory,
or a parquet store read back with declared schemas) and returns a DataFrame.
Its ``sql`` is the independent DuckDB statement that must give the same rows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame

from .oracle import with_views

# Fixed parameters of the registered queries.
AS_OF = dt.date(1998, 6, 17)
RUN_TS = dt.datetime(1998, 6, 17, 12, 0, 0)
ACTOR = "admin"


@dataclass(frozen=True)
class QuerySpec:
    name: str
    survey_id: str
    build: Callable[[object], DataFrame]
    sql: str | None


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, survey_id: str, sql: str | None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, survey_id, fn, None if sql is None else with_views(sql))
        return fn
    return deco


# The query modules register themselves on import.
from . import queries_core, queries_changes, queries_ops  # noqa: E402,F401
