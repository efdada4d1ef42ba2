"""Named queries over the driver's tables and their SQL oracles.

``@query`` registers a function under its name. Integers leave as 64-bit, reals rounded to six places
without negative zeros, on both sides.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.plans.fixtures import CTE

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
MODULES = ("depth_plans", "splat_plans", "match_plans", "cloud_plans", "model_plans", "io_plans", "sfm_plans", "solver_plans", "stream_plans")


def with_fixtures(sql: str) -> str:
    """Puts in front the common table expressions that the text names, and those that they name."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN|,)\s+([a-z_0-9]+)\b", text):
            if name in CTE and name not in need:
                visit(CTE[name])
                need.append(name)

    visit(sql)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in need) + " " if need else "") + sql


def query(sql: str | None, ints: str = "", reals: str = "", other: str = "") -> Callable:
    def register(f: Callable) -> Callable:
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) for c in ints.split()], *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in reals.split()], *other.split())

        QUERIES[name] = run
        if sql:
            cols = [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()] + [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in reals.split()] + other.split()
            # The body is its own table expression, so the fixtures that it names are found.
            body = with_fixtures(sql)
            ORACLES[name] = f"SELECT {', '.join(cols)} FROM ({body}) AS q_"
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"voxelloom.plans.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["unproject_api"](spark, sf_dir)
