"""Catalogue of runnable queries, each with the SQL that states its result independently."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.plans.inputs import ORACLE_VIEWS, Inputs


@dataclass(frozen=True)
class Query:
    build: Callable[[Inputs], DataFrame]
    oracle: str | None


CATALOG: dict[str, Query] = {}


def _nudge(digits: int) -> float:
    return float(f"1e-{digits + 3}")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round double columns so that results compare across engines.

    Engines add floats in different orders. Means of money often end in an exact 5
    just past the last digit, where that noise would decide the rounding, so a
    nudge far below the last digit and far above the noise goes on first.
    """
    return df.withColumns({n: F.round(F.col(n) + _nudge(digits), digits) for n in names})


def r(expression: str, digits: int = 6, name: str | None = None) -> str:
    """SQL text of the same rounding, named after the column unless told otherwise."""
    return f"ROUND({expression} + {_nudge(digits)}, {digits}) AS {name or expression}"


def query(name: str, oracle: str | None = None, ctes: str = ""):
    """Register a query; ``oracle`` is a SELECT over the views and any further CTEs."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query registered twice: {name}")
        text = None
        if oracle is not None:
            extra = f",\n{ctes.strip()}" if ctes.strip() else ""
            text = f"WITH RECURSIVE {ORACLE_VIEWS}{extra}\n{oracle.strip()}"
        CATALOG[name] = Query(build, text)
        return build

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG[name].build(Inputs(spark, sf_dir))
