"""Registry of runnable queries: a Spark builder and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import output
from ..sources.panels import Panels
from .ctes import oracle


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[Panels], DataFrame]
    body: str | None
    digits: dict[str, int]

    def run(self, spark: SparkSession, root: str) -> DataFrame:
        return output(self.build(Panels(spark, root)), self.digits)

    def sql(self) -> str | None:
        return None if self.body is None else oracle(self.body, self.digits)


PLANS: dict[str, Plan] = {}


def _digits(spec: str) -> dict[str, int]:
    """``"a b:4"`` -> {a: 6, b: 4}."""
    out = {}
    for part in spec.split():
        name, _, d = part.partition(":")
        out[name] = int(d or 6)
    return out


def plan(name: str, sql: str | None = None, r: str = ""):
    def wrap(fn):
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = Plan(name, fn, sql, _digits(r))
        return fn

    return wrap
