"""Named queries: a plan over adapted tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollbook.plans.adapters import Tables, oracle

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register a plan under ``name``; ``sql`` is its oracle over ``<table>`` names."""
    def keep(fn: Callable[[Tables], DataFrame]):
        PLANS[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, folder, fn=fn: fn(Tables(spark, folder))) for n, fn in PLANS.items()}


# SQL fragments shared by the oracles
OPEN = "status = 'active' AND (legal_end IS NULL OR legal_end > publication_date)"


def squash(c: str) -> str:
    return f"upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"


def norm(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[''’‘]', '', 'g'), "
            "'[^\\p{L}\\p{N}]+', ' ', 'g'))")


def outward(c: str) -> str:
    return f"regexp_extract(coalesce({c}, ''), '\\S+')"


def district(c: str) -> str:
    return f"regexp_replace({outward(c)}, '([0-9])[A-Za-z]$', '\\1')"
