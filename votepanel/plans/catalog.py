"""Registry of the queries the package answers: key -> (Spark builder, oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver tables over their full extent, and returns a
lazy DataFrame. Report rule: doubles are rounded with :func:`votepanel.session.r6` in the builder and
``floor(x*1e6+0.5)/1e6`` in the SQL, and every computed column carries the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(key: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        text = sql() if callable(sql) else sql
        REGISTRY[key] = (fn, text)
        return fn

    return deco


def load_all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    # importing the modules fills REGISTRY
    from votepanel.plans import queries_core  # noqa: F401
    from votepanel.plans import queries_more  # noqa: F401
    from votepanel.plans import queries_functions  # noqa: F401
    from votepanel.plans import queries_ml  # noqa: F401
    from votepanel.plans import queries_extra  # noqa: F401
    from votepanel.plans import queries_ridge  # noqa: F401

    return REGISTRY
