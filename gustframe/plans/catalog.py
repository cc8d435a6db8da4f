"""Registry of the operator queries: one Spark callable and, where SQL can
express it, one DuckDB oracle text per operator id of the blueprint.

``@query(name, views=..., sql=..., dbl=...)`` registers a function
``(spark, sf_dir) -> DataFrame``.  ``dbl`` lists the floating columns of the
result; they are rounded the same way on both sides (default 6 digits) so the
value hashes do not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.sources.driver_views import SQL_DEPENDS, SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOTES: dict[str, str] = {}


def view_ctes(views) -> list[tuple[str, str]]:
    order: list[str] = []
    for v in views:
        for dep in SQL_DEPENDS.get(v, []) + [v]:
            if dep not in order:
                order.append(dep)
    return [(v, SQL_VIEWS[v]) for v in order]


def _rmap(dbl, digits: int) -> dict[str, int]:
    if not dbl:
        return {}
    if isinstance(dbl, dict):
        return dict(dbl)
    return {c: digits for c in dbl}


def query(name: str, views=(), sql: str | None = None, dbl=None, digits: int = 6, ctes=(), note: str | None = None,
          bigint=()):
    """``bigint`` lists oracle columns to cast to BIGINT (DuckDB's
    ``count_if`` returns HUGEINT; Spark's returns BIGINT)."""
    rmap = _rmap(dbl, digits)

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if rmap:
                df = df.withColumns({c: F.round(F.col(c).cast("double"), d) for c, d in rmap.items()})
            return df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query id {name}")
        QUERIES[name] = run
        if note:
            NOTES[name] = note
        if sql is not None:
            inner = sql
            repl = [f'round(cast("{c}" as double), {d}) as "{c}"' for c, d in rmap.items()]
            repl += [f'cast("{c}" as bigint) as "{c}"' for c in bigint]
            if repl:
                inner = f"select * replace ({', '.join(repl)}) from ({sql}) _q"
            all_ctes = view_ctes(views) + list(ctes)
            ORACLE[name] = ("with " + ",\n".join(f"{n} as ({t})" for n, t in all_ctes) + "\n" + inner
                            if all_ctes else inner)
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from gustframe.plans import q_frames, q_models, q_profile, q_scalars  # noqa: F401
