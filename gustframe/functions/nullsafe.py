"""Null-safe predicates.

pandas treats a comparison with a missing value as False, so the complement
of a mask keeps the row.  Spark's three-valued logic turns ``NOT NULL`` into
NULL and ``filter`` drops the row.  Every mask in the library goes through
``keep`` before it is negated or used to split a table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regime cut-offs on rotor speed.
LOW_MED_CUT = 8.6
HIGH_CUT = 15.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep(cond: Column) -> Column:
    """True where ``cond`` is true; NULL counts as False."""
    return F.coalesce(cond, F.lit(False))


def reject(cond: Column) -> Column:
    """Null-safe complement: True where ``cond`` is false *or* NULL."""
    return ~keep(cond)


def holds(cond: Column) -> Column:
    """Filter form of ``keep``: ``filter`` already drops NULL, and the bare
    predicate can be pushed into the Parquet scan (``coalesce`` cannot)."""
    return cond


def fails(cond: Column) -> Column:
    """Filter form of ``reject``: ``NOT cond OR cond IS NULL``; Catalyst turns
    ``NOT (x >= 15)`` into ``x < 15``, so the scan still gets the predicate."""
    return (~cond) | cond.isNull()


def any_of(*conds: Column) -> Column:
    """OR of null-safe conditions (never NULL)."""
    out = F.lit(False)
    for c in conds:
        out = out | keep(c)
    return out



def high_condition(speed="Rotor_speed", cut: float = HIGH_CUT, by_cube: bool = True) -> Column:
    """Raw (three-valued) high-regime predicate.

    ``by_cube`` compares ``speed**3 >= cut**3`` as the training scripts do;
    for real speeds it equals ``speed >= cut``.
    """
    s = col(speed)
    return (s * s * s >= F.lit(float(cut) ** 3)) if by_cube else (s >= F.lit(float(cut)))


def high_regime(speed="Rotor_speed", cut: float = HIGH_CUT, by_cube: bool = True) -> Column:
    """Boolean regime flag (never NULL); a NULL speed is in the *low* part."""
    return keep(high_condition(speed, cut, by_cube))


def regime2(speed="Rotor_speed", cut: float = HIGH_CUT, by_cube: bool = True) -> Column:
    """'high' / 'low' label; NULL speed -> 'low'."""
    return F.when(high_regime(speed, cut, by_cube), F.lit("high")).otherwise(F.lit("low"))


def regime3(speed="Rotor_speed", low: float = LOW_MED_CUT, high: float = HIGH_CUT) -> Column:
    """'low' (<low), 'med' ([low, high)), 'high' (>=high); NULL speed -> NULL."""
    s = col(speed)
    return (F.when(s < low, F.lit("low"))
            .when(s < high, F.lit("med"))
            .when(s >= high, F.lit("high")))
