"""Registration helpers."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixtures as fx
from ..functions import quick_round
from ..session import share_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, *sources: str, many: bool = False):
    """Register a query under ``name`` with its SQL over the named common table expressions.

    ``many``: the result is far larger than the input, so that its doubles are rounded the short way.
    """

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            share_package(spark)
            return rounded(fn(spark, sf_dir), quick_round if many else F.round)

        run.__name__ = name
        QUERIES[name] = run
        if select is not None:
            ORACLES[name] = fx.sql(select, *sources)
        return fn

    return keep


def rounded(df: DataFrame, how: Callable[[str, int], Column] = F.round) -> DataFrame:
    """Doubles to six places, as both engines add numbers in their own order."""
    out = [how(c.name, 6).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(f"`{c.name}`")
           for c in df.schema]
    return df.select(*out)


def r6(*exprs: str) -> str:
    """``round(x, 6) AS name`` for each ``x`` or ``expression AS name``."""
    parts = []
    for e in exprs:
        value, _, name = e.rpartition(" AS ")
        parts.append(f"round({value or name}, 6) AS {name}")
    return ", ".join(parts)


E_COLS = [*fx.E_PARAMS, *(f"{p}_origine" for p in fx.E_PARAMS)]
L_COLS = [*fx.L_PARAMS, *(f"{p}_origine" for p in fx.L_PARAMS)]
E_WIDE = "station_id, day, " + r6(*E_COLS)
L_WIDE = "station_id, day, " + r6(*L_COLS)
E_FLAGS = ", ".join(f"{p}_anomaly" for p in fx.E_PARAMS)
E_LABEL = E_WIDE + ", " + r6(*(f"{p}_difference" for p in fx.E_PARAMS)) + f", {E_FLAGS}, anomaly"
LONG = "station_id, param, day, round(value, 6) AS value, round(raw_value, 6) AS raw_value, status, mode, row_id"


def solve_sql(name: str, equations: str, unknowns: int) -> str:
    """Common table expressions that solve systems of linear equations; ``{name}`` has one row per system: k and its solution ``w``.

    ``equations`` is a relation (k, i, r): the coefficients of equation ``i`` of
    system ``k`` and its right side as a list. Elimination without exchange of rows, as normal equations allow it.
    """
    steps = [f"{name}_0 AS MATERIALIZED ({equations})"]
    for p in range(1, unknowns + 1):
        steps.append(f"""{name}_{p} AS MATERIALIZED (SELECT t.k, t.i, CASE WHEN t.i = {p} THEN list_transform(t.r, lambda e: e / q.r[{p}])
            ELSE list_transform(range(1, {unknowns + 2}), lambda j: t.r[j] - t.r[{p}] * q.r[j] / q.r[{p}]) END AS r
            FROM {name}_{p - 1} t JOIN {name}_{p - 1} q ON q.k = t.k AND q.i = {p})""")
    steps.append(f"{name} AS MATERIALIZED (SELECT k, list(r[{unknowns + 1}] ORDER BY i) AS w FROM {name}_{unknowns} GROUP BY k)")
    return ", ".join(steps)
