"""Registry of checked queries: each name maps to a Spark plan over the driver tables
and, where SQL can express it, the equivalent DuckDB SQL used as the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import SNAP_DP, round_half_up

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = snap_rounding(sql)
        return fn

    return deco


def snap_rounding(sql: str) -> str:
    """Rewrite every ``round(x, n)`` (n < 6) of an oracle string into the engine-neutral
    half-up rounding of ``functions.numeric.round_half_up`` (snap to 6 dp, then floor(x·10^n + 0.5)).
    """
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 5, -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = sql[j + 6 : comma] if comma > 0 else None
        digits = sql[comma + 1 : k].strip() if comma > 0 else ""
        if inner is None or not digits.isdigit() or int(digits) >= SNAP_DP:
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        out.append(sql[i:j])
        n = int(digits)
        out.append(
            f"(floor(floor(({snap_rounding(inner)}) * 1e{SNAP_DP} + 0.5) / 1e{SNAP_DP} * 1e{n} + 0.5) / 1e{n})"
        )
        i = k + 1


def rnd(df: DataFrame, dp: int = 2, exclude: tuple[str, ...] = (), overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every DOUBLE column (presentation precision; keeps engine-order float noise out of checks)."""
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType) and f.name not in exclude:
            cols.append(round_half_up(F.col(f"`{f.name}`"), overrides.get(f.name, dp)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
