from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, *cols: str) -> None:
    """Raise ValueError naming the columns an operator needs but the input lacks."""
    have = set(df.columns)
    missing = [c for c in cols if c not in have]
    if missing:
        raise ValueError(f"missing input columns {missing}; have {sorted(have)}")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (``<=>``), keeping the left key columns — so only
    join types whose output keys come from the left side are accepted."""
    if not keys:
        raise ValueError("join_null_safe needs at least one key")
    how = "inner" if how is None else how
    if how.lower().replace("_", "") not in ("inner", "left", "leftouter", "leftanti", "leftsemi", "anti", "semi"):
        raise ValueError(f"join_null_safe keeps the left keys; unsupported join type {how!r}")
    r = right.select(*[right[c].alias(f"_r_{c}") if c in keys else right[c] for c in right.columns])
    cond = None
    for c in keys:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in keys])
