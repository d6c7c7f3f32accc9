"""Join conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def null_safe_condition(left: DataFrame, right: DataFrame, keys: Sequence[str], right_keys: Sequence[str] | None = None):
    right_keys = list(right_keys or keys)
    cond = None
    for lk, rk in zip(keys, right_keys):
        c = left[lk].eqNullSafe(right[rk])
        cond = c if cond is None else cond & c
    return cond
