"""Deterministic range shards: contiguous key ranges of about equal row counts, found from exact counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins that one round of counting may bring to the driver.
MAX_BINS = 1 << 18


def _binned(starts: np.ndarray, ends: np.ndarray, bins: int):
    """A column function: the bin of a key in [starts[i], ends[i]) cut into bins equal parts each, or -1."""

    def of(keys: pd.Series) -> pd.Series:
        x = keys.to_numpy(dtype="float64", na_value=np.nan)
        i = np.clip(np.searchsorted(starts, x, side="right") - 1, 0, len(starts) - 1)
        inside = (x >= starts[i]) & (x < ends[i])
        part = np.clip(np.floor((x - starts[i]) / (ends[i] - starts[i]) * bins), 0, bins - 1)
        return pd.Series(np.where(inside, i * bins + part, -1)).fillna(-1).astype("int64")

    return F.pandas_udf(of, "long")


def range_bounds(df: DataFrame, key: str, rows: int, rounds: int = 6) -> list[int]:
    """Ascending lower bounds of all shards but the first, so that a shard has about `rows` rows.

    Depends only on the multiset of keys, not on how df is partitioned. Counts are taken over equal-width
    bins; a bin with more rows than a shard should have is cut again, so clustered keys and outliers don't
    end up together. Rows of one key always share a shard. Null keys belong to the first shard.
    """
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or lo == hi:
        return []
    spans = [(float(lo), float(hi) + 1)]
    pieces: list[tuple[float, int]] = []  # (start, rows) of bins that are small enough
    for turn in range(rounds):
        bins = max(2, min(MAX_BINS // len(spans), 16 * (n // rows + 1)))
        starts, ends = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
        counted = df.select(_binned(starts, ends, bins)(F.col(key)).alias("b")).where("b >= 0").groupBy("b").count().collect()
        wide = []
        for b, count in counted:
            i, part = divmod(b, bins)
            step = (ends[i] - starts[i]) / bins
            a = starts[i] + part * step
            if count > rows and step > 1 and turn < rounds - 1:
                wide.append((a, a + step))
            else:
                pieces.append((a, count))
        spans = sorted(wide)
        if not spans:
            break
    bounds, held = [], 0
    for a, count in sorted(pieces):
        if held and held + count > rows:
            bounds.append(int(np.ceil(a)))
            held = 0
        held += count
    return bounds


def shard_column(bounds: list[int], key: str):
    """The shard of a row, by binary search; 0 for a null key."""
    cuts = np.array(bounds, dtype="int64")

    def of(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = np.zeros(len(keys), dtype="int32")
        out[known.to_numpy()] = np.searchsorted(cuts, keys[known].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    return F.pandas_udf(of, "int")(F.col(key))
