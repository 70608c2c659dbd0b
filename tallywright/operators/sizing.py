"""Join per-key tables back to the rows they describe, whatever the key skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

SMALL_ROWS = 20_000
SMALL_BYTES = 32 << 20
HOT_KEYS = 1_000


def is_small(stored: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> bool:
    """Whether a stored table is provably small; only counts reach the driver, never its rows."""
    if stored.agg(F.count(F.lit(1))).first()[0] > max_rows:
        return False
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*stored.columns)))), F.lit(0))
    return stored.agg(size).first()[0] <= max_bytes


def join_key_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    weight: str,
    max_rows: int = SMALL_ROWS,
    hot_keys: int = HOT_KEYS,
    stored: bool = False,
) -> DataFrame:
    """Inner join of ``rows`` with ``stats``, which has one row per ``keys``.

    ``weight`` is the column of ``stats`` that says how many rows a key has.
    ``stats`` is stored first, unless ``stored`` says that it is. If it is small
    it is broadcast. Otherwise the keys heavier than ``total / hot_keys`` (there
    can be no more than ``hot_keys`` of them) are broadcast, if small as well,
    and only the remaining, light keys are shuffled, so no task ever receives a
    hot key. Where not even the heavy keys are small, the optimizer's skew join
    handles them.
    """
    keys = list(keys)
    if not stored:
        stats = written(stats, "key-stats")
    if is_small(stats, max_rows):
        return rows.join(F.broadcast(stats), keys)
    total = stats.agg(F.sum(weight)).first()[0]
    cut = (total or 0) // hot_keys
    hot = stats.where(F.col(weight) > cut)
    cold = stats.where(F.col(weight) <= cut)
    if not is_small(hot, max(max_rows, hot_keys)):
        return rows.join(stats, keys)
    from_hot = rows.join(F.broadcast(hot), keys)
    light = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return from_hot.unionByName(light.join(cold, keys))
