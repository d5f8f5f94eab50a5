"""Hot groups: keys that hold so many rows that one task should not take them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.session import pin

# A group above this many rows is split. One million narrow rows sort in a few seconds per task.
HOT_ROWS = 1_000_000
# Rows that a group at the limit leaves in the sample searched for hot groups.
SEEN = 100
# Tables within both bounds may be broadcast; bytes are those of the rows as text.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys with about ``limit`` rows or more, with estimated counts; ``None`` when there are none.

    Counts come from a sample in which a group of ``limit`` rows leaves ``SEEN`` rows, and read the
    key columns only. The answer steers how rows are spread, never which rows a result holds:
    every path that takes hot keys gives the same result for any set of keys.
    """
    share = min(1.0, SEEN / limit)
    rows = df.select(*keys)
    if share < 1.0:
        rows = rows.sample(fraction=share, seed=11)
    # Half of the expected count is five deviations below it.
    least = limit if share == 1.0 else SEEN // 2
    counts = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_seen"))
        .where(F.col("_seen") > F.lit(least))
        .select(*keys, F.ceil(F.col("_seen") / share).alias("_rows"))
    )
    if counts.isEmpty():
        return None
    return pin(counts)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join in which null keys match, as they do in a grouping. Keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a frame whose counted rows and bytes are within the bounds."""
    size = df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")
    ).first()
    fits = size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df


def split_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys)."""
    side = small(hot.select(*keys))
    return null_safe_join(df, side, keys, "left_anti"), null_safe_join(df, side, keys, "left_semi")


def lookup_join(
    big: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    how: str = "inner",
    limit: int = HOT_ROWS,
    hot: DataFrame | None = None,
    detect: bool = True,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``big`` to a table with at most one row per key (``inner`` or ``left``).

    Rows of hot keys never meet in one task: their few partner rows are broadcast, and all
    other rows take the ordinary shuffled join. Pass ``hot`` to reuse keys already found, or
    ``detect=False`` when the keys are known to be unique in ``big``. With ``null_safe`` null keys match,
    as they do in a grouping. ``per_key`` is worked out once, also when both kinds of keys occur.
    """
    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        return null_safe_join(left, right, keys, how) if null_safe else left.join(right, keys, how)

    if hot is None and detect:
        hot = hot_keys(big, keys, limit)
    if hot is None:
        return join(big, per_key)
    per_key = pin(per_key)
    light, heavy = split_hot(big, hot, keys)
    wanted = null_safe_join(per_key, small(hot.select(*keys)), keys, "left_semi")
    # One row per hot key, but of any width.
    return join(light, per_key).unionByName(join(heavy, small(wanted)))
