"""Batches of lines: layout offsets, size limits and greedy packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxline.operators.hot import hot_keys, null_safe_join, split_hot
from boxline.operators.ordered import OrderedGroups, slice_rows, with_group_totals
from boxline.session import pin

# Fixed values of the line packer.
GAP = 20
PACK_LINES = 20
TARGET_HEIGHT = 48
MAX_PACK_WIDTH = 8192
BATCH_SIZE = 32
BATCH_PADDING = 5
# Lines per array, and slices per array when the slices of a long image are chained.
SLICE = 4_000
FAN = 1_000


def micro_batches(
    items: DataFrame, keys: list[str], order: list, size: int = BATCH_SIZE, **options
) -> DataFrame:
    """Numbers items 1.. in ``pos`` and batches of at most ``size`` 0.. in ``batch``."""
    groups = OrderedGroups(items, keys, order, **options).row_number("pos")
    return groups.with_columns(
        {"batch": F.floor((F.col("pos") - 1) / size).cast("long")}
    ).frame()


def batch_layout(
    batched: DataFrame, keys: list[str], width: str = "width", padding: int = BATCH_PADDING
) -> DataFrame:
    """Left offset of each item in its batch row, and the batch width; needs ``micro_batches``."""
    batch = Window.partitionBy(*keys, "batch")
    before = batch.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return batched.withColumns({
        "batch_x": F.coalesce(F.sum(F.col(width) + padding).over(before), F.lit(0)),
        "batch_width": F.sum(width).over(batch) + padding * (F.count(F.lit(1)).over(batch) - 1),
    })


def pack_limit(
    mean_width: Column, max_width: Column, mean_height: Column, strategy: str = "adaptive",
    default: int = 1280,
) -> Column:
    """Width limit of a pack from the line widths and character heights of one image."""
    def whole(value: Column) -> Column:
        return value.cast("int")

    if strategy == "conservative":
        wanted = whole(mean_width * 2.5)
    elif strategy == "balanced":
        wanted = whole(mean_width * 3 + (max_width - mean_width) * 0.5)
    elif strategy == "aggressive":
        wanted = whole(max_width * 6)
    elif strategy == "adaptive":
        density = mean_width / (mean_height * 20)
        base = (
            F.when(density < 1, whole(mean_width * 8))
            .when(density < 2, whole(mean_width * 5))
            .otherwise(whole(mean_width * 3))
        )
        wanted = (
            F.when(mean_height < 20, whole(base * 1.5))
            .when(mean_height > 60, whole(base * 0.8))
            .otherwise(base)
        )
    else:
        wanted = F.lit(default)
    return F.greatest(whole(max_width + 100), F.least(wanted, F.lit(MAX_PACK_WIDTH)))


def pack_limits(
    lines: DataFrame, keys: list[str] = ["image_id"], strategy: str = "adaptive"
) -> DataFrame:
    """Pack limit per image of lines (effective_width, char_height)."""
    return lines.groupBy(*keys).agg(
        F.avg("effective_width").alias("mean_width"),
        F.max("effective_width").alias("max_width"),
        F.avg("char_height").alias("mean_height"),
    ).select(
        *keys,
        pack_limit(
            F.col("mean_width"), F.col("max_width"), F.col("mean_height"), strategy
        ).alias("pack_limit"),
    )


def _grow(state: Column, line: Column, limit: Column) -> tuple[Column, Column]:
    """(width of the open pack with the line in it, whether the line may join)."""
    wide = state["w"] + line["w"] + F.when(state["n"] > 0, GAP).otherwise(0)
    # |h - mean height| < mean height, without a division
    similar = F.abs(line["h"] * state["n"] - state["sh"]) < state["sh"]
    fits = (state["n"] == 0) | ((wide <= limit) & (state["n"] < PACK_LINES) & similar)
    return wide, fits


def _reaches(lines: Column, own: Column, limit: Column) -> Column:
    """For each own line: how many lines a pack holds that starts there."""
    def grow(state: Column, line: Column) -> Column:
        wide, fits = _grow(state, line, limit)
        longer = F.struct(
            wide.alias("w"), (state["n"] + 1).alias("n"), (state["sh"] + line["h"]).alias("sh"),
            F.lit(True).alias("open"),
        )
        closed = F.struct(
            state["w"].alias("w"), state["n"].alias("n"), state["sh"].alias("sh"),
            F.lit(False).alias("open"),
        )
        return F.when(state["open"] & fits, longer).otherwise(closed)

    start = F.struct(
        F.lit(0).cast("long").alias("w"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sh"),
        F.lit(True).alias("open"),
    )
    return F.transform(
        F.sequence(F.lit(1), own),
        lambda i: F.aggregate(F.slice(lines, i, PACK_LINES), start, grow, lambda s: s["n"]),
    )


def _walk(reaches: Column, entry: Column) -> Column:
    """Follows packs through one slice from its line ``entry``: struct(exit, packs)."""
    def step(state: Column, reach: Column) -> Column:
        here = state["at"] == state["next"]
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(here, state["at"] + reach).otherwise(state["next"]).alias("next"),
            (state["packs"] + here.cast("long")).alias("packs"),
        )

    start = F.struct(
        F.lit(0).alias("at"), entry.alias("next"), F.lit(0).cast("long").alias("packs")
    )
    return F.aggregate(
        reaches, start, step,
        lambda s: F.struct((s["next"] - s["at"]).alias("exit"), s["packs"].alias("packs")),
    )


def _all_entries(walk) -> Column:
    """Array over the entries 0..PACK_LINES-1 of ``walk(entry)``."""
    return F.transform(F.sequence(F.lit(0), F.lit(PACK_LINES - 1)), walk)


def _chain(moves: Column, entry: Column) -> Column:
    """Follows consecutive slices (each an array of struct(exit, packs) by entry)."""
    start = F.struct(entry.alias("exit"), F.lit(0).cast("long").alias("packs"))

    def step(state: Column, move: Column) -> Column:
        taken = F.get(move, state["exit"])
        return F.struct(
            taken["exit"].alias("exit"), (state["packs"] + taken["packs"]).alias("packs")
        )

    return F.aggregate(moves, start, step)


def _entries(slices: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, slice, entry, base): where the first pack of each slice starts, and packs before.

    ``slices`` holds ``moves``, the exits of a slice for each possible entry. Runs of ``FAN``
    slices are folded into one until few are left, then unfolded again.
    """
    group = keys if levels == 0 else [*keys, "_upper"]
    numbered = slices.withColumn("_upper", F.floor(F.col("_slice") / FAN).cast("int"))
    folded = numbered.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("_slice", "moves"))).alias("_members")
    )
    if levels == 0:
        opened = folded.withColumns(
            {"entry": F.lit(0), "base": F.lit(0).cast("long")}
        )
    else:
        combined = folded.withColumn(
            "moves",
            _all_entries(lambda e: _chain(F.transform("_members", lambda m: m["moves"]), e)),
        )
        upper = _entries(
            combined.select(*keys, F.col("_upper").alias("_slice"), "moves"), keys, levels - 1
        ).withColumnRenamed("_slice", "_upper")
        opened = null_safe_join(folded, upper, group, "inner")

    def step(state: Column, member: Column) -> Column:
        last = F.element_at(state, -1)
        taken = F.get(member["moves"], last["entry"])
        return F.concat(state, F.array(F.struct(
            taken["exit"].alias("entry"), (last["base"] + taken["packs"]).alias("base")
        )))

    first = F.array(F.struct(F.col("entry").alias("entry"), F.col("base").alias("base")))
    trail = F.aggregate("_members", first, step)
    return opened.withColumn("_trail", trail).select(
        *keys, F.posexplode("_members").alias("_i", "_m"), "_trail"
    ).select(
        *keys,
        F.col("_m._slice").alias("_slice"),
        F.get("_trail", F.col("_i"))["entry"].alias("entry"),
        F.get("_trail", F.col("_i"))["base"].alias("base"),
    )


def _item() -> Column:
    return F.struct(
        "line_no", F.col("scaled_width").cast("long").alias("w"),
        F.col("char_height").cast("long").alias("h"),
    )


def _numbered(packs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per line of the arrays ``_lines`` and ``_packs``.

    No array is empty; the outer form keeps Spark from packing once more to test for that.
    """
    return packs.select(
        *keys, "pack_limit", F.posexplode_outer("_packs").alias("_i", "pack"), "_lines"
    ).select(
        *keys,
        F.get("_lines", F.col("_i"))["line_no"].alias("line_no"),
        F.get("_lines", F.col("_i"))["w"].alias("scaled_width"),
        F.get("_lines", F.col("_i"))["h"].alias("char_height"),
        "pack", "pack_limit",
    )


def _pack_whole(lines: DataFrame, keys: list[str], strategy: str) -> DataFrame:
    """Packs of images whose lines fit one array: one shuffle, no join."""
    limit = pack_limit(F.col("_mw"), F.col("_xw"), F.col("_mh"), strategy)
    arrays = lines.groupBy(*keys).agg(
        F.array_sort(F.collect_list(_item())).alias("_lines"),
        F.avg("effective_width").alias("_mw"),
        F.max("effective_width").alias("_xw"),
        F.avg("char_height").alias("_mh"),
    ).withColumn("pack_limit", limit)

    def step(state: Column, line: Column) -> Column:
        wide, fits = _grow(state, line, F.col("pack_limit"))
        pack = F.when(fits, state["pack"]).otherwise(state["pack"] + 1)
        return F.struct(
            F.when(fits, wide).otherwise(line["w"]).alias("w"),
            F.when(fits, state["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.when(fits, state["sh"] + line["h"]).otherwise(line["h"]).alias("sh"),
            pack.alias("pack"),
            F.concat(state["out"], F.array(pack)).alias("out"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(
        zero.alias("w"), F.lit(0).alias("n"), zero.alias("sh"), zero.alias("pack"),
        F.array().cast("array<bigint>").alias("out"),
    )
    packs = F.aggregate("_lines", start, step, lambda s: s["out"])
    return _numbered(arrays.withColumn("_packs", packs), keys)


def _pack_sliced(lines: DataFrame, keys: list[str], strategy: str, size: int) -> DataFrame:
    """Packs of long images, cut into slices.

    How far a pack reaches depends on the next 20 lines only, so each slice is followed for every
    possible entry and the slices are chained.
    """
    sliced = slice_rows(lines, "line_no", size, after=PACK_LINES - 1)
    sliced = with_group_totals(sliced, keys, {
        "_mw": F.avg(F.when(F.col("_own"), F.col("effective_width"))),
        "_xw": F.max("effective_width"),
        "_mh": F.avg(F.when(F.col("_own"), F.col("char_height"))),
    })
    limit = pack_limit(F.col("_mw"), F.col("_xw"), F.col("_mh"), strategy)
    arrays = sliced.groupBy(*keys, "_slice").agg(
        F.array_sort(F.collect_list(_item())).alias("_lines"),
        F.count_if(F.col("_own")).alias("_n"),
        F.first(limit).alias("pack_limit"),
    ).withColumn("_reach", _reaches(F.col("_lines"), F.col("_n"), F.col("pack_limit")))
    arrays = pin(arrays)
    moves = arrays.select(
        *keys, "_slice", _all_entries(lambda e: _walk(F.col("_reach"), e)).alias("moves")
    )
    entered = null_safe_join(arrays, _entries(moves, keys, levels=2), [*keys, "_slice"], "inner")

    def step(state: Column, reach: Column) -> Column:
        here = state["at"] == state["next"]
        pack = state["pack"] + here.cast("long")
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(here, state["at"] + reach).otherwise(state["next"]).alias("next"),
            pack.alias("pack"),
            F.concat(state["out"], F.array(pack)).alias("out"),
        )

    start = F.struct(
        F.lit(0).alias("at"), F.col("entry").alias("next"), (F.col("base") - 1).alias("pack"),
        F.array().cast("array<bigint>").alias("out"),
    )
    packs = F.aggregate("_reach", start, step, lambda s: s["out"])
    return _numbered(entered.withColumn("_packs", packs), keys)


def pack_lines(
    lines: DataFrame, keys: list[str] = ["image_id"], strategy: str = "adaptive",
    size: int = SLICE, hot: DataFrame | None = None, detect: bool = True,
) -> DataFrame:
    """Greedy packs of consecutive lines: adds ``pack`` (0..) and the limit used.

    ``lines`` carries ``line_no`` (dense, 0-based), ``effective_width``, ``char_height`` and
    ``scaled_width``. A line joins the open pack when the widths plus gaps stay within the limit,
    the pack has fewer than 20 lines and its height is near the mean of the pack. Images with
    more than ``size`` lines are packed in slices, with the same result.
    """
    if size < PACK_LINES:
        raise ValueError("a slice must hold at least one full pack")
    if hot is None and detect:
        hot = hot_keys(lines, keys, size)
    if hot is None:
        return _pack_whole(lines, keys, strategy)
    light, heavy = split_hot(lines, hot, keys)
    return _pack_whole(light, keys, strategy).unionByName(
        _pack_sliced(heavy, keys, strategy, size)
    )


def pack_efficiency(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Lines, recognition calls, lines per call and calls saved."""
    packs = packed.groupBy(*keys, "pack").agg(F.count(F.lit(1)).alias("n"))
    return packs.groupBy(*keys).agg(
        F.sum("n").alias("lines"), F.count(F.lit(1)).alias("calls")
    ).withColumns({
        "efficiency": F.col("lines") / F.col("calls"),
        "calls_saved": F.col("lines") - F.col("calls"),
    })


def best_strategy(sweep: DataFrame) -> DataFrame:
    """Strategy summary of (strategy, lines, calls) runs, best mean efficiency flagged wherever it
    occurs.

    Runs that have a ``time_ms`` too get its mean.
    """
    timed = [F.avg("time_ms").alias("avg_time_ms")] if "time_ms" in sweep.columns else []
    per = sweep.groupBy("strategy").agg(
        F.avg(F.try_divide("lines", "calls")).alias("avg_efficiency"), *timed,
        F.sum("calls").alias("total_calls"),
        F.sum("lines").alias("total_lines"),
    )
    # One row per strategy, so one window holds them all.
    best = F.max("avg_efficiency").over(Window.partitionBy())
    return per.withColumn("is_best", F.col("avg_efficiency") == best)
