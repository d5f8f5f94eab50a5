"""Greedy decoding of probability steps held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.functions import decode as D
from boxline.operators.hot import HOT_ROWS, null_safe_join
from boxline.operators.ordered import OrderedGroups

# Characters joined into one string; longer lines are given in parts.
PART = 4_096


def decode_matrix(lines: DataFrame, matrix: str, dictionary: list[str]) -> DataFrame:
    """Adds ``text`` and ``confidence`` to lines that carry their matrix; no shuffle."""
    kept = D.kept_steps(D.best_steps(F.col(matrix)), len(dictionary))
    return lines.withColumn("_kept", kept).withColumns({
        "text": D.steps_text(F.col("_kept"), dictionary),
        "confidence": D.steps_confidence(F.col("_kept")),
    }).drop("_kept")


def best_class(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Best class of each step from rows (keys, class_idx, prob); lower ids win ties."""
    return steps.groupBy(*keys).agg(
        F.max_by(F.struct("class_idx", "prob"), F.struct("prob", -F.col("class_idx"))).alias("b")
    ).select(*keys, "b.class_idx", "b.prob")


def kept_characters(
    steps: DataFrame, dictionary: DataFrame, order: list[str], limit: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Characters of steps (line_id, class_idx, prob) that survive blanks and repeats, numbered.

    ``dictionary`` is (class_idx, char); an index beyond it gives no character but still counts
    as the step before.
    """
    groups = OrderedGroups(steps, ["line_id"], order, limit=limit, hot=hot)
    rows = groups.previous({"_last": F.col("class_idx")}).frame()
    kept = rows.where((F.col("class_idx") != 0) & ~F.col("class_idx").eqNullSafe(F.col("_last")))
    # A character dictionary is one small file: tens of thousands of rows at most.
    return kept.drop("_last").join(dictionary, "class_idx")


def decode_steps(
    steps: DataFrame, dictionary: DataFrame, order: list[str], limit: int = HOT_ROWS,
    hot: DataFrame | None = None, part: int = PART,
) -> DataFrame:
    """Text per line in parts of ``part`` characters, with the line's mean confidence."""
    kept = kept_characters(steps, dictionary, order, limit, hot)
    numbered = OrderedGroups(kept, ["line_id"], order, limit=limit, hot=hot).row_number("pos")
    pieces = numbered.frame().groupBy(
        "line_id", F.floor((F.col("pos") - 1) / part).cast("int").alias("part")
    ).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda s: s["char"]),
            "",
        ).alias("text"),
        F.sum("prob").alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
    )
    means = pieces.groupBy("line_id").agg((F.sum("_sum") / F.sum("_n")).alias("confidence"))
    # A line without characters keeps one empty part.
    lines = steps.select("line_id").distinct()
    return (
        null_safe_join(
            null_safe_join(lines, pieces.drop("_sum", "_n"), ["line_id"], "left"), means, ["line_id"],
            "left",
        ).select(
            "line_id",
            F.coalesce("part", F.lit(0)).alias("part"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        )
    )
