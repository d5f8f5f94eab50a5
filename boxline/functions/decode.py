"""Greedy decoding of one probability matrix per row (array of steps, each an array)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxline.functions.binding import bind


def best_steps(matrix: Column) -> Column:
    """Per step struct(idx, prob): the first largest class and its value."""
    return F.transform(
        matrix,
        lambda p: F.struct(
            (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("idx"),
            F.array_max(p).cast("double").alias("prob"),
        ),
    )


def kept_steps(steps: Column, dictionary_size: int) -> Column:
    """Steps that give a character: no blank, no repeat of the step before, index in range."""
    return bind(steps, lambda line: F.filter(
        line,
        lambda s, i: (s["idx"] != 0)
        & (s["idx"] < dictionary_size)
        & ((i == 0) | (s["idx"] != F.get(line, i - 1)["idx"])),
    ))


def steps_text(kept: Column, dictionary: list[str]) -> Column:
    """Text of kept steps; the dictionary is a small literal list."""
    table = F.array(*[F.lit(c) for c in dictionary])
    return F.array_join(F.transform(kept, lambda s: F.get(table, s["idx"])), "")


def steps_confidence(kept: Column) -> Column:
    """Mean probability of kept steps, 0 when none is kept."""
    total = F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["prob"])
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0))
