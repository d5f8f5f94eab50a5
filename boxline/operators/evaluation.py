"""Detection evaluation: prediction-truth matches, average precision, text error rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxline.functions import geometry as G
from boxline.operators.hot import hot_keys, lookup_join, null_safe_join, split_hot
from boxline.operators.ordered import ranked
from boxline.operators.overlap import PAIR_ROWS, close_pairs
from boxline.session import Rounds

# IoU levels of the mean average precision.
IOU_LEVELS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
BUCKETS = 1_000


def match_truth(
    predictions: DataFrame, truths: DataFrame, min_iou: float = IOU_LEVELS[0],
    limit: int = PAIR_ROWS,
) -> DataFrame:
    """(image_id, class, det_id, truth_id, iou, confidence): the best truth of each prediction.

    Equal boxes are compared once: predictions of the same box share their best truth, and equal
    truths share the box; the lowest id stands for them.
    """
    keys = ["image_id", "class"]
    shapes = predictions.select(*keys, *G.BOX).distinct()
    marks = truths.groupBy(*keys, *[F.col(c).alias(f"q_{c}") for c in G.BOX]).agg(
        F.min("truth_id").alias("truth_id")
    )
    pairs = close_pairs(shapes, marks, keys, min_iou, limit)
    best = pairs.groupBy(*keys, *G.BOX).agg(
        F.max_by(F.struct("truth_id", "iou"), F.struct("iou", -F.col("truth_id"))).alias("m")
    )
    return lookup_join(predictions, best, [*keys, *G.BOX]).select(
        *keys, "det_id", F.col("m.truth_id").alias("truth_id"), F.col("m.iou").alias("iou"),
        "confidence",
    )


_Q = [f"q_{c}" for c in G.BOX]


def _assigned_groups(
    predictions: DataFrame, truths: DataFrame, keys: list[str], levels: list[float]
) -> DataFrame:
    """Assignment of groups of bounded size: one row per key with its close pairs, folded once per level.

    Most predictions overlap no truth closely, or a single one that nobody else wants, so pairs are joined and
    filtered before anything is gathered into arrays, and a key with one pair needs no fold.
    """
    boxes = truths.withColumnsRenamed(dict(zip(G.BOX, _Q)))
    pairs = null_safe_join(predictions, boxes, keys, "inner").withColumn("iou", G.iou())
    # The order of turns: by prediction, then by its wishes.
    turn = F.struct(
        (-F.col("confidence")).alias("neg"), "det_id", "confidence", (-F.col("iou")).alias("apart"), *_Q, "truth_id"
    )
    both = pairs.where(F.col("iou") >= min(levels)).groupBy(*keys).agg(F.collect_list(turn).alias("_w"))

    def taken(w: Column) -> Column:
        return F.struct(w["det_id"], w["truth_id"], (-w["apart"]).alias("iou"), w["confidence"])

    def fold(level: Column) -> Column:
        def step(done: Column, w: Column) -> Column:
            met = F.exists(done, lambda m: m["truth_id"].eqNullSafe(w["truth_id"]) | (
                m["det_id"].eqNullSafe(w["det_id"]) & m["confidence"].eqNullSafe(w["confidence"])
            ))
            return F.when((-w["apart"] >= level) & ~met, F.concat(done, F.array(taken(w)))).otherwise(done)

        none = F.filter(F.transform("_w", taken), lambda m: F.lit(False))
        single = F.filter(F.transform("_w", taken), lambda m: m["iou"] >= level)
        return F.when(F.size("_w") == 1, single).otherwise(F.aggregate(F.array_sort("_w"), none, step))

    per_level = F.transform(F.array(*[F.lit(v) for v in levels]), lambda level: F.struct(
        level.alias("level"), fold(level).alias("matches")
    ))
    return both.select(*keys, F.explode(per_level).alias("_l")).select(
        *keys, F.col("_l.level").alias("level"), F.explode("_l.matches").alias("m")
    ).select(*keys, "level", "m.*")


def _assigned_in_rounds(
    predictions: DataFrame, truths: DataFrame, keys: list[str], levels: list[float], limit: int
) -> DataFrame:
    """Assignment of crowded groups: all predictions propose to a truth, its losers go on to their next one.

    Truths of one box stand as one with as many places. A truth prefers the more confident prediction, so the
    rounds end in the same assignment as one prediction after another.
    """
    spark = predictions.sparkSession
    shapes = predictions.select(*keys, *G.BOX).distinct()
    boxes = truths.withColumnsRenamed(dict(zip(G.BOX, _Q)))
    marks = boxes.groupBy(*keys, *_Q).agg(F.count(F.lit(1)).alias("_places"))
    near = close_pairs(shapes, marks, keys, min(levels), limit)
    at = F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v <= F.col("iou")))
    met = null_safe_join(
        predictions.select(*keys, "det_id", "confidence", *G.BOX), near, [*keys, *G.BOX], "inner"
    ).drop(*G.BOX).withColumn("level", at)
    one = [*keys, "level", "det_id"]
    # A prediction overlaps few boxes beside the rows of its group.
    own = Window.partitionBy(*one)
    met = met.withColumns({
        "_turn": F.row_number().over(own.orderBy(F.col("iou").desc(), *_Q)), "_turns": F.count(F.lit(1)).over(own),
    })
    met = Rounds(spark, "wishes").write(met)
    rounds = Rounds(spark, "proposals")
    now = met.where("_turn = 1")
    while True:
        order = [F.col("confidence").desc(), F.col("det_id")]
        placed = rounds.write(ranked(now, [*keys, "level", *_Q], order, "_place"))
        onward = (F.col("_place") > F.col("_places")) & (F.col("_turn") < F.col("_turns"))
        if placed.where(onward).isEmpty():
            break
        turn = F.when(F.col("_place") > F.col("_places"), F.col("_turn") + 1).otherwise(F.col("_turn"))
        wanted = placed.select(*one, turn.alias("_turn"))
        now = null_safe_join(met, wanted, [*one, "_turn"], "left_semi")
    numbered = ranked(boxes, [*keys, *_Q], ["truth_id"], "_place").select(*keys, *_Q, "_place", "truth_id")
    won = placed.where(F.col("_place") <= F.col("_places"))
    return null_safe_join(won, numbered, [*keys, *_Q, "_place"], "inner").select(
        *keys, "level", "det_id", "truth_id", "iou", "confidence"
    )


def assign_truths(
    predictions: DataFrame, truths: DataFrame, levels: list[float] = IOU_LEVELS[:1],
    keys: list[str] = ["image_id", "class"], limit: int = PAIR_ROWS, hot: DataFrame | None = None,
) -> DataFrame:
    """(keys, level, det_id, truth_id, iou, confidence): predictions and truths matched one to one, at each IoU level.

    From the most confident prediction on (equal ones by det_id), each takes the free truth of its key with the
    highest IoU, at the level at least; of equal ones the first by box and truth_id. One whose best truth is taken
    goes on to the next best. Groups with more than about ``limit`` boxes on either side are matched in rounds.
    """
    sides = [predictions.select(*keys, "det_id", "confidence", *G.BOX), truths.select(*keys, "truth_id", *G.BOX)]
    crowded = hot
    if crowded is None:
        crowded = hot_keys(sides[0].select(*keys).unionByName(sides[1].select(*keys)), keys, limit)
    if crowded is None:
        return _assigned_groups(*sides, keys, levels)
    (light_p, heavy_p), (light_t, heavy_t) = (split_hot(side, crowded, keys) for side in sides)
    return _assigned_groups(light_p, light_t, keys, levels).unionByName(
        _assigned_in_rounds(heavy_p, heavy_t, keys, levels, limit)
    )


def assigned_positives(
    predictions: DataFrame, truths: DataFrame, levels: list[float] = IOU_LEVELS, limit: int = PAIR_ROWS
) -> DataFrame:
    """(class, level, bucket, tp): matched predictions per IoU level and confidence (three digits)."""
    return assign_truths(predictions, truths, levels, limit=limit).groupBy(
        "class", "level", _bucket("confidence").alias("bucket")
    ).agg(F.count(F.lit(1)).alias("tp"))


def true_positives(matches: DataFrame, levels: list[float] = IOU_LEVELS) -> DataFrame:
    """(class, level, bucket, tp): per truth and IoU level the most confident match counts."""
    order = F.struct("confidence", -F.col("det_id"))
    winners = matches.groupBy("image_id", "class", "truth_id").agg(*[
        F.max_by("confidence", F.when(F.col("iou") >= level, order)).alias(f"c{i}")
        for i, level in enumerate(levels)
    ])
    entries = F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(f"c{i}").alias("confidence"))
        for i, level in enumerate(levels)
    ])
    return (
        winners.select("class", F.explode(entries).alias("e"))
        .where(F.col("e.confidence").isNotNull())
        .groupBy("class", F.col("e.level").alias("level"), _bucket("e.confidence").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("tp"))
    )


def _bucket(confidence: str) -> Column:
    return F.round(F.col(confidence) * BUCKETS).cast("int")


def precision_curve(
    predictions: DataFrame, truths: DataFrame, levels: list[float] = IOU_LEVELS,
    limit: int = PAIR_ROWS,
) -> DataFrame:
    """Precision and recall per class, IoU level and confidence (three digits).

    Rows are counted into confidence buckets before any ordering, so the windows run over at most
    1001 rows per class and level.
    """
    counts = predictions.groupBy("class", _bucket("confidence").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = counts.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    tp = assigned_positives(predictions, truths, levels, limit)
    totals = truths.groupBy("class").agg(F.count(F.lit(1)).alias("n_truth"))
    down = (
        Window.partitionBy("class", "level").orderBy(F.col("bucket").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = grid.join(tp, ["class", "level", "bucket"], "left").join(totals, "class")
    found = F.sum(F.coalesce("tp", F.lit(0))).over(down)
    return rows.select(
        "class", "level", "bucket", "n_truth",
        found.alias("tp"), F.sum("n").over(down).alias("n"),
    ).withColumns({
        "precision": F.col("tp") / F.col("n"), "recall": F.col("tp") / F.col("n_truth"),
    })


def _f1() -> Column:
    precision, recall = F.col("precision"), F.col("recall")
    return 2 * precision * recall / (precision + recall + 1e-6)


def level_scores(curve: DataFrame) -> DataFrame:
    """Per class and IoU level: the area under the precision envelope, and the best F1 point."""
    by_level = Window.partitionBy("class", "level").orderBy(F.col("bucket").desc())
    lower = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    gained = F.col("recall") - F.coalesce(F.lag("recall").over(by_level), F.lit(0.0))
    return (
        curve.withColumns({"envelope": F.max("precision").over(lower), "gained": gained})
        .groupBy("class", "level")
        .agg(
            F.sum(F.col("envelope") * F.col("gained")).alias("ap"),
            F.max_by(F.struct("precision", "recall"), F.struct(_f1(), "bucket")).alias("best"),
        )
    )


def evaluate(
    predictions: DataFrame, truths: DataFrame, classes: DataFrame, limit: int = PAIR_ROWS
) -> DataFrame:
    """Per class and in total: AP50, AP50-95, and precision, recall and F1 at the best F1.

    ``classes`` lists the classes to report; one without predictions scores 0.
    """
    at_first = F.col("level") == IOU_LEVELS[0]
    scored = level_scores(precision_curve(predictions, truths, limit=limit)).groupBy("class").agg(
        F.max(F.when(at_first, F.col("ap"))).alias("ap50"),
        (F.sum("ap") / len(IOU_LEVELS)).alias("ap50_95"),
        F.max(F.when(at_first, F.col("best"))).alias("best"),
    ).select("class", "ap50", "ap50_95", "best.precision", "best.recall")
    values = ["ap50", "ap50_95", "precision", "recall"]
    scores = classes.select("class").join(scored, "class", "left").na.fill(0.0, values)
    both = scores.rollup("class").agg(*[F.avg(c).alias(c) for c in values])
    return both.withColumn("class", F.coalesce("class", F.lit("all"))).withColumn("f1", _f1())


def _edits(one: str, two: str) -> int:
    """Edit distance, a column of the table at a time: its steps up and down are the bits of two integers (Hyyrö)."""
    text, pattern = sorted((one, two), key=len)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(pattern)) - 1
    last = every ^ every >> 1
    up, down, distance = every, 0, len(pattern)
    for c in text:
        same = places.get(c, 0)
        kept = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up), up & across
        distance += bool(more & last) - bool(less & last)
        more = more << 1 | 1
        up, down = (less << 1 | ~(kept | more)) & every, more & kept & every
    return distance


def with_edits(pairs: DataFrame, output: str = "edits") -> DataFrame:
    """Adds the edit distance of ``predicted`` and ``truth``, as ``levenshtein`` does, with 64 cells or more a step."""
    @F.pandas_udf("int")
    def edits(predicted: pd.Series, truth: pd.Series) -> pd.Series:
        found = [None if p is None or t is None else _edits(p, t) for p, t in zip(predicted, truth)]
        return pd.Series(found, dtype="Int32")

    return pairs.withColumn(output, edits("predicted", "truth"))


def character_error_rate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Edit distance summed over (predicted, truth) texts, divided by the truth length.

    Equal pairs are compared once. The distance is quadratic in the text length, so the pairs are
    spread over all shuffle partitions first, however few bytes they are.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = pairs.groupBy(*keys, "predicted", "truth").agg(F.count(F.lit(1)).alias("_n"))
    return with_edits(distinct.repartition(parts), "_edits").groupBy(*keys).agg(
        F.sum(F.col("_edits") * F.col("_n")).alias("edits"),
        F.sum(F.length("truth") * F.col("_n")).alias("chars"),
    ).withColumn("cer", F.try_divide("edits", "chars"))
